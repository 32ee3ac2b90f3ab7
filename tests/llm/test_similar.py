"""The pipeline's near-duplicate stage against brute-force similarity."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from sigspark.llm import similar, simhash
from sigspark.llm.common import table


def slow_sets(texts):
    """Sets of 5-word shingles, all words where there are fewer; and the pairs of a similarity of 0.8 or more."""
    own = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ")
        w = [x for y in w for x in y.split("\n") if x]
        own.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    seen = defaultdict(list)
    for i, s in enumerate(own):
        for g in s:
            seen[g].append(i)
    shared = defaultdict(int)
    for at in seen.values():
        for k, j in enumerate(at):
            for i in at[:k]:
                shared[i, j] += 1
    return [(i, j) for (i, j), n in shared.items() if Fraction(n, len(own[i]) + len(own[j]) - n) >= Fraction(4, 5)]


def slow_components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_roots(texts):
    """For each text the first one that it reaches over pairs of a similarity of 0.8 or more; texts without words are equal."""
    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    return slow_components(len(texts), [*slow_sets(texts), *zip(empty, empty[1:], strict=False)])


def test_stage_keeps_one_of_every_similar_pair(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").where("text rlike '\\\\S'")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    root = slow_components(len(rows), slow_sets([r.text for r in rows]))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, d).collect()}
    alone = {r.doc_id for i, r in enumerate(rows) if root[i] == i}
    gone = {r.doc_id for r in rows} - alone
    assert kept >= alone and len(gone - kept) >= 0.98 * len(gone) > 0
    assert 2 in kept and 56 not in kept  # similarity 0.967, five bits of 64 apart


@pytest.mark.parametrize("bucket", [4096, 8])
def test_similar_groups(spark, bucket):
    """A group of near copies, pairs close to the bound, a line in most texts, short texts: no link is wrong, few are missed, also in tiles."""
    rng = np.random.default_rng(5)
    line = " ".join(f"line{i}" for i in range(12))
    texts = []
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(1, 90)))]
        for _ in range(int(rng.integers(1, 30 if k < 2 else 6))):
            own = [f"e{rng.integers(9999)}" if rng.random() < 0.02 else w for w in base]
            texts.append(" ".join(own) + (" " + line if rng.random() < 0.6 else ""))
    texts += ["a b", "A  b", "a b c", "a b c d e", "a b c d e f", None, "", " \n "]
    root = slow_components(len(texts), [*slow_sets(texts), *((len(texts) - 3, len(texts) - k) for k in (2, 1))])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(df, bucket=bucket).collect()}
    assert all(root[i] == root[c] for i, c in got.items()) and all(got[i] == got[len(texts) - 3] for i in range(len(texts) - 3, len(texts)))
    linked = [i for i in range(len(texts)) if root[i] != i]
    assert sum(got[i] != i for i in linked) >= 0.95 * len(linked) > 20


def test_pairs_in_buckets_stay_linear(spark):
    """Three hundred near copies: a forest a band, not all pairs, and one component."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if (j + 7 * i) % 120 else f"x{i}" for j, w in enumerate(base)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in similar.near_duplicates(df).collect()} == {0}
    words = np.array([similar.sketch(similar.shingles(t))[0] for t in texts], np.uint64)
    i, j = simhash.forest(words, np.zeros(len(texts), np.int64), *map(similar.radius_of, (0.9, 0.8)))
    assert len(i) == len(texts) - 1 and (np.bitwise_count(words[i] ^ words[j]).sum(1) <= similar.radius_of(0.8)).all()


def test_documents_with_letters_stay_where_no_language_is_known(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "été", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {1, 4}
