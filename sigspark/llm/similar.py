"""SimHash near-duplicates by similarity: fingerprints of 256 bits, buckets of MinHash bands, bit-sliced comparison.

Sets of shingles with a Jaccard similarity of 0.8 differ in about 15 % of a SimHash's bits: too many for blocks of bits to
bring them together among many documents, and with 64 bits too uncertain to tell them from a similarity of 0.65. So
fingerprints are of four words here, and buckets are bands of MinHash values, which sets of that similarity share with
a probability of 0.998. Within a bucket the comparison is operator 10's, bit-sliced with carry-save
counters; it gives a spanning forest, the closest pairs first, never all pairs, and a bucket stops once it is connected. The
forest's pairs are then verified on their whole sets. Equal sets are merged before anything is compared.

Every link is exact. A pair of the bound's similarity can be missed where it shares no band, is beyond the radius, or lost its
place in the forest to a pair that was refuted: the tests and README give the measured recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import cut, map_batches, map_stream, small_batches, written
from sigspark.llm.simhash import _LOWER, BUCKET, components, forest, majority, named_components, spread, tiled, whole_buckets

#: Least similarity, and words a shingle.
SIMILARITY, SHINGLE = 0.8, 5
#: Words of a fingerprint; bands, and MinHash values that a band is made of.
WORDS, BANDS, ROWS = 4, 12, 4
#: Similarities up to which pairs are taken one after the other, beside the bound itself.
CLOSER = (0.95, 0.9, 0.85)
#: Hashes that are spread out at a time.
PART = 4096
#: Odd multipliers, one for each MinHash value, by a fixed rule.
_ODD = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's shingles; of all its words, where they are fewer than one has."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    n, joined, digest = len(words), b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(begins[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1).view(np.int64))


def radius_of(similarity: float, words: int = WORDS) -> int:
    """Bits in which fingerprints may differ: the expected number at that similarity, and two standard deviations of it."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * words * p + 2 * math.sqrt(64 * words * p * (1 - p)))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A hash's bits stirred (the finaliser of a published 64-bit mixer)."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def sketch(own: np.ndarray) -> tuple[list[int], list[int]]:
    """(words of the fingerprint, keys of the bands) of a set of hashes, as signed 64-bit numbers; an empty set has no bands."""
    h = own.view(np.uint64)
    words = [majority(h if k == 0 else _mixed(h + np.uint64(k))) for k in range(WORDS)]
    if not len(h):
        return words, []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(h), PART):
        least = np.minimum(least, (h[i : i + PART, None] * _ODD).min(0))
    keys = [xxhash.xxh64_intdigest(least[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)]
    return words, np.array(keys, np.uint64).view(np.int64).tolist()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, hashes) are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b["x"], b["y"], strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            same = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(same >= similarity * (len(u) + len(v) - same) - 1e-9)
        return b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, keep: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """Per row of df: key, the columns `keep`, `fingerprint` (64 hex digits, of the set of shingles) and `component_id`, the smallest key that is reached over links of at least that similarity.

    Words are those of simhash.fingerprint; texts without words, null ones among them, equal each other. Null
    keys count in no minimum; a component of such rows alone gets null. Repeated rows are kept. An empty df gives an
    empty result. The names _text, node, bands and w0 to w3 are this operator's own.
    """
    small_batches(df.sparkSession)
    narrow = df.select(key, *keep, F.xxhash64(text).alias("_text"), text)
    words = [f"w{k}" for k in range(WORDS)]
    fields = T._parse_datatype_string(f"node long, {', '.join(f'{w} long' for w in words)}, bands array<long>").fields
    schema = T.StructType([*narrow.select(key, *keep, "_text").schema.fields, *fields])

    def prints(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t, shingle) for t in b[text].to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], np.uint64).view(np.int64)
        made = [sketch(s) for s in own]
        cols = np.array([w for w, _ in made], np.uint64).reshape(-1, WORDS).view(np.int64)
        return pa.RecordBatch.from_arrays([b[key], *(b[c] for c in keep), b["_text"], pa.array(node), *(pa.array(np.ascontiguousarray(cols[:, k])) for k in range(WORDS)), pa.array([x for _, x in made], pa.list_(pa.int64()))], schema.names)

    made = written(map_batches(narrow, prints, schema), "prints")
    sets = made.select("node", *words, "bands").dropDuplicates(["node"])
    rows = tiled(written(sets.select("node", *words, F.explode(F.transform("bands", lambda x: x.cast("string"))).alias("key")), "bands"), "key", "node", bucket)
    radii = [radius_of(x) for x in (*(x for x in CLOSER if x > similarity), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, node, *fps in whole_buckets(batches, ["h", "node", *words]):
            i, j = forest(np.stack(fps, 1).view(np.uint64), h, *radii)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])

    hashed = rows.select(F.xxhash64("key").alias("h"), "node", *words)
    pairs = cut(map_stream(hashed.repartition("h").sortWithinPartitions("h"), run, "a long, b long").distinct())
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    whole = T._parse_datatype_string("node long, hashes binary")

    def sets_of(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [shingles(t, shingle) for t in b[text].to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in own], pa.binary())], whole.names)

    # one text of each set: the least hash of those that have it
    texts = made.join(ends, "node", "left_semi").groupBy("node").agg(F.min("_text").alias("_text")).select("_text")
    one = df.select(F.xxhash64(text).alias("_text"), text).join(texts, "_text", "left_semi").groupBy("_text").agg(F.first(text).alias(text))
    roots = components(_verified(pairs, written(map_batches(one.select(text), sets_of, whole), "sets"), similarity))
    nodes = made.groupBy("node").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"))
    table = named_components(nodes, roots, "node")
    digits = F.concat(*(F.lpad(F.lower(F.hex(w)), 16, "0") for w in words))
    return spread(made.drop("bands", "_text"), table, "node").select(key, *keep, digits.alias("fingerprint"), "component_id")
