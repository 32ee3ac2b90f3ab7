"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item gives windows of `window` consecutive words, or one of all its words if it has fewer. A
window's shingles are ordered by rarity over all documents. As every shingle of a window must be found
(containment 1), its necessary prefix is the rarest shingle alone: only where a document has that one is
the window considered. The shingle's place in the window and in the document fix the alignment, so the
positional bound (the window begins at or after the document's first word) and the length bound (it ends
at or before the last) come before the words are compared.

The benchmark is cut into blocks of a measured size; the driver holds one block at a time, whose index goes to
every task as arrays of word numbers. With one block no document is shuffled. With more, each block's pass gives
only the hits, keyed by the text's digest, and one join brings them together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import cut, map_batches, map_stream, small_batches, written

#: Characters of items and their ids in a block; its index then takes about 25 MB for each million characters.
BLOCK_CHARS = 4_000_000
#: Characters of documents, and candidates, that are looked at together.
CHUNK_CHARS, PAIRS = 1_000_000, 1_000_000
#: Bits of a word's number in a shingle's key of 63 bits: at most three words.
WORD_BITS = 21
#: Bytes that end words: all of ASCII but digits and letters. A-Z are lowered.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _keys(ids: np.ndarray, size: int) -> np.ndarray:
    """The key of the shingle of `size` words at every place of the last axis but the last size - 1; ids beyond a shingle's size count as 0."""
    n = ids.shape[-1] - size + 1
    out = np.zeros((*ids.shape[:-1], max(n, 0)), np.int64)
    for j in range(size):
        out |= ids[..., j : j + n] << np.int64(WORD_BITS * (63 // WORD_BITS - 1 - j))
    return out


class Index:
    """Windows of a block's texts by their rarest shingle, in arrays. texts: distinct, each with the ids of its items."""

    def __init__(self, texts: list[tuple[str, list[str]]], window: int = 13, shingle: int = 3):
        if not 1 <= shingle <= 63 // WORD_BITS:
            raise ValueError("shingles have one to three words")
        lists = [words_of(t) for t, _ in texts]
        self.items = [ids for _, ids in texts]
        self.number = {w: i + 1 for i, w in enumerate(sorted(set(chain.from_iterable(lists))))}
        if len(self.number) >= 1 << WORD_BITS:
            raise ValueError("too many distinct words in a block")
        self.flat = np.fromiter((self.number[w] for ws in lists for w in ws), np.int32, sum(map(len, lists)))
        begins = np.cumsum([0, *map(len, lists)])
        starts, lengths, owners, first = [], [], [], 0
        self.sizes: list[int] = sorted({min(shingle, window, len(ws)) for ws in lists if ws})
        known: dict[int, list[np.ndarray]] = {z: [] for z in self.sizes}
        for n in sorted({min(window, len(ws)) for ws in lists if ws}):
            own = [k for k, ws in enumerate(lists) if ws and min(window, len(ws)) == n]
            at = np.concatenate([np.arange(begins[k], begins[k + 1] - n + 1) for k in own])
            text = np.concatenate([np.full(len(lists[k]) - n + 1, k) for k in own])
            rows = np.ascontiguousarray(self.flat[at[:, None] + np.arange(n)])
            _, least, of = np.unique(rows.view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
            starts.append(at[least])
            lengths.append(np.full(len(least), n))
            owners.append(np.unique(np.stack([first + of.ravel(), text], 1), axis=0))
            first += len(least)
            known[min(shingle, n)].append(_keys(rows[least].astype(np.int64), min(shingle, n)).ravel())
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.start, self.length = join(starts).astype(np.int64), join(lengths).astype(np.int64)
        pairs = np.concatenate(owners) if owners else np.zeros((0, 2), np.int64)
        self.owner, self.owned = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        self.shingle = shingle
        #: the distinct keys of all shingles, by size, whose occurrences are to be counted.
        self.known = {z: np.unique(join(k)) for z, k in known.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def choose(self, counts: dict[int, np.ndarray]) -> Index:
        """Fixes each window's prefix, the shingle with the fewest occurrences (of equal ones the first in word order). counts: for each of known."""
        found: dict[int, list] = {z: [] for z in self.sizes}
        for n in np.unique(self.length).tolist():
            z, w = min(self.shingle, n), np.flatnonzero(self.length == n)
            keys = _keys(self.flat[self.start[w][:, None] + np.arange(n)].astype(np.int64), z)
            often = counts[z][np.searchsorted(self.known[z], keys)]
            offset = np.where(often == often.min(1, keepdims=True), keys, np.iinfo(np.int64).max).argmin(1)
            found[z].append((keys[np.arange(len(w)), offset], w, offset))
        for z, parts in found.items():
            key, w, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            self.prefix[z] = key[order], w[order], offset[order]
        return self

    def _chunks(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word numbers, 0 for unknown ones; the text of each; words of each text), for some texts at a time."""
        lists: list[list[bytes]] = []
        chars = 0

        def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = np.array([len(ws) for ws in lists], np.int64)
            ids = np.fromiter(map(self.number.get, chain.from_iterable(lists), repeat(0)), np.int64, int(sizes.sum()))
            return ids, np.repeat(np.arange(len(lists)), sizes), sizes

        for t in texts:
            lists.append(words_of(t))
            chars += len(t or "")
            if chars >= CHUNK_CHARS:
                yield made()
                lists, chars = [], 0
        if lists:
            yield made()

    def _shingles(self, ids: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the shingles all of whose words are known."""
        n = max(len(ids) - size + 1, 0)
        ok = text[:n] == text[size - 1 :]
        for j in range(size):
            ok &= ids[j : j + n] > 0
        p = np.flatnonzero(ok)
        return p, _keys(ids, size)[p]

    def count(self, texts: Iterable[str | None]) -> dict[int, np.ndarray]:
        """Occurrences in the texts of each of known."""
        out = {z: np.zeros(len(k), np.int64) for z, k in self.known.items()}
        for ids, text, _ in self._chunks(texts):
            for z, known in self.known.items():
                _, keys = self._shingles(ids, text, z)
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out[z] += np.bincount(i[known[i] == keys], minlength=len(known))
        return out

    def _verified(self, ids: np.ndarray, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(begin, window) of the windows that occur in a chunk."""
        for z, (prefix, window, offset) in self.prefix.items():
            p, keys = self._shingles(ids, text, z)
            low = np.searchsorted(prefix, keys)
            many = np.searchsorted(prefix, keys, "right") - low
            p, low, many = p[many > 0], low[many > 0], many[many > 0]
            ends = np.cumsum(many)
            a = 0
            while a < len(p):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                n = many[a:b]
                e = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at, w = np.repeat(p[a:b], n), window[e]
                begin, d = at - offset[e], text[at]
                ok = (begin >= begins[d]) & (begin + self.length[w] <= begins[d] + sizes[d])
                begin, w = begin[ok], w[ok]
                for j in range(int(self.length[w].max(initial=0))):
                    same = (j >= self.length[w]) | (ids[np.minimum(begin + j, len(ids) - 1)] == self.flat[np.minimum(self.start[w] + j, len(self.flat) - 1)])
                    begin, w = begin[same], w[same]
                yield begin, w
                a = b

    def hits(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[int], list[str]]]:
        """(words, begins and ends of hit stretches, sorted ids of items with an occurring window) of each text."""
        for ids, text, sizes in self._chunks(texts):
            begins = np.cumsum(sizes) - sizes
            spans: list[list[int]] = [[] for _ in sizes]
            items: list[set[str]] = [set() for _ in sizes]
            edge = np.zeros(len(ids) + 1, np.int64)
            for begin, w in self._verified(ids, text, begins, sizes):
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + self.length[w], -1)
                for d, k in np.unique(np.stack([text[begin], w], 1), axis=0).tolist():
                    for o in self.owner[self.owned[k] : self.owned[k + 1]].tolist():
                        items[d].update(self.items[o])
            inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
            new = np.concatenate(([True], text[1:] != text[:-1], [True])) if len(text) else np.array([True])
            rise = np.flatnonzero(inside[1:] & (~inside[:-1] | new))
            fall = np.flatnonzero(inside[:-1] & (~inside[1:] | new))  # the end of the stretch
            for a, b in zip(rise.tolist(), fall.tolist(), strict=True):
                d = int(text[a])
                spans[d] += [a - int(begins[d]), b - int(begins[d])]
            yield from zip(sizes.tolist(), spans, map(sorted, items), strict=True)


def _rarity(docs: DataFrame, text: str, index: Index) -> dict[int, np.ndarray]:
    """Occurrences over all documents of every shingle of the index: a number for each."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.count(t for b in batches for t in b[text].to_pylist())
        for z, n in own.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), z)), pa.array(k), pa.array(n[k])], ["z", "k", "n"])

    out = {z: np.zeros(len(k), np.int64) for z, k in index.known.items()}
    if out:
        rows = map_stream(docs.select(text), run, "z long, k long, n long").groupBy("z", "k").agg(F.sum("n").alias("n")).toArrow()
        z, k, n = (rows[c].to_numpy() for c in ("z", "k", "n"))
        for size in out:
            out[size][k[z == size]] = n[z == size]
    sent.unpersist()
    return out


def _blocks(items: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[int, list[tuple[str, list[str]]]]]:
    """(number of blocks, one block's distinct texts with their items' ids), a block at a time.

    Blocks are made by hash, and more of them until each has at most `limit` characters or one text.
    """
    named = items.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"))
    texts = cut(named.groupBy("t").agg(F.sort_array(F.collect_set("i")).alias("i")))
    size = F.length("t") + F.aggregate("i", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    n = 1
    while True:
        sizes = texts.groupBy(F.pmod(F.xxhash64("t"), F.lit(n)).alias("b")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
        if not sizes.where((F.col("size") > limit) & (F.col("rows") > 1)).take(1):
            break
        n *= 2
    for k in range(n):
        yield n, [(r.t, r.i) for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()]  # at most `limit` characters


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 3, keep: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: key, the columns `keep`, `n_words` long, `spans` (array of begin and end of hit stretches of words) and `items` (array of the ids, as strings, of items with an occurring window).

    Words are the runs of ASCII letters (lowered), digits and non-ASCII characters. A null text has no words;
    items without words have no windows; equal texts of several items count for each, null ids as `null`. Repeated rows
    of docs are kept. An empty docs gives an empty result, an empty items no hits. `keep` must not name the results.
    """
    small_batches(docs.sparkSession)
    front = list(dict.fromkeys([key, *keep]))
    narrow = docs.select(*dict.fromkeys([*front, text]))
    found = T._parse_datatype_string("n_words long, spans array<long>, items array<string>").fields
    schema = T.StructType([*docs.select(*front).schema.fields, *found])
    parts = []
    for n, block in _blocks(items, item, item_text, block_chars):
        index = Index(block, window, shingle)
        index.choose(_rarity(docs, text, index))
        index.known = {}
        sent = docs.sparkSession.sparkContext.broadcast(index)
        if n == 1:

            def run(b: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
                words, spans, ids = zip(*sent.value.hits(b[text].to_pylist()), strict=True)
                return pa.RecordBatch.from_arrays([*(b[c] for c in front), pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], schema.names)

            return map_batches(narrow, run, schema)

        def hit(b: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            rows = [(k, s, i) for k, (_, s, i) in zip(b["k"].to_pylist(), sent.value.hits(b[text].to_pylist()), strict=True) if s]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["k", "s", "i"])

        own = map_batches(docs.select(F.md5(text).alias("k"), text), hit, "k string, s array<long>, i array<string>").dropDuplicates(["k"])
        parts.append(written(own, "hits"))
        sent.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy("k").agg(F.flatten(F.collect_list("s")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("i")))).alias("items"))
    first = T.StructType([*schema.fields[: len(front)], T.StructField("_k", T.StringType()), found[0]])

    def sized(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b[c] for c in front), b["_k"], pa.array([len(words_of(t)) for t in b[text].to_pylist()], pa.int64())], first.names)

    def joined(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b[c] for c in [*front, "n_words"]), pa.array([_merged(x or []) for x in b["spans"].to_pylist()], pa.list_(pa.int64())), pa.array([x or [] for x in b["items"].to_pylist()], pa.list_(pa.string()))], schema.names)

    rows = map_batches(narrow.withColumn("_k", F.md5(text)), sized, first)
    return map_batches(rows.join(every.withColumnRenamed("k", "_k"), "_k", "left").select(*front, "n_words", "spans", "items"), joined, schema)


def judged(found: DataFrame) -> DataFrame:
    """The result of contamination() with `n_hit` (words inside hit stretches), `n_items` and `contaminated` (a twentieth of the words at least)."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
