"""Near-duplicates by SimHash: fingerprints, pigeonhole buckets, bit-sliced comparison, components.

Fingerprints within the radius agree in one of radius + 1 blocks of bits, so only those that
share a block are compared. A bucket's fingerprints stand as bit planes (one bit of 64 of them in a
machine word); a carry-save counter adds up the differing planes of all lanes at once, and words are
abandoned as soon as all their lanes are beyond the radius. A bucket gives the links of a spanning forest,
never its pairs. Buckets above a bound are divided again by the bits left over, and at last into pairs
of tiles; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import cut, map_batches, map_stream, small_batches

BITS = 64
#: Distinct fingerprints that a bucket holds before it is divided.
BUCKET = 4096
#: Rows that a task compares together, whole buckets at a time.
LANES = 65_536
#: Planes added between two looks at which words can be abandoned.
GROUP = 8
#: Rows of one key from which a join sends that key's row to every task instead of shuffling its rows to one.
HOT = 1_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 for none or one without words."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1))


def majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes (uint64); 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), LANES):
        part = h[i : i + LANES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns `keep` and `fp` long (the fingerprint's 64 bits) of every row."""
    small_batches(df.sparkSession)
    narrow = df.select(*keep, text)
    schema = T.StructType([*narrow.select(*keep).schema.fields, T.StructField("fp", T.LongType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle, seed) for t in b[text].to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(fp.view(np.int64))], schema.names)

    return map_batches(narrow, run, schema)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, 64 to a word, with a word to spare."""
    out = np.packbits(bits, axis=-1, bitorder="little")
    width = (out.shape[-1] + 7) // 8 * 8 + 8
    return np.ascontiguousarray(np.pad(out, [(0, 0)] * (out.ndim - 1) + [(0, width - out.shape[-1])])).view("<u8")


def near_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int = 3, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays i < j of all pairs of a bucket within the radius. fps uint64, one word or a row of words each; equal buckets stand together.

    label: components that the caller joins by the pairs so far; buckets with a single one left are not looked at further.
    """
    index = np.arange(len(fps))
    fps = fps[:, None] if fps.ndim == 1 else fps
    bits = 64 * fps.shape[1]
    counter_bits = max(1, radius.bit_length())
    full = ~np.uint64(0)
    # counters begin so high that they overflow with the first bit beyond the radius
    begin = [full if (1 << counter_bits) - 1 - radius >> k & 1 else np.uint64(0) for k in range(counter_bits)]
    d = 1
    while True:
        last = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]), len(bucket) - 1) if len(bucket) else np.array([], int)
        sizes = np.diff(np.append(-1, last))
        more = sizes > d  # buckets with lanes still to be paired at this distance
        if label is not None and len(sizes):
            first = last - sizes + 1
            own = label[index]
            more &= np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        keep = np.repeat(more, sizes)
        if not keep.any():
            return
        fps, bucket, index, n = fps[keep], bucket[keep], index[keep], int(keep.sum())
        planes = _packed(np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").T)
        stop = min(2 * d, int(sizes[more].max()))
        for d in range(d, max(stop, d + 1)):
            mask = _packed(bucket[: n - d] == bucket[d:])[: planes.shape[1]]
            act = np.flatnonzero(mask)
            over = ~mask[act]  # lanes that count no more
            count = [np.full(len(act), x) for x in begin]
            word, shift = divmod(d, 64)
            right, left = np.uint64(shift), np.uint64(64 - shift)
            width = planes.shape[1] - 1
            for g in range(0, bits, GROUP):
                lo = np.minimum(act + word, width)
                other = planes[g : g + GROUP, lo]
                if shift:
                    other = (other >> right) | (planes[g : g + GROUP, np.minimum(lo + 1, width)] << left)
                for diff in planes[g : g + GROUP, act] ^ other:
                    carry = diff
                    for k, c in enumerate(count):
                        count[k], carry = c ^ carry, c & carry
                    over |= carry
                alive = over != full
                if not alive.all():
                    act, over, count = act[alive], over[alive], [c[alive] for c in count]
                if not len(act):
                    break
            if len(act):
                lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                w, b = np.nonzero(lanes)
                i = act[w] * 64 + b
                i = i[np.bitwise_count(fps[i] ^ fps[i + d]).sum(1) <= radius]
                if len(i):
                    yield index[i], index[i + d]
        d += 1


def forest(fps: np.ndarray, bucket: np.ndarray, *radii: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a spanning forest of the pairs within the last radius; of pairs within an earlier one first."""
    label = np.arange(len(fps))
    left, right = [], []
    for radius in radii or (3,):
        for i, j in near_pairs(fps, bucket, radius, label):
            a, b = label[i], label[j]
            if (apart := a != b).any():
                up: dict[int, int] = {}

                def find(x: int) -> int:
                    while (y := up.get(x, x)) != x:
                        up[x] = up.get(y, y)
                        x = y
                    return x

                for (x, y), (p, q) in {(x, y): (p, q) for x, y, p, q in zip(a[apart].tolist(), b[apart].tolist(), i[apart].tolist(), j[apart].tolist(), strict=True)}.items():
                    x, y = find(x), find(y)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        left.append(p)
                        right.append(q)
                to = np.arange(len(label))
                for x in up:
                    to[x] = find(x)
                label[:] = to[label]
    return np.array(left, np.int64), np.array(right, np.int64)


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """n blocks of near-equal width that cover the lowest `bits` bits: (shift, width)."""
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def whole_buckets(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns as arrays, the first being the bucket that rows are sorted by, in runs of whole buckets of LANES rows or more."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([b[c].to_numpy() for c in cols])
        n += b.num_rows
        if n >= LANES:
            every = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(every[0], every[0][-1]))  # the last bucket may go on
            if end:
                yield [c[:end] for c in every]
            held, n = [[c[end:] for c in every]], len(every[0]) - end
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def tiled(rows: DataFrame, key: str, node: str, bucket: int = BUCKET) -> DataFrame:
    """rows with the string `key` refined where it has more than `bucket` rows: they are dealt into tiles by node, and every two tiles meet under a key of their own."""
    half = bucket // 2
    counts = rows.groupBy(key).count().where(F.col("count") > bucket)
    if not counts.take(1):
        return rows
    sizes = cut(counts).select(key, F.ceil(F.col("count") / half).cast("int").alias("_tiles"))
    tile = F.pmod(F.xxhash64(node), F.col("_tiles"))
    met = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: F.concat_ws(".", key, F.least(t, F.col("_tile")).cast("string"), F.greatest(t, F.col("_tile")).cast("string")))
    large = rows.join(sizes, key).withColumn("_tile", tile).withColumn(key, F.explode(met)).select(*rows.columns)
    return rows.join(sizes.select(key), key, "left_anti").select(*rows.columns).unionByName(large)


def spread(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """left joined with right, which has a row a key and in `n` how many rows of left have it.

    Keys with more than HOT rows, of which there are few, go to every task, so that none of their rows is shuffled. rows: how
    many left has at most, where that is known.
    """
    hot = right.where(F.col("n") > HOT).drop("n")
    if rows is not None and rows <= HOT or not hot.take(1):
        return left.join(right.drop("n"), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= HOT).drop("n"), key)
    return rest.unionByName(left.join(F.broadcast(hot), key))


def links(nodes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` of nodes, enough to connect all that lie within the radius."""
    # `rest` holds the bits not yet used by a key, packed to the low end; `left` says how many
    rows = nodes.select("fp", F.col("fp").alias("rest"), F.lit("").alias("key"))
    left, out = BITS, []
    for level in range(3):
        blocks = _blocks(left, radius + 1)
        ones = lambda n: F.lit((1 << n) - 1)
        below = lambda s: F.col("rest").bitwiseAND(ones(s)) if s < 63 else F.col("rest")
        made = [F.struct(F.concat_ws(".", "key", F.lit(k), F.shiftrightunsigned("rest", s).bitwiseAND(ones(w)).cast("string")).alias("key"), (F.shiftleft(F.shiftrightunsigned("rest", s + w), s) if s + w < left else F.lit(0).cast("long")).bitwiseOR(below(s) if s else F.lit(0)).alias("rest")) for k, (s, w) in enumerate(blocks)]
        # blocks differ by a bit at most, so the narrowest's rest is the widest
        left -= min(w for _, w in blocks)
        rows = rows.select("fp", F.explode(F.array(*made)).alias("m")).select("fp", "m.key", "m.rest")
        if level:
            rows = cut(rows)
        large = cut(rows.groupBy("key").count().where(F.col("count") > bucket))
        if not large.take(1):
            out.append(rows.select("key", "fp"))
            rows = None
            break
        out.append(rows.join(large, "key", "left_anti").select("key", "fp"))
        rows = rows.join(large.select("key"), "key", "left_semi")
    if rows is not None:  # buckets that stay large: every two tiles meet
        out.append(tiled(rows.select("key", "fp"), "key", "fp", bucket))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, some in whole_buckets(batches, ["h", "fp"]):
            fps = some.view(np.uint64)
            i, j = forest(fps, keys, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], ["a", "b"])

    # a key's hash stands for it: keys that share one are only compared for nothing
    hashed = every.select(F.xxhash64("key").alias("h"), "fp")
    small_batches(nodes.sparkSession)
    return map_stream(hashed.repartition("h").sortWithinPartitions("h"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b): root is the smallest node that is reached.

    Alternates large-star and small-star steps until nothing changes; each is written to the shared folder.
    """
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = cut(spread(both, least, "a", 2 * now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        met = spread(large, least, "a", 2 * now[0])
        edges = cut(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, now = now, state(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42, bucket: int = BUCKET, keep: tuple[str, ...] = (), similarity: float | None = None) -> DataFrame:
    """Per row of df: key, the columns `keep`, `fingerprint` (16 lowercase hex digits) and `component_id`.

    component_id is the smallest key that is reached over links of at most `radius` differing bits. Null
    texts and texts without words have fingerprint 0 and link like others. Equal fingerprints are
    merged before anything is compared, so copies cost no comparisons. Null keys count in no
    minimum; rows whose component has no other key get null. An empty df gives an empty result.

    With a `similarity`, links need sets of shingles of that Jaccard similarity, found by wide fingerprints (see similar.py); `radius`
    and `seed` then play no part, and `fingerprint` has 64 digits.
    """
    if similarity is not None:
        from sigspark.llm import similar

        return similar.near_duplicates(df, key, text, similarity, shingle, keep, bucket)
    prints = cut(fingerprints(df, text, (key, *keep), shingle, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")))  # read by links and components
    roots = components(links(nodes, radius, bucket))
    table = named_components(nodes, roots.withColumnRenamed("node", "fp"), "fp")
    return spread(prints, table, "fp").select(key, *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def named_components(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, component_id, n) of nodes (node, least key, n rows), whose roots are given where they are not themselves."""
    rooted = cut(nodes.join(roots, node, "left").select(node, "least", F.col("n").alias("rows"), F.coalesce("root", node).alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return cut(spread(rooted, named, "root").select(node, "component_id", F.col("rows").alias("n")))
