"""WARC archives with a two-level capture index.

Each task writes its rows' records, every one its own gzip member, to an archive in the shared folder. The
captures' keys (host names reversed, then the path) are sorted over all tasks into index files of compressed
blocks of lines; beside each file lies a sparse directory with the first key of every block. A look-up finds the
index file by the files' first keys, the block by binary search in its directory, reads that block's range,
and reads the record's range in the archive. Files carry the attempt in their names and count only through rows
that a task delivered, so a lost executor's files are never taken for good.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import cut, map_stream, shared_folder, small_batches, written

#: Payloads of fewer bytes are stored each time.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256_000_000
#: Captures of an index block.
BLOCK_LINES = 256
#: Digests of repeated payloads up to which they go to every task; more are joined by a shuffle, but for those with more than HOT rows.
BROADCAST_DIGESTS = 100_000
HOT = 100_000
#: Rows and bytes of payloads that a look-up hands on at a time.
READ_ROWS, READ_BYTES = 256, 16_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """Where a written archive lies: its folder, and for every index file its first key."""

    folder: str
    files: list[tuple[str, str]]  # (first key, index file), ascending


def capture_key(url: Column) -> Column:
    """The host's labels reversed and comma-joined, `)`, then path and query: `org,example)/a?b`. Empty for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    tail = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1), "[\\x00-\\x20]", "%20")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), tail)


def _record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<urn:page:{page}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()}
    if refers_to:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    block = http if refers_to else http + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """(WARC headers, payload or None for a revisit, the payload's declared length) of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    http, _, body = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    if headers["WARC-Type"] == "revisit":
        return headers, None, declared
    if len(body) != declared:
        raise ValueError("payload of a wrong length")
    return headers, body, declared


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _name(kind: str) -> str:
    c = TaskContext.get()
    return f"{kind}-{c.partitionId():05d}-{c.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> Archive:
    """Writes a record per row of pages and the index over them; folder: a URI that every executor can write (default: a new shared folder).

    Of rows with equal payloads of REVISIT_BYTES at least, the one with the largest key is a response and the others
    revisit it; rows that share that key are responses all. A null html is an empty payload; null keys
    never are the largest, and null urls have an empty capture key.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "archive")
    fs, path = _open(folder)
    fs.create_dir(path)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("string").alias("page"), F.col(key).alias("order"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), capture_key(F.col(url)).alias("ckey"))
    # only digests move here, summed in each task first
    again = cut(rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("first")).where("n > 1 and first is not null"))
    some = again.limit(BROADCAST_DIGESTS + 1).count()
    if not some:
        rows = rows.withColumn("first", F.lit(None).cast(pages.schema[key].dataType))
    elif some <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(again.drop("n")), "digest", "left")
    else:
        # those with many rows, of which there are few, go to every task, so that no task gets all rows of one
        hot = rows.join(F.broadcast(again.where(F.col("n") > HOT).drop("n")), "digest", "left")
        rest = hot.where("first is null").drop("first").join(again.where(F.col("n") <= HOT).drop("n"), "digest", "left")
        rows = hot.where("first is not null").unionByName(rest)
    rows = rows.withColumn("refers", F.when(~F.col("order").eqNullSafe(F.col("first")), F.col("first").cast("string"))).drop("order", "first")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                made = []
                for r in b.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = _name("warc") + ".warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    member = _gzip(_record(r["page"] or "null", r["url"], r["payload"], r["digest"], r["refers"]))
                    out.write(member)
                    made.append((r["ckey"], r["page"], name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c, pa.string()) for i, c in enumerate(zip(*made, strict=True))], ["ckey", "page", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    captures = written(map_stream(rows, archive, "ckey string, page string, file string, at long, size long"), "captures")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["ckey", "page", "file", "at"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        held: list[list] = []
        directory: list[tuple[str, int, int]] = []
        out, name, at = None, _name("cdx"), 0

        def flush(part: list[list]) -> None:
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(f"{path}/{name}.gz", compression=None)
            member = _gzip("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in part).encode())
            out.write(member)
            directory.append((part[0][0], at, len(member)))
            at += len(member)

        for b in batches:
            held += [list(r.values()) for r in b.to_pylist()]
            while len(held) >= BLOCK_LINES:
                flush(held[:BLOCK_LINES])
                del held[:BLOCK_LINES]
        if held:
            flush(held)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory, ensure_ascii=False).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first", "name"])

    files = map_stream(captures.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, "size"), blocks, "first string, name string")
    return Archive(folder, sorted(map(tuple, cut(files).collect())))  # a row for each index file


class Reader:
    """Look-ups in one archive from one process; keeps the last index file's directory and block."""

    def __init__(self, archive: Archive):
        self.archive = archive
        self.fs, self.path = _open(archive.folder)
        self.firsts = [k for k, _ in archive.files]
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[str, int, list] = ("", -1, [])
        self.inputs: dict[str, pa.NativeFile] = {}

    def _range(self, name: str, at: int, size: int) -> bytes:
        if name not in self.inputs:
            if len(self.inputs) >= 64:
                self.inputs.pop(next(iter(self.inputs))).close()
            self.inputs[name] = self.fs.open_input_file(f"{self.path}/{name}")
        return zlib.decompress(self.inputs[name].read_at(size, at), 31)

    def files(self, key: str) -> Iterator[int]:
        """Index files that can have lines of a key: equal keys can begin in the one before the first that starts with it."""
        f = max(0, bisect_left(self.firsts, key) - 1)
        while f < len(self.firsts) and self.firsts[f] <= key:
            yield f
            f += 1

    def blocks(self, f: int, key: str) -> Iterator[int]:
        """Blocks of an index file that can have lines of a key, by binary search in its directory."""
        name = self.archive.files[f][1]
        if self.directory[0] != name:
            with self.fs.open_input_file(f"{self.path}/{name}.dir") as d:
                self.directory = (name, json.loads(d.read()))
        blocks = self.directory[1]
        b = max(0, bisect_left(blocks, key, key=lambda x: x[0]) - 1)
        while b < len(blocks) and blocks[b][0] <= key:
            yield b
            b += 1

    def lines(self, f: int, b: int, key: str) -> Iterator[tuple[str, str | None, str, int, int]]:
        """Lines (key, page, file, offset, length) of a key in a block."""
        name = self.archive.files[f][1]
        if self.block[:2] != (name, b):
            next(self.blocks(f, key), None)  # loads the directory
            _, at, size = self.directory[1][b]
            self.block = (name, b, [json.loads(x) for x in self._range(f"{name}.gz", at, size).decode().split("\n")[:-1]])
        lines = self.block[2]
        i = bisect_left(lines, key, key=lambda x: x[0])
        while i < len(lines) and lines[i][0] == key:
            yield tuple(lines[i])
            i += 1

    def captures(self, key: str) -> Iterator[tuple[str, str | None, str, int, int]]:
        """Lines of a key in the whole index, in order."""
        for f in self.files(key):
            for b in list(self.blocks(f, key)):
                yield from self.lines(f, b, key)

    def record(self, name: str, at: int, size: int) -> bytes:
        return self._range(name, at, size)


def lookup(queries: DataFrame, archive: Archive, url: str = "url") -> DataFrame:
    """Every capture of every distinct url of queries, read back: `page` string, `payload_bytes` long, `payload_digest` string, `record_type` string, `refers_to` string, `payload` binary (null for revisits).

    Responses' payloads are checked against their digests. A url that was never captured gives no row; null urls are
    one key, like any other; no queries, or an archive of nothing, give an empty result. Tasks are dealt blocks of the index, not
    keys, so the captures of a frequent url are read by many of them.
    """
    small_batches(queries.sparkSession)
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = queries.select(capture_key(F.col(url)).alias("ckey")).distinct()

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for b in batches:
            made = [(k, f) for k in b["ckey"].to_pylist() for f in reader.files(k)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.string()), pa.array([f for _, f in made], pa.int32())], ["ckey", "file"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for b in batches:
            made = [(k, f, i) for k, f in zip(b["ckey"].to_pylist(), b["file"].to_pylist(), strict=True) for i in reader.blocks(f, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in made], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["ckey", "file", "block"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archive)
        for b in batches:
            found = (c for k, f, i in zip(b["ckey"].to_pylist(), b["file"].to_pylist(), b["block"].to_pylist(), strict=True) for c in reader.lines(f, i, k))
            for chunk in _chunks(found):
                rows = []
                for _, page, name, at, size in chunk:
                    head, payload, declared = parse_record(reader.record(name, at, size))
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"page {page}: wrong payload digest")
                    refers = head.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">") or None
                    own = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    rows.append((None if own == "null" else own, declared, digest, head["WARC-Type"], refers, payload))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    if not archive.files:
        return queries.sparkSession.createDataFrame([], "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    files = map_stream(keyed, to_files, "ckey string, file int").repartition(n, "file").sortWithinPartitions("file", "ckey")
    blocks = map_stream(files, to_blocks, "ckey string, file int, block int").repartition(n, "file", "block").sortWithinPartitions("file", "block", "ckey")
    return map_stream(blocks, read, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def _chunks(rows: Iterator) -> Iterator[list]:
    """Captures (the last field is the stored length) by READ_ROWS, or fewer large ones."""
    held: list = []
    size = 0
    for r in rows:
        held.append(r)
        size += r[-1]
        if len(held) == READ_ROWS or size >= READ_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held
