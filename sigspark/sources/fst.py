"""Binary wave dumps (FST): reader, one task for each value block, and writer.

Written from the published format: blocks of (type, length, body); geometry (lengths by handle), hierarchy, and value
blocks with a frame of initial values, one compressed chain of changes for each handle, an index of chains and a
time table.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigspark.model import CHANGES, SCOPES, SIGNALS, TRACES, TraceSet
from sigspark.sources.vcd import as_int
from sigspark.storage import ship

# Block types, the header's layout, the states that a scalar chain can name.
HDR, VCDATA, BLACKOUT, GEOM, HIER, VC_ALIAS, HIER_LZ4, HIER_LZ4DUO, VC_ALIAS2, ZWRAP, SKIP = 0, 1, 2, 3, 4, 5, 6, 7, 8, 254, 255
HEADER = struct.Struct(">QQ8sQQQQQb128s119sBq")
STATES = "xzhuwl-?"
VAR_TYPES = "event integer parameter real real_parameter reg supply0 supply1 time tri triand trior trireg tri0 tri1 wand wire wor port sparse_array realtime string bit logic int shortint longint byte enum shortreal".split()
SCOPE_TYPES = "module task function begin fork generate struct union class interface package program".split()
SCOPE, UPSCOPE, ATTR, ATTR_END = 254, 255, 252, 253
E_BYTES = struct.pack("<d", 2.7182818284590452354)
#: Rows that a task hands over at once.
BATCH = 1 << 16


# -- codecs ------------------------------------------------------------------------------------------------


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def svarint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 127
        n >>= 7
        if n == 0 and not b & 64 or n == -1 and b & 64:
            out.append(b)
            return bytes(out)
        out.append(b | 128)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        shift += 7
        if c < 128:
            return n, at


def read_svarint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        shift += 7
        if c < 128:
            return (n - (1 << shift) if c & 64 else n), at


def lz4_block(src: bytes, size: int) -> bytes:
    """Decodes a raw LZ4 block."""
    out, at = bytearray(), 0

    def more(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                c = src[at]
                at += 1
                n += c
                if c != 255:
                    break
        return n

    while at < len(src):
        token = src[at]
        at += 1
        n = more(token >> 4)
        out += src[at : at + n]
        at += n
        if at >= len(src):
            break
        back = src[at] | src[at + 1] << 8
        at += 2
        _copy(out, back, more(token & 15) + 4)
    if len(out) != size:
        raise ValueError("LZ4 block of a wrong length")
    return bytes(out)


def _copy(out: bytearray, back: int, n: int) -> None:
    start = len(out) - back
    if start < 0:
        raise ValueError("reference before the beginning")
    while n > 0:  # a reference may reach into what it makes
        part = out[start : start + min(n, len(out) - start)]
        out += part
        n -= len(part)
        start += len(part)


def fastlz(src: bytes, size: int) -> bytes:
    """Decodes a FastLZ block of level 1 or 2."""
    out, at, level = bytearray(), 1, (src[0] >> 5) + 1
    ctrl = src[0] & 31
    while True:
        if ctrl >= 32:
            n, back = (ctrl >> 5) - 1, (ctrl & 31) << 8
            if n == 6:
                while True:
                    c = src[at]
                    at += 1
                    n += c
                    if level == 1 or c != 255:
                        break
            c = src[at]
            at += 1
            back += c
            if level == 2 and c == 255 and back == (31 << 8) + 255:
                back = (src[at] << 8 | src[at + 1]) + 8191
                at += 2
            _copy(out, back + 1, n + 3)
        else:
            out += src[at : at + ctrl + 1]
            at += ctrl + 1
        if at >= len(src):
            break
        ctrl = src[at]
        at += 1
    if len(out) != size:
        raise ValueError("FastLZ block of a wrong length")
    return bytes(out)


def unpack(kind: str, src: bytes, size: int) -> bytes:
    return zlib.decompress(src) if kind == "Z" else lz4_block(src, size) if kind == "4" else fastlz(src, size)


# -- reading -----------------------------------------------------------------------------------------------


@dataclass
class Var:
    name: str
    short: str
    scope: str
    kind: str
    width: int
    handle: int  # from 1


@dataclass
class Meta:
    timescale: int = -9
    version: str = ""
    date: str = ""
    lengths: list[int] = field(default_factory=list)  # by handle - 1; 0 for a real
    vars: list[Var] = field(default_factory=list)
    scopes: list[tuple[str, str, str, int]] = field(default_factory=list)
    blocks: list[tuple[int, int]] = field(default_factory=list)  # (position of the length, length) of value blocks


def read_meta(f: BinaryIO) -> Meta:
    """Header, geometry, hierarchy and where the value blocks are; values aren't read."""
    m, at, hier = Meta(), 0, b""
    f.seek(0, 2)
    end = f.tell()
    while at + 9 <= end:
        f.seek(at)
        kind, size = struct.unpack(">BQ", f.read(9))
        if kind == SKIP or size < 8 or at + 1 + size > end:
            break
        if kind == ZWRAP:  # the whole file, compressed
            f.seek(at + 17)
            import io

            return read_meta(io.BytesIO(gzip.decompress(f.read(size - 16))))
        if kind == HDR:
            h = HEADER.unpack(f.read(HEADER.size))
            m.timescale, m.version, m.date = h[8], h[9].split(b"\0")[0].decode("latin-1").strip(), h[10].split(b"\0")[0].decode("latin-1").strip()
        elif kind == GEOM:
            full, count = struct.unpack(">QQ", f.read(16))
            body = f.read(size - 24)
            body, p = (body if len(body) == full else zlib.decompress(body)), 0
            for _ in range(count):
                n, p = read_varint(body, p)
                m.lengths.append(n)
        elif kind in (HIER, HIER_LZ4, HIER_LZ4DUO):
            (full,) = struct.unpack(">Q", f.read(8))
            body = f.read(size - 16)
            if kind == HIER:
                hier = gzip.decompress(body)
            elif kind == HIER_LZ4:
                hier = lz4_block(body, full)
            else:
                middle, p = read_varint(body, 0)
                hier = lz4_block(lz4_block(body[p:], middle), full)
        elif kind == VC_ALIAS2:
            m.blocks.append((at + 1, size))
        at += 1 + size
    _hierarchy(m, hier)
    return m


def _hierarchy(m: Meta, b: bytes) -> None:
    at, stack, handle = 0, [], 0

    def text() -> str:
        nonlocal at
        end = b.index(0, at)
        s, at = b[at:end].decode("utf-8", "replace"), end + 1
        return s

    while at < len(b):
        tag = b[at]
        at += 1
        if tag == SCOPE:
            kind = SCOPE_TYPES[b[at]] if b[at] < len(SCOPE_TYPES) else "module"
            at += 1
            name = text()
            text()
            parent = ".".join(stack)
            stack.append(name)
            m.scopes.append((".".join(stack), parent, kind, len(stack)))
        elif tag == UPSCOPE:
            stack = stack[:-1]
        elif tag == ATTR:
            at += 2
            text()
            _, at = read_varint(b, at)
        elif tag == ATTR_END:
            continue
        else:
            at += 1  # direction
            short = text()
            width, at = read_varint(b, at)
            alias, at = read_varint(b, at)
            if not alias:
                handle += 1
            scope = ".".join(stack)
            m.vars.append(Var(f"{scope}.{short}" if scope else short, short, scope, VAR_TYPES[tag] if tag < len(VAR_TYPES) else "wire", width, alias or handle))


@dataclass
class Block:
    """A value block's parts, from its body (after the length)."""

    body: bytes

    def __post_init__(self) -> None:
        b = self.body
        self.begin, self.end, _ = struct.unpack(">QQQ", b[:24])
        full, at = read_varint(b, 24)
        packed, at = read_varint(b, at)
        self.frame_count, at = read_varint(b, at)
        raw = b[at : at + packed]
        self.frame = raw if packed == full else zlib.decompress(raw)
        at += packed
        self.count, at = read_varint(b, at)
        self.pack, self.start = chr(b[at]), at
        full, packed, times = struct.unpack(">QQQ", b[-24:])
        raw = b[-24 - packed : -24]
        raw, p, t = (raw if packed == full else zlib.decompress(raw)), 0, 0
        self.times = array("q")
        for _ in range(times):
            d, p = read_varint(raw, p)
            t += d
            self.times.append(t)
        (size,) = struct.unpack(">Q", b[-32 - packed : -24 - packed])
        self._index(b[-32 - packed - size : -32 - packed], len(b) - 32 - packed - size - self.start)

    def _index(self, b: bytes, end: int) -> None:
        """chains: (offset from the pack byte, length) by handle - 1; None without changes."""
        chains: list = []
        at, value, last, alias = 0, 0, -1, 0
        starts: dict[int, int] = {}
        aliases: dict[int, int] = {}
        while at < len(b) and len(chains) < self.count:
            if b[at] & 1:
                v, at = read_svarint(b, at)
                v >>= 1
                i = len(chains)
                if v > 0:
                    value += v
                    if last >= 0:
                        chains[last] = (starts[last], value - starts[last])
                    starts[i], last = value, i
                    chains.append(None)
                else:
                    alias = v if v < 0 else alias
                    aliases[i] = -alias - 1
                    chains.append(None)
            else:
                v, at = read_varint(b, at)
                chains += [None] * (v >> 1)
        if last >= 0:
            chains[last] = (starts[last], end - starts[last])
        for i, of in aliases.items():
            chains[i] = chains[of]
        self.chains = chains[: self.count]

    def changes(self, handle: int, width: int) -> Iterator[tuple[int, str]]:
        """(place in the time table, value) of a handle's changes; a real's value is its repr."""
        if handle > len(self.chains) or (c := self.chains[handle - 1]) is None:
            return
        raw = self.body[self.start + c[0] : self.start + c[0] + c[1]]
        size, at = read_varint(raw, 0)
        b, at, t = (unpack(self.pack, raw[at:], size), 0, 0) if size else (raw, at, 0)
        while at < len(b):
            v, at = read_varint(b, at)
            if width == 1:
                if v & 1:
                    t += v >> 4
                    yield t, STATES[v >> 1 & 7]
                else:
                    t += v >> 2
                    yield t, str(v >> 1 & 1)
                continue
            t += v >> 1
            if width == 0:
                yield t, repr(struct.unpack("<d", b[at : at + 8])[0])
                at += 8
            elif v & 1:
                yield t, b[at : at + width].decode("latin-1")
                at += width
            else:
                n = (width + 7) // 8
                yield t, bin(int.from_bytes(b"\1" + b[at : at + n]))[3 : 3 + width]
                at += n

    def initial(self, lengths: list[int]) -> Iterator[tuple[int, str]]:
        """(handle, value) before the block's first time."""
        at = 0
        for i, width in enumerate(lengths[: self.frame_count]):
            n = width or 8
            raw = self.frame[at : at + n]
            at += n
            if len(raw) == n:
                yield i + 1, raw.decode("latin-1") if width else repr(struct.unpack("<d", raw)[0])


def _open(path: str) -> BinaryIO:
    fs, p = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(p)


def _block(path: str, at: int, size: int) -> Block:
    with _open(path) as f:
        f.seek(at + 8)
        return Block(f.read(size - 8))


def read_fst(spark: SparkSession, path: str, trace_id: str = "t0", load_order: int = 0, bucket: int = 1 << 18) -> TraceSet:
    """The trace of a binary dump that executors can open under the same path. A time repeated within a block is an index of its own; equal times of neighbouring blocks are one index."""
    ship(spark)
    with _open(path) as f:
        m = read_meta(f)
    at = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(m.blocks)], "block int, at long, size long").repartition(max(1, len(m.blocks)), "block")
    lengths, pulses = m.lengths, {v.handle for v in m.vars if v.kind == "event"}

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t = _block(path, r["at"], r["size"]).times
                if t:
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int32()), pa.array([len(t)], pa.int64()), pa.array([t[0]], pa.int64()), pa.array([t[-1]], pa.int64())], ["block", "n", "first", "last"])

    base: dict[int, int] = {}
    n, last = 0, None
    for r in sorted(at.mapInArrow(ends, "block int, n long, first long, last long").collect()):  # a row for each block
        base[r.block] = n - (r.first == last)
        n, last = base[r.block] + r.n, r.last
    first_block = min(base, default=-1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["block"] not in base:
                    continue
                block, add, seq = _block(path, r["at"], r["size"]), base[r["block"]], r["block"] << 40
                none = lambda k, kind: pa.nulls(k, kind)
                for i in range(0, len(block.times), BATCH):
                    t = pa.array(block.times[i : i + BATCH].tolist(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(range(add + i, add + i + len(t)), pa.int64()), none(len(t), pa.int64()), t, none(len(t), pa.int32()), none(len(t), pa.string())], ["idx", "seq", "ts", "handle", "value"])
                start = {h: v for h, v in block.initial(lengths) if h not in pulses} if r["block"] == first_block else {}
                for h, width in enumerate(lengths, 1):
                    own = chain([(0, start[h])] if h in start else [], block.changes(h, width))
                    at_seq = seq
                    while part := list(islice(own, BATCH)):
                        k, vs = zip(*part, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([add + i for i in k], pa.int64()), pa.array(range(at_seq, at_seq + len(k)), pa.int64()), none(len(k), pa.int64()), pa.array([h] * len(k), pa.int32()), pa.array(vs, pa.string())], ["idx", "seq", "ts", "handle", "value"])
                        at_seq += len(k)

    parsed = at.mapInArrow(rows, "idx long, seq long, ts long, handle int, value string")
    signals = spark.createDataFrame([(trace_id, i, v.name, v.short, v.scope, v.width, v.kind, str(v.handle), v.kind == "event", i) for i, v in enumerate(m.vars)], SIGNALS)
    ids = F.broadcast(signals.select("sig_id", "name", F.col("id_code").cast("int").alias("handle"), "var_type", "is_event"))
    real = F.col("var_type").isin("real", "realtime", "real_parameter", "shortreal")
    bits = F.when(~real, F.col("value"))
    one = lambda c: F.when(F.col("is_event"), F.lit(1).cast("long")).otherwise(c)
    changes = parsed.where("handle is not null").join(ids, "handle").select(F.lit(trace_id).alias("trace_id"), "sig_id", "name", "idx", F.lit(None).cast("long").alias("ts"), "seq", bits.alias("bits"), one(F.coalesce(as_int(bits), F.lit(0).cast("long"))).alias("ival"), one(as_int(bits, True)).alias("ival_strict"), F.coalesce(F.when(real, F.col("value").try_cast("double")), as_int(bits).cast("double")).alias("rval"))
    axis = parsed.where("ts is not null").select(F.lit(trace_id).alias("trace_id"), "idx", "ts").dropDuplicates(["idx"])
    traces = spark.createDataFrame([(trace_id, path, load_order, m.timescale, m.version, m.date, n - 1)], TRACES)
    scopes = spark.createDataFrame([(trace_id, *s) for s in m.scopes], SCOPES)
    return TraceSet(traces, signals, axis, changes.select(*[c.split()[0] for c in CHANGES.split(", ")]), scopes, {v.name: "real" for v in m.vars if v.kind in ("real", "realtime", "real_parameter", "shortreal")}, "int", bucket, frozenset(v.name for v in m.vars if v.kind == "event"))


# -- writing -----------------------------------------------------------------------------------------------


class FstWriter:
    """Writes a binary dump: scopes and variables first, then times and values, in order.

    repeats: a time equal to the last is an index of its own; else it adds to the last. No block ends between equal
    times, as a reader takes those of neighbouring blocks for one: a run of them is held whole.
    """

    def __init__(self, f: BinaryIO, timescale: int = -9, version: str = "sigspark", date: str = "", flush_bytes: int = 64 << 20, repeats: bool = False):
        self.repeats = repeats
        self.f, self.timescale, self.version, self.date, self.flush_bytes = f, timescale, version, date, flush_bytes
        self.hier, self.lengths = bytearray(), []
        self.current: list[str] = []
        self.scopes = self.vars = self.blocks = self.held = 0
        self.times = array("q")
        self.chains: dict[int, tuple[bytearray, int]] = {}
        self.start: int | None = None
        self.now = 0
        self.pulses: set[int] = set()
        f.write(bytes([HDR]) + (HEADER.size + 8).to_bytes(8) + bytes(HEADER.size))

    def push_scope(self, name: str, kind: str = "module") -> None:
        self.hier += bytes([SCOPE, SCOPE_TYPES.index(kind)]) + name.encode() + b"\0\0"
        self.scopes += 1

    def pop_scope(self) -> None:
        self.hier.append(UPSCOPE)

    def create_var(self, name: str, width: int = 1, kind: str = "wire", alias: int = 0) -> int:
        """The new variable's handle; an alias shares the values of an earlier one."""
        self.hier += bytes([VAR_TYPES.index(kind), 0]) + name.encode() + b"\0" + varint(width) + varint(alias)
        self.vars += 1
        if alias:
            return alias
        real = kind in ("real", "realtime", "real_parameter", "shortreal")
        self.lengths.append(0 if real else width)
        self.current.append(struct.pack("<d", 0.0).decode("latin-1") if real else "x" * width)
        if kind == "event":
            self.pulses.add(len(self.lengths))
        return len(self.lengths)

    def emit_time_change(self, t: int) -> None:
        again = bool(self.times) and t == self.times[-1]
        if self.times and t < self.times[-1]:
            raise ValueError("times must ascend")
        if again and not self.repeats:
            return
        if self.held >= self.flush_bytes and not again:
            self.flush()
        if self.start is None:
            self.start = t
        if not self.times:
            self.frame = "".join(self.current)
        self.times.append(t)
        self.held += 8
        self.now = t

    def emit_value_change(self, handle: int, value: str | float) -> None:
        """Values before the first time are initial ones; a value equal to the last is left out."""
        width = self.lengths[handle - 1]
        text = struct.pack("<d", float(value)).decode("latin-1") if not width else str(value).lower().rjust(width, "0")
        if text == self.current[handle - 1] and self.times and handle not in self.pulses:
            return
        self.current[handle - 1] = text
        if not self.times:
            return
        chain, last = self.chains.get(handle, (bytearray(), 0))
        at = len(self.times) - 1
        d = at - last
        if width == 1:
            chain += varint(d << 2 | int(text) << 1) if text in "01" else varint(d << 4 | STATES.index(text) << 1 | 1)
        elif width and not text.strip("01"):
            chain += varint(d << 1) + int(text.ljust(-(-width // 8) * 8, "0"), 2).to_bytes(-(-width // 8))
        else:
            chain += varint(d << 1 | 1) + text.encode("latin-1")
        self.held += 8
        self.chains[handle] = chain, at

    def flush(self) -> None:
        if not self.times:
            return
        frame = self.frame.encode("latin-1")
        packed = zlib.compress(frame)
        packed = packed if len(packed) < len(frame) else frame
        n = len(self.lengths)
        body = struct.pack(">QQQ", self.times[0], self.times[-1], len(frame) * 2) + varint(len(frame)) + varint(len(packed)) + varint(n) + packed + varint(n)
        waves, index, offset, zeros, before = bytearray(b"Z"), bytearray(), 0, 0, 0
        for h in range(1, n + 1):
            if h not in self.chains:
                zeros += 1
                continue
            if zeros:
                index += varint(zeros << 1)
                zeros = 0
            raw = bytes(self.chains[h][0])
            z = zlib.compress(raw)
            offset = len(waves)
            index += svarint((offset - before) << 1 | 1)
            before = offset
            waves += varint(len(raw)) + z if len(z) < len(raw) else b"\0" + raw
        if zeros:
            index += varint(zeros << 1)
        times, last = bytearray(), 0
        for t in self.times:
            times += varint(t - last)
            last = t
        z = zlib.compress(times)
        z = z if len(z) < len(times) else times
        body += bytes(waves) + bytes(index) + len(index).to_bytes(8) + bytes(z) + struct.pack(">QQQ", len(times), len(z), len(self.times))
        self.f.write(bytes([VC_ALIAS2]) + (len(body) + 8).to_bytes(8) + body)
        self.blocks += 1
        self.times, self.chains, self.held = array("q"), {}, 0

    def close(self) -> None:
        """Writes what is left, geometry and hierarchy, and fills the header in."""
        self.flush()
        geom = b"".join(map(varint, self.lengths))
        z = zlib.compress(geom)
        z = z if len(z) < len(geom) else geom
        self.f.write(bytes([GEOM]) + (len(z) + 24).to_bytes(8) + len(geom).to_bytes(8) + len(self.lengths).to_bytes(8) + z)
        z = gzip.compress(bytes(self.hier), mtime=0)
        self.f.write(bytes([HIER]) + (len(z) + 16).to_bytes(8) + len(self.hier).to_bytes(8) + z)
        self.f.seek(9)
        self.f.write(HEADER.pack(self.start or 0, self.now, E_BYTES, 0, self.scopes, self.vars, len(self.lengths), self.blocks, self.timescale, self.version.encode()[:127], self.date.encode()[:118], 0, 0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one value: the driver unpacks columns, not rows."""
    for b in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["data"])


def vcd_to_fst(spark: SparkSession, source: str, target: str, repeats: bool = False) -> None:
    """Converts a dump. Changes come to the driver a part at a time, in order; repeated values are dropped. repeats: repeated times stay indices of their own."""
    from sigspark.sources.vcd import read_vcd

    ship(spark)
    s = read_vcd(spark, source)
    with open(target, "w+b") as f:
        w = FstWriter(f, s.traces.first().timescale_exp, repeats=repeats)
        handles: dict[str, int] = {}
        stack: list[str] = []
        for v in s.signals.orderBy("decl_order").toLocalIterator():
            path = v.scope.split(".") if v.scope else []
            while stack and stack != path[: len(stack)]:
                w.pop_scope()
                stack.pop()
            for part in path[len(stack) :]:
                w.push_scope(part)
                stack.append(part)
            kind = v.var_type if v.var_type in VAR_TYPES else "wire"
            handles[v.name] = w.create_var(v.short, v.width, kind, 0)
        for _ in stack:
            w.pop_scope()
        rows = s.timestamps.select("idx", F.lit(-1).cast("long").alias("seq"), "ts", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("bits"), F.lit(None).cast("double").alias("rval"))
        rows = rows.unionByName(s.changes.select("idx", "seq", F.lit(None).cast("long").alias("ts"), "name", "bits", "rval"))
        for r in rows.orderBy("idx", "seq").select("ts", "name", "bits", "rval").mapInArrow(_packed, "data binary").toLocalIterator(prefetchPartitions=True):
            for b in pa.ipc.open_stream(r.data):
                for ts, name, bits, rval in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if name is None:
                        w.emit_time_change(ts)
                    else:
                        w.emit_value_change(handles[name], bits if bits is not None else rval)
        w.close()
