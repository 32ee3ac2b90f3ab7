"""FLAC streams of 8-bit mono samples, many frames at a time.

Frames of a similar length form a matrix, so the encoder's predictors and Rice codes, and the decoder's
residuals and linear predictors, advance over all rows at once. A decoder row's bit position moves by one
table look-up a sample: the next 1 bit ends the unary part, the low bits are read afterwards for all samples
together. Every frame has a point in the seek table, so any range of samples is read from its own frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigspark.llm.common import map_batches, small_batches

BLOCK = 4096  # samples of a frame
UNIT = 64  # a payload is padded to a multiple of it
GROUP_SAMPLES = 1_500_000  # of the frames that are coded together
LPC_ORDER, LPC_BITS = 4, 12
RATE = 8000


def payload(text: str | None) -> bytes:
    """The UTF-8 bytes with bytes 0 up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


# -- checksums ---------------------------------------------------------------------------------------------


def _crc_table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        c = np.where(c >> (bits - 1) & 1, c << 1 ^ poly, c << 1) & ((1 << bits) - 1)
    return c


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


@lru_cache(1)
def _far(n: int) -> np.ndarray:
    """What a byte adds to the CRC-16 when d bytes follow it, for d below n."""
    out = np.empty((n, 256), np.uint16)
    c = _CRC16.copy()
    for d in range(n):
        out[d] = c
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8]
    return out.ravel()


def crc16(frames: list[bytes]) -> np.ndarray:
    """The CRC-16 of each frame: bytes add up independently, as the code is linear."""
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    if not len(sizes):
        return np.array([], np.uint16)
    far = _far(1 << max(14, int(sizes.max() - 1).bit_length()))
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(frames), np.uint8)
    after = np.repeat(ends, sizes) - 1 - np.arange(len(flat))
    return np.bitwise_xor.reduceat(far[after * 256 + flat], ends - sizes)


# -- encoding ----------------------------------------------------------------------------------------------


def _number(n: int) -> bytes:
    """A frame number in the header's extended UTF-8."""
    if n < 128:
        return bytes([n])
    size = 2
    while n >> (5 * size + 1):
        size += 1
    tail = [0x80 | n >> 6 * i & 63 for i in reversed(range(size - 1))]
    return bytes([0xFF << (8 - size) & 0xFF | n >> 6 * (size - 1), *tail])


def _header(number: int, n: int) -> bytes:
    code, extra = (12, b"") if n == BLOCK else (7, struct.pack(">H", n - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0b0000_001_0]) + _number(number) + extra
    return head + bytes([crc8(head)])


def _groups(lengths: np.ndarray) -> list[np.ndarray]:
    """Frames by falling length, in groups of bounded size."""
    order, out, at = np.argsort(-lengths, kind="stable"), [], 0
    while at < len(order):
        n = max(1, GROUP_SAMPLES // int(lengths[order[at]]))
        out.append(order[at : at + n])
        at += n
    return out


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _lpc(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (rows, LPC_ORDER) and their shifts, from autocorrelations by the Levinson recursion."""
    f = np.where(mask, x, 0).astype(np.float32)
    n = f.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : n - lag]) for lag in range(LPC_ORDER + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(x), LPC_ORDER)), r[:, 0] + 1e-9
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(int) - 1, 0, 15)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << LPC_BITS - 1), (1 << LPC_BITS - 1) - 1).astype(np.int64), shift


def _bits(value: int, width: int) -> np.ndarray:
    return np.array([value >> i & 1 for i in range(width - 1, -1, -1)], np.uint8)


def encode_frames(parts: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """A frame for each array of 8-bit samples (int8), of falling length."""
    lengths = np.array([len(p) for p in parts])
    rows, width = len(parts), int(lengths[0])
    x = np.zeros((rows, width), np.int32)
    for row, p in zip(x, parts, strict=True):
        row[: len(p)] = p
    inside = np.arange(width) < lengths[:, None]
    coef, shift = _lpc(x, inside)
    tries, d = [], x
    for order in range(3):
        tries.append((order, d))
        d = np.diff(d, axis=1, prepend=0)
    pred = np.zeros_like(x)
    for j in range(LPC_ORDER):
        pred[:, j + 1 :] += (coef[:, j, None].astype(np.int32)) * x[:, : width - j - 1]
    tries.append((LPC_ORDER, x - (pred >> shift[:, None].astype(np.int32))))
    cost, ks, us = [], [], []
    for kind, (order, res) in enumerate(tries):
        u = _zigzag(res)
        coded = inside & (np.arange(width) >= order)
        u = np.where(coded, u, 0)
        n = np.maximum(lengths - order, 1)
        k = np.clip(np.floor(np.log2(u.sum(1, dtype=np.int64) / n * 0.6931 + 1e-9)).astype(int), 0, 14)
        bits = (lengths - order) * (1 + k) + (u >> k[:, None]).sum(1, dtype=np.int64) + 10 + 8 * order + (9 + LPC_BITS * LPC_ORDER) * (kind == 3)
        cost.append(np.where(lengths > order, bits, 1 << 40))
        ks.append(k)
        us.append(u)
    constant = ((x == x[:, :1]) | ~inside).all(1)
    best = np.argmin(cost, 0)
    verbatim = np.min(cost, 0) >= 8 * lengths
    out: list[bytes] = [b""] * rows
    sub: list[bytes] = [b""] * rows
    for i in np.flatnonzero(constant | verbatim):
        raw = parts[i].astype(np.int8).tobytes()
        sub[i] = b"\x00" + raw[:1] if constant[i] else b"\x02" + raw
    for kind, (order, _) in enumerate(tries):
        rice = np.flatnonzero(~constant & ~verbatim & (best == kind))
        if not len(rice):
            continue
        u, k, n = us[kind][rice], ks[kind][rice], lengths[rice]
        heads = []
        for i, kk in zip(rice, k.tolist(), strict=True):
            h = [np.frombuffer(bytes([(8 | order) << 1 if kind < 3 else (32 | order - 1) << 1]) + x[i, :order].astype(np.int8).tobytes(), np.uint8)]
            h = [np.unpackbits(h[0])]
            if kind == 3:
                h += [_bits(LPC_BITS - 1, 4), _bits(int(shift[i]), 5), *(_bits(int(c) & (1 << LPC_BITS) - 1, LPC_BITS) for c in coef[i])]
            heads.append(np.concatenate([*h, _bits(0, 6), _bits(kk, 4)]))
        coded = (np.arange(width) < n[:, None]) & (np.arange(width) >= order)
        flat = u[coded]
        per = (n - order).astype(np.int64)
        kf = np.repeat(k, per).astype(np.int64)
        q = (flat >> kf).astype(np.int64)
        ends = np.cumsum(q + 1 + kf)
        row_bits = np.add.reduceat(q + 1 + kf, np.cumsum(per) - per)
        total = np.array([len(h) for h in heads]) + row_bits
        begin = np.concatenate(([0], np.cumsum((total + 7) // 8 * 8)))
        lead = begin[:-1] + np.array([len(h) for h in heads])
        stop = ends - kf - 1 + np.repeat(lead - (np.cumsum(row_bits) - row_bits), per)  # each sample's terminating 1
        bits = np.zeros(int(begin[-1]), np.uint8)
        for h, b in zip(heads, begin[:-1], strict=True):
            bits[b : b + len(h)] = h
        bits[stop] = 1
        for j in range(int(k.max())):
            some = slice(None) if (k > j).all() else kf > j
            bits[stop[some] + 1 + j] = flat[some] >> (kf[some] - 1 - j) & 1
        packed = np.packbits(bits).tobytes()
        for i, a, b in zip(rice, begin[:-1] // 8, begin[1:] // 8, strict=True):
            sub[i] = packed[a:b]
    for i in range(rows):
        out[i] = _header(numbers[i], int(lengths[i])) + sub[i]
    return [f + struct.pack(">H", int(c)) for f, c in zip(out, crc16(out), strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a byte b is the sample b - 128."""
    samples = [(np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8) for p in payloads]
    where = [(i, at) for i, s in enumerate(samples) for at in range(0, len(s), BLOCK)]
    parts = [samples[i][at : at + BLOCK] for i, at in where]
    frames: list[list[bytes]] = [[b""] * -(-len(s) // BLOCK) for s in samples]
    if parts:
        for group in _groups(np.array([len(p) for p in parts])):
            for g, f in zip(group, encode_frames([parts[g] for g in group], [where[g][1] // BLOCK for g in group]), strict=True):
                frames[where[g][0]][where[g][1] // BLOCK] = f
    out = []
    for s, own in zip(samples, frames, strict=True):
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes, default=0).to_bytes(3) + max(sizes, default=0).to_bytes(3) + (RATE << 44 | 7 << 36 | len(s)).to_bytes(8) + hashlib.md5(s.tobytes()).digest()
        seek, at = [], 0
        for i, size in enumerate(sizes):
            seek.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(s) - i * BLOCK)))
            at += size
        # a metadata block's size has 24 bits; longer streams do without the table and are scanned
        table = b"".join(seek) if len(seek) * 18 < 1 << 24 else b""
        out.append(b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x83" + len(table).to_bytes(3) + table + b"".join(own))
    return out


# -- decoding ----------------------------------------------------------------------------------------------


@dataclass
class Frame:
    first: int  # sample
    n: int
    begin: int  # byte in the stream
    end: int
    body: int  # where the subframe begins


@dataclass
class Stream:
    data: bytes
    total: int
    md5: bytes
    frames: list[Frame]


def _parse_header(data: bytes, at: int, block: int) -> tuple[int, int, int] | None:
    """(number, samples, byte after the header) of a frame header with a right CRC-8; None for anything else."""
    if data[at : at + 2] != b"\xff\xf8" or at + 6 > len(data):
        return None
    code, rate, kind = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3]
    if kind != 0b0000_001_0 and kind != 0 or rate > 11 or code not in (1, 6, 7) and not 2 <= code <= 5 and not 8 <= code <= 15:
        return None
    p, first = at + 5, data[at + 4]
    size = 0 if first < 128 else 8 - (first ^ 0xFF).bit_length()
    if size == 1 or size > 7:
        return None
    number = first if not size else first & (0x7F >> size)
    for b in data[p : p + max(0, size - 1)]:
        if b >> 6 != 2:
            return None
        number = number << 6 | b & 63
    p += max(0, size - 1)
    if code in (6, 7):
        n = int.from_bytes(data[p : p + code - 5]) + 1
        p += code - 5
    else:
        n = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    return (number, n, p + 1) if p < len(data) and crc8(data[at:p]) == data[p] else None


def open_stream(data: bytes) -> Stream:
    """Finds the frames: from the seek table where it has all of them, else by their headers and checksums."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, b"", b""
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        body = data[at + 4 : at + 4 + size]
        info, seek, at = body if kind == 0 else info, body if kind == 3 else seek, at + 4 + size
    packed = int.from_bytes(info[10:18])
    total, block = packed & (1 << 36) - 1, int.from_bytes(info[2:4])
    if packed >> 41 & 7 or (packed >> 36 & 31) + 1 != 8:
        raise ValueError("only one channel of 8-bit samples is supported")
    points = [struct.unpack(">QQH", seek[i : i + 18]) for i in range(0, len(seek), 18)]
    points = [p for p in points if p[0] != (1 << 64) - 1]
    starts: list[int] = []
    if points and sum(p[2] for p in points) == total:
        starts = [at + p[1] for p in points]
    else:
        p, seen = at, 0
        while p >= 0 and seen < total:
            if (h := _parse_header(data, p, block)) and h[0] == len(starts) and (not starts or int(crc16([data[starts[-1] : p - 2]])[0]) == int.from_bytes(data[p - 2 : p])):
                starts.append(p)
                seen += h[1]
            p = data.find(b"\xff\xf8", p + 1)
    frames, seen = [], 0
    for i, p in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else len(data)
        if (h := _parse_header(data, p, block)) is None or h[0] != i:
            raise ValueError(f"frame {i}: damaged header")
        frames.append(Frame(seen, h[1], p, end, h[2]))
        seen += h[1]
    if seen != total:
        raise ValueError(f"{seen} samples in frames, {total} declared")
    return Stream(data, total, info[18:34], frames)


def _read(flat: np.ndarray, pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """`width` bits (17 at most) at each bit position of a byte array with three bytes to spare."""
    byte = pos >> 3
    word = flat[byte].astype(np.int64) << 16 | flat[byte + 1].astype(np.int64) << 8 | flat[byte + 2]
    return word >> (24 - (pos & 7) - width) & ((np.int64(1) << width) - 1)


def decode_frames(streams: list[Stream], which: list[tuple[int, int]]) -> list[np.ndarray]:
    """Samples (int8) of the frames (stream, frame); raises ValueError where a checksum is wrong."""
    out: list[np.ndarray] = [np.array([], np.int8)] * len(which)
    if not which:
        return out
    lengths = np.array([streams[s].frames[f].n for s, f in which])
    for group in _groups(lengths):
        raw = [streams[which[g][0]].data[(f := streams[which[g][0]].frames[which[g][1]]).begin : f.end] for g in group]
        wrong = crc16(raw) != 0  # the footer makes a whole frame's CRC zero
        if wrong.any():
            raise ValueError(f"frame {which[group[int(np.argmax(wrong))]][1]}: wrong CRC-16")
        coded: list[tuple[int, bytes, int, int]] = []  # place, body, order, LPC
        for g, b in zip(group, raw, strict=True):
            f = streams[which[g][0]].frames[which[g][1]]
            body = b[f.body - f.begin : -2]
            kind = body[0] >> 1
            if body[0] & 0x81:
                raise ValueError("wasted bits are not supported")
            if kind == 0:
                out[g] = np.full(f.n, np.frombuffer(body[1:2], np.int8)[0], np.int8)
            elif kind == 1:
                out[g] = np.frombuffer(body[1 : 1 + f.n], np.int8)
            elif 8 <= kind <= 12:
                coded.append((int(g), body, kind - 8, 0))
            elif kind >= 32:
                coded.append((int(g), body, kind - 31, 1))
            else:
                raise ValueError("reserved subframe type")
        for order, lpc in sorted({c[2:] for c in coded}):
            own = [c for c in coded if c[2:] == (order, lpc)]
            for c, s in zip(own, _decode_rice([c[1] for c in own], lengths[[c[0] for c in own]], order, bool(lpc)), strict=True):
                out[c[0]] = s
    return out


def _decode_rice(bodies: list[bytes], lengths: np.ndarray, order: int, lpc: bool) -> list[np.ndarray]:
    """Subframes of one predictor order, of falling length, row by row at once."""
    rows, width = len(bodies), int(lengths[0])
    flat = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    begin = np.cumsum([0, *map(len, bodies)])[:-1] * 8
    x = np.zeros((rows, width), np.int64)
    warm = [np.frombuffer(b[1 : 1 + order], np.int8) for b in bodies]
    for i in range(order):
        x[:, i] = [w[i] for w in warm]
    pos = begin + 8 + 8 * order
    if lpc:
        precision = _read(flat, pos, 4) + 1
        shift = _read(flat, pos + 4, 5)
        shift -= (shift >> 4) * 32
        if (shift < 0).any():
            raise ValueError("negative predictor shift")
        coef = np.zeros((rows, order), np.int64)
        for j in range(order):
            c = _read(flat, pos + 9 + j * precision, precision)
            coef[:, j] = c - ((c >> precision - 1) << precision)
        pos = pos + 9 + order * precision
    method, parts = _read(flat, pos, 2), _read(flat, pos + 2, 4)
    pos = pos + 6
    param = 4 + method
    part = lengths >> parts  # samples of a partition; the first one's lack the warm-up
    bits = np.unpackbits(flat)
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    nxt = np.minimum.accumulate(ones[::-1])[::-1]
    at = np.zeros((width, rows), np.int64)  # where each sample's low bits begin
    quot = np.zeros((width, rows), np.int32)
    ks = np.zeros((width, rows), np.int8)
    escaped = np.zeros((width, rows), bool)
    k, esc = np.zeros(rows, np.int64), np.zeros(rows, bool)
    active = np.searchsorted(-lengths, -np.arange(width), side="left")  # rows longer than i
    opens = np.zeros(width, bool)
    for p, n in {(int(a), int(b)) for a, b in zip(part, lengths, strict=True)}:
        if p:
            opens[order], opens[p:n:p] = True, True
    for i in range(order, width):
        a = active[i]
        here = pos[:a]
        if opens[i]:
            new = (i == order) | (i % np.maximum(part[:a], 1) == 0) & (i >= part[:a])
            if new.any():
                w = param[:a][new]
                v = _read(flat, here[new], w)
                esc[:a][new] = v == (1 << w) - 1
                raw = _read(flat, here[new] + w, 5)
                k[:a][new] = np.where(v == (1 << w) - 1, raw, v)
                here[new] += w + np.where(v == (1 << w) - 1, 5, 0)
        kk = k[:a]
        stop = nxt[here]
        if esc[:a].any():
            e = esc[:a]
            escaped[i, :a] = e
            quot[i, :a] = np.where(e, 0, stop - here)
            at[i, :a] = np.where(e, here, stop + 1)
            pos[:a] = np.where(e, here + kk, stop + 1 + kk)
        else:
            quot[i, :a] = stop - here
            stop = stop + 1
            at[i, :a] = stop
            pos[:a] = stop + kk
        ks[i, :a] = kk
    low = _read(flat, np.minimum(at, len(bits) - 24), ks.astype(np.int64))
    u = (quot.astype(np.int64) << ks) | low
    res = (u >> 1) ^ -(u & 1)
    if escaped.any():
        res = np.where(escaped, low - ((low >> np.maximum(ks - 1, 0) & 1) << ks) * (ks > 0), res)
    res = res.T
    if lpc:
        past = [x[:, order - 1 - j].copy() for j in range(order)]
        for i in range(order, width):
            total = past[0] * coef[:, 0]
            for j in range(1, order):
                total += past[j] * coef[:, j]
            now = res[:, i] + (total >> shift)
            x[:, i] = now
            past = [now, *past[:-1]]
    elif order == 0:
        x = res
    else:
        # the order-th difference is known: integrate it, with the warm-up's own differences as beginnings
        d = [x[:, :order]]
        for _ in range(order - 1):
            d.append(np.diff(d[-1], axis=1))
        run = res[:, order:]
        for o in range(order - 1, -1, -1):
            run = np.cumsum(run, axis=1) + d[o][:, -1:]
        x[:, order:] = run
    return [x[r, :n].astype(np.int8) for r, n in enumerate(lengths)]


def pcm(samples: np.ndarray) -> bytes:
    """Samples as unsigned bytes, the payload's own."""
    return (samples.view(np.uint8) ^ 0x80).tobytes()


def read_samples(data: bytes, first: int, n: int) -> bytes:
    """Samples first to first + n as unsigned bytes; only the frames that hold them are decoded."""
    s = open_stream(data)
    which = [(0, i) for i, f in enumerate(s.frames) if f.first < first + n and f.first + f.n > first]
    if not which:
        return b""
    skip = first - s.frames[which[0][1]].first
    return pcm(np.concatenate(decode_frames([s], which)))[skip : skip + n]


def decode_many(media: list[bytes]) -> list[bytes]:
    """The payload of each stream; checksums of frames and the whole stream's MD5 are verified."""
    streams = [open_stream(m) for m in media]
    which = [(i, f) for i, s in enumerate(streams) for f in range(len(s.frames))]
    parts: list[list[np.ndarray]] = [[] for _ in media]
    for (i, _), x in zip(which, decode_frames(streams, which), strict=True):
        parts[i].append(x)
    out = []
    for s, p in zip(streams, parts, strict=True):
        whole = np.concatenate(p) if p else np.array([], np.int8)
        if hashlib.md5(whole.tobytes()).digest() != s.md5:
            raise ValueError("wrong MD5 of the samples")
        out.append(pcm(whole))
    return out


# -- DataFrames --------------------------------------------------------------------------------------------


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `n_bytes` long and `media` binary: a FLAC stream of each whole text's padded bytes.

    A null text counts as empty. Every row gives one, repeated ones too; an empty df gives no rows; other columns are not read, and
    `keep` must not name the results. No shuffle; memory is bounded by a batch and a group of frames.
    """
    small_batches(df.sparkSession)
    narrow = df.select(*keep, text)
    schema = T.StructType([*narrow.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b[text].to_pylist()
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(encode_many([payload(t) for t in texts]), pa.binary())], schema.names)

    return map_batches(narrow, run, schema)


def features(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `payload_bytes`, `payload_sha256`, `tail_crc32`, `media_bytes`, `media_sha256` and `feature`, from the stored bytes.

    feature: frames, sum, sum of squares, peak and zero crossings of the samples. Null media give nulls; a
    stream whose checksums fail raises. Repeated rows are kept, an empty df gives no rows; `keep` must not name the results.
    """
    small_batches(df.sparkSession)
    narrow = df.select(*keep, media)
    schema = T.StructType([*narrow.select(*keep).schema.fields, *T._parse_datatype_string("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").fields])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        stored = b[media].to_pylist()
        there = [m for m in stored if m is not None]
        read = iter(decode_many(there))
        rows = []
        for m in stored:
            if m is None:
                rows.append((None,) * 6)
                continue
            raw = next(read)
            x = (np.frombuffer(raw, np.uint8) ^ 0x80).view(np.int8)
            wide = x.astype(np.int32)
            crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            feature = f"frames={-(-len(x) // BLOCK)} sum={int(wide.sum(dtype=np.int64))} squares={int((wide * wide).sum(dtype=np.int64))} peak={int(np.abs(wide).max(initial=0))} crossings={crossings}"
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.int64()), ("d", pa.int64()), ("e", pa.string()), ("f", pa.string())]), strict=True))], schema.names)

    return map_batches(narrow, run, schema)


def pcm_blocks(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each frame: `keep`, `block` int, `first_sample` long, `n_samples` int, `byte_offset` long (in the stream) and `pcm` binary. Null media give no rows."""
    small_batches(df.sparkSession)
    narrow = df.select(*keep, media).where(f"{media} is not null")
    schema = T.StructType([*narrow.select(*keep).schema.fields, *T._parse_datatype_string("block int, first_sample long, n_samples int, byte_offset long, pcm binary").fields])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        streams = [open_stream(m) for m in b[media].to_pylist()]
        which = [(i, f) for i, s in enumerate(streams) for f in range(len(s.frames))]
        own = [streams[i].frames[f] for i, f in which]
        cols = [pa.array([f for _, f in which], pa.int32()), pa.array([f.first for f in own], pa.int64()), pa.array([f.n for f in own], pa.int32()), pa.array([f.begin for f in own], pa.int64()), pa.array([pcm(x) for x in decode_frames(streams, which)], pa.binary())]
        rows = pa.array([i for i, _ in which], pa.int64())
        return pa.RecordBatch.from_arrays([*(b[c].take(rows) for c in keep), *cols], schema.names)

    return map_batches(narrow, run, schema)
