"""A session: loaded traces, cursor, scope, group, aliases, virtual signals."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.model import TraceSet, empty_trace
from sigspark.operators import scopes as names_of
from sigspark.operators import search
from sigspark.sources.sink import read_store
from sigspark.timeexpr import Expr, sig

#: A signal's changes are kept on the driver for point reads up to this many; beyond it a read is a query. Signals kept.
POINT_ROWS, POINT_SIGNALS = 200_000, 256


@dataclass
class Trace:
    """One loaded trace and its cursor."""

    trace_id: str
    file: str
    data: TraceSet
    names: list[str]
    widths: dict[str, int]
    max_index: int
    index: int = 0
    points: OrderedDict[str, tuple[list[int], list] | None] = field(default_factory=OrderedDict)

    def kind(self, name: str) -> str:
        return self.data.kinds.get(name, self.data.kind)

    def signal(self, name: str) -> Expr:
        return sig(name, self.kind(name))

    def value(self, name: str, index: int):
        """The value held at an index; 0 while unknown."""
        if name not in self.points:
            v = self.data.value(name)
            own = self.data.of(name).groupBy("idx").agg(F.max_by(v, "seq").alias("v"))
            rows = own.limit(POINT_ROWS + 1).collect()
            self.points[name] = None if len(rows) > POINT_ROWS else tuple(zip(*sorted((r.idx, r.v) for r in rows), strict=True)) or ((), ())
            if len(self.points) > POINT_SIGNALS:
                self.points.popitem(last=False)
        kept = self.points[name]
        pulse = name in self.data.pulses
        if kept is not None:
            i = bisect_right(kept[0], index) - 1
            if i < 0 or pulse and kept[0][i] != index:
                return 0
            return kept[1][i] if kept[1][i] is not None else 0
        row = search.sample_at(self.data, name, index).first()
        return row.value if row else 0

    def time(self, index: int) -> int:
        row = self.data.timestamps.where(F.col("idx") == index).first()
        return row.ts if row else 0


class Session:
    """The engine's Python interface; the language runs on the same object."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.traces: dict[str, Trace] = {}
        self.scope = ""
        self.group = ""
        self.aliases: dict[str, str] = {}
        self.virtual: dict[str, object] = {}

    # -- loading -------------------------------------------------------------------------------------------

    def load(self, path: str, trace_id: str | None = None) -> Trace:
        """Loads a dump (.vcd, .vcd.gz, .vcd.bz2, a folder of parts), a binary trace (.fst) or a native store; unknown endings are told by their first bytes."""
        trace_id = trace_id or f"t{len(self.traces)}"
        kind = detect_format(self.spark, path)
        if kind == "fst":
            from sigspark.sources.fst import read_fst

            data = read_fst(self.spark, path, trace_id, len(self.traces))
        elif kind == "store":
            data = read_store(self.spark, path)
        else:
            from sigspark.sources.vcd import read_vcd

            data = read_vcd(self.spark, path, trace_id, len(self.traces))
        return self.attach(trace_id, data, path)

    def attach(self, trace_id: str, data: TraceSet, file: str = "") -> Trace:
        """A trace of a set already built; the set must hold one trace."""
        rows = [(r.name, r.width) for r in data.signals.orderBy("decl_order", "name").select("name", "width").collect()]
        top = data.traces.select("max_index").first()
        self.traces[trace_id] = t = Trace(trace_id, file, data, [n for n, _ in rows], dict(rows), top.max_index if top else -1)
        return t

    def new_trace(self, trace_id: str, indices: int) -> Trace:
        return self.attach(trace_id, empty_trace(self.spark, trace_id, indices))

    def unload(self, trace_id: str) -> None:
        self.traces.pop(trace_id, None)

    def first(self) -> Trace:
        if not self.traces:
            raise LookupError("no trace is loaded")
        return next(iter(self.traces.values()))

    # -- cursor --------------------------------------------------------------------------------------------

    def step(self, n: int = 1, trace_id: str | None = None) -> bool:
        """Moves cursors; false, and that cursor stays, where it would pass the end. Backward stops at 0."""
        done = True
        for t in [self.traces[trace_id]] if trace_id is not None else list(self.traces.values()):
            if t.index + n > t.max_index:
                done = False
            else:
                t.index = max(0, t.index + n)
        return done

    @contextmanager
    def timeframe(self) -> Iterator[None]:
        """Restores every cursor afterwards."""
        was = {k: t.index for k, t in self.traces.items()}
        try:
            yield
        finally:
            for k, i in was.items():
                if k in self.traces:
                    self.traces[k].index = i

    @contextmanager
    def scoped(self, scope: str | None = None, group: str | None = None) -> Iterator[None]:
        was = self.scope, self.group
        self.scope, self.group = (was[0] if scope is None else scope), (was[1] if group is None else group)
        try:
            yield
        finally:
            self.scope, self.group = was

    # -- names ---------------------------------------------------------------------------------------------

    def resolve(self, name: str, exact: bool = False) -> tuple[Trace, str] | None:
        name = self.aliases.get(name, name)
        for t in self.traces.values():
            for n in (name, self.scope + name, self.group + name):
                if n in t.widths:
                    return t, n
        if not exact:
            for t in self.traces.values():
                if n := names_of.resolve(t.names, name, self.scope, self.group):
                    return t, n
        return None

    def groups(self, *suffixes: str) -> list[str]:
        rows = self.spark.createDataFrame([(n,) for t in self.traces.values() for n in t.names] or [("",)], "name string")
        return [r.prefix for r in names_of.groups(rows, list(suffixes)).collect()]

    def scopes(self) -> list[str]:
        return sorted({n.rsplit(".", 1)[0] for t in self.traces.values() for n in t.names if "." in n} | {r.path for t in self.traces.values() if t.data.scopes is not None for r in t.data.scopes.select("path").collect()})

    def local_scopes(self) -> list[str]:
        rest = [s[len(self.scope) :] for s in (f"{x}." for x in self.scopes()) if s.startswith(self.scope) and len(s) > len(self.scope)]
        return sorted({r.split(".", 1)[0] + "." for r in rest})

    # -- values and searches -------------------------------------------------------------------------------

    def get(self, name: str):
        found = self.resolve(name)
        if not found:
            raise LookupError(f"no signal {name}")
        return found[0].value(found[1], found[0].index)

    def sample_at(self, name: str, index: int):
        for t in self.traces.values():
            if (n := names_of.resolve(t.names, self.aliases.get(name, name), self.scope, self.group)) and 0 <= index <= t.max_index:
                return t.value(n, index)
        return None

    def indices(self, conds: dict[str, Expr], limit: int | None = None) -> list[int]:
        """Distinct indices, ascending, over the traces that have a condition."""
        out: DataFrame | None = None
        for k, c in conds.items():
            own = search.find_by_trace(self.traces[k].data, c).select("idx")
            out = own if out is None else out.unionByName(own)
        if out is None:
            return []
        out = out.distinct().orderBy("idx")
        return [r.idx for r in (out if limit is None else out.limit(limit)).collect()]

    def counts(self, conds: dict[str, list[Expr]]) -> list[int]:
        total: list[int] = []
        for k, cs in conds.items():
            row = list(search.count(self.traces[k].data, *cs).first())
            total = row if not total else [a + b for a, b in zip(total, row, strict=True)]
        return total


def detect_format(spark: SparkSession, path: str) -> str:
    """vcd, fst or store: by ending, else by the first bytes."""
    if re.search(r"\.vcd(\.gz|\.bz2)?/?$", path):
        return "vcd"
    if path.endswith(".fst"):
        return "fst"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(path)
    if fs.isDirectory(fs_path):
        return "store" if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "changes")) else "vcd"
    stream = fs.open(fs_path)
    try:
        head = bytes(stream.read() & 0xFF for _ in range(min(3, fs.getFileStatus(fs_path).getLen())))
    finally:
        stream.close()
    if head[:3] in (b"$da", b"$ti", b"$ve", b"$sc", b"$co"):
        return "vcd"
    if head[:1] in (b"\x00", b"\x01", b"\x03", b"\x04", b"\xfe"):
        return "fst"
    raise ValueError(f"{path}: unknown trace format")
