"""Expressions over signals and time, compiled to one Column over elementary intervals.

An expression knows which (signal, offset) pairs it reads. For those, the change points of all pairs make a
frame of elementary intervals on which every pair is constant; the expression is evaluated once per interval,
not per index.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.model import TraceSet
from sigspark.operators.held import expand, hold

Ref = tuple[str, int]


@dataclass
class At:
    """What an expression sees at an index: held values, the index, whether an offset stays on the axis."""

    held: Callable[[str, int], Column]
    offset: int = 0

    def value(self, name: str) -> Column:
        return self.held(name, self.offset)

    def inside(self, offset: int) -> Column:
        at = F.col("idx") + (self.offset + offset)
        return (at >= 0) & (at <= F.col("max_index"))

    def index(self) -> Column:
        return F.col("idx") + self.offset

    def time(self) -> Column:
        return F.col("ts")


def truthy(x: Column, kind: str) -> Column:
    """False for null, false, 0, and empty text and lists."""
    if kind == "bool":
        return F.coalesce(x, F.lit(False))
    if kind == "str":
        return F.coalesce(x != "", F.lit(False))
    if kind == "list":
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return F.coalesce(x != 0, F.lit(False))


@dataclass
class Expr:
    """kind: int, real, str or bool. dense: the index or time itself is read, so every index is looked at."""

    build: Callable[[At], Column]
    refs: frozenset[Ref]
    kind: str = "int"
    dense: bool = False
    timed: bool = False

    def _with(self, other: Any, op: Callable[[Column, Column], Column], kind: str) -> Expr:
        o = other if isinstance(other, Expr) else const(other)
        return Expr(lambda at: op(self.build(at), o.build(at)), self.refs | o.refs, kind, self.dense or o.dense, self.timed or o.timed)

    def _num(self, o: Any) -> str:
        return "real" if "real" in (self.kind, o.kind if isinstance(o, Expr) else "real" if isinstance(o, float) else "int") else "int"

    # a value that lies off the axis is null: unequal to anything, in no order to anything
    def __eq__(self, o: Any) -> Expr:  # type: ignore[override]
        return self._with(o, lambda a, b: F.coalesce(a == b, F.lit(False)), "bool")

    def __ne__(self, o: Any) -> Expr:  # type: ignore[override]
        return self._with(o, lambda a, b: F.coalesce(a != b, F.lit(True)), "bool")

    def __gt__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: F.coalesce(a > b, F.lit(False)), "bool")

    def __lt__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: F.coalesce(a < b, F.lit(False)), "bool")

    def __ge__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: F.coalesce(a >= b, F.lit(False)), "bool")

    def __le__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: F.coalesce(a <= b, F.lit(False)), "bool")

    def __and__(self, o: Any) -> Expr:
        return self.true()._with(as_expr(o).true(), lambda a, b: a & b, "bool")

    def __or__(self, o: Any) -> Expr:
        return self.true()._with(as_expr(o).true(), lambda a, b: a | b, "bool")

    def __invert__(self) -> Expr:
        return self.true().map(lambda x: ~x, "bool")

    def __add__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a + b, self._num(o))

    def __sub__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a - b, self._num(o))

    def __mul__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a * b, self._num(o))

    def __truediv__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a.cast("double") / b.cast("double"), "real")

    def __mod__(self, o: Any) -> Expr:
        return self._with(o, lambda a, b: a.cast("long") % b.cast("long"), "int")

    __hash__ = None  # type: ignore[assignment]

    def map(self, f: Callable[[Column], Column], kind: str | None = None) -> Expr:
        return Expr(lambda at: f(self.build(at)), self.refs, kind or self.kind, self.dense, self.timed)

    def true(self) -> Expr:
        return self.map(lambda x: truthy(x, self.kind), "bool")

    def at(self, offset: int) -> Expr:
        """The expression `offset` indices later; off the axis it is null, which is false."""
        if self.timed:
            raise ValueError("the time itself can't be shifted")
        build = self.build

        def shifted(at: At) -> Column:
            inner = build(At(at.held, at.offset + offset))
            return F.when(at.inside(offset), inner)

        # the shift's own bound is a reference too, so that no interval crosses it
        return Expr(shifted, frozenset((n, k + offset) for n, k in self.refs) | {("", offset)}, self.kind, self.dense)

    def bits(self, high: int, low: int | None = None) -> Expr:
        low = high if low is None else low
        return self.map(lambda x: F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1)), "int")


def const(v: Any) -> Expr:
    kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "real" if isinstance(v, float) else "str"
    return Expr(lambda at: F.lit(v), frozenset(), kind)


def as_expr(v: Any) -> Expr:
    return v if isinstance(v, Expr) else const(v)


def sig(name: str, kind: str = "int") -> Expr:
    """The held value of a signal, by its full name."""
    return Expr(lambda at: at.value(name), frozenset({(name, 0)}), kind)


#: Marks a reference to whether a signal's value is known, in place of the value.
KNOWN = "\0"


def known(name: str) -> Expr:
    """Whether the held value has no unknown bits; with it a condition can leave unknown values out: `known(s) & (sig(s) != 1)`."""
    return Expr(lambda at: at.value(KNOWN + name), frozenset({(KNOWN + name, 0)}), "bool")


INDEX = Expr(lambda at: at.index(), frozenset(), "int", True)
TS = Expr(lambda at: at.time(), frozenset(), "int", True, True)


def rising(s: Expr) -> Expr:
    """1 now and 0 at the index before; never at index 0."""
    return (s == 1) & (s.at(-1) == 0)


def falling(s: Expr) -> Expr:
    return (s == 0) & (s.at(-1) == 1)


def all_of(*conditions: Expr) -> Expr:
    out = as_expr(conditions[0])
    for c in conditions[1:]:
        out = out & c
    return out


def any_of(*conditions: Expr) -> Expr:
    out = as_expr(conditions[0])
    for c in conditions[1:]:
        out = out | c
    return out


def frame(s: TraceSet, *exprs: Expr) -> tuple[DataFrame, At]:
    """(elementary intervals, how to evaluate the expressions on them).

    Columns: trace_id, idx, end_idx, max_index and a value for each pair read. One shuffle by trace (or by trace and
    bucket): only changes of the signals read, from the columns read, take part.
    """
    refs = sorted(frozenset().union(*(e.refs for e in exprs)))
    read = [r for r in refs if r[0]]
    number = {r: f"v{i}" for i, r in enumerate(read)}
    zero = F.lit(0).cast("long")
    offsets = sorted({k for _, k in refs} - {0})
    edges = [zero] + [(F.col("max_index") - k + 1 if k > 0 else F.lit(-k).cast("long")) for k in offsets]
    axis = s.traces.select("trace_id", "max_index")
    parts = [axis.select("trace_id", F.explode(F.array_distinct(F.array(*edges))).alias("idx"), "max_index").where("idx between 0 and max_index")]
    if read:
        plain = lambda n: n.removeprefix(KNOWN)
        names = sorted({plain(n) for n, _ in read})
        changes = s.of(*names).select("trace_id", "name", "idx", "seq", *sorted({s.value(n) for n in names} | ({"ival_strict"} if any(n != plain(n) for n, _ in read) else set())))
        if pulses := s.pulses & set(names):  # an event is 1 at its index only
            ends = changes.where(F.col("name").isin(sorted(pulses))).withColumn("idx", F.col("idx") + 1).withColumn("seq", F.lit(-1).cast("long")).withColumn("ival", zero)
            changes = changes.unionByName(ends)
        shifts = F.array(*[F.struct(F.lit(plain(n)).alias("n"), F.lit(k).alias("k"), F.lit(i).alias("i")) for i, (n, k) in enumerate(read)])
        moved = changes.select("*", F.explode(F.filter(shifts, lambda x: x["n"] == F.col("name"))).alias("m")).withColumn("at", F.col("idx") - F.col("m.k"))
        cols = []
        for i, (n, _) in enumerate(read):
            cols.append(F.when(F.col("m.i") == i, F.struct(F.col("idx"), F.col("seq"), (F.col(s.value(n)) if n == plain(n) else F.col("ival_strict").isNotNull()).alias("v"))).alias(f"s{i}"))
        parts.append(moved.select("trace_id", F.greatest(F.col("at"), zero).alias("idx"), F.lit(None).cast("long").alias("max_index"), *cols))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], True)
    # one exchange serves the grouping and the windows
    keys = ["trace_id"]
    if s.bucket:
        rows, keys = rows.withColumn("_b", F.floor(F.col("idx") / s.bucket)), ["trace_id", "_b"]
    points = rows.repartition(*keys).groupBy(*keys, "idx").agg(F.max("max_index").alias("max_index"), *[F.max(f"s{i}")["v"].alias(f"v{i}") for i in range(len(read))])
    filled = hold(points, ["trace_id"], "idx", ["max_index", *number.values()], s.bucket, "end_idx")
    filled = filled.where("idx <= max_index").withColumn("end_idx", F.least(F.coalesce("end_idx", F.col("max_index") + 1), F.col("max_index") + 1))

    def held(name: str, offset: int) -> Column:
        if name.startswith(KNOWN):
            return F.coalesce(F.col(number[name, offset]), F.lit(False))
        unknown = {"ival": F.lit(0).cast("long"), "rval": F.lit(0.0), "bits": F.lit("x")}[s.value(name)]
        return F.coalesce(F.col(number[name, offset]), unknown)

    return filled, At(held)


def dense(s: TraceSet, df: DataFrame, timed: bool) -> DataFrame:
    """A row for each index of the intervals, with its time if asked for."""
    out = expand(df).withColumn("end_idx", F.col("idx") + 1)
    return out.join(s.timestamps, ["trace_id", "idx"]) if timed else out


def evaluated(s: TraceSet, **exprs: Expr) -> DataFrame:
    """trace_id, idx, end_idx and each expression's value over the intervals (or every index, if one reads the index)."""
    df, at = frame(s, *exprs.values())
    if any(e.dense for e in exprs.values()):
        df = dense(s, df, any(e.timed for e in exprs.values()))
    return df.select("trace_id", "idx", "end_idx", *[e.build(at).alias(n) for n, e in exprs.items()])
