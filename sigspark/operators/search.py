"""Finding, counting and reading over traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.model import TraceSet
from sigspark.operators.held import CHUNK, as_of, expand, hold
from sigspark.timeexpr import Expr, evaluated, sig


def matches(s: TraceSet, cond: Expr) -> DataFrame:
    """(trace_id, idx, end_idx) of the intervals over which the condition is true."""
    return evaluated(s, c=cond.true()).where("c").drop("c")


def find_by_trace(s: TraceSet, cond: Expr) -> DataFrame:
    """(trace_id, idx) of every index at which the condition is true: only matching intervals are expanded."""
    return expand(matches(s, cond))


def find(s: TraceSet, cond: Expr, limit: int | None = None, from_index: int = 0) -> DataFrame:
    """Distinct indices over all traces, ascending, from an index on; at most `limit`.

    With a limit of n, only the n intervals with the smallest distinct starts are expanded, by n indices at most: what any other
    holds comes after n indices.
    """
    hit = matches(s, cond).where(F.col("end_idx") > from_index).select(F.greatest("idx", F.lit(from_index).cast("long")).alias("idx"), "end_idx")
    if limit is not None:
        hit = hit.groupBy("idx").agg(F.max("end_idx").alias("end_idx")).orderBy("idx").limit(limit).withColumn("end_idx", F.least(F.col("end_idx"), F.col("idx") + limit))
    out = expand(hit).distinct().orderBy("idx")
    return out if limit is None else out.limit(limit)


def find_global(s: TraceSet, cond: Expr) -> DataFrame:
    """Lockstep over all traces: at each step of the longest axis at which the condition holds in any trace that is still on its axis, `step` and `indices`, every trace's index in load order, exhausted ones at their end."""
    hits = find_by_trace(s, cond).select(F.col("idx").alias("step")).distinct()
    ends = s.traces.orderBy("load_order", "trace_id").agg(F.array_sort(F.collect_list(F.struct("load_order", "trace_id", "max_index"))).alias("t"))
    ends = ends.select(F.transform("t", lambda x: x["max_index"]).alias("ends"))
    return hits.withColumn("ends", ends.scalar()).select("step", F.transform("ends", lambda e: F.least(e, F.col("step"))).alias("indices"))


def count(s: TraceSet, *conds: Expr) -> DataFrame:
    """One row, n0, n1, ...: at how many indices, over all traces, each condition is true. One pass, nothing expanded."""
    df = evaluated(s, **{f"c{i}": c.true() for i, c in enumerate(conds)})
    return df.agg(*[F.coalesce(F.sum(F.when(F.col(f"c{i}"), F.col("end_idx") - F.col("idx"))), F.lit(0)).cast("long").alias(f"n{i}") for i in range(len(conds))])


def count_by_trace(s: TraceSet, *conds: Expr) -> DataFrame:
    df = evaluated(s, **{f"c{i}": c.true() for i, c in enumerate(conds)})
    return df.groupBy("trace_id").agg(*[F.coalesce(F.sum(F.when(F.col(f"c{i}"), F.col("end_idx") - F.col("idx"))), F.lit(0)).cast("long").alias(f"n{i}") for i in range(len(conds))])


def whenever(s: TraceSet, cond: Expr, **body: Expr) -> DataFrame:
    """(trace_id, idx, the body's values) at every index at which the condition is true."""
    df = evaluated(s, c=cond.true(), **body).where("c").drop("c")
    return expand(df).select("trace_id", "idx", *body)


def sample_at(s: TraceSet, name: str, index: int) -> DataFrame:
    """(trace_id, value) held at an index in every trace whose axis has it; the scan reads one signal up to the index."""
    v = s.value(name)
    last = s.of(name).where(F.col("idx") <= index).groupBy("trace_id").agg(F.max_by(v, F.struct("idx", "seq")).alias("value"))
    unknown = {"ival": F.lit(0), "rval": F.lit(0.0), "bits": F.lit("x")}[v]
    return s.traces.where(F.col("max_index") >= index).select("trace_id").join(last, "trace_id", "left").select("trace_id", F.coalesce("value", unknown).alias("value"))


def samples(s: TraceSet, name: str, at: DataFrame) -> DataFrame:
    """at (trace_id, idx, ...) with the value held there (0, or x for text, while it is unknown): an as-of join for many points."""
    v = s.value(name)
    own = s.of(name).groupBy("trace_id", "idx").agg(F.max_by(v, "seq").alias("value"))
    unknown = {"ival": F.lit(0).cast("long"), "rval": F.lit(0.0), "bits": F.lit("x")}[v]
    return as_of(at, own, ["trace_id"], "idx", ["value"], s.bucket).withColumn("value", F.coalesce("value", unknown))


def held_dense(s: TraceSet, *names: str) -> DataFrame:
    """A row for each trace and index with every signal's held value (unknown is 0)."""
    df = evaluated(s, **{f"x{i}": sig(n) for i, n in enumerate(names)})
    return expand(df).select("trace_id", "idx", *[F.col(f"x{i}").alias(n) for i, n in enumerate(names)])


def fold_signal(s: TraceSet, name: str, kind: str = "sum", stop: Expr | None = None, start: int = 0) -> DataFrame:
    """(trace_id, value): sum, max, min or last of a signal's held value from an index until, and without, the first index at which `stop` holds."""
    e = {"x": sig(name)} | ({"stop": stop.true()} if stop is not None else {})
    df = evaluated(s, **e).where(F.col("end_idx") > start).withColumn("idx", F.greatest("idx", F.lit(start)))
    if stop is not None:
        first = df.where("stop").groupBy("trace_id").agg(F.min("idx").alias("first"))
        df = df.join(first, "trace_id", "left").where("first is null or idx < first")
    long = F.col("end_idx") - F.col("idx")
    agg = {"sum": F.sum(F.col("x") * long), "max": F.max("x"), "min": F.min("x"), "last": F.max_by("x", "idx"), "count": F.sum(long)}[kind]
    return df.groupBy("trace_id").agg(agg.alias("value"))


def fold_ordered(s: TraceSet, name: str, zero, merge, start: int = 0) -> DataFrame:
    """(trace_id, value): an ordered fold by any Column function merge(acc, x), over a trace's indices from start.

    An ordered fold needs a trace's values in one place: its intervals are gathered, cut to CHUNK indices, and merge is
    applied as often as an interval is long.
    """
    df = evaluated(s, x=sig(name)).where(F.col("end_idx") > start).withColumn("idx", F.greatest("idx", F.lit(start).cast("long")))
    cut = df.withColumn("idx", F.explode(F.sequence("idx", F.col("end_idx") - 1, F.lit(CHUNK).cast("long"))))
    rows = cut.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.least(F.lit(CHUNK).cast("long"), F.col("end_idx") - F.col("idx")).alias("n"), "x"))).alias("r"))
    each = lambda acc, r: F.aggregate(F.sequence(F.lit(1).cast("long"), r["n"]), acc, lambda a, _: merge(a, r["x"]))
    return rows.select("trace_id", F.aggregate("r", zero, each).alias("value"))


def align(s: TraceSet, left: str, right: str, name: str) -> DataFrame:
    """Two traces by index: (idx, left, right), the shorter one held at its end."""
    a, b = (held_dense(s.only(t), name).select("idx", F.col(f"`{name}`").alias(side)) for t, side in ((left, "left_value"), (right, "right_value")))
    both = a.join(b, "idx", "full").withColumn("axis", F.lit(0))
    return hold(both, ["axis"], "idx", ["left_value", "right_value"], 1 << 18).select("idx", "left_value", "right_value")
