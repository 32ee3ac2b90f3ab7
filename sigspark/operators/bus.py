"""Bus analysis: handshakes, utilisation, bandwidth, mix of operations, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.model import TraceSet
from sigspark.operators.held import as_of, running_total
from sigspark.operators.search import find_by_trace
from sigspark.timeexpr import Expr, evaluated


def handshakes(s: TraceSet, valid: Expr, ready: Expr) -> DataFrame:
    """(trace_id, idx) of every index at which both hold."""
    return find_by_trace(s, valid & ready)


def utilisation(s: TraceSet, valid: Expr, ready: Expr) -> DataFrame:
    """One row: valid_cycles, stalls (valid without ready), beats (both), cycles and util_pct."""
    df = evaluated(s, v=valid.true(), r=ready.true()).withColumn("n", F.col("end_idx") - F.col("idx"))
    of = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0)).cast("long")
    out = df.agg(of("v").alias("valid_cycles"), of("v and not r").alias("stalls"), of("v and r").alias("beats"), of("true").alias("cycles"))
    return out.withColumn("util_pct", F.round(F.when(F.col("cycles") > 0, 100.0 * F.col("beats") / F.col("cycles")).otherwise(0.0), 4))


def bandwidth(s: TraceSet, valid: Expr, ready: Expr, bytes_per_beat: int) -> DataFrame:
    """Per trace: beats, bytes, and bytes an index."""
    df = evaluated(s, c=valid & ready).withColumn("n", F.col("end_idx") - F.col("idx"))
    out = df.groupBy("trace_id").agg(F.coalesce(F.sum(F.when(F.col("c"), F.col("n"))), F.lit(0)).cast("long").alias("beats"), F.sum("n").cast("long").alias("cycles"))
    return out.select("trace_id", "beats", (F.col("beats") * bytes_per_beat).alias("bytes"), F.round(F.col("beats") * bytes_per_beat / F.col("cycles"), 4).alias("bytes_per_cycle"))


def mix(s: TraceSet, cond: Expr, opcode: Expr, first: int | None = None) -> DataFrame:
    """(opcode, n) over the matching indices, or over each trace's first ones."""
    df = evaluated(s, c=cond.true(), op=opcode).where("c")
    if first is None:
        return df.groupBy("op").agg(F.sum(F.col("end_idx") - F.col("idx")).cast("long").alias("n")).select(F.col("op").alias("opcode"), "n")
    # matches before an interval of the same trace; only what is left of the first ones counts
    df = running_total(df.withColumn("n", F.col("end_idx") - F.col("idx")), ["trace_id"], "idx", "n", "seen", s.bucket)
    df = df.withColumn("n", F.least(F.col("n"), F.lit(first) - F.col("seen"))).where("n > 0")
    return df.groupBy("op").agg(F.sum("n").cast("long").alias("n")).select(F.col("op").alias("opcode"), "n")


def latency(s: TraceSet, request: Expr, response: Expr, every: int = 1) -> DataFrame:
    """Per trace over every `every`-th index at which `request` holds: samples, and least, largest and total distance to the next index, strictly after, at which `response` holds. Requests without a later response are left out.

    Works on intervals: within one, the sampled indices are an arithmetic progression, and the next response is at the next
    index if the interval has responses itself (but for its last index), else at the start of the next one that has.
    """
    df = evaluated(s, q=request.true(), p=response.true())
    starts = df.where("p").select("trace_id", (-F.col("idx")).alias("at"), F.col("idx").alias("next"))
    asked = running_total(df.where("q").withColumn("n", F.col("end_idx") - F.col("idx")), ["trace_id"], "idx", "n", "seen", s.bucket)
    asked = as_of(asked.withColumn("at", -F.col("end_idx")), starts, ["trace_id"], "at", ["next"], s.bucket)
    # the first sampled index of the interval, and how many there are in the interval and before its last index
    first = F.col("idx") + F.pmod(-F.col("seen"), F.lit(every))
    upto = lambda end: F.greatest(F.floor((end - F.col("i") + every - 1) / every), F.lit(0))
    rows = asked.withColumn("i", first).withColumn("m", upto(F.col("end_idx"))).withColumn("inner", upto(F.col("end_idx") - 1))
    known = F.col("next").isNotNull()
    near = F.struct(F.col("inner").alias("k"), F.lit(1).cast("long").alias("low"), F.lit(1).cast("long").alias("high"), F.col("inner").alias("sum"))
    d = F.col("next") - F.col("end_idx") + 1
    last = F.struct((F.col("m") - F.col("inner")).alias("k"), d.alias("low"), d.alias("high"), ((F.col("m") - F.col("inner")) * d).alias("sum"))
    low, high = F.col("next") - F.col("i") - every * (F.col("m") - 1), F.col("next") - F.col("i")
    far = F.struct(F.col("m").alias("k"), low.alias("low"), high.alias("high"), (F.col("m") * (low + high) / 2).cast("long").alias("sum"))
    parts = F.when(F.col("p"), F.when(known, F.array(near, last)).otherwise(F.array(near))).when(known, F.array(far)).otherwise(F.array().cast("array<struct<k:bigint,low:bigint,high:bigint,sum:bigint>>"))
    out = rows.select("trace_id", F.explode(parts).alias("x")).where("x.k > 0")
    return out.groupBy("trace_id").agg(F.sum("x.k").alias("samples"), F.min("x.low").alias("least"), F.max("x.high").alias("largest"), F.sum("x.sum").alias("total"))
