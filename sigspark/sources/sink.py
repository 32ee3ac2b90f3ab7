"""Sinks: Parquet, the native store, and value-change dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigspark.model import TraceSet

_TABLES = ("traces", "signals", "timestamps", "changes", "scopes")


def write_store(s: TraceSet, path: str, mode: str = "overwrite") -> None:
    """The tables as Parquet by trace; changes lie sorted by signal and index, so that readers skip row groups."""
    for name in _TABLES:
        df = getattr(s, name)
        if df is not None:
            if name == "changes":
                df = df.repartitionByRange("trace_id", "sig_id", "idx").sortWithinPartitions("trace_id", "sig_id", "idx")
            df.write.mode(mode).partitionBy("trace_id").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, kinds: dict[str, str] | None = None, bucket: int | None = 1 << 18) -> TraceSet:
    read = lambda n: spark.read.parquet(f"{path}/{n}").withColumn("trace_id", F.col("trace_id").cast("string"))
    traces, signals, timestamps, changes = map(read, _TABLES[:4])
    try:
        scopes = read("scopes")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        scopes = None
    known = kinds if kinds is not None else {r.name: "real" for r in signals.where("var_type in ('real', 'realtime', 'shortreal')").select("name").distinct().collect()}
    pulses = frozenset(r.name for r in signals.where("is_event").select("name").distinct().collect())
    return TraceSet(traces, signals, timestamps, changes, scopes, known, "int", bucket, pulses)


def _code(n: int) -> str:
    out = ""
    while True:
        out += chr(33 + n % 94)
        n = n // 94 - 1
        if n < 0:
            return out


def vcd_lines(values: DataFrame, axis: DataFrame, signals: list[tuple[str, int, str]], timescale: str = "1ns", module: str = "top") -> DataFrame:
    """(idx, place, value): a dump's lines in order. values: idx, name, bits (or rval for type real); only changes are written.

    signals: (name, width, type). axis: idx, ts. Equal neighbouring values are left out.
    """
    spark = values.sparkSession
    codes = {n: _code(i) for i, (n, _, _) in enumerate(signals)}
    head = [f"$timescale {timescale} $end", f"$scope module {module} $end", *(f"$var {k} {w} {codes[n]} {n} $end" for n, w, k in signals), "$upscope $end", "$enddefinitions $end"]
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "idx long, place int, value string")
    dim = F.broadcast(spark.createDataFrame([(n, codes[n], w, k, i + 1) for i, (n, w, k) in enumerate(signals)], "name string, code string, width int, kind string, place int"))
    w = Window.partitionBy("name").orderBy("idx")
    rows = values.join(dim, "name")
    text = F.when(F.col("kind") == "real", F.concat(F.lit("r"), F.col("bits"), F.lit(" "), F.col("code"))).when(F.col("width") == 1, F.concat("bits", "code")).otherwise(F.concat(F.lit("b"), F.col("bits"), F.lit(" "), F.col("code")))
    changed = rows.withColumn("was", F.lag("bits").over(w)).where("was is null or was <> bits").select("idx", "place", text.alias("value"))
    times = axis.select("idx", F.lit(0).alias("place"), F.concat(F.lit("#"), F.col("ts").cast("string")).alias("value"))
    return top.unionByName(times).unionByName(changed)


def write_vcd(lines: DataFrame, path: str, single: bool = False) -> None:
    """Text parts that are the dump in name order; one part if single."""
    out = lines.orderBy("idx", "place").select("value")
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)
