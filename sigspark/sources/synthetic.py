"""Generated dumps with closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toggle_header(signals: int) -> list[str]:
    return ["$timescale 1ns $end", "$scope module test $end", *(f"$var wire 1 s{i} sig{i} $end" for i in range(1, signals + 1)), "$upscope $end", "$enddefinitions $end", "$dumpvars", *(f"0s{i}" for i in range(1, signals + 1)), "$end"]


def toggle_lines(spark: SparkSession, signals: int, timestamps: int, step: int = 1000) -> DataFrame:
    """A dump's lines, in order of (t, place): signal i is 0 at time t (from 1) if t + i is even, else 1."""
    head = spark.createDataFrame([(0, i, x) for i, x in enumerate(toggle_header(signals))], "t long, place int, value string")
    t = spark.range(1, timestamps + 1).select(F.col("id").alias("t"))
    body = t.select("t", F.explode(F.sequence(F.lit(0), F.lit(signals))).alias("place"))
    value = F.when(F.col("place") == 0, F.concat(F.lit("#"), (F.col("t") * step).cast("string"))).otherwise(F.concat(((F.col("t") + F.col("place")) % 2).cast("string"), F.lit("s"), F.col("place").cast("string")))
    return head.unionByName(body.select("t", "place", value.alias("value")))


def write_toggle(spark: SparkSession, path: str, signals: int = 100, timestamps: int = 1000) -> None:
    toggle_lines(spark, signals, timestamps).orderBy("t", "place").select("value").write.mode("overwrite").text(path)
