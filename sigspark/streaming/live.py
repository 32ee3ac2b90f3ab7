"""Live traces: changes that arrive as a stream become intervals, with the last value of each signal as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INTERVAL = "trace_id string, name string, idx long, end_idx long, value string"


def closed_intervals(changes: DataFrame) -> DataFrame:
    """Intervals that are complete, from a stream of (trace_id, name, idx, value).

    A signal's open interval is its state; a change closes it. A value equal to the held one is dropped. Changes of a signal
    must not arrive for indices before the open interval: such late rows are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, value = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(batches).sort_values("idx", kind="stable").itertuples():
            if idx is None or r.idx == idx and r.value != value:
                idx, value = (r.idx, r.value) if idx is None else (idx, r.value)
            elif r.idx > idx and r.value != value:
                out.append((*key, idx, int(r.idx), value))
                idx, value = int(r.idx), r.value
        if idx is not None:
            state.update((int(idx), value))
        yield pd.DataFrame(out, columns=["trace_id", "name", "idx", "end_idx", "value"])

    return changes.groupBy("trace_id", "name").applyInPandasWithState(step, INTERVAL, "idx long, value string", "append", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (trace_id, name, idx, value) from Parquet files of changes that appear in a folder."""
    return spark.readStream.schema("trace_id string, name string, idx long, value string").parquet(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Changes a signal and window of event time; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "name").agg(F.count(F.lit(1)).alias("n"))


def convert(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Converts what is in the folder to Parquet intervals; run again, it goes on after what the checkpoint has.

    The target has the closed intervals, its folder _open those still open after the run (end_idx null), one a
    signal, written anew from the state by every run. Readers of the target skip _open; converted() gives both.
    """
    q = closed_intervals(follow(spark, folder)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not _committed(spark, checkpoint):
        return  # no batch yet, so no state
    held = spark.read.format("statestore").load(checkpoint)
    open_ = held.select("key.trace_id", "key.name", F.col("value.groupState.idx").alias("idx"), F.lit(None).cast("long").alias("end_idx"), F.col("value.groupState.value").alias("value"))
    open_.write.mode("overwrite").parquet(f"{target}/_open")


def _committed(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the checkpoint has a finished batch."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def converted(spark: SparkSession, target: str) -> DataFrame:
    """All intervals of a conversion: every change opens one; end_idx is null in those still open."""
    read = spark.read.schema(INTERVAL)
    return read.parquet(target).unionByName(read.parquet(f"{target}/_open"))
