"""Contiguous shards of near-equal bytes from global prefix sums.

The rows are range-partitioned by an order, each partition reports its bytes and rows, the
running sums of those few totals give every partition its offset, and one more pass over the
partitions yields each row's global byte interval. Cutting the byte axis at equal targets
gives contiguous shards. Only keys and sizes move, never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import cut, map_stream


def byte_shards(df: DataFrame, size: str, order: list[str], shards: int = 16, partitions: int | None = None) -> DataFrame:
    """df with `shard` int and `slot` long, plus `byte_start` long: where the row's bytes begin in the global order.

    A row goes to the shard in which the middle of its byte interval lies, so every shard's
    bytes differ from the target by less than the largest row. `slot` counts the rows of a
    shard from 0 without gaps. Sizes must be positive, or null, which counts as 0. Ties in `order`
    are broken by the place in the input, so repeated rows spread over partitions like others.
    An empty df gives an empty result. Columns of df named like the results are replaced.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop("shard", "slot", "byte_start")
    keys = [*order, "_place"]
    placed = df.withColumn("_place", F.monotonically_increasing_id()).withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    ordered = cut(placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    totals = sorted(map(tuple, ordered.groupBy("_part").agg(F.sum("_size"), F.count(F.lit(1))).collect()))  # a row for each partition
    base, at, row = {}, 0, 0
    for part, some, count in totals:
        base[part] = (at, row)
        at, row = at + some, row + count
    total = max(at, 1)
    names = [c for c in ordered.columns if c not in ("_place", "_size", "_part")]

    def place(starts: list[int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = row = None
            for b in batches:
                sizes = b["_size"].to_numpy(zero_copy_only=False)
                if at is None:
                    at, row = base[b["_part"][0].as_py()]
                begin = at + np.cumsum(sizes) - sizes
                rows = row + np.arange(len(sizes))
                at, row = int(begin[-1] + sizes[-1]), int(rows[-1] + 1)
                shard = np.minimum((2 * begin + sizes) * shards // (2 * total), shards - 1)
                slot = rows - np.array(starts)[shard] if starts else rows
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(shard, pa.int32()), pa.array(slot, pa.int64()), pa.array(begin, pa.int64())], [*names, "shard", "slot", "byte_start"])

        return run

    schema = ordered.select(*names).withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).withColumn("byte_start", F.lit(0).cast("long")).schema
    first = dict(map(tuple, map_stream(ordered, place(None), schema).groupBy("shard").agg(F.min("slot")).collect()))  # a row for each shard
    return map_stream(ordered, place([first.get(s, 0) for s in range(shards)]), schema)
