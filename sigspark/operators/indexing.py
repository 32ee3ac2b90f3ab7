"""A dense index over all rows in an order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.storage import cut


def global_index(df: DataFrame, order: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """df with a column of places from 0 in the order.

    Rows are range-partitioned and sorted; a count for each partition gives its first place. The sorted rows
    are written to the shared folder between the two steps, as sampling again could move the bounds.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id is partition << 33 | place in the partition
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    counts = sorted(map(tuple, rows.groupBy(F.shiftright("_m", 33).cast("long").alias("p")).count().collect()))  # a row for each partition
    base, at = [], 0
    for p, c in counts:
        base.append((p, at))
        at += c
    first = F.broadcast(spark.createDataFrame(base, "_p long, _base long"))
    out = rows.withColumn("_p", F.shiftright("_m", 33).cast("long")).join(first, "_p")
    return out.withColumn(name, F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_m", "_base")
