"""Filling forward and looking ahead on an index axis, also where one trace is far larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hold(df: DataFrame, keys: list[str], idx: str, cols: list[str], bucket: int | None = None, lead: str | None = None) -> DataFrame:
    """df with each of cols filled forward from its last non-null value along idx, and `lead` (if named) the next idx.

    With a bucket, windows run within buckets of that many indices; what enters a bucket from before, and
    the first index after it, come from a table of a row for each bucket.
    """
    if not bucket:
        w = Window.partitionBy(*keys).orderBy(idx)
        out = df.select("*", *[F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{c}") for c in cols], *([F.lead(idx).over(w).alias(lead)] if lead else []))
        return out.select(*[F.col(f"_{c}").alias(c) if c in cols else c for c in df.columns], *([lead] if lead else []))
    if "_b" not in df.columns:  # else the caller has its rows by bucket already
        df = df.withColumn("_b", F.floor(F.col(idx) / bucket))
    w = Window.partitionBy(*keys, "_b").orderBy(idx)
    inner = df.select("*", *[F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{c}") for c in cols], F.lead(idx).over(w).alias("_next"))
    ends = df.groupBy(*keys, "_b").agg(F.min(idx).alias("_first"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_in_{c}") for c in cols])
    over = Window.partitionBy(*keys).orderBy("_b")
    seeds = ends.select(*keys, "_b", F.lead("_first").over(over).alias("_after"), *[F.last(f"_in_{c}", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_in_{c}") for c in cols])
    out = inner.join(seeds, [*keys, "_b"])
    return out.select(*[(F.coalesce(f"_{c}", f"_in_{c}").alias(c) if c in cols else F.col(c)) for c in df.columns if c != "_b"], *([F.coalesce("_next", "_after").alias(lead)] if lead else []))


#: Indices that an interval is expanded into at a time.
CHUNK = 1 << 16


def expand(df: DataFrame, idx: str = "idx", end: str = "end_idx") -> DataFrame:
    """A row for each index of the rows' intervals, in place of idx and end; an interval is cut into chunks first, so no array is longer than CHUNK."""
    rest = [c for c in df.columns if c not in (idx, end)]
    cut = df.where(F.col(idx) < F.col(end)).select(*rest, F.explode(F.sequence(F.col(idx), F.col(end) - 1, F.lit(CHUNK).cast("long"))).alias("_from"), F.col(end).alias("_to"))
    return cut.select(*rest, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("_to")) - 1)).alias(idx))


def _bucketed(df: DataFrame, idx: str, bucket: int | None) -> tuple[DataFrame, list[str]]:
    """df with its bucket of indices in _b, and the columns that name a bucket beside the keys."""
    return (df.withColumn("_b", F.floor(F.col(idx) / bucket)), ["_b"]) if bucket else (df, [])


def running_total(df: DataFrame, keys: list[str], idx: str, amount: str, name: str, bucket: int | None = None) -> DataFrame:
    """df with `name`, the sum of `amount` over the rows before, along idx. With a bucket, a row for each bucket carries the sums on."""
    rows, own = _bucketed(df, idx, bucket)
    w = Window.partitionBy(*keys, *own).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)))
    if not own:
        return rows
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(amount).alias("_s")).select(*keys, "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s"))
    return rows.join(sums, [*keys, "_b"]).withColumn(name, F.col(name) + F.col("_s")).select(*df.columns, name)


def suppress_repeats(df: DataFrame, keys: list[str], idx: str, value: str, bucket: int | None = None) -> DataFrame:
    """Only the rows whose value differs from the one before. With a bucket, a row for each bucket carries the value on."""
    rows, own = _bucketed(df.withColumn("_v", F.struct(F.col(value).alias("v"))), idx, bucket)
    w = Window.partitionBy(*keys, *own).orderBy(idx)
    rows = rows.withColumn("_was", F.lag("_v").over(w))
    if own:
        over = Window.partitionBy(*keys).orderBy("_b")
        ends = rows.groupBy(*keys, "_b").agg(F.max_by("_v", idx).alias("_last")).select(*keys, "_b", F.lag("_last").over(over).alias("_in"))
        rows = rows.join(ends, [*keys, "_b"]).withColumn("_was", F.coalesce("_was", "_in"))
    return rows.where(F.col("_was").isNull() | ~F.col("_was.v").eqNullSafe(F.col(value))).select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], idx: str, values: list[str], bucket: int | None = None) -> DataFrame:
    """left with the last values of right at or before idx: one union, one fill, no range join."""
    packed = F.struct(*values)
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(*keys, idx, packed.alias("_v")).withColumn("_side", F.lit(0)), True)
    # the right's rows of an index come before the left's
    filled = hold(both.withColumn("_at", 2 * F.col(idx) + F.col("_side")), keys, "_at", ["_v"], 2 * bucket if bucket else None)
    return filled.where("_side = 1").select(*[F.col(f"_v.{c}").alias(c) if c in values else F.col(c) for c in [*left.columns, *[v for v in values if v not in left.columns]]])
