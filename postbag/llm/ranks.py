"""Gapless ranks and running sums inside groups of any size, without one task per group.

A group is dealt into buckets, each bucket is ordered alone, and a prefix sum
over the small table of bucket totals gives each bucket its base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_base(df: DataFrame, group: list[str], bucket: Column, order: list, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come
    before a row, in the order of ``bucket`` and then ``order``. With ``value`` 1
    it is a gapless rank. Rows that tie in all of ``order`` are interchangeable.
    Buckets should be small (tens of thousands of rows) and ``df`` must give the
    same rows each time that it is read."""
    keys = [*group, "_bucket"]
    seen = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = seen.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ordered = seen.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    spare = ["_bucket", "_value", "_in", "_base", *[f"_k{i}" for i in range(len(keys))]]
    return ordered.join(bases, on).withColumn(out, F.col("_base") + F.col("_in")).drop(*spare)


def hash_bucket(cols: list[str], rows: int, each: int = 20_000) -> Column:
    """A bucket from a hash of ``cols``, for about ``each`` of ``rows`` rows a bucket."""
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, -(-rows // each))))
