"""Exclusive running sums over a sorted key without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleave.session import cut

#: Rows of a range of keys, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 100_000


def _in_ranges(df: DataFrame, *order) -> DataFrame:
    """`df` with `__range`: rows dealt by ranges of `order` that hold about as many rows each, however the values lie."""
    df = cut(df)
    ranges = min(MOST_RANGES, max(1, -(-df.count() // RANGE_ROWS)))
    return cut((df.repartitionByRange(ranges, *order) if ranges > 1 else df.coalesce(1)).withColumn("__range", F.spark_partition_id()))


def _starts(placed: DataFrame, value: Column) -> DataFrame:
    """__range, __start: the sum of `value` over the ranges before; a row a range, so MOST_RANGES at most."""
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    return F.broadcast(sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start")))


def exclusive_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """`df` (unique keys) with `out`: the sum of `value` over smaller keys.

    Sums of ranges of keys are added up in one small window; rows are added up within their range only.
    """
    placed = _in_ranges(df, key)
    within = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    here = placed.withColumn("__here", F.coalesce(F.sum(value).over(within), F.lit(0))).join(_starts(placed, F.col(value)), "__range")
    return here.withColumn(out, (F.col("__start") + F.col("__here")).cast("bigint")).drop("__range", "__start", "__here")


def ranked(df: DataFrame, out: str, *order) -> DataFrame:
    """`df` with its rows' places from 1 in `order`."""
    placed = _in_ranges(df, *order)
    here = placed.withColumn("__here", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).join(_starts(placed, F.lit(1)), "__range")
    return here.withColumn(out, (F.col("__start") + F.col("__here")).cast("bigint")).drop("__range", "__start", "__here")


def dense_ids(values: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct values of `key` with their rank from 0."""
    return exclusive_sum(values.select(key).distinct().withColumn("__one", F.lit(1)), key, "__one", out).select(key, out)
