"""Signed graphs made from the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.session import cut

#: Rows of a batch of pairs.
BATCH = 1 << 16


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j), i < j: the pairs of distinct s of each o, for whole groups of (o, s). Distances in the sorted group are taken in turn, so work grows as the pairs do."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    o, s = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
    order = np.lexsort((s, o))
    o, s = o[order], s[order]
    first = np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])]
    o, s = o[first], s[first]
    at, far = np.arange(len(o)), 0
    while len(at):
        far += 1
        at = at[: np.searchsorted(at, len(o) - far)]
        at = at[o[at] == o[at + far]]
        for k in range(0, len(at), BATCH):
            here = at[k : k + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(s[here]), pa.array(s[here + far])], names=["i", "j"])


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share orders: how many, less the whole part of the mean count. A projection of counts that are kept, so cheap to read again."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("bigint").alias("o"), F.col("l_suppkey").cast("bigint").alias("s")).dropna()
    pairs = lines.repartition("o").mapInArrow(_pairs, "i bigint, j bigint")
    counts = cut(pairs.groupBy("i", "j").agg(F.count("*").alias("c")))  # for the mean and the costs
    mean = counts.agg(F.floor(F.avg("c"))).first()[0]
    return counts.select("i", "j", (F.col("c") - F.lit(mean)).cast("double").alias("cost"))


def customer_orders(spark: SparkSession, sf_dir: str, days: int = 180) -> DataFrame:
    """Orders of one customer at most `days` apart: 3 less the whole 50,000s between their prices. Orders without customer, date or price have no edge."""
    read = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    orders = read.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), day.alias("d"), F.col("o_totalprice").alias("p"))
    orders = orders.withColumn("span", F.floor(F.col("d") / (days + 1))).dropna()  # two orders in reach lie in one span or in two that touch
    later = orders.select("c", F.col("span").alias("at"), *[F.col(x).alias(f"{x}2") for x in ("o", "d", "p")])
    pairs = orders.withColumn("at", F.explode(F.array("span", F.col("span") + 1))).join(later, ["c", "at"])
    near = pairs.where((F.col("d2") - F.col("d")).between(0, days) & (F.struct("d", "o") < F.struct("d2", "o2")))
    cost = 3 - F.floor(F.abs(F.col("p") - F.col("p2")) / 50_000.0)
    return near.select(F.least("o", "o2").alias("i"), F.greatest("o", "o2").alias("j"), cost.cast("double").alias("cost"))
