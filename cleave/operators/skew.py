"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key in a task, about, and parts of a key at most.
PART_ROWS, MOST_PARTS = 200, 4096
#: Keys that are dealt in parts: the most frequent ones. Any other key has at most 1 / HOT_KEYS of the rows.
HOT_KEYS = 500


def deal(many: DataFrame, *keys: str, place: Column | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`many` with `__part`, and the hot keys with their count of parts (HOT_KEYS rows at most): rows of a frequent key have many parts.

    Null keys are dealt too. Rows are dealt by a hash of `place`, which has to tell them apart; without one, by their place in `many`, which then
    has to be a table or a result of `cut`. sizes: (keys, __n), where the counts are known.
    """
    counts = many.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("__n")) if sizes is None else sizes.select(*keys, "__n")
    parts = F.least(F.ceil(F.col("__n") / PART_ROWS), F.lit(MOST_PARTS)).cast("int")
    hot = counts.where(F.col("__n") > PART_ROWS).orderBy(F.desc("__n"), *keys).limit(HOT_KEYS).select(*keys, parts.alias("__parts"))
    null = F.lit(False)
    for k in keys:
        null |= F.col(k).isNull()
    of_row = F.when(null, F.lit(MOST_PARTS)).otherwise(F.coalesce("__parts", F.lit(1)))
    hashed = F.xxhash64(F.monotonically_increasing_id() if place is None else place)
    return many.join(F.broadcast(hot), list(keys), "left").withColumn("__part", F.pmod(hashed, of_row).cast("int")).drop("__parts"), hot


def spread(one: DataFrame, hot: DataFrame, *keys: str) -> DataFrame:
    """A row of `one` for each part of its key."""
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__part")
    return one.join(F.broadcast(hot), list(keys), "left").select(*one.columns, copies)


def skew_join(many: DataFrame, one: DataFrame, *keys: str, how: str = "inner", place: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """`many` joined with `one`, which has each key once at most; inner or left. A hot key's rows are in many parts; see `deal`."""
    left, hot = deal(many, *keys, place=place, sizes=sizes)
    return left.join(spread(one, hot, *keys), [*keys, "__part"], how).drop("__part")
