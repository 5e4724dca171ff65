"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleave.llm.common import mix
from cleave.operators.prefix import exclusive_sum
from cleave.operators.skew import skew_join
from cleave.session import settle

#: Weights of sources in code-point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its words, and so does a document.
MOST_REPEATS = 3
SEED = 17
#: Documents are given back before the knapsack up to this many words, or four times the longest document but not above KNAPSACK_MOST.
KNAPSACK, KNAPSACK_MOST = 16_384, 1 << 26
#: Beyond KNAPSACK words it takes as many lengths as keep its steps within so many bytes: those given back, then others in their seeded order.
KNAPSACK_BYTES = 64 << 20
#: Documents of each length that the knapsack tries first.
FEW = 2
#: Documents that are given back before the knapsack, so that it has sums to choose from.
FREED = 12
#: Documents of one source and length are numbered in cells of about this many.
CELL = 128
#: Sources that the driver weighs, at most; more are weighed by aggregates.
FEW_SOURCES = 10_000
#: Equal documents that one row stands for in a task.
TOGETHER = 1000


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """What each source shall give: shares of all words by weight, none above `most` times its own, the excess reshared."""
    out, rest, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        per = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > most * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else per * weights[i]
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ -= full
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length make the largest sum that `budget` allows: bounded-knapsack dynamic programming over sums.

    The sums that are reachable are the bits of one integer; counts are split into powers of two. Each step's bits are kept
    to walk back from the best sum. Lengths are tried in the order in which they are given, until the budget is met exactly.
    """
    take = np.zeros(len(lengths), np.int64)
    mask, bits, steps = (1 << (budget + 1)) - 1, 1, []
    for i in range(len(lengths)):
        length, left, size = int(lengths[i]), int(counts[i]), 1
        if not 0 < length <= budget:
            continue
        left = min(left, budget // length)
        while left > 0:
            size = min(size, left)
            steps.append((i, size, bits))
            bits |= bits << (length * size) & mask
            left, size = left - size, size * 2
        if bits >> budget & 1:
            break
    at = bits.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            take[i] += size
            at -= size * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take once (more) so that their words come to `budget` or just below.

    Every length first gives its share, rounded up or down by a seeded draw. Then lengths give back or add one document each, in a seeded
    order, until the rest is less than the longest document, or not above KNAPSACK words if that is more. FREED further documents are given
    back to make room, and the knapsack fills what is left: with a few documents of each length, in a seeded order, so that short and long
    documents are taken alike; only if these don't meet the budget, with all that are free.
    """
    total = int((lengths * counts).sum())
    if budget >= total or not total:
        return counts.copy()
    draw = (mix(np.uint64(seed) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    take = np.minimum(counts, np.floor(counts * (budget / total) + draw).astype(np.int64))
    take[lengths == 0] = 0
    order = [i for i in np.argsort(mix((draw * 2.0**53).astype(np.uint64)), kind="stable").tolist() if lengths[i] and counts[i]]
    rest, longest = budget - int((lengths * take).sum()), int(lengths[counts > 0].max())
    while rest < 0:  # one of each length at a time
        for i in order:
            if rest < 0 and take[i]:
                take[i] -= 1
                rest += int(lengths[i])
    moved = True
    while rest >= longest and moved:
        moved = False
        for i in reversed(order):
            if lengths[i] <= rest and take[i] < counts[i] and rest >= longest:
                take[i] += 1
                rest -= int(lengths[i])
                moved = True
    most, freed = max(KNAPSACK, min(4 * longest, KNAPSACK_MOST)), []
    for i in order:
        if take[i] and rest + lengths[i] <= most and len(freed) < FREED:
            take[i] -= 1
            rest += int(lengths[i])
            freed.append(i)
    if rest:
        ranked = np.array(freed + [i for i in order if i not in set(freed)])
        free = counts - take
        for few in (True, False):
            allowed = _candidates(lengths, free, rest, freed, ranked, few)
            more = np.zeros_like(take)
            more[ranked] = knapsack(lengths[ranked], allowed[ranked], rest)
            if int((lengths * more).sum()) == rest:
                break
        take += more
    return take


def _candidates(lengths: np.ndarray, free: np.ndarray, budget: int, freed: list[int], ranked: np.ndarray, few: bool) -> np.ndarray:
    """How many of each length the knapsack may take: FEW of each, or all; of many words, as many lengths of `ranked` as KNAPSACK_BYTES hold."""
    out, steps = np.zeros_like(free), len(freed)
    out[freed] = 1
    for i in ranked:
        if not 0 < lengths[i] <= budget or not free[i]:
            continue
        allowed = min(int(free[i]), FEW if few else budget // int(lengths[i]))
        steps += allowed.bit_length()
        if budget > KNAPSACK and steps * budget > 8 * KNAPSACK_BYTES:
            break
        out[i] = max(out[i], allowed)
    return out


PLAN = "src bigint, source string, source_size bigint, target double, passes bigint, budget bigint"


def plan_sources(sizes: DataFrame) -> DataFrame:
    """src (the source's number), source, source_size, target, passes (over all its documents), budget (words beyond them); sizes: (source, words).

    Up to FEW_SOURCES the driver reckons; beyond, the same sums are aggregates over the table of sources.
    """
    found = sizes.limit(FEW_SOURCES + 1).collect()
    if len(found) > FEW_SOURCES:
        return _plan_of_many(sizes)
    found = sorted(((r[0], int(r[1])) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    out = []
    for k, ((name, n), t) in enumerate(zip(found, goal, strict=True)):
        passes = int(t // n) if n else 0
        out.append((k, name, n, float(t), passes, int(t - passes * n + Fraction(1, 2)) if n else 0))
    return F.broadcast(sizes.sparkSession.createDataFrame(out, PLAN))  # FEW_SOURCES rows at most


def _plan_of_many(sizes: DataFrame) -> DataFrame:
    """`plan_sources` without a list of sources: in each round, sources that would get more than MOST_REPEATS times their words are closed."""
    plain = sizes.toDF("source", "words").select("source", F.col("words").cast("decimal(38,0)").alias("n"))
    named = exclusive_sum(plain.where("source IS NOT NULL").withColumn("one", F.lit(1)), "source", "one", "src").select("src", "source", "n")
    last = plain.where("source IS NULL").join(named.agg(F.count("*").alias("src"))).select("src", "source", "n")  # one row
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    rows = settle(named.unionByName(last).withColumn("w", F.element_at(weights, (F.col("src") % len(WEIGHTS) + 1).cast("int")).cast("decimal(10,0)")))
    total, weight = rows.agg(F.sum("n"), F.sum("w")).first()
    rest, per, closed = total, weight, -1
    lit = lambda x: F.lit(Decimal(int(x))).cast("decimal(38,0)")
    while True:
        full = F.col("w").cast("decimal(20,0)") * lit(rest) > F.col("n") * lit(MOST_REPEATS * per)
        count, words, w = rows.where(full).agg(F.count("*"), F.coalesce(F.sum("n"), lit(0)), F.coalesce(F.sum("w"), lit(0))).first()
        if count == closed:
            break
        closed, rest, per = count, total - MOST_REPEATS * words, weight - w
    shares, mass = F.col("w") * lit(rest), F.col("n") * lit(per)
    passes = F.when(F.col("n") == 0, 0).when(full, MOST_REPEATS).otherwise(F.expr("1") * _div(shares, mass))
    left = 2 * (shares - F.col("passes").cast("decimal(20,0)") * mass) + lit(per)
    budget = F.when((F.col("n") == 0) | full, 0).otherwise(_div(left, lit(2 * per)))
    goal = F.when(full, F.col("n").cast("double") * MOST_REPEATS).otherwise(shares.cast("double") / float(per))
    out = rows.withColumn("passes", passes.cast("bigint"))
    return out.select("src", "source", F.col("n").cast("bigint").alias("source_size"), goal.alias("target"), "passes", budget.cast("bigint").alias("budget"))


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of whole numbers that are not negative."""
    a, b = a.cast("decimal(38,0)"), F.when(b > 0, b).otherwise(1).cast("decimal(38,0)")
    return ((a - a % b) / b).cast("bigint")


def choose(df: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tie: bool = False) -> DataFrame:
    """src, size, doc_id, tie, m, k, source_size, target, passes: m equal documents of which the mix takes k once more than the others.

    tie: the hash of all columns if `tie`, else 0; documents of one source, size, id and tie are equal for the mix.
    """
    hashed = F.xxhash64(*df.toDF(*[f"c{i}" for i in range(len(df.columns))]).columns) if tie else F.lit(0).cast("bigint")
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    doc_id, text, source = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col, source_col))
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    rows = named.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), hashed.alias("tie"))
    alike = settle(rows.groupBy("source", "size", "doc_id", "tie").agg(F.count("*").alias("m")), 200_000)
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("name")
    plan = plan_sources(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("m"))))
    docs = skew_join(alike.select("*", name), plan.select(name, "src"), "name").select("src", "size", "doc_id", "tie", "m")
    docs = settle(docs.withColumn("draw", F.xxhash64(F.lit(seed), F.coalesce("doc_id", "tie"))), 200_000)

    counts = docs.where("size > 0").groupBy("src", "size").agg(F.sum("m").alias("n"), F.count("*").alias("__n"))

    def fitted(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("size", ignore_index=True)
        f["take"] = fit(f["size"].to_numpy(np.int64), f["n"].to_numpy(np.int64), int(f["budget"].iloc[0]), seed * 1_000_003 + int(f["src"].iloc[0]))
        return f[["src", "size", "__n", "take"]]

    budgets = counts.join(plan.select("src", "budget"), "src")
    chosen = settle(budgets.groupBy("src").applyInPandas(fitted, "src bigint, size bigint, __n bigint, take bigint"))  # one row a length
    placed = skew_join(docs, chosen.withColumnRenamed("__n", "ids"), "src", "size", how="left", place=F.struct("draw", "doc_id", "tie"), sizes=chosen)
    cells = F.when(F.coalesce("ids", F.lit(0)) > CELL, F.pmod(F.xxhash64(F.lit(3), "draw"), F.ceil(F.col("ids") / CELL))).otherwise(F.lit(0))
    placed = placed.select("src", "size", "doc_id", "tie", "m", "draw", F.coalesce("take", F.lit(0)).alias("take"), cells.alias("cell"))
    by_cell = placed.where("take > 0").groupBy("src", "size", "cell").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("src", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.select("src", "size", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("src", "size", "cell").orderBy("draw", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("at", F.coalesce(F.sum("m").over(within), F.lit(0))).join(starts, ["src", "size", "cell"], "left")
    k = F.greatest(F.lit(0), F.least("m", F.coalesce(F.col("take") - F.col("start") - F.col("at"), F.lit(0))))
    return skew_join(settle(numbered.select("src", "size", "doc_id", "tie", "m", k.cast("bigint").alias("k")), 200_000), plan.select("src", "source_size", "target", "passes"), "src")


def mix_sources(df: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats: how often the mix repeats each document.

    size: words between white space (null text: 0). Targets by `targets`; a source gives whole passes over its documents,
    and documents that `fit` chose by length one time more, so its words come as near the target as whole documents allow.
    Among documents of one length, those with the least seeded hash of their id are taken. Reruns agree.

    Null sources are one source, weighed last. Empty and null texts have size 0 and nothing is taken of them. Texts of any length count
    whole. Repeated rows and null ids are documents of their own. An empty table gives an empty result. Columns beyond id, text and source are not read.
    """
    found = choose(df, seed, id_col, text_col, source_col)
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / TOGETHER))
    if not found.where(F.col("m") > TOGETHER).isEmpty():  # very many equal documents are not made in one task
        found = found.withColumn("part", F.explode(parts)).repartition("src", "size", "doc_id", "part")
    else:
        found = found.withColumn("part", F.lit(0).cast("bigint"))
    first = F.col("part") * TOGETHER + 1
    each = found.withColumn("nth", F.explode(F.sequence(first, F.least("m", first + TOGETHER - 1))))
    repeats = F.when(F.col("size") > 0, F.least(F.col("passes") + (F.col("nth") <= F.col("k")).cast("int"), F.lit(MOST_REPEATS))).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).cast("bigint").alias("taken"), repeats.cast("int").alias("repeats"))


def repeat_documents(df: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `df`, a table, each as often as the mix takes it: not at all, or up to MOST_REPEATS times. Same rules as `mix_sources`.

    Rows that are equal in all columns are one another's stand-ins: of m such rows, their copies in all are what the mix takes.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    names = flat.columns
    key = F.coalesce(F.col(f"c{df.columns.index(id_col)}").cast("bigint"), F.lit(0)).alias("id")
    found = choose(df, seed, id_col, text_col, source_col, tie=True).where("size > 0")
    found = settle(found.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), "tie", "m", "k", "passes").where("passes > 0 OR k > 0"), 200_000)
    rows = flat.select("*", key, F.xxhash64(*names).alias("tie"))
    even = found.where("k = 0 OR k = m").select("id", "tie", (F.col("passes") + (F.col("k") > 0).cast("int")).alias("times"), F.col("m").alias("__n"))
    out = skew_join(rows, even.drop("__n"), "id", "tie", sizes=even).select(*names, F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one")).select(*names)
    split = found.where("k > 0 AND k < m")
    if not split.isEmpty():  # one row stands for all of its equals
        some = skew_join(rows, split.select("id", "tie", (F.col("passes") * F.col("m") + F.col("k")).alias("times")), "id", "tie", sizes=split.select("id", "tie", F.col("m").alias("__n")))
        one = some.groupBy("id", "tie").agg(F.first("times").alias("times"), F.first(F.struct(*names)).alias("row"))
        one = one.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("times") - 1) / TOGETHER)))).repartition("id", "tie", "part")
        here = F.least(F.lit(TOGETHER), F.col("times") - F.col("part") * TOGETHER).cast("int")
        out = out.unionByName(one.select("row", F.explode(F.array_repeat(F.lit(1), here)).alias("n")).select("row.*"))
    return out.toDF(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
