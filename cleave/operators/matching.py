"""Matching of vertices with their strongest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.operators.components import ONE_TASK
from cleave.operators.edges import compress_labels, matching_threshold, symmetric
from cleave.session import cut

ROUNDS, LEAST_GAIN = 10, 0.1
#: Edges that a task of `match_few` holds together.
HELD = 1 << 18


def best_neighbours(edges: DataFrame, threshold: DataFrame) -> DataFrame:
    """(node, best): the neighbour over the dearest edge whose cost is above the threshold; of equal ones the least id."""
    strong = edges.join(F.broadcast(threshold)).where("cost > threshold").select("i", "j", "cost")  # one row
    choice = F.max(F.struct("cost", (-F.col("dst")).alias("back")))
    return symmetric(strong).groupBy(F.col("src").alias("node")).agg(choice.alias("m")).select("node", (-F.col("m.back")).alias("best"))


def mutual_pairs(best: DataFrame) -> DataFrame:
    """(low, high) of nodes that are each other's best."""
    there = best.select(F.col("node").alias("low"), F.col("best").alias("high")).where("low < high")
    back = best.select(F.col("node").alias("high"), F.col("best").alias("low")).where("low < high")
    return there.join(back, ["low", "high"])


def unmatched(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges without an end in a pair (low, high)."""
    taken = pairs.select(F.explode(F.array("low", "high")).alias("t"))
    free = edges.join(taken.withColumnRenamed("t", "i"), "i", "left_anti").join(taken.withColumnRenamed("t", "j"), "j", "left_anti")
    return free.select("i", "j", "cost")


def _rounds_on_arrays(rounds: int, before: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rest of `match` over edges between free nodes: at most `rounds` rounds after `before` nodes were matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        i, j, cost = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        src, dst = at, np.roll(at, len(i))
        order = np.lexsort((dst, -np.concatenate([cost, cost]), src))
        src, dst, partner, matched = src[order], dst[order], np.full(len(ids), -1), before
        for _ in range(rounds):
            keep = (partner[src] < 0) & (partner[dst] < 0)
            src, dst = src[keep], dst[keep]
            first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]][: len(src)])
            best = np.full(len(ids), -1)
            best[src[first]] = dst[first]
            low = src[first][best[dst[first]] == src[first]]
            partner[low] = best[low]
            gain = len(low) / (matched + 1)
            matched += len(low)
            if not gain or gain < LEAST_GAIN:
                break
        low = np.flatnonzero(partner > np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[partner[low]])], names=["low", "high"])

    return run


def match(edges: DataFrame, multiplier: float, one_task: int = ONE_TASK) -> tuple[DataFrame, int]:
    """Pairs (low, high) of up to 10 rounds, and how many nodes they match.

    A round pairs mutual best neighbours among nodes that are still free; the next one runs while the count grows by at
    least a tenth. A negative threshold (no cost that isn't negative) matches nothing. Once at most `one_task` edges join free nodes
    (80 bytes each), one task takes the remaining rounds on arrays.
    """
    threshold = cut(matching_threshold(edges, multiplier))
    pairs = edges.sparkSession.createDataFrame([], "low bigint, high bigint")
    if threshold.first()["threshold"] < 0:
        return pairs, 0
    free, before = edges.join(F.broadcast(threshold)).where("cost > threshold").select("i", "j", "cost"), 0
    for k in range(ROUNDS):
        if one_task and free.limit(one_task + 1).count() <= one_task:
            flat = free.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("cost").cast("double"))
            pairs = cut(pairs.unionByName(flat.coalesce(1).mapInArrow(_rounds_on_arrays(ROUNDS - k, before), "low bigint, high bigint")))
            return pairs, 2 * pairs.count()
        new = mutual_pairs(best_neighbours(free, threshold))
        pairs = cut(pairs.unionByName(new))
        now = 2 * pairs.count()
        gain, before = (now - before) / (before + 1), now
        if not gain or gain < LEAST_GAIN:
            break
        free = cut(unmatched(free, pairs))
    return pairs, before


def _free(threshold: float, taken: np.ndarray, best: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of edges (i, j, cost) above the threshold between nodes that aren't taken: themselves; or, for `best`, rows (node, cost, back, n) of the dearest
    edge at each node among those held together, -back being its other end, of equal ones the least; and one row of node -1 with the count of edges."""

    def kept(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        i, j, cost = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        keep = cost > threshold
        keep[keep] = ~(taken[i[keep]] | taken[j[keep]])
        return [i[keep], j[keep], cost[keep]]

    def strongest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        i, j, cost = kept(held)
        src, dst, cost = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cost, cost])
        order = np.lexsort((dst, -cost, src))
        first = order[np.r_[True, src[order][1:] != src[order][:-1]][: len(src)]]
        rows = np.r_[src[first], -1], np.r_[cost[first], 0.0], np.r_[-dst[first], 0], np.r_[np.zeros(len(first), np.int64), len(i)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["node", "cost", "back", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not best:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept([b])], names=["i", "j", "cost"])
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= HELD:
                yield strongest(held)
                held, rows = [], 0
        if held:
            yield strongest(held)

    return run


def match_few(edges: DataFrame, n: int, threshold: float, one_task: int = ONE_TASK) -> tuple[np.ndarray, np.ndarray, int]:
    """`match` for few nodes (0 to n - 1) of any number of edges, kept by `cut`: pairs low and high as arrays, and how many nodes they match.

    A round is one job: tasks give the best edge of each node among theirs, and the driver holds 16 bytes a node.
    """
    partner, before = np.full(n, -1), 0
    for k in range(ROUNDS if threshold >= 0 else 0):
        free = edges.mapInArrow(_free(threshold, partner >= 0, True), "node bigint, cost double, back bigint, n bigint")
        found = free.groupBy("node").agg(F.max(F.struct("cost", "back")).alias("m"), F.sum("n").alias("n")).select("node", (-F.col("m.back")).alias("best"), "n").toArrow()
        node, to, counts = (found[c].to_numpy() for c in ("node", "best", "n"))
        best = np.full(n, -1)
        best[node[node >= 0]] = to[node >= 0]
        low = np.flatnonzero(best > np.arange(n))
        low = low[best[best[low]] == low]
        partner[low], partner[best[low]] = best[low], low
        now = before + 2 * len(low)
        gain, before = (now - before) / (before + 1), now
        if not gain or gain < LEAST_GAIN:
            break
        if k + 1 < ROUNDS and counts[node < 0].sum() <= one_task:  # as many before this round
            free = edges.mapInArrow(_free(threshold, partner >= 0, False), "i bigint, j bigint, cost double")
            rest = free.repartition(1).mapInArrow(_rounds_on_arrays(ROUNDS - k - 1, before), "low bigint, high bigint").toArrow()
            a, b = (rest[c].to_numpy() for c in ("low", "high"))
            partner[a], partner[b] = b, a
            before += 2 * len(a)
            break
    low = np.flatnonzero(partner > np.arange(n))
    return low, partner[low], before


def contraction_map(nodes: DataFrame, edges: DataFrame, multiplier: float) -> tuple[DataFrame, int]:
    """(node, cluster) with matched pairs in one cluster, numbered from 0, and the count of matched nodes."""
    pairs, n = match(edges, multiplier)
    joined = nodes.select("node").join(pairs.select(F.col("high").alias("node"), "low"), "node", "left").select("node", F.coalesce("low", "node").alias("cluster"))
    return compress_labels(joined), n
