"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.operators.skew import skew_join
from cleave.session import cut, settle

#: Edges that one task finishes on arrays (16 bytes each), at most; more are halved by steps on DataFrames first.
ONE_TASK = 1 << 20
#: Ranges of ids at most, in each of which one task joins edges on arrays.
MOST_RANGES = 4096


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the nodes 0 to n - 1 that each of them reaches over edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, label[i], label[j])
        np.minimum.at(new, label[j], label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _least(pairs: DataFrame) -> DataFrame:
    """u and the least of u and its v, by partial sums."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    return skew_join(both.where("v > u"), _least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = _least(edges)
    moved = skew_join(edges, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that have two centres, or a centre and leaves: none if the edges are stars."""
    out, mid = F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("mid")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("mid"))
    by_node = edges.select(F.explode(F.array(out, mid)).alias("e")).groupBy("e.x").agg(F.sum("e.out").alias("out"), F.max("e.mid").alias("mid"))
    return by_node.where("out > 1 OR out = 1 AND mid = 1")


def _stars_on_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        least = least_reached(len(ids), at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(least != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[least[moved]])], names=["u", "v"])


def _placed(bounds: np.ndarray, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges with the range of ids that holds both ends; those that cross get none (-1), and both their ends a row (`mark`) in their own ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(k).to_numpy() for k in (0, 1))
            at, to = np.searchsorted(bounds, u), np.searchsorted(bounds, v)
            crossing = at != to
            yield pa.RecordBatch.from_arrays([pa.array(np.where(crossing, -1, at)), pa.array(np.zeros(len(u), bool)), *b.columns], names=["range", "mark", *columns])
            ends = np.unique(np.concatenate([u[crossing], v[crossing]]))
            rest = [pa.array(np.zeros(len(ends))).cast(b.column(k).type) for k in range(2, b.num_columns)]  # nulls would turn whole columns to floats
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ends)), pa.array(np.ones(len(ends), bool)), pa.array(ends), pa.array(ends), *rest], names=["range", "mark", *columns])

    return run


def in_ranges(edges: DataFrame, kept: Callable, width: int) -> tuple[DataFrame, DataFrame] | None:
    """(closed, open): what `kept` leaves of edges (u, v, ...) where ids lie close together, so that only a remainder goes on by joins.

    Ids are cut into ranges that hold about as many ends each. One task takes the edges within a range, at most about `width` whatever the degrees:
    of a hub at a range's upper end none lies within. A component that no edge between two ranges touches is closed; the edges left of others are
    open, with all that cross. kept: from the columns, the ids, each end's place among them and each id's component to rows of the same columns;
    it must not change what the whole graph gives. None if there would be more than MOST_RANGES.
    """
    ranges = -(-edges.count() // width)
    if ranges > MOST_RANGES:
        return None
    ends = edges.select(F.explode(F.array("u", "v")).alias("x"))
    cuts = ends.agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)] or [1.0], 10 * ranges + 1000).alias("b")).first()["b"]
    bounds = np.unique(np.array((cuts or []) if ranges > 1 else [], np.int64))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema.fields)
    columns = edges.columns
    placed = cut(edges.mapInArrow(_placed(bounds, columns), f"range bigint, mark boolean, {kinds}"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        marks, held = rows.loc[rows["mark"], "u"].to_numpy(np.int64), rows.loc[~rows["mark"], columns]
        u, v = held["u"].to_numpy(np.int64), held["v"].to_numpy(np.int64)
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = least_reached(len(ids), at[: len(u)], at[len(u) :])
        touched = np.zeros(len(ids), bool)
        touched[label[np.isin(ids, marks)]] = True
        out = kept(held, ids, at, label)
        return out.assign(closed=~touched[label[np.searchsorted(ids, out["u"].to_numpy(np.int64))]])

    out = settle(placed.where("range >= 0").groupBy("range").applyInPandas(run, f"{kinds}, closed boolean"))
    return out.where("closed").drop("closed"), out.where("NOT closed").drop("closed").unionByName(placed.where("range < 0").select(*columns))


def _stars_in_range(held: pd.DataFrame, ids: np.ndarray, at: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]})


def close_by_ranges(open_: DataFrame, kept: Callable, most: int) -> tuple[list[DataFrame], DataFrame]:
    """What `in_ranges` closes of edges in rounds, and the rest: at most `most` edges, or what another round would not bring below three quarters. A range has about a quarter of `most`."""
    closed, left = [], open_.count()
    while left > most:
        found = in_ranges(open_, kept, max(1, most // 4))
        if found is None:
            break
        closed.append(found[0])
        open_ = settle(found[1])
        before, left = left, open_.count()
        if left > 0.75 * before:
            break
    return closed, open_


def star_edges(edges: DataFrame, most: int = 64, one_task: int = 0) -> DataFrame:
    """(u, v): each node that isn't the least of its component, with that least node.

    Of at most `one_task` edges, one task makes the stars on arrays, so small graphs cost two jobs; of more, what lies in ranges of ids is closed first.
    """
    now = edges.select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).where("u <> v").distinct()
    now = settle(now)
    closed: list[DataFrame] = []
    if one_task:
        closed, now = close_by_ranges(now, _stars_in_range, one_task)
    whole = lambda rest: reduce(DataFrame.unionByName, closed, rest)
    for _ in range(most):
        if one_task and now.limit(one_task + 1).count() <= one_task:
            return whole(settle(now.coalesce(1).mapInArrow(_stars_on_arrays, "u bigint, v bigint")))
        if _unsettled(now).isEmpty():
            return whole(now)
        now = settle(_small_star(settle(_large_star(now))))
    raise RuntimeError("components did not settle")


def connected_components(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the least node id that each node of `nodes` reaches; `edges` has i and j.

    The count of steps grows with the logarithm of a component's size. The edges of a hub are dealt to many tasks.
    """
    stars = star_edges(edges.select(F.col("i").alias("u"), F.col("j").alias("v")), one_task=one_task)
    return nodes.select("node").distinct().join(stars, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
