"""Maximum spanning forests, and taking edges out of them until no repulsive edge lies within a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.operators.components import ONE_TASK, close_by_ranges, connected_components, least_reached
from cleave.operators.edges import between_components, compress_labels, split_by_sign, symmetric
from cleave.operators.skew import skew_join
from cleave.session import cut, settle

#: Forest edges below this share of the mean are dropped every THIN_EVERY passes of the general search.
THIN, THIN_EVERY = 0.9, 5


def _root(parent: list[int], a: int) -> int:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def _joining(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """Places of edges (a, b) that join two trees, taken in `order`."""
    parent, taken = list(range(n)), []
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = _root(parent, x), _root(parent, y)
        if x != y:
            parent[x] = y
            taken.append(k)
    return taken


def _forest_in_range(held: pd.DataFrame, ids: np.ndarray, at: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((held["j"].to_numpy(), held["i"].to_numpy(), -held["cost"].to_numpy()))
    return held.iloc[_joining(len(ids), at[: len(held)], at[len(held) :], order)]


def _forest_on_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ti, tj, cost, i, j) that join two trees, taken by falling cost, then i and j."""
    held = [b for b in batches if b.num_rows]
    if held:
        ti, tj, cost, i, j = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(5))
        names, at = np.unique(np.concatenate([ti, tj]), return_inverse=True)
        taken = _joining(len(names), at[: len(ti)], at[len(ti) :], np.lexsort((j, i, -cost)))
        yield pa.RecordBatch.from_arrays([pa.array(x[taken]) for x in (i, j, cost)], names=["i", "j", "cost"])


def _roots(chosen: DataFrame) -> DataFrame:
    """(t, root) of trees t whose best edge leads to `to`, by pointer jumping.

    Edges have one order, so only two trees that chose the same edge form a ring; the lesser one of them is the root.
    """
    back = chosen.select(F.col("t").alias("to"), F.col("to").alias("back"))
    now = settle(skew_join(chosen, back, "to").select("t", F.when((F.col("t") == F.col("back")) & (F.col("t") < F.col("to")), F.col("t")).otherwise(F.col("to")).alias("root")))
    while True:
        ahead = now.select(F.col("t").alias("root"), F.col("root").alias("next"))
        jumped = settle(skew_join(now, ahead, "root").select("t", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = jumped.select("t", "root")
        if jumped.where("moved").isEmpty():
            return now


def maximum_spanning_forest(edges: DataFrame, most: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """(i, j, cost): the unique maximum spanning forest under the order (cost falling, i, j).

    Rounds in which every tree takes its best outgoing edge; trees are then joined by pointer jumping over the chosen edges, and of
    parallel edges between two trees only the best stays. The count of rounds is logarithmic in the nodes. Before, what lies in ranges of
    ids is thinned to its own forest, and closed where no other edge touches it. Once at most `one_task` edges
    between trees are left (40 bytes each), one task takes the rest of the forest from them on arrays.
    """
    value = F.struct("cost", (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))
    open_ = settle(edges.select(F.col("i").cast("bigint").alias("ti"), F.col("j").cast("bigint").alias("tj"), value.alias("e")))
    edge = [(-F.col("e.ni")).alias("i"), (-F.col("e.nj")).alias("j"), F.col("e.cost").alias("cost")]
    forest = edges.select("i", "j", "cost").where("false")
    if one_task and open_.count() > one_task:
        flat = open_.select(F.col("ti").alias("u"), F.col("tj").alias("v"), *(edge[k].cast(t).alias(n) for k, t, n in ((0, "bigint", "i"), (1, "bigint", "j"), (2, "double", "cost"))))
        closed, flat = close_by_ranges(flat, _forest_in_range, one_task)
        forest = reduce(DataFrame.unionByName, [c.select("i", "j", "cost") for c in closed], forest)
        open_ = flat.select(F.col("u").alias("ti"), F.col("v").alias("tj"), value.alias("e"))
    for _ in range(most):
        if one_task and open_.limit(one_task + 1).count() <= one_task:
            flat = open_.select("ti", "tj", F.col("e.cost").cast("double").alias("cost"), edge[0].alias("i"), edge[1].alias("j"))
            return forest.unionByName(flat.coalesce(1).mapInArrow(_forest_on_arrays, "i bigint, j bigint, cost double"))
        ends = open_.select(F.explode(F.array(F.struct(F.col("ti").alias("t"), F.col("tj").alias("to")), F.struct(F.col("tj").alias("t"), F.col("ti").alias("to")))).alias("x"), "e")
        best = settle(ends.groupBy("x.t").agg(F.max(F.struct("e", "x.to")).alias("b")).select("t", "b.to", "b.e"))
        if best.isEmpty():
            return forest
        forest = forest.unionByName(best.select(*edge).distinct())
        roots = _roots(best.select("t", "to"))
        for end in ("ti", "tj"):
            open_ = settle(skew_join(open_, roots.select(F.col("t").alias(end), "root"), end).withColumn(end, F.col("root")).drop("root"))
        low, high = F.least("ti", "tj"), F.greatest("ti", "tj")
        open_ = settle(open_.where("ti <> tj").groupBy(low.alias("ti"), high.alias("tj")).agg(F.max("e").alias("e")))
    raise RuntimeError("the forest did not settle")


def thin(forest: DataFrame, share: float = THIN) -> DataFrame:
    """Forest edges of at least `share` of the mean of costs that are not negative."""
    limit = forest.agg((F.avg(F.when(F.col("cost") >= 0, F.col("cost"))) * share).alias("limit"))
    return forest.join(F.broadcast(limit)).where("cost >= limit").select("i", "j", "cost")  # one row


def without(forest: DataFrame, gone: DataFrame) -> DataFrame:
    return forest.join(gone.select("i", "j").distinct(), ["i", "j"], "left_anti").select("i", "j", "cost")


def _edge(a: str, b: str):
    return F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))


def conflicts3(forest: DataFrame, rep: DataFrame) -> DataFrame:
    """Forest edges to take out: of each path i, m, j closed by a repulsive (i, j) the cheaper edge, of equal ones that at j."""
    sym = symmetric(forest)
    one = sym.select(F.col("src").alias("i"), F.col("dst").alias("m"), F.col("cost").alias("c1"))
    two = sym.select(F.col("src").alias("j"), F.col("dst").alias("m"), F.col("cost").alias("c2"))
    paths = rep.select("i", "j").join(one, "i").join(two, ["j", "m"])
    return paths.select(F.when(F.col("c1") < F.col("c2"), _edge("i", "m")).otherwise(_edge("j", "m")).alias("e")).select("e.i", "e.j").distinct()


def conflicts4(forest: DataFrame, rep: DataFrame) -> DataFrame:
    """Of each path i, n, m, j: the first edge if strictly cheapest, else the middle one if cheaper than the last, else the last."""
    sym = symmetric(forest)
    hop = lambda a, b, c: sym.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("cost").alias(c))
    paths = rep.select("i", "j").join(hop("i", "n", "c1"), "i").join(hop("j", "m", "c3"), "j").join(hop("n", "m", "c2"), ["n", "m"])
    first = (F.col("c1") < F.col("c2")) & (F.col("c1") < F.col("c3"))
    gone = F.when(first, _edge("i", "n")).when(F.col("c2") < F.col("c3"), _edge("n", "m")).otherwise(_edge("j", "m"))
    return paths.select(gone.alias("e")).select("e.i", "e.j").distinct()


def seeds(rep: DataFrame, end: str) -> DataFrame:
    """A frontier at one end of every repulsive edge (u, v): no parent, and a bottleneck of infinite cost."""
    null = F.lit(None).cast("bigint")
    return rep.select(F.col("i").alias("u"), F.col("j").alias("v"), F.col(end).alias("node"), null.alias("parent"), null.alias("bn_i"), null.alias("bn_j"), F.lit(float("inf")).alias("bn_cost"))


def expand(frontier: DataFrame, forest: DataFrame) -> DataFrame:
    """One hop over the forest, never back to the parent; the cheapest edge so far goes along, of equal ones the older."""
    hop = symmetric(forest).select(F.col("src").alias("node"), "dst", "cost")
    onward = frontier.join(hop, "node").where("parent IS NULL OR dst <> parent")
    cheaper = F.col("cost") < F.col("bn_cost")
    pick = lambda new, old: F.when(cheaper, new).otherwise(F.col(old)).alias(old)
    return onward.select("u", "v", F.col("dst").alias("node"), F.col("node").alias("parent"), pick(F.least("node", "dst"), "bn_i"), pick(F.greatest("node", "dst"), "bn_j"), pick(F.col("cost"), "bn_cost"))


def meeting(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Bottleneck edges (i, j) of paths whose two frontiers meet: the cheaper one, of equal ones that of the second."""
    side = lambda f, k: f.select("u", "v", "node", F.col("bn_i").alias(f"i{k}"), F.col("bn_j").alias(f"j{k}"), F.col("bn_cost").alias(f"c{k}"))
    met = side(rows, 1).join(side(cols, 2), ["u", "v", "node"])
    first = F.col("c1") < F.col("c2")
    return met.select(F.when(first, F.col("i1")).otherwise(F.col("i2")).alias("i"), F.when(first, F.col("j1")).otherwise(F.col("j2")).alias("j")).distinct()


def within_trees(nodes: DataFrame, forest: DataFrame, rep: DataFrame) -> DataFrame:
    """Repulsive edges whose ends are in one tree of the forest."""
    return between_components(rep.select("i", "j"), connected_components(nodes, forest))


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the forest of edges (a, b) over nodes 0 to n - 1: each node's tree (least node), parent, edge to it and depth; all trees walked at once."""
    tree, parent, up, depth = least_reached(n, a, b), np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1))
    at = np.unique(tree)
    while len(at):
        count = first[at + 1] - first[at]
        place = order[np.repeat(first[at] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        old, new, edge = src[place], dst[place], place % max(1, len(a))
        onward = new != parent[old]
        old, at, edge = old[onward], new[onward], edge[onward]
        parent[at], up[at], depth[at] = old, edge, depth[old] + 1
    return tree, parent, up, depth


def _climb(parent: np.ndarray, depth: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The edges of the paths from u to v, one a step of each path: places of paths, whether the step is up from u, the node whose edge up it is,
    and how many edges of that end were walked before."""
    ends, walked, open_ = np.stack([u, v]), np.zeros((2, len(u)), np.int64), np.flatnonzero(u != v)
    while len(open_):
        a, b = ends[:, open_]
        side = (depth[a] < depth[b]).astype(np.int64)
        node, before = ends[side, open_], walked[side, open_]
        yield open_, side == 0, node, before
        ends[side, open_] = parent[node]
        walked[side, open_] += 1
        open_ = open_[ends[0, open_] != ends[1, open_]]


def _bottlenecks(cost: np.ndarray, up: np.ndarray, parent: np.ndarray, depth: np.ndarray, u: np.ndarray, v: np.ndarray, length: int, steps: int) -> np.ndarray:
    """The edge to take out of each path of `length` edges, `steps` of them walked from u: the cheapest on each side, the older of equal ones; then
    the cheaper, of equal ones that of v."""
    best, age, edge = np.full((2, len(u)), np.inf), np.full((2, len(u)), length), np.full((2, len(u)), -1)
    for path, from_u, node, before in _climb(parent, depth, u, v):
        place = np.where(from_u, before, length - 1 - before)
        side = (place >= steps).astype(np.int64)
        old = np.where(side == 0, place, length - 1 - place)
        c = cost[up[node]]
        better = (c < best[side, path]) | (c == best[side, path]) & (old < age[side, path])
        side, path = side[better], path[better]
        best[side, path], age[side, path], edge[side, path] = c[better], old[better], up[node][better]
    return np.where((edge[1] < 0) | (best[0] < best[1]), edge[0], edge[1])


def _stepped(limit: float | None = None, length: int = 0, steps: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole trees after edges below `limit` went, or the bottlenecks of paths of `length` edges. Rows (tree, length, i, j, cost): forest edges have length 0,
    or -1 once no repulsive edge lies within their tree; repulsive ones have that of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        home, far, i, j, cost = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(5))
        ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b, n = at[: len(i)], at[len(i) :], len(ids)
        edge, rep = np.flatnonzero(far <= 0), np.flatnonzero(far > 0)
        if limit is not None:
            edge = edge[cost[edge] >= limit]
        if length:
            _, parent, up, depth = _rooted(n, a[edge], b[edge])
            due = rep[far[rep] == length]
            edge = np.delete(edge, _bottlenecks(cost[edge], up, parent, depth, a[due], b[due], length, steps))
        tree, parent, up, depth = _rooted(n, a[edge], b[edge])
        rep = rep[tree[a[rep]] == tree[b[rep]]]
        lengths = np.zeros(len(rep), np.int64)
        for path, *_ in _climb(parent, depth, a[rep], b[rep]):
            lengths[path] += 1
        active = np.zeros(n, bool)
        active[tree[a[rep]]] = True
        rows, far = np.concatenate([edge, rep]), np.concatenate([np.where(active[tree[a[edge]]], 0, -1), lengths])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (home[rows], far, i[rows], j[rows], cost[rows])], names=["tree", "length", "i", "j", "cost"])

    return run


#: Rows of whole trees in a task, about.
TREE_ROWS = 100_000
_STATE = "tree bigint, length bigint, i bigint, j bigint, cost double"


def _conflict_free_in_tasks(forest: DataFrame, rep: DataFrame, half: int, checked: int) -> DataFrame:
    """The search of `conflict_free` from after `half` half passes on, for (i, j, cost, tree) and (i, j, tree): trees lie whole in tasks.
    checked: after how many half passes the forest was thinned last.

    Two frontiers meet when their steps add up to the length of the path, which is unique; so tasks keep lengths, and the driver holds
    only the least length and the threshold, by which all trees go in step.
    """
    rows = forest.select("tree", F.lit(0).cast("bigint").alias("length"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("cost").cast("double").alias("cost"))
    rows = rows.unionByName(rep.select("tree", F.lit(1).cast("bigint").alias("length"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.lit(0.0).alias("cost")))
    done, floor, start = [], float("-inf"), half
    now = rows.repartition(max(1, -(-rows.count() // TREE_ROWS)), "tree")
    step = _stepped()
    while True:
        now = cut(now.mapInArrow(step, _STATE))
        done.append(now.where("length = -1"))
        now = now.where("length >= 0")
        left = reduce(DataFrame.unionByName, done, now.where("length = 0")).where(F.col("cost") >= floor).select("i", "j", "cost")
        while True:
            least = now.where("length > 0").agg(F.min("length")).first()[0]
            if least is None:
                return left
            look = -(-half // (2 * THIN_EVERY)) * 2 * THIN_EVERY
            look += 2 * THIN_EVERY * (look == checked)
            if look > start + least - 1:
                half = start + least
                step, start = _stepped(length=least, steps=half // 2 + half % 2 - start // 2 - start % 2), half
                break
            half = checked = look
            limit = left.agg(F.avg(F.when(F.col("cost") >= 0, F.col("cost"))) * THIN).first()[0]
            limit = float("inf") if limit is None else limit
            if not left.where(F.col("cost") < limit).isEmpty():
                floor, start, step = max(floor, limit), half, _stepped(limit=limit)
                break


def _trees_of(nodes: DataFrame, forest: DataFrame, rep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forest edges and the repulsive edges within a tree, each with its `tree`."""
    labels = cut(connected_components(nodes, forest))
    at = lambda end, name: labels.select(F.col("node").alias(end), F.col("component").alias(name))
    inside = rep.select("i", "j").join(at("i", "tree"), "i").join(at("j", "__other"), "j").where("tree = __other").select("i", "j", "tree")
    return forest.join(at("i", "tree"), "i").select("i", "j", "cost", "tree"), inside


def conflict_free(nodes: DataFrame, forest: DataFrame, rep: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """The forest without the edges that the general search takes out: then no repulsive edge lies within a tree.

    From both ends of every such edge, frontiers walk the forest in turn; where they meet, the path's cheapest edge goes and the walk
    starts anew. Every THIN_EVERY passes the forest is thinned. While a tree has more than `one_task` edges of both kinds, the walk is on frames;
    from then on whole trees are dealt to tasks.
    """
    forest, half, checked = cut(forest), 0, -1
    while True:
        labelled, inside = _trees_of(nodes, forest, rep)
        inside = cut(inside)
        if inside.isEmpty() or forest.isEmpty():
            return forest
        if one_task:
            sizes = labelled.select("tree").unionAll(inside.select("tree")).groupBy("tree").count()
            if sizes.agg(F.max("count")).first()[0] <= one_task:
                return _conflict_free_in_tasks(labelled, inside, half, checked)
        rep = inside.select("i", "j")
        rows, cols = seeds(rep, "i"), seeds(rep, "j")
        while True:
            if half % (2 * THIN_EVERY) == 0 and checked != half:
                checked, thinned = half, cut(thin(forest))
                if thinned.count() != forest.count():
                    forest = thinned
                    break
            if half % 2 == 0:
                rows = cut(expand(rows, forest))
            else:
                cols = cut(expand(cols, forest))
            half += 1
            gone = cut(meeting(rows, cols))
            if not gone.isEmpty():
                forest = cut(without(forest, gone))
                break


def contraction_map(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, cluster) of a conflict-free forest's trees, numbered from 0, and twice its count of edges."""
    joining, rep = split_by_sign(edges)
    forest = cut(maximum_spanning_forest(joining))
    if forest.isEmpty():
        return nodes.select("node", F.col("node").alias("cluster")), 0
    rep = cut(within_trees(nodes, forest, rep))
    for conflicts in (conflicts3, conflicts4):
        gone = cut(conflicts(forest, rep))
        if not gone.isEmpty():
            forest = cut(without(forest, gone))
            rep = cut(within_trees(nodes, forest, rep))
    forest = conflict_free(nodes, forest, rep)
    labels = connected_components(nodes, forest).select("node", F.col("component").alias("cluster"))
    return compress_labels(labels), 2 * forest.count()
