"""The solver: a lower bound from the dual, then contraction by matchings and conflict-free forests."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cleave.functions.expressions import edge_bound
from cleave.metrics import Metrics
from cleave.operators import dual, forest, matching
from cleave.operators import edges as E
from cleave.operators.components import ONE_TASK
from cleave.options import Options
from cleave.plans import local
from cleave.plans.local import BadContraction
from cleave.session import cut

LOG = logging.getLogger("cleave")


@dataclass
class Result:
    """labels (node, cluster) with clusters numbered by their least node, or None for a bound only; objective on the given costs;
    timeline (iteration, node, cluster) if it was asked for."""

    labels: DataFrame | None
    lower_bound: float
    objective: float | None
    timeline: DataFrame | None
    elapsed_ms: float
    iterations: int = 0
    metrics: Metrics = field(default_factory=Metrics)


def solve(edges: DataFrame, options: Options | None = None) -> Result:
    """Cluster a signed graph (i, j, cost): costs above 0 attract, below 0 repel; the summed cost between clusters is minimised.

    Ids are 0 to some greatest one; with options.sanitize_graph any ids, repeated edges and self loops go, and ids without an
    edge get cluster -1. Above options.local_edges edges, every step is a DataFrame step; a graph of fewer, or one that
    contraction has brought below that number, is finished in this process, whose memory that number bounds. Without duals one task
    finishes a graph of ONE_TASK edges. Of at most SENT_ROWS nodes, this process holds their labels, however many edges there are.
    """
    options, began, metrics = options or Options(), time.monotonic(), Metrics()
    spark = edges.sparkSession
    given = cut(E.dedupe(edges.where("i <> j")) if options.sanitize_graph else E.validated(edges))
    ids = None
    work = given
    if options.sanitize_graph:
        with metrics.stage("sanitize"):
            work, ids = E.densified(given)
            work = cut(work.withColumn("cost", F.col("cost").cast("double")))
    else:
        work = cut(work.groupBy("i", "j").agg(F.sum("cost").alias("cost")))
    state, whole = _Solve(spark, options, metrics, began, _facts(work)), work
    with metrics.stage("dual bound"):
        work, bound = state.dual(work, options.max_cycle_length_lb, options.num_dual_itr_lb, options.num_outer_itr_dual, options.tri_memory_factor)
    state.tell("lower bound %s", bound)
    labels = objective = timeline = None
    if not options.only_compute_lb:
        found, timeline = state.primal(work)
        if ids is not None and timeline is not None:
            timeline = ids.join(timeline.withColumnRenamed("node", "dense"), "dense").select("iteration", "node", "cluster")
        if isinstance(found, np.ndarray):
            found = local.renumbered(found)
            labels = state.table(found)
            objective = E.objective(whole, F.broadcast(labels)).first()["objective"]
            if ids is not None:
                at = ids.toArrow()
                node = np.empty(len(found), np.int64)
                node[at["dense"].to_numpy()] = at["node"].to_numpy()
                labels = E.on_driver(spark, node=node, cluster=found)
                if options.label_gaps:
                    labels = E.with_gaps(F.broadcast(labels), int(node.max(initial=-1)) + 1)
        else:
            labels = found if ids is None else E.desanitize(found, ids, options.label_gaps)
            labels = cut(_renumbered(labels))
            objective = E.objective(given, E.sent_if_small(labels)).first()["objective"]
    return Result(labels, bound, objective, timeline, (time.monotonic() - began) * 1000, state.iterations, metrics)


def _facts(edges: DataFrame) -> Row:
    """What a step needs to know of edges and diagonal, in one pass: count, greatest id, greatest i, least inner cost, trivial bound, mean of costs that are not negative."""
    between, cost = F.col("i") != F.col("j"), F.col("cost")
    return edges.agg(
        F.count(F.when(between, 1)).alias("rows"),
        F.max(F.greatest("i", "j")).alias("most"),
        F.max(F.when(between, F.col("i"))).alias("most_i"),
        F.min(F.when(~between, cost)).alias("least"),
        F.coalesce(F.sum(F.when(between, edge_bound(cost))), F.lit(0.0)).alias("bound"),
        F.avg(F.when(between & (cost >= 0), cost)).alias("mean"),
    ).first()


def _renumbered(labels: DataFrame) -> DataFrame:
    """Clusters numbered from 0 in the order of their least node; -1 stays."""
    least = labels.where("cluster >= 0").groupBy("cluster").agg(F.min("node").alias("least"))
    named = labels.join(least, "cluster", "left").select("node", F.coalesce("least", F.lit(-1)).alias("cluster"))
    ranked = E.compress_labels(named.where("cluster >= 0"))
    return ranked.unionByName(named.where("cluster < 0"))


def _rest_on_arrays(n: int, options: Options, by_matching: bool, first: bool, spent: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (step, node, cluster) of the ids 0 to n - 1 after the last contraction, or after each for a timeline. spent: seconds before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, began = [b for b in batches if b.num_rows], time.monotonic()
        if not held:
            return
        graph = local.summed(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3)))
        late = lambda: options.max_time_sec >= 0 and int(spent + time.monotonic() - began) > options.max_time_sec
        steps = local.primal(graph, n, options, by_matching, first, late, lambda *_: None)
        for k in range(0 if options.dump_timeline else max(0, len(steps) - 1), len(steps)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, k), np.arange(n), steps[k])], names=["step", "node", "cluster"])

    return run


class _Solve:
    def __init__(self, spark, options: Options, metrics: Metrics, began: float, facts: Row):
        self.spark, self.options, self.metrics, self.began, self.facts = spark, options, metrics, began, facts
        self.n = 0 if facts.most is None else facts.most + 1
        self.iterations = 0

    def small(self) -> bool:
        return self.options.local_edges > 0 and self.facts.rows <= self.options.local_edges

    def one_task(self, n: int) -> bool:
        o = self.options
        return o.local_edges > 0 and (o.max_cycle_length_primal < 3 or not o.num_dual_itr_primal) and max(self.facts.rows, n) <= ONE_TASK

    def table(self, labels: np.ndarray) -> DataFrame:
        return E.on_driver(self.spark, node=np.arange(len(labels)), cluster=labels)

    def arrays(self, edges: DataFrame) -> local.Graph:
        found = edges.select("i", "j", "cost").toPandas()  # local_edges rows at most
        return local.summed(found["i"].to_numpy(np.int64), found["j"].to_numpy(np.int64), found["cost"].to_numpy(np.float64))

    def frame(self, graph: local.Graph) -> DataFrame:
        found = pd.DataFrame(dict(zip(("i", "j", "cost"), graph, strict=True)))
        return self.spark.createDataFrame(found, "i bigint, j bigint, cost double")

    def dual(self, edges: DataFrame, longest: int, steps: int, outer: int, factor: float) -> tuple[DataFrame, float]:
        if longest < 3 or not steps or not outer:
            return edges, self.facts.bound
        budget = factor if self.options.triangle_budget else None
        if self.small():
            graph, bound = local.dual(self.arrays(edges), longest, steps, outer, budget=budget)
            edges = self.frame(graph)
        else:
            edges, bound = dual.solve(edges, longest, steps, outer, budget=budget)
            edges = cut(edges)
        self.facts = _facts(edges)
        return edges, bound

    def tell(self, what: str, *values) -> None:
        if self.options.verbose:
            LOG.info(what, *values)

    def late(self) -> bool:
        return self.options.max_time_sec >= 0 and int(time.monotonic() - self.began) > self.options.max_time_sec

    def primal(self, edges: DataFrame) -> tuple[DataFrame | np.ndarray, DataFrame | None]:
        """Labels, as an array where the nodes are few, and the timeline."""
        o, n = self.options, self.n
        few = o.local_edges > 0 and n <= E.SENT_ROWS
        labels = np.arange(n) if few else self.spark.range(0, n).select(F.col("id").alias("node"), F.col("id").alias("cluster"))
        history: list[DataFrame] = []
        by_matching, first = o.matching_thresh_crossover_ratio <= 1.0, True
        while self.facts.rows:
            if self.small() or self.one_task(n):
                return self.finish(edges, labels, n, by_matching, first, history)
            if not first:
                with self.metrics.stage("dual"):
                    edges, _ = self.dual(edges, o.max_cycle_length_primal, o.num_dual_itr_primal, 1, 1.0)
            nodes = self.spark.range(0, n).withColumnRenamed("id", "node")
            with self.metrics.stage("contraction map"):
                if few and by_matching:
                    low, high, count = matching.match_few(edges, n, -1.0 if self.facts.mean is None else self.facts.mean * o.mean_multiplier_mm)
                    to = np.arange(n)
                    to[high] = low
                    to = local.ranks(to)
                elif by_matching:
                    mapping, count = matching.contraction_map(nodes, edges, o.mean_multiplier_mm)
                else:
                    mapping, count = forest.contraction_map(nodes, edges)
                    if few:
                        at, to = mapping.toArrow(), np.arange(n)
                        to[at["node"].to_numpy()] = at["cluster"].to_numpy()
                by_matching = by_matching and count >= (self.facts.most_i + 1) * o.matching_thresh_crossover_ratio
            self.tell("iteration %d: %d to contract", self.iterations, count)
            if not count:
                break
            mapping = F.broadcast(self.table(to)) if few else E.sent_if_small(cut(mapping))
            with self.metrics.stage("contract"):
                contracted = cut(E.contract(edges, mapping))
                self.facts = _facts(contracted)
                if self.facts.least is not None and self.facts.least < 0:
                    raise BadContraction("a contraction joined what repels")
                n, edges = self.facts.most + 1, E.remove_diagonal(contracted)
                labels = local.through(labels, to) if few else cut(E.compose_labels(labels, mapping))
            if o.dump_timeline:
                history.append((self.table(labels) if few else labels).select(F.lit(self.iterations).alias("iteration"), "node", "cluster"))
            self.iterations += 1
            first = False
            if self.late():
                break
        return labels, _timeline(history)

    def finish(self, edges: DataFrame, labels: DataFrame | np.ndarray, n: int, by_matching: bool, first: bool, history: list[DataFrame]) -> tuple[DataFrame | np.ndarray, DataFrame | None]:
        """The same loop on arrays, for the ids 0 to n - 1 that are left: here, or in one task."""
        o, before = self.options, self.iterations
        if self.small():
            tell = lambda what, *values: self.tell("on arrays: " + what, *values)
            steps = local.primal(self.arrays(edges), n, o, by_matching, first, self.late, tell)
            done = len(steps)
        else:
            flat = edges.select(F.col("i").cast("bigint"), F.col("j").cast("bigint"), F.col("cost").cast("double"))
            found = flat.repartition(1).mapInArrow(_rest_on_arrays(n, o, by_matching, first, time.monotonic() - self.began), "step bigint, node bigint, cluster bigint").toArrow()
            step, node, cluster = (found[c].to_numpy() for c in ("step", "node", "cluster"))
            done, steps = int(step.max(initial=-1)) + 1, []
            for k in np.unique(step).tolist():
                steps.append(np.empty(n, np.int64))
                steps[-1][node[step == k]] = cluster[step == k]
        if not done:
            return labels, _timeline(history)
        self.iterations += done
        frame = lambda to: self.spark.createDataFrame(pd.DataFrame({"node": np.arange(len(to)), "cluster": to}), "node bigint, cluster bigint")
        few = isinstance(labels, np.ndarray)
        if o.dump_timeline:
            after = lambda to: self.table(local.through(labels, to)) if few else E.compose_labels(labels, frame(to))
            history += [after(to).select(F.lit(before + k).alias("iteration"), "node", "cluster") for k, to in enumerate(steps)]
        if few:
            return local.through(labels, steps[-1]), _timeline(history)
        return cut(E.compose_labels(labels, frame(steps[-1]))), _timeline(history)


def _timeline(history: list[DataFrame]) -> DataFrame | None:
    if not history:
        return None
    out = history[0]
    for h in history[1:]:
        out = out.unionByName(h)
    return out
