"""Queries that hold what iterates to the data's end against SQL: hand-made graphs with known results, and properties on the test tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.functions.expressions import edge_bound
from cleave.operators import components, forest, matching
from cleave.operators import edges as E
from cleave.options import PRESETS, Options
from cleave.plans import oracles as O
from cleave.plans.solver import solve
from cleave.session import cut
from cleave.sources import graphs

Edges = list[tuple[int, int, float]]

# Small graphs with the clusters that follow from the definitions.
TRIANGLE_A: Edges = [(0, 1, 1.1), (1, 2, -2.0), (2, 0, 3.0)]
TRIANGLE_B: Edges = [(0, 1, 1.5), (0, 2, -3.0), (1, 2, 1.0)]
SPARSE_IDS: Edges = [(0, 5, 1.0), (5, 0, 2.0), (5, 9, -1.0)]
ALL_APART: Edges = [(0, 1, -1.0), (1, 2, -2.0)]
ALL_TOGETHER: Edges = [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0)]
FOREST_1: Edges = [(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (0, 3, -3.0), (0, 2, -2.0)]
FOREST_2: Edges = [(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (0, 3, -3.0), (0, 2, -2.0), (0, 4, 0.5), (3, 4, 0.75), (3, 5, 0.9), (3, 2, 0.8)]
FOREST_3: Edges = [(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (0, 4, 0.5), (3, 4, 0.75), (3, 5, 0.9), (3, 2, 0.8), (1, 5, -2.0), (0, 2, -3.0), (0, 3, -1.0)]
LONG_PATH: Edges = [(0, 1, 1.0), (1, 2, 1.01), (2, 3, 1.02), (3, 4, 1.03), (4, 5, 1.04), (5, 6, 1.05), (0, 6, -5.0)]
MATCHING: Edges = [(0, 1, 2.0), (1, 2, 3.0), (0, 2, -1.0), (0, 3, 1.0), (1, 3, 2.0)]
TWO_PARTS: Edges = [(0, 1, 1.0), (0, 3, 1.0), (2, 4, 1.0), (2, 5, 1.0)]
#: name: edges, preset, further options, cluster by node, objective, lower bound.
SOLVED = {
    "triangle A": (TRIANGLE_A, "P", {}, [0, 1, 0], -0.9, -2.0),
    "triangle B": (TRIANGLE_B, "PD", {}, [0, 0, 1], -2.0, -2.0),
    "triangle B, frames": (TRIANGLE_B, "PD", {"local_edges": 0}, [0, 0, 1], -2.0, -2.0),
    "sparse ids": (SPARSE_IDS, "PD", {"sanitize_graph": True}, [0, -1, -1, -1, -1, 0, -1, -1, -1, 1], -1.0, -1.0),
    "all apart": (ALL_APART, "PD", {}, [0, 1, 2], -3.0, -3.0),
    "all together": (ALL_TOGETHER, "PD+", {}, [0, 0, 0, 1, 1], 0.0, 0.0),
}


def _frame(spark: SparkSession, edges: Edges) -> DataFrame:
    return spark.createDataFrame(edges, "i bigint, j bigint, cost double")


def _nodes(g: DataFrame) -> DataFrame:
    return g.select(F.explode(F.array("i", "j")).alias("node")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _values(rows: list[tuple], names: str) -> str:
    word = lambda v: "'" + v + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(word(v) for v in r) + ')' for r in rows)}) t({names})"


def solved_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, (edges, preset, more, *_) in SOLVED.items():
        found = solve(_frame(spark, edges), Options.preset(preset, verbose=False, **more))
        out.append(found.labels.select(F.lit(name).alias("graph"), "node", "cluster", F.lit(round(found.objective, 6)).alias("objective"), F.lit(round(found.lower_bound, 6)).alias("lower_bound")))
    return _union(out)


def solved_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters after each iteration, and the same graph stopped by a time limit of 0 seconds after whole iterations only."""
    found = solve(_frame(spark, TRIANGLE_A), Options.preset("P", verbose=False, dump_timeline=True))
    limited = solve(_frame(spark, ALL_TOGETHER), Options.preset("P", verbose=False, max_time_sec=0, local_edges=0))
    whole = limited.labels.agg(F.count("*").alias("node"), F.max("cluster").alias("most")).select(F.lit(-1).alias("iteration"), "node", (F.col("most") < 5).cast("bigint").alias("cluster"))
    return found.timeline.unionByName(whole)


def contracted_forests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, edges in (("one", FOREST_1), ("two", FOREST_2), ("three", FOREST_3), ("long", LONG_PATH)):
        g = _frame(spark, edges)
        to, twice = forest.contraction_map(_nodes(g), g)
        out.append(to.select(F.lit(name).alias("graph"), "node", "cluster", F.lit(twice).cast("bigint").alias("twice")))
    return _union(out)


def contracted_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _frame(spark, MATCHING)
    to, n = matching.contraction_map(_nodes(g), g, 0.0)
    return to.select("node", "cluster", F.lit(n).cast("bigint").alias("matched"))


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every option of every preset, and what an unknown preset does."""
    rows = [(p, k, float(v)) for p in PRESETS for k, v in asdict(Options.preset(p)).items() if k in PRESET_VALUES["PD"]]
    try:
        Options.preset("DP")
    except ValueError:
        rows.append(("DP", "raises", 1.0))
    return spark.createDataFrame(rows, "preset string, option string, value double")


# The presets' options as numbers.
_PD = {
    "max_cycle_length_lb": 5.0,
    "num_dual_itr_lb": 10.0,
    "max_cycle_length_primal": 3.0,
    "num_dual_itr_primal": 5.0,
    "num_outer_itr_dual": 1.0,
    "mean_multiplier_mm": 0.05,
    "matching_thresh_crossover_ratio": 0.05,
    "tri_memory_factor": 2.0,
    "only_compute_lb": 0.0,
}
PRESET_VALUES = {
    "PD": _PD,
    "P": _PD | {"max_cycle_length_lb": 0.0, "num_dual_itr_lb": 0.0, "max_cycle_length_primal": 0.0, "num_dual_itr_primal": 0.0},
    "PD+": _PD | {"max_cycle_length_primal": 5.0, "num_dual_itr_primal": 10.0},
    "D": _PD | {"num_outer_itr_dual": 5.0, "only_compute_lb": 1.0},
}


def _kept_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(graphs.customer_orders(spark, sf_dir))


def _claims(preset: str, graph, **more):
    """One row: nodes, whether clusters are numbered without gaps, whether the objective is that of the labels, whether the bound lies between the trivial one and
    the objective; for a bound only, without labels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        found = solve(g, Options.preset(preset, sanitize_graph=True, verbose=False, **more))
        gapless = agrees = True
        above = found.lower_bound <= 0
        if found.labels is not None:
            kept = E.sent_if_small(found.labels.where("cluster >= 0"))
            n, clusters, most = kept.agg(F.count("*"), F.count_distinct("cluster"), F.max("cluster")).first()
            ends = g.join(kept.toDF("i", "a"), "i", "left").join(kept.toDF("j", "b"), "j", "left")
            cut_cost, all_rows = F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("cost"))), F.lit(0.0)), F.coalesce(F.sum(edge_bound(F.col("cost"))), F.lit(0.0))
            cost, trivial = ends.agg(cut_cost, all_rows).first()
            gapless, agrees, above, nodes = clusters == most + 1, abs(cost - found.objective) < 1e-6, found.lower_bound <= cost + 1e-6, n
        else:
            trivial, nodes = E.trivial_bound(g).first()["bound"], _nodes(g).count()
        row = (nodes, gapless, agrees, above, trivial <= found.lower_bound + 1e-6, round(trivial, 6))
        return spark.createDataFrame([row], "nodes bigint, gapless boolean, objective_holds boolean, bound_holds boolean, beats_trivial boolean, trivial_bound double")

    return run


def _claims_sql(edges: str) -> str:
    nodes = f"(SELECT count(DISTINCT node) FROM (SELECT unnest([i, j]) AS node FROM {edges}))"
    return O.query(f"SELECT {nodes} AS nodes, true AS gapless, true AS objective_holds, true AS bound_holds, true AS beats_trivial, round(sum(least(cost, 0.0)), 6) AS trivial_bound FROM {edges}")


def both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: a solve by DataFrame steps alone against the one on arrays, on the orders graph."""
    g = cut(graphs.customer_orders(spark, sf_dir))
    frames, arrays = (solve(g, Options.preset("P", sanitize_graph=True, verbose=False, local_edges=n)) for n in (0, 200_000))
    other = frames.labels.join(arrays.labels.toDF("node", "other"), "node", "full").where("cluster IS DISTINCT FROM other").count()
    row = (frames.labels.where("cluster >= 0").count(), other, abs(frames.objective - arrays.objective) < 1e-6, abs(frames.lower_bound - arrays.lower_bound) < 1e-6)
    return spark.createDataFrame([row], "nodes bigint, apart bigint, same_objective boolean, same_bound boolean")


def forest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of a conflict-free contraction of the whole suppliers graph: nodes, gapless clusters, repulsive edges inside a cluster, clusters that attractive edges don't connect."""
    g = cut(graphs.suppliers(spark, sf_dir))
    to, _ = forest.contraction_map(_nodes(g), g)
    to = cut(to)
    ends = g.join(to.toDF("i", "a"), "i").join(to.toDF("j", "b"), "j")
    inside = ends.where("a = b AND cost <= 0").count()
    joined = components.connected_components(_nodes(g), ends.where("a = b AND cost > 0").select("i", "j"))
    pieces = joined.join(to, "node").groupBy("cluster").agg(F.count_distinct("component").alias("n")).where("n > 1").count()
    row = to.agg(F.count("*").alias("nodes"), (F.count_distinct("cluster") == F.max("cluster") + 1).alias("gapless"))
    return row.select("nodes", "gapless", F.lit(inside).cast("bigint").alias("inside"), F.lit(pieces).cast("bigint").alias("in_pieces"))


def general_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of the general search on the orders graph: forest edges that it made up, and repulsive edges that stay within a tree."""
    g = cut(graphs.customer_orders(spark, sf_dir))
    joining, rep = E.split_by_sign(g)
    tree = cut(forest.maximum_spanning_forest(joining))
    left = cut(forest.conflict_free(_nodes(g), tree, rep))
    stays = forest.within_trees(_nodes(g), left, rep).count()
    return spark.createDataFrame([(left.join(tree, ["i", "j", "cost"], "left_anti").count(), stays)], "made_up bigint, stay bigint")


def component_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a small graph, and of its steps on frames alone."""
    g = _frame(spark, TWO_PARTS)
    one = components.connected_components(_nodes(g), g).select(F.lit("one task").alias("way"), "node", "component")
    return one.unionByName(components.connected_components(_nodes(g), g, one_task=0).select(F.lit("frames").alias("way"), "node", "component"))


def spanning_forest_on_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum spanning forest by rounds on frames alone, without the finish in one task."""
    return forest.maximum_spanning_forest(E.attractive(cut(graphs.customer_orders(spark, sf_dir))), one_task=0)


def _thirds(g: DataFrame) -> DataFrame:
    return _nodes(g).where("node % 3 <> 0")


def _on(graph, f):
    return lambda spark, sf_dir: f(graph(spark, sf_dir))


def _fixture_rows(wanted: dict[str, list[int]], extra: dict[str, int]) -> list[tuple]:
    return [(name, node, cluster, extra[name]) for name, clusters in wanted.items() for node, cluster in enumerate(clusters)]


_FORESTS = {"one": [0, 1, 1, 2], "two": [0, 1, 1, 2, 2, 2], "three": [0, 1, 1, 2, 2, 3], "long": [0, 1, 1, 1, 1, 1, 1]}
_SOLVED_ROWS = [(name, node, c, objective, bound) for name, (_, _, _, clusters, objective, bound) in SOLVED.items() for node, c in enumerate(clusters)]
_TENS = "(SELECT DISTINCT unnest([i, j]) AS node FROM gs)"

#: name: (query, SQL).
CHECKED = {
    "proj_both_present": (_on(graphs.suppliers, lambda g: E.both_present(g, _thirds(g))), O.query("SELECT i, j, cost FROM gs WHERE i % 3 <> 0 AND j % 3 <> 0")),
    "filter_between_components": (
        _on(graphs.suppliers, lambda g: E.between_components(g, _nodes(g).select("node", (F.col("node") % 10).alias("component")), same=False)),
        O.query("SELECT i, j, cost FROM gs WHERE i % 10 <> j % 10"),
    ),
    "filter_unmatched_edges": (
        _on(graphs.suppliers, lambda g: matching.unmatched(g.where("cost > 0"), matching.mutual_pairs(matching.best_neighbours(g, E.matching_threshold(g, 0.05))))),
        O.query("SELECT i, j, cost FROM gs WHERE cost > 0 AND NOT EXISTS (SELECT 1 FROM m_p1 q WHERE gs.i IN (q.low, q.high) OR gs.j IN (q.low, q.high))", O.matching("gs", 0.05, 1, "m_")),
    ),
    "argmax_over_all_edges": (
        _on(graphs.suppliers, lambda g: matching.best_neighbours(g, g.agg((F.min("cost") - 1).alias("threshold")))),
        O.query("SELECT src AS node, dst AS best FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY cost DESC, dst) AS k FROM (SELECT i AS src, j AS dst, cost FROM gs UNION ALL SELECT j, i, cost FROM gs)) WHERE k = 1"),
    ),
    "matching_contraction_map": (
        _on(graphs.suppliers, lambda g: (lambda g: matching.contraction_map(_nodes(g), g, 0.05)[0])(cut(g))),
        O.query(
            f"SELECT node, dense_rank() OVER (ORDER BY least_node) - 1 AS cluster FROM (SELECT node, coalesce(low, node) AS least_node FROM {_TENS} LEFT JOIN m_pairs ON high = node)",
            O.matching("gs", 0.05, 10, "m_"),
        ),
    ),
    "matching_fixture": (contracted_matching, _values([(0, 0, 4), (1, 1, 4), (2, 1, 4), (3, 0, 4)], "node, cluster, matched")),
    "forest_fixtures": (contracted_forests, _values(_fixture_rows(_FORESTS, {"one": 2, "two": 6, "three": 4, "long": 10}), "graph, node, cluster, twice")),
    "components_fixture": (component_claims, _values([(way, n, c) for way in ("one task", "frames") for n, c in enumerate([0, 0, 2, 0, 2, 2])], "way, node, component")),
    "max_spanning_forest_frames": (spanning_forest_on_frames, O.query("SELECT i, j, cost FROM forest", O.FOREST)),
    "options_presets": (presets, _values([(p, k, v) for p, vs in PRESET_VALUES.items() for k, v in vs.items()] + [("DP", "raises", 1.0)], "preset, option, value")),
    "solve_fixtures": (solved_graphs, _values(_SOLVED_ROWS, "graph, node, cluster, objective, lower_bound")),
    "solve_timeline": (solved_timeline, _values([(0, 0, 0), (0, 1, 1), (0, 2, 0), (-1, 5, 1)], "iteration, node, cluster")),
    "solve_P_claims": (_claims("P", graphs.suppliers), _claims_sql("gs")),
    "solve_PD_claims": (_claims("PD", _kept_orders), _claims_sql("g")),
    "solve_PDplus_claims": (_claims("PD+", _kept_orders), _claims_sql("g")),
    "lower_bound_D_claims": (_claims("D", _kept_orders), _claims_sql("g")),
    "solve_both_ways": (both_ways, O.query("SELECT count(DISTINCT node) AS nodes, 0 AS apart, true AS same_objective, true AS same_bound FROM (SELECT unnest([i, j]) AS node FROM g)")),
    "forest_contraction_claims": (forest_claims, O.query("SELECT count(DISTINCT node) AS nodes, true AS gapless, 0 AS inside, 0 AS in_pieces FROM (SELECT unnest([i, j]) AS node FROM gs)")),
    "forest_general_claims": (general_claims, "SELECT 0 AS made_up, 0 AS stay"),
}
