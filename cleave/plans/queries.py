"""The clustering queries over graphs made from the test tables, each with its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.operators import components, dual, forest, matching, triangles
from cleave.operators import edges as E
from cleave.options import Options
from cleave.plans import evidence
from cleave.plans import oracles as O
from cleave.plans.solver import solve
from cleave.session import cut, shared_folder
from cleave.sources import graphs, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _on(graph, f) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(graph(spark, sf_dir))

    run.over = f
    return run


def _whole(f):
    return _on(graphs.suppliers, f)


def _orders(f):
    return _on(graphs.customer_orders, f)


def _nodes(g: DataFrame) -> DataFrame:
    return g.select(F.explode(F.array("i", "j")).alias("node")).distinct()


def _tens(g: DataFrame) -> DataFrame:
    return _nodes(g).select("node", (F.col("node") % 10).alias("cluster"))


def _six(name: str):
    return (F.round(name, 6) + F.lit(0.0)).alias(name)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_six(c) if c in names else c for c in df.columns])


def _turned(g: DataFrame) -> DataFrame:
    """Edges with every other one turned around."""
    odd = (F.col("i") + F.col("j")) % 2 == 1
    return g.select(F.when(odd, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(odd, F.col("i")).otherwise(F.col("j")).alias("j"), "cost")


# Sources and sinks.
def _text(g: DataFrame) -> DataFrame:
    path = f"{shared_folder(g.sparkSession)}/edges-{uuid.uuid4().hex}"
    text.write_edges(g, path)
    return text.read_edges(g.sparkSession, path)


_add("src_text_edges", _orders(_text), O.query("SELECT i, j, cost FROM g"))
_add(
    "sink_cluster_lists",
    _whole(lambda g: text.cluster_lines(_nodes(g).select("node", (F.col("node") % 7 * 2).alias("cluster")))),
    O.query(
        "SELECT c AS cluster, coalesce(line, '') AS line FROM (SELECT unnest(range(0, (SELECT max(cluster) + 1 FROM l))) AS c) LEFT JOIN (SELECT cluster, string_agg(node::VARCHAR, chr(9) ORDER BY node) AS line FROM l GROUP BY 1) ON c = cluster",
        "l AS (SELECT DISTINCT node, node % 7 * 2 AS cluster FROM (SELECT unnest([i, j]) AS node FROM gs))",
    ),
)

# Projections, filters, partitions.
_add("proj_canonical_edges", _whole(lambda g: E.canonical(_turned(g))), O.query("SELECT i, j, cost FROM gs"))
_add("proj_to_directed", _whole(lambda g: E.to_directed(E.symmetric(g))), O.query("SELECT i, j, cost FROM gs"))
_add("setop_to_undirected", _whole(E.symmetric), O.query("SELECT i AS src, j AS dst, cost FROM gs UNION ALL SELECT j, i, cost FROM gs"))
_MAPPED = "mapped AS (SELECT least(i % 10, j % 10) AS i, greatest(i % 10, j % 10) AS j, cost FROM gs)"
_add("filter_remove_diagonal", _whole(lambda g: E.remove_diagonal(E.map_endpoints(g, _tens(g)))), O.query("SELECT i, j, cost FROM mapped WHERE i <> j", _MAPPED))
_add("join_map_endpoints", _whole(lambda g: E.map_endpoints(g, _tens(g))), O.query("SELECT i, j, cost FROM mapped", _MAPPED))
_add("contract_graph", _whole(lambda g: E.contract(g, _tens(g))), O.query("SELECT i, j, sum(cost) AS cost FROM mapped GROUP BY 1, 2", _MAPPED))
_add(
    "agg_diagonal",
    _whole(lambda g: E.diagonal(E.contract(g, _tens(g)).where("i > 2 OR i <> j"), _tens(g).select(F.col("cluster").alias("node")).distinct())),
    O.query("SELECT n AS node, coalesce((SELECT sum(cost) FROM mapped WHERE i = j AND i = n AND i > 2), 0.0) AS cost FROM (SELECT DISTINCT node % 10 AS n FROM (SELECT unnest([i, j]) AS node FROM gs))", _MAPPED),
)
_add("check_bad_contractions", _whole(lambda g: E.bad_contractions(E.contract(g, _tens(g)))), O.query("SELECT i AS node, sum(cost) AS cost FROM mapped WHERE i = j GROUP BY 1 HAVING sum(cost) < 0", _MAPPED))
_add("filter_cost_range", _whole(lambda g: E.cost_range(g, -2.0, 3.0)), O.query("SELECT i, j, cost FROM gs WHERE cost BETWEEN -2 AND 3"))
_add("filter_attractive", _whole(E.attractive), O.query("SELECT i, j, cost FROM gs WHERE cost > 0"))
_add("filter_repulsive", _whole(E.repulsive), O.query("SELECT i, j, cost FROM gs WHERE cost < 0"))


def _sided(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    return parts[0].withColumn("side", F.lit("attractive")).unionByName(parts[1].withColumn("side", F.lit("repulsive")))


_add("partition_signed_edges", _whole(lambda g: _sided(E.split_by_sign(g))), O.query("SELECT i, j, cost, CASE WHEN cost > 0 THEN 'attractive' ELSE 'repulsive' END AS side FROM gs"))
_add(
    "partition_with_tolerance",
    _whole(lambda g: _sided((lambda a, r: (a.select(F.col("src").alias("i"), F.col("dst").alias("j")), r))(*E.split_with_tolerance(g)))),
    O.query("SELECT s AS i, d AS j, 'attractive' AS side FROM z_near UNION ALL SELECT i, j, 'repulsive' FROM z_rep", O.cycles("gs", 3, "z_")),
)
_add("filter_forest_threshold", _orders(lambda g: forest.thin(forest.maximum_spanning_forest(E.attractive(g)))), O.query("SELECT i, j, cost FROM forest WHERE cost >= 0.9 * (SELECT avg(cost) FROM forest WHERE cost >= 0)", O.FOREST))

# Sorts, distinct, limits.
_add("sort_edges_coo", _whole(E.sort_ranks), O.query("SELECT i, j, cost, row_number() OVER (ORDER BY i, j) AS place FROM gs"))
_add(
    "tri_normalize",
    _whole(lambda g: triangles.normalize(g.select(F.col("i").alias("a"), F.col("j").alias("b"), ((F.col("i") * 7 + F.col("j")) % 23 + 1).alias("c")))),
    O.query("SELECT DISTINCT t[1] AS a, t[2] AS b, t[3] AS c FROM (SELECT list_sort([i, j, (i * 7 + j) % 23 + 1]) AS t FROM gs WHERE (i * 7 + j) % 23 + 1 NOT IN (i, j))"),
)
_first = lambda g: g.select(F.col("i").alias("v"))
_add("agg_unique_counts", _whole(lambda g: E.run_lengths(_first(g))), O.query("SELECT i AS v, count(*) AS n FROM gs GROUP BY 1"))
_add("gen_invert_unique", _whole(lambda g: E.expand_runs(E.run_lengths(_first(g)))), O.query("SELECT i AS v, row_number() OVER (PARTITION BY i ORDER BY j) AS k FROM gs"))
_add(
    "topk_triangle_budget",
    _orders(lambda g: (lambda g: triangles.strongest(triangles.conflicted(g, 4), g, int(0.5 * g.where("cost < 0").count())))(cut(g))),
    O.query(
        "SELECT a, b, c, strength, place FROM (SELECT *, row_number() OVER (ORDER BY strength DESC, a, b, c) AS place FROM (SELECT a, b, c, min(coalesce(abs(cost), 0.0)) AS strength FROM s LEFT JOIN g USING (i, j) GROUP BY 1, 2, 3)) WHERE place <= (SELECT floor(0.5 * count(*)) FROM g WHERE cost < 0)",
        O.cycles("g", 4, "z_"),
        "s AS (SELECT a, b, c, unnest([a, a, b]) AS i, unnest([b, c, c]) AS j FROM z_tri)",
    ),
)
_twice = lambda g: _turned(g).unionByName(g.where("i % 2 = 0").select("i", "j", (F.col("cost") - 1).alias("cost")))
_add("dedupe_edges", _whole(lambda g: E.dedupe(_twice(g))), O.query("SELECT i, j, CASE WHEN i % 2 = 0 THEN cost - 1 ELSE cost END AS cost FROM gs"))

# Set operations.
_add("setop_intersect_edges", _orders(lambda g: (lambda g: dual.side_costs(g, triangles.conflicted(g, 4)))(cut(g))), O.query("SELECT c.i, c.j, coalesce(cost, 0.0) AS cost FROM y_count c LEFT JOIN g ON g.i = c.i AND g.j = c.j", O.cycles("g", 4, "z_"), O.dual_start("g", "z_tri", "y_")))
_add("setop_union_edges", _orders(lambda g: (lambda g: dual.with_chords(g, triangles.conflicted(g, 4)).select("i", "j", "cost"))(cut(g))), O.query("SELECT i, j, cost FROM y_e0", O.cycles("g", 4, "z_"), O.dual_start("g", "z_tri", "y_")))
_add("setop_forest_difference", _orders(lambda g: (lambda f: forest.without(f, f.where("cost < 3")))(cut(forest.maximum_spanning_forest(E.attractive(g))))), O.query("SELECT i, j, cost FROM forest WHERE cost >= 3", O.FOREST))

# Joins.
_add(
    "join_map_old_consec",
    _whole(lambda g: E.map_to_consecutive(g.select("i", F.col("j").alias("v")), g.where("cost > 0").select(F.col("i").alias("v")))),
    O.query("SELECT gs.i, gs.j AS v, coalesce(r, -1) AS new FROM gs LEFT JOIN (SELECT i, row_number() OVER (ORDER BY i) - 1 AS r FROM (SELECT DISTINCT i FROM gs WHERE cost > 0)) k ON k.i = gs.j"),
)
_add(
    "join_compose_labels",
    _whole(lambda g: E.compose_labels(_tens(g), _tens(g).select(F.col("cluster").alias("node")).distinct().where("node < 7").select("node", (F.col("node") % 3).alias("cluster")))),
    O.query("SELECT DISTINCT node, CASE WHEN node % 10 < 7 THEN node % 10 % 3 ELSE node % 10 END AS cluster FROM (SELECT unnest([i, j]) AS node FROM gs)"),
)


def _cycles(kind):
    def run(g: DataFrame) -> DataFrame:
        sym, rep = E.split_with_tolerance(cut(g))
        return kind(sym.select("src", "dst"), rep)

    return _orders(run)


_tri = "SELECT a, b, c FROM z_tri"
_add("cycles3", _cycles(triangles.three_cycles), O.query(_tri, O.cycles("g", 3, "z_")))
_add("cycles4", _cycles(triangles.four_cycles), O.query(_tri, O.cycles("g", 4, "z_", 4)))
_add("cycles5", _cycles(triangles.five_cycles), O.query(_tri, O.cycles("g", 5, "z_", 5)))
_add("cycles_upto5", _orders(lambda g: triangles.conflicted(cut(g), 5)), O.query(_tri, O.cycles("g", 5, "z_")))


def _trees(f) -> Callable[[SparkSession, str], DataFrame]:
    def run(g: DataFrame) -> DataFrame:
        g = cut(g)
        joining, rep = E.split_by_sign(g)
        tree = cut(forest.maximum_spanning_forest(joining))
        return f(g, tree, forest.within_trees(_nodes(g), tree, rep))

    return _orders(run)


_SAME = ["held AS MATERIALIZED (SELECT m.i, m.j FROM minus m JOIN t_cc x ON x.node = m.i JOIN t_cc y ON y.node = m.j WHERE x.component = y.component)"]
_TREES = [O.FOREST, O.components("gnodes", "forest", "t_"), *_SAME]
_add("max_spanning_forest", _orders(lambda g: forest.maximum_spanning_forest(E.attractive(cut(g)))), O.query("SELECT i, j, cost FROM forest", O.FOREST))
_add("connected_components", _orders(lambda g: (lambda g: components.connected_components(_nodes(g), E.attractive(g)))(cut(g))), O.query("SELECT node, component FROM t_cc", O.FOREST, O.components("gnodes", "plus", "t_")))
_add("filter_rep_by_component", _trees(lambda g, f, rep: rep), O.query("SELECT i, j FROM held", *_TREES))
_add(
    "forest_conflict3",
    _trees(lambda g, f, rep: forest.conflicts3(f, rep)),
    O.query("SELECT DISTINCT CASE WHEN x.cost < y.cost THEN least(h.i, x.dst) ELSE least(h.j, x.dst) END AS i, CASE WHEN x.cost < y.cost THEN greatest(h.i, x.dst) ELSE greatest(h.j, x.dst) END AS j FROM held h JOIN fs x ON x.src = h.i JOIN fs y ON y.src = h.j AND y.dst = x.dst", *_TREES),
)
_add(
    "forest_conflict4",
    _trees(lambda g, f, rep: forest.conflicts4(f, rep)),
    O.query(
        "SELECT DISTINCT least(p, q) AS i, greatest(p, q) AS j FROM (SELECT CASE WHEN c1 < c2 AND c1 < c3 THEN a WHEN c2 < c3 THEN n ELSE b END AS p, CASE WHEN c1 < c2 AND c1 < c3 THEN n ELSE m END AS q FROM w)",
        *_TREES,
        "w AS (SELECT h.i AS a, h.j AS b, x.dst AS n, y.dst AS m, x.cost AS c1, y.cost AS c2, z.cost AS c3 FROM held h JOIN fs x ON x.src = h.i JOIN fs y ON y.src = x.dst JOIN fs z ON z.src = y.dst AND z.dst = h.j)",
    ),
)
_FRONT = "row1 AS MATERIALIZED (SELECT h.i AS u, h.j AS v, x.dst AS node, h.i AS parent, least(h.i, x.dst) AS bn_i, greatest(h.i, x.dst) AS bn_j, x.cost AS bn_cost FROM held h JOIN fs x ON x.src = h.i)"
_ROW2 = "row2 AS MATERIALIZED (SELECT r.u, r.v, x.dst AS node, r.node AS parent, CASE WHEN x.cost < r.bn_cost THEN least(r.node, x.dst) ELSE r.bn_i END AS bn_i, CASE WHEN x.cost < r.bn_cost THEN greatest(r.node, x.dst) ELSE r.bn_j END AS bn_j, least(r.bn_cost, x.cost) AS bn_cost FROM row1 r JOIN fs x ON x.src = r.node AND x.dst <> r.parent)"
_COL1 = "col1 AS MATERIALIZED (SELECT h.i AS u, h.j AS v, x.dst AS node, least(h.j, x.dst) AS bn_i, greatest(h.j, x.dst) AS bn_j, x.cost AS bn_cost FROM held h JOIN fs x ON x.src = h.j)"
_add("frontier_expand", _trees(lambda g, f, rep: forest.expand(forest.expand(forest.seeds(rep, "i"), f), f)), O.query("SELECT * FROM row2", *_TREES, _FRONT, _ROW2))
_add(
    "frontier_meet",
    _trees(lambda g, f, rep: forest.meeting(forest.expand(forest.expand(forest.seeds(rep, "i"), f), f), forest.expand(forest.seeds(rep, "j"), f))),
    O.query("SELECT DISTINCT CASE WHEN r.bn_cost < c.bn_cost THEN r.bn_i ELSE c.bn_i END AS i, CASE WHEN r.bn_cost < c.bn_cost THEN r.bn_j ELSE c.bn_j END AS j FROM row2 r JOIN col1 c ON r.u = c.u AND r.v = c.v AND r.node = c.node", *_TREES, _FRONT, _ROW2, _COL1),
)

# Aggregations and scans.
_add("agg_sum_min_max", _whole(E.cost_summary), O.query("SELECT sum(cost) AS total, min(cost) AS least, max(cost) AS most FROM gs"))
_add("agg_trivial_lb", _whole(E.trivial_bound), O.query("SELECT sum(least(cost, 0.0)) AS bound FROM gs"))
_add("agg_objective", _whole(lambda g: E.objective(g, _tens(g))), O.query("SELECT coalesce(sum(cost) FILTER (WHERE i % 10 <> j % 10), 0.0) AS objective FROM gs"))
_add("agg_matching_threshold", _whole(lambda g: _rounded(E.matching_threshold(g, 0.05), "threshold")), O.query("SELECT round(avg(cost) FILTER (WHERE cost >= 0) * 0.05, 6) AS threshold FROM gs"))
_add("scan_row_offsets", _whole(lambda g: E.row_offsets(_first(g))), O.query("SELECT v, (SELECT count(*) FROM gs WHERE i < v) AS start FROM (SELECT unnest(range(0, (SELECT max(i) + 2 FROM gs))) AS v)"))
_DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT unnest([i, j]) AS node FROM gs) GROUP BY 1)"
_add("agg_degrees", _whole(E.degrees), O.query("SELECT node, degree FROM deg", _DEG))
_add("scan_degrees_to_offsets", _whole(lambda g: E.degrees_to_offsets(E.degrees(g))), O.query("SELECT node, coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM deg", _DEG))
_add("scan_compress_labels", _whole(lambda g: E.compress_labels(_nodes(g).select("node", (F.col("node") * 7 % 31 * 3).alias("cluster")))), O.query("SELECT node, dense_rank() OVER (ORDER BY node * 7 % 31) - 1 AS cluster FROM (SELECT DISTINCT unnest([i, j]) AS node FROM gs)"))
_sparse = lambda g: _twice(g).select((F.col("i") * 3 + 5).alias("i"), (F.col("j") * 3 + 5).alias("j"), "cost")
_IDS = "ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS d FROM (SELECT DISTINCT unnest([i, j]) AS node FROM gs))"
_add("sanitize_graph", _whole(lambda g: E.sanitize(_sparse(g))[0]), O.query("SELECT x.d AS i, y.d AS j, CASE WHEN i % 2 = 0 THEN cost - 1 ELSE cost END AS cost FROM gs JOIN ids x ON x.node = i JOIN ids y ON y.node = j", _IDS))
_add(
    "desanitize_labels",
    _whole(lambda g: (lambda ids: E.desanitize(ids.select(F.col("dense").alias("node"), (F.col("dense") % 4).alias("cluster")), ids))(E.sanitize(_sparse(g))[1])),
    O.query("SELECT k AS node, coalesce(d % 4, -1) AS cluster FROM (SELECT unnest(range(0, (SELECT max(node) * 3 + 6 FROM ids))) AS k) LEFT JOIN ids ON node * 3 + 5 = k", _IDS),
)
_add("agg_edge_triangle_count", _orders(lambda g: dual.triangle_counts(triangles.conflicted(cut(g), 5))), O.query("SELECT i, j, n AS n_tri FROM y_count", O.cycles("g", 5, "z_"), O.dual_start("g", "z_tri", "y_")))
_add(
    "argmax_best_neighbour",
    _whole(lambda g: matching.best_neighbours(g, E.matching_threshold(g, 0.05))),
    O.query("SELECT src AS node, dst AS best FROM m_b1", O.matching("gs", 0.05, 1, "m_")),
)

# Matching.
_add("matching_one_round", _whole(lambda g: (lambda g: matching.mutual_pairs(matching.best_neighbours(g, E.matching_threshold(g, 0.05))))(cut(g))), O.query("SELECT low, high FROM m_p1", O.matching("gs", 0.05, 1, "m_")))
_add("matching_full", _whole(lambda g: matching.match(cut(g), 0.05)[0]), O.query("SELECT low, high FROM m_pairs", O.matching("gs", 0.05, 10, "m_")))

# Conflict-free forests: the search depends on the data, so tests hold them against properties and an independent version.
_add("forest_contraction_map", _whole(lambda g: (lambda g: forest.contraction_map(_nodes(g), g)[0])(cut(g))))


def _general(g: DataFrame) -> DataFrame:
    g = cut(g)
    joining, rep = E.split_by_sign(g)
    return forest.conflict_free(_nodes(g), forest.maximum_spanning_forest(joining), rep)


_add("forest_conflict_general", _orders(_general))

# Dual.
_Z = [O.cycles("g", 5, "z_"), O.dual_start("g", "z_tri", "y_")]
_names = ("c12", "c13", "c23")


def _messages(f):
    def run(g: DataFrame) -> DataFrame:
        g = cut(g)
        return f(*(cut(x) for x in dual.start(g, cut(triangles.conflicted(g, 5)))))

    return _orders(run)


_T = "SELECT a, b, c, round(x, 6) + 0.0 AS c12, round(y, 6) + 0.0 AS c13, round(z, 6) + 0.0 AS c23 FROM "
_E = "SELECT i, j, round(cost, 6) + 0.0 AS cost, n AS n_tri FROM "
_add("dual_init", _messages(lambda e, t: e), O.query("SELECT i, j, cost, n AS n_tri FROM y_e0", *_Z))
_add("dual_send_to_triplets", _messages(lambda e, t: _rounded(dual.send_to_triangles(e, t)[1], *_names)), O.query(_T + "y_r1", *_Z, O.dual_down("y_", 1)))
_add("dual_send_to_edges", _messages(lambda e, t: _rounded(dual.send_to_edges(*dual.send_to_triangles(e, t))[0], "cost")), O.query(_E + "y_e1", *_Z, O.dual_down("y_", 1), O.dual_up("y_", 1)))
_add("dual_one_iteration", _messages(lambda e, t: _rounded(dual.iterate(e, t)[1], *_names)), O.query(_T + "y_t1", *_Z, O.dual_down("y_", 1), O.dual_up("y_", 1)))
_add("agg_dual_lower_bound", _messages(lambda e, t: _rounded(dual.lower_bound(*dual.iterate(e, t)), "bound")), O.query("SELECT round(lb, 6) AS bound FROM y_l1", *_Z, O.dual_down("y_", 1), O.dual_up("y_", 1)))
_add("dual_reparametrize", _orders(lambda g: _rounded(dual.update(cut(g), 3, 2)[0], "cost")), O.query("SELECT i, j, round(cost, 6) + 0.0 AS cost FROM d_edges", O.dual_update("g", 3, 2, "d_")))


def _dual_cycle3(g: DataFrame) -> DataFrame:
    _, bound, n = dual.update(cut(g), 3, 5)
    return g.sparkSession.createDataFrame([(round(bound, 6), n)], "lower_bound double, n_tri bigint")


def _dual_bound(g: DataFrame) -> DataFrame:
    _, bound = dual.solve(cut(g), 4, 2, 1)
    return g.sparkSession.createDataFrame([(round(bound, 6),)], "lower_bound double")


_add("dual_cycle3", _orders(_dual_cycle3), O.query("SELECT round(lb, 6) AS lower_bound, n_tri FROM d_final", O.dual_update("g", 3, 5, "d_")))
_add("dual_lower_bound", _orders(_dual_bound), O.query("SELECT round(lb, 6) AS lower_bound FROM f_final", O.dual_update("g", 3, 2, "d_"), O.dual_update("d_edges", 4, 2, "f_")))


# The same on every edge of the suppliers graph, and the same SQL there. Not so for cycles of four and five edges: see the README.
WHOLE = "src_text_edges connected_components max_spanning_forest filter_forest_threshold setop_forest_difference filter_rep_by_component forest_conflict3 forest_conflict4 frontier_expand frontier_meet cycles3".split()
for _name in WHOLE:
    _add(f"{_name}_whole", _whole(QUERIES[_name].over), O.whole(ORACLES[_name]))


# Solver: iterative to the data's end; tests hold it against bounds, brute force and the array version.
def _solved(preset: str, graph=graphs.customer_orders):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = solve(graph(spark, sf_dir), Options.preset(preset, sanitize_graph=True, verbose=False))
        if found.labels is None:
            return spark.createDataFrame([(round(found.lower_bound, 6),)], "lower_bound double")
        return found.labels.select("node", "cluster", F.lit(round(found.objective, 6)).alias("objective"), F.lit(round(found.lower_bound, 6)).alias("lower_bound"))

    return run


_add("solve_P", _solved("P", graphs.suppliers))
_add("solve_PD", _solved("PD"))
_add("solve_PDplus", _solved("PD+"))
_add("lower_bound_D", _solved("D"))

for _name, (_run, _sql) in evidence.CHECKED.items():
    _add(_name, _run, _sql)
