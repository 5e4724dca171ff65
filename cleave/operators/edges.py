"""Edge tables (i, j, cost): forms, filters, partitions, mapping, contraction and their sums.

Canonical form has one row an undirected edge with i < j. The symmetric form (src, dst, cost) has both directions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.functions.expressions import edge_bound
from cleave.operators.prefix import dense_ids, exclusive_sum, ranked
from cleave.session import cut

#: Rows of a result of `cut` that goes whole to every task of a join (16 bytes each), at most.
SENT_ROWS = 1 << 16


def sent_if_small(df: DataFrame) -> DataFrame:
    """A table or a result of `cut`, marked to be broadcast in joins if it has SENT_ROWS rows at most: the edges then stay where they are."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def on_driver(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """A table of SENT_ROWS rows at most from arrays."""
    return spark.createDataFrame(pa.table(columns))


def canonical(edges: DataFrame) -> DataFrame:
    """Endpoints in rising order."""
    return edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cost")


def validated(edges: DataFrame) -> DataFrame:
    """Canonical edges; a self loop or a null stops the job that reads them."""
    bad = F.col("i").isNull() | F.col("j").isNull() | F.col("cost").isNull() | (F.col("i") == F.col("j"))
    checked = edges.select(F.when(bad, F.raise_error(F.lit("self loop or null in the edge table")).cast("bigint")).otherwise(F.col("i").cast("bigint")).alias("i"), F.col("j").cast("bigint").alias("j"), F.col("cost").cast("double").alias("cost"))
    return canonical(checked)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, from one scan."""
    both = F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"))))
    rest = [c for c in edges.columns if c not in ("i", "j")]
    return edges.select(both.alias("e"), *rest).select("e.src", "e.dst", *rest)


def to_directed(sym: DataFrame) -> DataFrame:
    """The rising direction of a symmetric table."""
    return sym.where("src < dst").withColumnsRenamed({"src": "i", "dst": "j"})


def remove_diagonal(edges: DataFrame) -> DataFrame:
    return edges.where("i <> j")


def cost_range(edges: DataFrame, low: float, high: float) -> DataFrame:
    """Costs from low to high, both included."""
    return edges.where(F.col("cost").between(low, high))


def attractive(edges: DataFrame, tol: float = 0.0) -> DataFrame:
    return edges.where(F.col("cost") > tol)


def repulsive(edges: DataFrame, tol: float = 0.0) -> DataFrame:
    return edges.where(F.col("cost") < tol)


def split_by_sign(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with cost > 0, and the rest: an edge of cost 0 does not join."""
    return edges.where("cost > 0"), edges.where("cost <= 0")


def tolerance(edges: DataFrame, ratio: float) -> DataFrame:
    """One row `tol`: the least cost times ratio."""
    return edges.agg((F.min("cost") * ratio).alias("tol"))


def split_with_tolerance(edges: DataFrame, ratio: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Symmetric edges above -tol, and edges (i, j) below tol; costs near zero are on neither side."""
    with_tol = edges.join(F.broadcast(tolerance(edges, ratio)))  # one row
    return symmetric(with_tol.where("cost > -tol").drop("tol")), with_tol.where("cost < tol").select("i", "j")


def dedupe(edges: DataFrame) -> DataFrame:
    """One row an undirected edge: the least cost."""
    return canonical(edges).groupBy("i", "j").agg(F.min("cost").alias("cost"))


def sanitize(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deduplicated edges without self loops over dense ids, and the map (node, dense) that keeps the ids' order."""
    return densified(dedupe(edges.where("i <> j")))


def densified(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique edges over dense ids, and the map (node, dense) that keeps the ids' order; of SENT_ROWS ids at most, the driver makes the map."""
    found = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct().limit(SENT_ROWS + 1).toArrow()["node"].combine_chunks()
    if len(found) <= SENT_ROWS and not found.null_count and pa.types.is_integer(found.type):
        ids = on_driver(edges.sparkSession, node=np.sort(found.to_numpy()), dense=np.arange(len(found)))
        return _mapped(edges, F.broadcast(ids).select("node", F.col("dense").alias("to"))), ids
    ids = cut(dense_ids(edges.select(F.explode(F.array("i", "j")).alias("node")), "node", "dense"))
    return _mapped(edges, sent_if_small(ids).select("node", F.col("dense").alias("to"))), ids


def desanitize(labels: DataFrame, ids: DataFrame, gaps: bool = True) -> DataFrame:
    """(node, cluster) for every id from 0 to the greatest; -1 for ids without an edge. labels are over dense ids.

    That is as many rows as the greatest id says. With `gaps` False, only ids that have an edge: so for ids that are far apart.
    """
    known = ids.join(labels.select(F.col("node").alias("dense"), "cluster"), "dense").select("node", "cluster")
    if not gaps:
        return known
    most = ids.agg(F.max("node")).first()[0]
    return with_gaps(known, 0 if most is None else most + 1)


def with_gaps(known: DataFrame, n: int) -> DataFrame:
    """(node, cluster) for the ids 0 to n - 1; -1 for those that are not known."""
    spine = known.sparkSession.range(0, n).withColumnRenamed("id", "node")
    return spine.join(known, "node", "left").select("node", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def _mapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both endpoints replaced by mapping (node, to), in canonical order; nodes without a row there stay as they are."""
    for end in ("i", "j"):
        edges = edges.join(mapping.select(F.col("node").alias(end), F.col("to").alias("__to")), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return canonical(edges)


def map_endpoints(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Both endpoints replaced by their cluster."""
    return _mapped(edges, labels.select("node", F.col("cluster").alias("to")))


def map_to_consecutive(values: DataFrame, old: DataFrame, column: str = "v") -> DataFrame:
    """`values` with `new`: the rank from 0 of `column` among the distinct values of `old`, -1 where it isn't there."""
    ranks = dense_ids(old.select(F.col(column).alias("__k")), "__k", "__r")
    return values.join(ranks, F.col(column) == F.col("__k"), "left").withColumn("new", F.coalesce("__r", F.lit(-1)).cast("bigint")).drop("__k", "__r")


def compose_labels(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """(node, cluster) after clusters were mapped on by (node, cluster); clusters that are not mapped stay."""
    step = mapping.select(F.col("node").alias("__at"), F.col("cluster").alias("__to"))
    return labels.join(step, F.col("cluster") == F.col("__at"), "left").select("node", F.coalesce("__to", "cluster").alias("cluster"))


def compress_labels(labels: DataFrame) -> DataFrame:
    """Clusters renumbered from 0 in their order."""
    ranks = dense_ids(labels.select(F.col("cluster").alias("__k")), "__k", "__r")
    return labels.join(ranks, F.col("cluster") == F.col("__k")).select("node", F.col("__r").alias("cluster"))


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between clusters with summed costs; what lies within a cluster is its diagonal (i = j)."""
    return map_endpoints(edges, labels).groupBy("i", "j").agg(F.sum("cost").alias("cost"))


def diagonal(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, cost) of rows with i = j; with `nodes`, 0 for the others."""
    own = edges.where("i = j").select(F.col("i").alias("node"), "cost")
    return own if nodes is None else nodes.select("node").join(own, "node", "left").select("node", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def bad_contractions(edges: DataFrame) -> DataFrame:
    """Clusters whose inner cost is negative."""
    return diagonal(edges).where("cost < 0")


def cost_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum("cost").alias("total"), F.min("cost").alias("least"), F.max("cost").alias("most"))


def trivial_bound(edges: DataFrame) -> DataFrame:
    """The sum of negative costs: no clustering costs less."""
    return edges.agg(F.coalesce(F.sum(edge_bound(F.col("cost"))), F.lit(0.0)).alias("bound"))


def objective(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The summed cost of edges between clusters."""
    at = lambda end, name: labels.select(F.col("node").alias(end), F.col("cluster").alias(name))
    both = edges.join(at("i", "ci"), "i").join(at("j", "cj"), "j")
    return both.agg(F.coalesce(F.sum(F.when(F.col("ci") != F.col("cj"), F.col("cost"))), F.lit(0.0)).alias("objective"))


def matching_threshold(edges: DataFrame, multiplier: float) -> DataFrame:
    """One row `threshold`: multiplier times the mean of costs that are not negative; -1 without such."""
    return edges.agg(F.coalesce(F.avg(F.when(F.col("cost") >= 0, F.col("cost"))) * multiplier, F.lit(-1.0)).alias("threshold"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return edges.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def run_lengths(values: DataFrame, column: str = "v") -> DataFrame:
    """Distinct values with their counts."""
    return values.groupBy(column).agg(F.count("*").alias("n"))


def expand_runs(runs: DataFrame, column: str = "v") -> DataFrame:
    """Each value as often as its count says, with its place in the run."""
    return runs.where("n > 0").select(column, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("k"))


def row_offsets(values: DataFrame, column: str = "v") -> DataFrame:
    """(v, start) for v from 0 to the greatest value plus 1: how many values are less. As many rows as the greatest value says: meant for dense ids."""
    most = values.agg(F.max(column)).first()[0]
    spine = values.sparkSession.range(0, 0 if most is None else most + 2).withColumnRenamed("id", column)
    counted = spine.join(run_lengths(values, column), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return exclusive_sum(counted, column, "n", "start").select(column, "start")


def degrees_to_offsets(degree: DataFrame) -> DataFrame:
    """(node, start): the sum of degrees of smaller nodes."""
    return exclusive_sum(degree, "node", "degree", "start").select("node", "start")


def sort_ranks(edges: DataFrame) -> DataFrame:
    """Edges with their place in the order by (i, j)."""
    return ranked(edges, "place", "i", "j", "cost").select("i", "j", "cost", "place")


def both_present(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints are both among `nodes`."""
    return edges.join(nodes.select(F.col("node").alias("i")), "i", "left_semi").join(nodes.select(F.col("node").alias("j")), "j", "left_semi").select("i", "j", "cost")


def between_components(edges: DataFrame, components: DataFrame, same: bool = True) -> DataFrame:
    """Edges within one component (or, with same False, between two)."""
    at = lambda end, name: components.select(F.col("node").alias(end), F.col("component").alias(name))
    condition: Column = F.col("__ci") == F.col("__cj") if same else F.col("__ci") != F.col("__cj")
    return edges.join(at("i", "__ci"), "i").join(at("j", "__cj"), "j").where(condition).select(*edges.columns)
