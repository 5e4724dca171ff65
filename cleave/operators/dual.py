"""Dual message passing between edges and triangles, and the lower bound that it proves.

Edge state: (i, j, cost, n_tri). Triangle state: (a, b, c, c12, c13, c23).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.functions.expressions import SCHEDULE, edge_bound, min_marginal, triangle_bound
from cleave.operators.edges import trivial_bound
from cleave.operators.triangles import conflicted, sides
from cleave.session import cut

LEAST_GAIN = 1e-3


def triangle_counts(triangles: DataFrame) -> DataFrame:
    """(i, j, n_tri) of the edges that some triangle has as a side."""
    return sides(triangles).groupBy("i", "j").agg(F.count("*").alias("n_tri"))


def side_costs(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """(i, j, cost) of triangles' sides: the edge's cost, 0 for chords."""
    return triangle_counts(triangles).select("i", "j").join(edges.select("i", "j", "cost"), ["i", "j"], "left").select("i", "j", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def with_chords(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """Edge state: all edges, and triangles' sides that were none at cost 0."""
    counts = triangle_counts(triangles)
    both = edges.select("i", "j", "cost").join(counts, ["i", "j"], "full_outer")
    return both.select("i", "j", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("n_tri", F.lit(0)).cast("bigint").alias("n_tri"))


def start(edges: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge and triangle state before the first message."""
    zero = F.lit(0.0)
    return with_chords(edges, triangles), triangles.select("a", "b", "c", zero.alias("c12"), zero.alias("c13"), zero.alias("c23"))


def send_to_triangles(edges: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each edge gives its cost to its triangles in equal parts."""
    share = edges.where("n_tri > 0").select("i", "j", (F.col("cost") / F.col("n_tri")).alias("m"))
    come = sides(triangles, "a", "b", "c", "c12", "c13", "c23").join(share, ["i", "j"])
    here = lambda name: (F.max(name) + F.sum(F.when(F.col("side") == name, F.col("m")))).alias(name)
    got = come.groupBy("a", "b", "c").agg(here("c12"), here("c13"), here("c23"))
    return edges.withColumn("cost", F.when(F.col("n_tri") > 0, F.lit(0.0)).otherwise(F.col("cost"))), got


def send_to_edges(edges: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each triangle gives shares of its min-marginals back, side after side by the schedule."""
    names = ("c12", "c13", "c23")
    state = triangles.select("a", "b", "c", *names, *[F.lit(0.0).alias(f"d{n[1:]}") for n in names])
    for name, share in SCHEDULE:
        y, z = (F.col(n) for n in names if n != name)
        state = state.withColumn("__m", min_marginal(F.col(name), y, z) * share)
        state = state.withColumn(name, F.col(name) - F.col("__m")).withColumn(f"d{name[1:]}", F.col(f"d{name[1:]}") + F.col("__m"))
    state = state.drop("__m")
    given = sides(state, "d12", "d13", "d23")
    delta = F.when(F.col("side") == "c12", F.col("d12")).when(F.col("side") == "c13", F.col("d13")).otherwise(F.col("d23"))
    sums = given.groupBy("i", "j").agg(F.sum(delta).alias("d"))
    back = edges.join(sums, ["i", "j"], "left").select("i", "j", (F.col("cost") + F.coalesce("d", F.lit(0.0))).alias("cost"), "n_tri")
    return back, state.select("a", "b", "c", *names)


def iterate(edges: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    return send_to_edges(*send_to_triangles(edges, triangles))


def lower_bound(edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row `bound`: of edges and of triangles together."""
    of_edges = edges.select(edge_bound(F.col("cost")).alias("b"))
    of_triangles = triangles.select(triangle_bound(F.col("c12"), F.col("c13"), F.col("c23")).alias("b"))
    return of_edges.unionAll(of_triangles).agg(F.coalesce(F.sum("b"), F.lit(0.0)).alias("bound"))


def reparametrized(edges: DataFrame) -> DataFrame:
    """The edge table after messages; what is left in triangles is dropped, which keeps the bound valid."""
    return edges.select("i", "j", "cost")


def update(edges: DataFrame, longest: int, steps: int, ratio: float = 1e-4, budget: float | None = None) -> tuple[DataFrame, float, int]:
    """Messages over triangles of cycles up to `longest` edges: new edges, bound, count of triangles.

    Up to `steps` iterations; stops once one gains less than 1e-3. budget: at most this many triangles a repulsive edge, the
    strongest ones; None keeps all.
    """
    most = None if budget is None else int(budget * edges.where("cost < 0").count())
    triangles = cut(conflicted(edges, longest, ratio, most))
    n = triangles.count()
    if not n:
        return edges, trivial_bound(edges).first()["bound"], 0
    edge_state, tri_state = start(edges, triangles)
    before = 0.0
    for k in range(steps):
        bound = lower_bound(edge_state, tri_state).first()["bound"]
        if k > 0 and bound - before < LEAST_GAIN:
            break
        new_edges, new_triangles = iterate(edge_state, tri_state)
        edge_state, tri_state, before = cut(new_edges), cut(new_triangles), bound
    return reparametrized(edge_state), lower_bound(edge_state, tri_state).first()["bound"], n


def solve(edges: DataFrame, longest: int, steps: int, outer: int, ratio: float = 1e-4, budget: float | None = None) -> tuple[DataFrame, float]:
    """Reparametrised edges and their lower bound: `outer` passes over cycle lengths 3 to `longest`."""
    if longest < 3 or not steps or not outer:
        return edges, trivial_bound(edges).first()["bound"]
    bound = before = 0.0
    for k in range(outer):
        n = 0
        for length in range(3, longest + 1):
            edges, bound, n = update(edges, length, steps, ratio, budget)
        if not n or k > 0 and bound - before < LEAST_GAIN:
            break
        before = bound
    return edges, bound
