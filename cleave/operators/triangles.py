"""Triangles (a < b < c) of conflicted cycles: one repulsive edge closed by attractive paths of two to four edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.functions.expressions import sorted_corners
from cleave.operators.edges import split_with_tolerance
from cleave.operators.prefix import ranked
from cleave.session import cut


def normalize(triples: DataFrame) -> DataFrame:
    """Distinct triangles with corners in rising order; triples that repeat a corner go."""
    low, mid, high = sorted_corners(F.col("a"), F.col("b"), F.col("c"))
    return triples.where("a <> b AND a <> c AND b <> c").select(low.alias("a"), mid.alias("b"), high.alias("c")).distinct()


def _near(sym: DataFrame, at: str, to: str) -> DataFrame:
    return sym.select(F.col("src").alias(at), F.col("dst").alias(to))


def _triples(paths: DataFrame, *corners: tuple[str, str, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c")) for a, b, c in corners])
    return paths.select(F.explode(rows).alias("t")).select("t.a", "t.b", "t.c")


def three_cycles(sym: DataFrame, rep: DataFrame) -> DataFrame:
    """For each repulsive (i, j), each common attractive neighbour m: the triangle of the three."""
    paths = rep.join(_near(sym, "i", "m"), "i").join(_near(sym, "j", "m"), ["j", "m"])
    return normalize(_triples(paths, ("i", "j", "m")))


def _starts(sym: DataFrame, rep: DataFrame) -> DataFrame:
    """(i, j, n): the first step n of an attractive path from i, for each repulsive (i, j)."""
    return rep.join(_near(sym, "i", "n"), "i").select("i", "j", "n")


def four_cycles(sym: DataFrame, rep: DataFrame) -> DataFrame:
    """For each attractive path i, n, m, j: triangles (i, j, n) and (j, n, m).

    What closes a path from n to j doesn't depend on i: pairs (j, n) are made distinct before the next step, and no pair of neighbours of i and of j is made.
    """
    starts = _starts(sym, rep)
    onward = starts.select("j", "n").distinct().join(_near(sym, "n", "m"), "n")
    closed = onward.join(_near(sym, "j", "m"), ["j", "m"]).select("j", "n", "m")
    first = starts.join(closed.select("j", "n").distinct(), ["j", "n"], "left_semi")
    return normalize(_triples(first, ("i", "j", "n")).unionByName(_triples(closed, ("j", "n", "m"))))


def five_cycles(sym: DataFrame, rep: DataFrame) -> DataFrame:
    """For each attractive path i, n, m, q, j with n <> q: triangles (i, j, n), (j, n, m) and (j, m, q).

    Steps n from the one end and q from the other meet at (j, m): there is a path over n if (j, m) has a q that isn't n, and over q likewise.
    """
    starts = _starts(sym, rep)
    one = starts.select("j", "n").distinct().join(_near(sym, "n", "m"), "n").select("j", "m", "n")
    two = one.select("j", "m").distinct().join(_near(sym, "j", "q"), "j").join(_near(sym, "m", "q"), ["m", "q"]).select("j", "m", "q")
    one, two = _with_other(one, two, "n", "q"), _with_other(two, one, "q", "n")
    first = starts.join(one.select("j", "n").distinct(), ["j", "n"], "left_semi")
    return normalize(_triples(first, ("i", "j", "n")).unionByName(_triples(one, ("j", "n", "m"))).unionByName(_triples(two, ("j", "m", "q"))))


def _with_other(mine: DataFrame, theirs: DataFrame, own: str, other: str) -> DataFrame:
    """Rows (j, m, own) for which `theirs` has a row (j, m, other) with another node."""
    range_ = theirs.groupBy("j", "m").agg(F.min(other).alias("low"), F.max(other).alias("high"))
    return mine.join(range_, ["j", "m"]).where((F.col("low") != F.col(own)) | (F.col("high") != F.col(own))).select("j", "m", own)


def conflicted(edges: DataFrame, longest: int, ratio: float = 1e-4, budget: int | None = None) -> DataFrame:
    """Triangles of conflicted cycles of 3 to `longest` (at most 5) edges. Costs within ratio of the least one count as neither sign.

    With a budget, longer cycles are searched only while the shorter ones leave some of it, and the strongest triangles fill it.
    """
    if longest > 5:
        raise ValueError("cycles of more than 5 edges are not searched")
    none = edges.sparkSession.createDataFrame([], "a bigint, b bigint, c bigint")
    if longest < 3:
        return none
    sym, rep = split_with_tolerance(edges.select("i", "j", "cost"), ratio)
    sym = sym.select("src", "dst")
    found = three_cycles(sym, rep)
    for length, more in ((4, four_cycles), (5, five_cycles)):
        if longest < length:
            break
        if budget is not None:
            found = cut(found)
            if found.count() >= budget:
                break
        found = found.unionByName(more(sym, rep)).distinct()
    if budget is None:
        return found
    found = cut(found)
    return found if found.count() <= budget else strongest(found, edges, budget).select("a", "b", "c")


def sides(triangles: DataFrame, *keep: str) -> DataFrame:
    """Three rows a triangle: its side as (i, j) and the side's name."""
    side = lambda a, b, name: F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.lit(name).alias("side"))
    return triangles.select(F.explode(F.array(side("a", "b", "c12"), side("a", "c", "c13"), side("b", "c", "c23"))).alias("s"), *keep).select("s.i", "s.j", "s.side", *keep)


def strongest(triangles: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The `most` triangles whose weakest side is strongest (a missing side counts 0), ties by corners; with their place, found by ranges in many tasks."""
    cost = edges.select("i", "j", F.abs("cost").alias("size"))
    weak = sides(triangles, "a", "b", "c").join(cost, ["i", "j"], "left").groupBy("a", "b", "c").agg(F.min(F.coalesce("size", F.lit(0.0))).alias("strength"))
    return ranked(weak, "place", F.desc("strength"), "a", "b", "c").where(F.col("place") <= most).select("a", "b", "c", "strength", "place")
