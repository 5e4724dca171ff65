"""Column expressions of the clustering operators; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_bound(cost: Column) -> Column:
    """What an edge adds to the trivial lower bound: its cost where that is negative."""
    return F.least(cost, F.lit(0.0))


def triangle_bound(c12: Column, c13: Column, c23: Column) -> Column:
    """Least cost of a labelling of a triangle's corners: cut nothing, two sides, or all three."""
    return F.least(F.lit(0.0), c12 + c13, c12 + c23, c13 + c23, c12 + c13 + c23)


def min_marginal(x: Column, y: Column, z: Column) -> Column:
    """Least cost with side x cut less the least cost with it joined."""
    return F.least(x + y + z, x + y, x + z) - F.least(F.lit(0.0), y + z)


def sorted_corners(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Three ids in rising order."""
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    return low, a + b + c - low - high, high


#: Messages from a triangle to its edges, in turn: the side and the share of its min-marginal.
SCHEDULE = [("c12", 1 / 3), ("c13", 1 / 2), ("c23", 1.0), ("c12", 1 / 2), ("c13", 1.0), ("c12", 1.0)]
