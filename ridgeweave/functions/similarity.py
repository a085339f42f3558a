"""Similarity of routes as sets of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain_density(ascent: Column, distance: Column) -> Column:
    """Metres of ascent for a kilometre; 0 without distance."""
    return F.when(distance > 0, ascent / (distance / 1000)).otherwise(F.lit(0.0))


def edge_jaccard(a: Column, b: Column) -> Column:
    """Share of common edges; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def count_jaccard(common: Column, na: Column, nb: Column) -> Column:
    """The same from the numbers of the common edges and of either side."""
    union = na + nb - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def weighted_jaccard(common: Column, a: Column, b: Column) -> Column:
    """From the lengths of the common edges and of either side."""
    union = a + b - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def weighted_containment(common: Column, a: Column, b: Column) -> Column:
    shorter = F.least(a, b)
    return F.when(shorter > 0, common / shorter).otherwise(F.lit(1.0))


def near_duplicate(common: Column, na: Column, nb: Column, shared: Column, ta: Column, tb: Column, jaccard: float, length_jaccard: float, containment: float) -> Column:
    """Whether any of the three similarities reaches its limit, from counts and lengths of the common edges and of either side."""
    return (count_jaccard(common, na, nb) >= jaccard) | (weighted_jaccard(shared, ta, tb) >= length_jaccard) | (weighted_containment(shared, ta, tb) >= containment)
