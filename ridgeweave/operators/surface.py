"""Elevations at points, by joins with the triangles and samples of a surface.

Triangles are laid on grid cells, and points look in their own cell. What lies
in no triangle takes the elevation of the nearest sample, found by a descent
through cells of cells: at each level a point keeps the cells that can still
hold its nearest sample, judged by the least and the greatest distance to the
box of what a cell holds. Both sides may be of any size; nothing is collected
but bounds and counts, and Spark chooses how to join from the sizes of written
tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeweave.scratch import Scratch

#: Children of a cell on either axis, samples that a last cell should not exceed, and levels at most.
FAN, LEAF, LEVELS = 4, 64, 12
#: How far outside a triangle a point may lie, as a share of its heights.
EDGE = 1e-9


def bounds(df: DataFrame, *axes: str) -> tuple[float, float, float, int] | None:
    """(least x, least y, span, rows), or None for an empty table."""
    xs, ys = axes[: len(axes) // 2], axes[len(axes) // 2 :]
    low = lambda cs: F.min(F.least(*cs) if len(cs) > 1 else F.col(cs[0]))
    high = lambda cs: F.max(F.greatest(*cs) if len(cs) > 1 else F.col(cs[0]))
    x0, y0, x1, y1, n = df.agg(low(xs), low(ys), high(xs), high(ys), F.count("*")).first()
    return (x0, y0, max(x1 - x0, y1 - y0, 1e-9), n) if n else None


def in_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(x, y, z) of the ``points`` (x, y, each once) that lie in a triangle; of several the first decides.

    ``triangles`` has triangle and the corners ax, ay, az to cx, cy, cz.
    """
    found = bounds(triangles, "ax", "bx", "cx", "ay", "by", "cy")
    if found is None:
        return points.select("x", "y", F.lit(None).cast("double").alias("z")).limit(0)
    x0, y0, span, n = found
    size = span / max(1.0, math.sqrt(n))
    cell = lambda v, low: F.floor((v - low) / size)
    side = lambda k, low, f: cell(f(*[F.col(c + k) for c in "abc"]), low)
    laid = triangles.withColumn("gx", F.explode(F.sequence(side("x", x0, F.least), side("x", x0, F.greatest)))).withColumn("gy", F.explode(F.sequence(side("y", y0, F.least), side("y", y0, F.greatest))))
    met = points.withColumns({"gx": cell(F.col("x"), x0), "gy": cell(F.col("y"), y0)}).join(laid.hint("merge"), ["gx", "gy"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    det = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy"))
    met = met.withColumn("det", det).filter("det <> 0")
    met = met.withColumns({"u": ((F.col("by") - F.col("cy")) * dx + (F.col("cx") - F.col("bx")) * dy) / F.col("det"), "v": ((F.col("cy") - F.col("ay")) * dx + (F.col("ax") - F.col("cx")) * dy) / F.col("det")})
    hit = met.filter((F.col("u") >= -EDGE) & (F.col("v") >= -EDGE) & (F.col("u") + F.col("v") <= 1 + EDGE))
    z = F.col("u") * F.col("az") + F.col("v") * F.col("bz") + (1 - F.col("u") - F.col("v")) * F.col("cz")
    return hit.groupBy("x", "y").agg(F.min_by(z, "triangle").alias("z"))


def box_gap(far: bool) -> Column:
    """Square of a point's least or greatest distance to the box of a cell."""
    if far:
        one = lambda k: F.greatest(F.abs(F.col(k) - F.col(f"low_{k}")), F.abs(F.col(k) - F.col(f"high_{k}")))
    else:
        one = lambda k: F.greatest(F.lit(0.0), F.col(f"low_{k}") - F.col(k), F.col(k) - F.col(f"high_{k}"))
    return one("x") * one("x") + one("y") * one("y")


def nearest(points: DataFrame, samples: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y, sample, z, gap): the nearest of ``samples`` (sample, x, y, z) for each of ``points`` (x, y, each once).

    ``gap`` is the square of the distance; of samples at one distance the
    smallest counts. Without samples there are no rows.
    """
    spots = scratch.keep(samples.groupBy("x", "y").agg(F.min(F.struct("sample", "z")).alias("s")), "samples")
    found = bounds(spots, "x", "y")
    if found is None:
        return points.select("x", "y", F.lit(None).cast("long").alias("sample"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("gap")).limit(0)
    x0, y0, span, n = found

    def at(level: int) -> dict[str, Column]:
        size = span / FAN**level
        one = lambda k, low: F.least(F.floor((F.col(k) - low) / size), F.lit(FAN**level - 1).cast("long"))
        return {"gx": one("x", x0), "gy": one("y", y0)}

    depth = max(1, math.ceil(math.log(max(1.0, n / LEAF), FAN * FAN)))
    while depth < LEVELS and spots.withColumns(at(depth)).groupBy("gx", "gy").count().agg(F.max("count")).first()[0] > LEAF:
        depth += 1
    box = [f(c).alias(f"{side}_{c}") for c in "xy" for side, f in (("low", F.min), ("high", F.max))]
    left = scratch.keep(points.select("x", "y").withColumns({"gx": F.lit(0).cast("long"), "gy": F.lit(0).cast("long")}), "points")
    for level in range(1, depth + 1):
        cells = spots.withColumns(at(level)).groupBy("gx", "gy").agg(*box)
        cells = cells.withColumns({"hx": F.col("gx"), "hy": F.col("gy"), "gx": F.floor(F.col("gx") / FAN), "gy": F.floor(F.col("gy") / FAN)})
        seen = left.join(scratch.keep(cells, "cells").hint("merge"), ["gx", "gy"]).withColumns({"near": box_gap(False), "far": box_gap(True)})
        kept = seen.groupBy("x", "y").agg(F.min("far").alias("most"), F.collect_list(F.struct("near", "hx", "hy")).alias("c"))
        kept = kept.select("x", "y", F.explode(F.filter("c", lambda c: c["near"] <= F.col("most"))).alias("c"))
        left = scratch.keep(kept.select("x", "y", F.col("c.hx").alias("gx"), F.col("c.hy").alias("gy")), "left")
    last = spots.withColumns(at(depth)).select("gx", "gy", F.col("x").alias("sx"), F.col("y").alias("sy"), "s")
    gap = (F.col("sx") - F.col("x")) * (F.col("sx") - F.col("x")) + (F.col("sy") - F.col("y")) * (F.col("sy") - F.col("y"))
    best = left.join(last.hint("merge"), ["gx", "gy"]).groupBy("x", "y").agg(F.min(F.struct(gap.alias("gap"), "s.sample", "s.z")).alias("b"))
    return best.select("x", "y", "b.sample", "b.z", "b.gap")


def elevations(points: DataFrame, triangles: DataFrame, samples: DataFrame) -> DataFrame:
    """``points`` with ``z``, and ``stood_in`` where the nearest sample stood in. Points at one place are looked up once."""
    scratch = Scratch(points.sparkSession, "surface")
    places = scratch.keep(points.select("x", "y").distinct(), "places")
    inside = scratch.keep(in_triangles(places, triangles), "inside")
    outside = scratch.keep(places.join(inside, ["x", "y"], "left_anti"), "outside")
    both = inside.withColumn("stood_in", F.lit(False)).unionByName(nearest(outside, samples, scratch).select("x", "y", "z", F.lit(True).alias("stood_in")))
    return points.join(scratch.keep(both, "found").hint("merge"), ["x", "y"])
