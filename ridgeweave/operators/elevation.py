"""Contours, the elevation surface, and profiles of edges."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeweave.functions import clean as C
from ridgeweave.functions import geometry as G
from ridgeweave.operators import series, surface
from ridgeweave.operators.paths import field, with_ordinals


def folder_paths(layer: DataFrame) -> DataFrame:
    """Sorted distinct FOLDERPATH values."""
    return layer.select(field("properties", "FOLDERPATH").alias("folderpath")).filter("folderpath is not null").distinct().orderBy("folderpath")


def contour_lines(layer: DataFrame, patterns: list[str]) -> DataFrame:
    """Lines with ``elevation_m``; layers without FOLDERPATH pass unfiltered."""
    if patterns and layer.filter(F.map_contains_key("properties", "FOLDERPATH")).limit(1).count():
        layer = layer.filter(C.matches_any(field("properties", "FOLDERPATH"), patterns))

    def named(key: str) -> Column:
        """The property of that name, or else the first that differs from it in case only."""
        like = F.map_values(F.map_filter("properties", lambda k, v: F.upper(k) == key))
        return F.coalesce(field("properties", key), F.get(like, F.lit(0)))

    fields = [named(k) for k in C.ELEVATION_KEYS]
    heights = F.col("heights") if "heights" in layer.columns else None
    out = layer.withColumn("elevation_m", C.contour_elevation(fields, heights)).filter("elevation_m is not null")
    return out.select("feature_idx", "properties", "elevation_m", F.posexplode("lines").alias("part", "coords")).filter((F.size("coords") > 1) & (G.length(F.col("coords")) > 0))


def contour_points(contours: DataFrame, spacing_m: float = 100, most: int | None = None) -> DataFrame:
    """(elevation_m, x, y) at stations of every contour, thinned by a global stride if there would be more than ``most``."""
    lines = contours.withColumn("_pts", G.densify(F.col("coords"), spacing_m))
    points = lines.select("feature_idx", "part", "elevation_m", F.posexplode("_pts").alias("k", "p")).select("feature_idx", "part", "k", "elevation_m", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    if most:
        total, n = contours.agg(F.sum(G.length(F.col("coords")) / max(spacing_m, 1e-9)), F.count("*")).first()
        estimate = int(total or 0) + n
        if estimate > most:
            stride = math.ceil(estimate / most)
            points = with_ordinals(points, ["feature_idx", "part", "k"]).filter((F.col("path_ordinal") + 1) % stride == 1)
    return points.select("elevation_m", "x", "y")


# -- the surface ------------------------------------------------------------------


class Triangulation:
    """Delaunay triangles of points in the plane by insertion with edge flips.

    Points are inserted along a snake of strips, so the walk to each starts
    next door; flips then restore the empty-circle rule.
    """

    def __init__(self, xy: np.ndarray):
        self.p = [tuple(map(float, v)) for v in xy]
        n = len(self.p)
        low, high = xy.min(axis=0), xy.max(axis=0)
        span = float(max(high - low)) or 1.0
        cx, cy = map(float, (low + high) / 2)
        self.p += [(cx - 3e4 * span, cy - 3e4 * span), (cx + 3e4 * span, cy - 3e4 * span), (cx, cy + 3e4 * span)]
        self.v = [[n, n + 1, n + 2]]
        self.t: list[list[int]] = [[-1, -1, -1]]
        self.n, last = n, 0
        strips = max(1, int(math.sqrt(n / 4)))
        row = np.minimum(((xy[:, 1] - low[1]) / span * strips).astype(int), strips - 1)
        order = np.lexsort((np.where(row % 2, -xy[:, 0], xy[:, 0]), row))
        for k in order:
            last = self.insert(int(k), last)

    def side(self, a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = self.p[a], self.p[b], self.p[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def inside_circle(self, a: int, b: int, c: int, d: int) -> bool:
        dx, dy = self.p[d]
        m = [(x - dx, y - dy) for x, y in (self.p[a], self.p[b], self.p[c])]
        s = [x * x + y * y for x, y in m]
        det = m[0][0] * (m[1][1] * s[2] - s[1] * m[2][1]) - m[0][1] * (m[1][0] * s[2] - s[1] * m[2][0]) + s[0] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        return det > 1e-13 * math.sqrt(s[0]) * math.sqrt(s[1]) * math.sqrt(s[2]) * math.sqrt(max(s))

    def find(self, k: int, t: int) -> int:
        for _ in range(4 * len(self.v) + 8):
            a, b, c = self.v[t]
            for e, (i, j) in enumerate(((b, c), (c, a), (a, b))):
                if self.side(i, j, k) < 0 and self.t[t][e] >= 0:
                    t = self.t[t][e]
                    break
            else:
                return t
        return t

    def link(self, t: int, old: int, new: int) -> None:
        if t >= 0:
            self.t[t][self.t[t].index(old)] = new

    def insert(self, k: int, near: int) -> int:
        t = self.find(k, near)
        a, b, c = self.v[t]
        if self.p[k] in (self.p[a], self.p[b], self.p[c]):
            return t
        na, nb, nc = self.t[t]
        u, w = len(self.v), len(self.v) + 1
        self.v[t], self.t[t] = [k, b, c], [na, u, w]
        self.v.append([k, c, a])
        self.t.append([nb, w, t])
        self.v.append([k, a, b])
        self.t.append([nc, t, u])
        self.link(nb, t, u)
        self.link(nc, t, w)
        stack = [t, u, w]
        while stack:
            s = stack.pop()
            o = self.t[s][0]
            if self.v[s][0] != k or o < 0:
                continue
            e = self.t[o].index(s)
            d = self.v[o][e]
            _, i, j = self.v[s]
            if not self.inside_circle(k, i, j, d) or self.side(k, i, d) <= 0 or self.side(k, d, j) <= 0:
                continue
            after_i, after_j = self.t[o][(e + 1) % 3], self.t[o][(e + 2) % 3]
            if self.v[o][(e + 1) % 3] != j:
                after_i, after_j = after_j, after_i
            # o = (d, j, i): the neighbour across d-i lies opposite j
            ni, nj = self.t[s][1], self.t[s][2]
            self.v[s], self.t[s] = [k, i, d], [after_i, o, nj]
            self.v[o], self.t[o] = [k, d, j], [after_j, ni, s]
            self.link(after_i, o, s)
            self.link(ni, s, o)
            stack += [s, o]
        return t

    def triangles(self) -> np.ndarray:
        """Rows of three points, without what touches the surrounding triangle."""
        found = [v for v in self.v if max(v) < self.n and abs(self.side(*v)) > 1e-12]
        return np.array(found, int).reshape(-1, 3)


@dataclass
class Surface:
    """Triangles with linear elevation, and the points for what lies outside of them."""

    points: np.ndarray
    triangles: np.ndarray

    @classmethod
    def of(cls, points: pd.DataFrame) -> Surface:
        """From (x, y, elevation_m); fewer than three points, or all in one line, give no triangles."""
        xyz = points[["x", "y", "elevation_m"]].to_numpy(float)
        if not len(xyz):
            raise ValueError("no points to build an elevation surface from")
        _, first = np.unique(xyz[:, :2], axis=0, return_index=True)
        xyz = xyz[np.sort(first)]
        none = np.empty((0, 3), int)
        d = xyz[:, :2] - xyz[0, :2]
        scale = np.abs(d).max() or 1.0
        far = d[np.argmax((d * d).sum(axis=1))]
        if len(xyz) < 3 or np.abs(d[:, 0] * far[1] - d[:, 1] * far[0]).max() <= 1e-12 * scale * scale:
            return cls(xyz, none)
        return cls(xyz, Triangulation(xyz[:, :2]).triangles())

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The triangles with their corners, and the samples, for the lookups in ``operators/surface``."""
        samples = pd.DataFrame(self.points, columns=["x", "y", "z"]).rename_axis("sample").reset_index()
        corners = np.hstack([self.points[self.triangles[:, k]] for k in range(3)]) if len(self.triangles) else np.empty((0, 9))
        names = [a + c for a in "abc" for c in "xyz"]
        triangles = pd.DataFrame(corners, columns=names).rename_axis("triangle").reset_index()
        spec = "triangle long, " + ", ".join(f"{n} double" for n in names)
        return spark.createDataFrame(triangles, spec), spark.createDataFrame(samples, "sample long, x double, y double, z double")


PROFILE = ("profile_distance", "profile_elevation_raw", "profile_elevation_smooth")


def enrich_edges(edges: DataFrame, triangles: DataFrame, samples: DataFrame, spacing_m: float = 10, window_m: float = 30) -> DataFrame:
    """``edges`` with profiles of both orientations, their ascents and descents, and how often the nearest sample stood in.

    The reverse profile is sampled anew from its own start. All stations of
    all edges are looked up in one join, then each profile is one row.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(tag).alias("side"), G.densify(line, spacing_m).alias("stations")) for tag, line in (("fwd", F.col("coords")), ("rev", F.reverse("coords")))])).alias("s")
    stations = edges.select("edge_id", sides).select("edge_id", "s.side", F.explode("s.stations").alias("p")).select("edge_id", "side", "p.d", "p.x", "p.y")
    found = surface.elevations(stations, triangles, samples)
    rows = found.groupBy("edge_id", "side").agg(F.array_sort(F.collect_list(F.struct("d", "z"))).alias("p"), F.sum(F.col("stood_in").cast("int")).alias("stood_in"))
    part = lambda c: F.transform("p", lambda v: v[c])
    rows = rows.withColumns({PROFILE[0]: part("d"), PROFILE[1]: part("z")}).withColumn(PROFILE[2], series.smoothed(F.col(PROFILE[0]), F.col(PROFILE[1]), window_m))
    rows = rows.withColumns({"ascent": series.total_of(F.col(PROFILE[2]), 1), "descent": series.total_of(F.col(PROFILE[2]), -1)})
    only = lambda tag, c: F.max(F.when(F.col("side") == tag, F.struct(c))).getItem(c)
    out = [only(tag, c).alias(f"{c}_{tag}_m") for tag in ("fwd", "rev") for c in ("ascent", "descent")]
    out += [only(tag, c).alias(f"{c}{'' if tag == 'fwd' else '_rev'}_m") for tag in ("fwd", "rev") for c in PROFILE]
    profiles = rows.groupBy("edge_id").agg(*out, F.sum("stood_in").cast("int").alias("elevation_fallback_count"))
    return edges.drop(*profiles.columns[1:]).join(profiles, "edge_id")
