"""Samples along routes, and the geometry of whole routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ridgeweave.functions import geometry as G
from ridgeweave.functions.crs import to_degrees
from ridgeweave.operators import series

CARRIED = ("source_primary", "source_confidence", "source_feature_id", "source_row_index", "source_raw_properties_json", "highway", "name", "trail_type")


def ordered_edges(routes: DataFrame, directed: DataFrame) -> DataFrame:
    """The edges of each route in order; an unknown identifier is an error."""
    steps = routes.select("route_id", F.posexplode("directed_edge_ids").alias("edge_number", "directed_edge_id"))
    out = steps.join(directed, "directed_edge_id", "left")
    known = F.assert_true(F.col("src").isNotNull(), F.concat(F.lit("unknown edge "), F.col("directed_edge_id")))
    return out.withColumn("_known", known).filter(F.col("_known").isNull()).drop("_known")


def route_lines(routes: DataFrame, directed: DataFrame) -> DataFrame:
    """(route_id, coords, gaps): whole geometries, and warnings about gaps between edges."""
    edges = ordered_edges(routes, directed).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("edge_number", "coords"))).alias("e"))
    line = G.concatenated(F.transform("e", lambda x: x["coords"]))
    return edges.select("route_id", line.alias("l")).select("route_id", F.col("l.coords").alias("coords"), F.col("l.warnings").alias("gaps"))


def with_gap_warnings(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """``routes`` whose warnings also name the gaps of their geometry."""
    return routes.join(lines.select("route_id", "gaps"), "route_id", "left").withColumn("warnings", F.array_union("warnings", F.coalesce("gaps", F.array().cast("array<string>")))).drop("gaps")


def in_degrees(line: Column) -> Column:
    def one(p: Column) -> Column:
        lon, lat = to_degrees(p["x"], p["y"])
        return F.array(lon, lat)

    return F.transform(line, one)


@F.pandas_udf(ArrayType(DoubleType()))
def profile_at(where: pd.Series, distance: pd.Series, value: pd.Series) -> pd.Series:
    """Values of a profile at places along it, clamped at both ends."""
    return pd.Series([None if d is None or len(d) == 0 else np.interp(np.asarray(w, float), np.asarray(d, float), np.asarray(v, float)) for w, d, v in zip(where, distance, value, strict=True)])


def route_samples(routes: DataFrame, directed: DataFrame, spacing_m: float = 10) -> DataFrame:
    """One row for each station along each route.

    The first station of every edge but the first is its neighbour's last and
    goes. Elevations come from the edge's profile; edges without one rise
    evenly by their net gain from where the edge before ended.
    """
    e = ordered_edges(routes, directed)
    have = set(e.columns)
    w = W.partitionBy("route_id").orderBy("edge_number")
    keep = lambda d: F.when(F.col("edge_number") > 0, F.filter(d, lambda x: x > 1e-8)).otherwise(d)
    e = e.withColumns({"before": series.cumulative(["route_id"], "edge_number", "length_m"), "where": keep(G.stations(F.col("length_m"), spacing_m))})
    gain = F.col("ascent_m") - F.col("descent_m")
    share = lambda d: F.when(F.col("length_m") > 0, d / F.col("length_m")).otherwise(F.lit(0.0))
    if "profile_distance_m" in have:
        raw = F.when(F.col("profile_distance_m").isNotNull(), profile_at("where", "profile_distance_m", "profile_elevation_raw_m"))
        smooth = F.when(F.col("profile_distance_m").isNotNull(), profile_at("where", "profile_distance_m", "profile_elevation_smooth_m"))
    else:
        raw = smooth = F.lit(None).cast("array<double>")
    e = e.withColumns({"raw": raw, "smooth": smooth})
    # Where profiles and plain edges meet, a plain edge starts at the last profile's end plus the gains since.
    last = F.when(F.col("smooth").isNotNull() & (F.size("where") > 0), F.element_at("smooth", -1))
    plain = F.when(F.col("smooth").isNull() & (F.size("where") > 0), gain).otherwise(F.lit(0.0))
    e = e.withColumns({"_last": last, "_sum": F.sum(plain).over(w.rowsBetween(W.unboundedPreceding, -1))})
    back = w.rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("_last").isNotNull(), F.struct("_last", (F.coalesce("_sum", F.lit(0.0))).alias("s")))
    e = e.withColumn("_from", F.last(mark, True).over(back))
    start = F.coalesce(F.col("_from._last"), F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0)) - F.coalesce(F.col("_from.s"), F.lit(0.0))
    e = e.withColumn("_start", start)
    even = F.transform("where", lambda d: F.col("_start") + gain * share(d))
    e = e.withColumns({"raw": F.coalesce("raw", even), "smooth": F.coalesce("smooth", even)})
    rows = e.select("*", F.posexplode(F.arrays_zip("where", "raw", "smooth")).alias("k", "s"))
    rows = rows.withColumn("p", G.at(F.col("coords"), F.col("s.where")))
    lon, lat = to_degrees(F.col("p.x"), F.col("p.y"))
    order = W.partitionBy("route_id").orderBy("edge_number", "k")
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = rows.select(
        "route_id",
        (F.row_number().over(order) - 1).alias("sample_index"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.col("p.x").alias("x_svy21"),
        F.col("p.y").alias("y_svy21"),
        (F.col("before") + F.col("s.where")).alias("cum_distance_m"),
        ((F.col("before") + F.col("s.where")) / 1000).alias("cum_distance_km"),
        F.col("s.raw").alias("elevation_raw_m"),
        F.col("s.smooth").alias("elevation_smooth_m"),
        F.col("undirected_edge_id").alias("edge_id"),
        "directed_edge_id",
        "undirected_edge_id",
        *[col(c).alias("path_name" if c == "name" else c) for c in CARRIED],
    )
    keys = ["route_id"]
    return out.withColumns(
        {
            "grade_pct": series.grade(keys, "sample_index", "cum_distance_m", "elevation_raw_m"),
            "grade_smooth_pct": series.grade(keys, "sample_index", "cum_distance_m", "elevation_smooth_m"),
        }
    )


def steep(samples: DataFrame, threshold_pct: float = 12) -> DataFrame:
    return series.steep_sections(samples, ["route_id"], "sample_index", "cum_distance_m", "grade_smooth_pct", threshold_pct)


def markers(samples: DataFrame, threshold_pct: float = 12) -> DataFrame:
    """Samples to mark on a map: kilometres, half kilometres for direction, steps, and steep points."""
    d = F.col("cum_distance_m")
    kinds = F.array_compact(
        F.array(
            F.when((d > 0) & (d % 1000 < 10), F.lit("km")),
            F.when((d > 0) & (d % 500 < 10), F.lit("direction")),
            F.when(F.col("highway") == "steps", F.lit("steps")),
            F.when(~F.isnan("grade_smooth_pct") & (F.abs("grade_smooth_pct") >= threshold_pct), F.lit("steep")),
        )
    )
    named = F.concat(F.lit("Steps"), F.coalesce(F.concat(F.lit(": "), "path_name"), F.lit("")))
    note = F.when(F.col("kind") == "km", F.format_string("%.1f km", d / 1000)).when(F.col("kind") == "steps", named).when(F.col("kind") == "steep", F.format_string("%.1f %%", "grade_smooth_pct")).otherwise(F.lit("Direction"))
    return samples.withColumn("kind", F.explode(kinds)).select("route_id", "sample_index", "lon", "lat", "kind", note.alias("note"))


def features(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """(route_id, feature): each route as a GeoJSON feature in degrees, without its identifier lists."""
    joined = routes.join(lines, "route_id").drop("gaps")
    properties = F.struct(*[c for c in routes.columns if c not in ("directed_edge_ids", "undirected_edge_ids", "node_ids")])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), in_degrees(F.col("coords")).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return joined.select("route_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def simplified(line: Column, tolerance: float) -> Column:
    """Points of a line that are at least ``tolerance`` from the last one kept, and its end."""

    def step(kept: Column, p: Column) -> Column:
        return F.when((F.size(kept) == 0) | (G.distance(F.element_at(kept, -1), p) >= tolerance), F.array_append(kept, p)).otherwise(kept)

    body = F.aggregate(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.array().cast(G.LINE), step)
    return F.when(F.size(line) > 0, F.array_append(body, F.element_at(line, -1))).otherwise(body)
