"""Checks of routes and of what was written for them; each gives one row (name, ok, message)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of a run's files; so are the names and messages of the checks below.
ROUTE_FILES = (".geojson", "_edges.json", ".gpx", "_profile.png", "_samples.parquet")
GLOBAL_FILES = ("routes/routes.csv", "viz/index.html", "viz/assets/route_summary.json", "viz/assets/routes.geojson")


def counted(df: DataFrame, name: str, bad: Column, unit: str) -> DataFrame:
    n = F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0))
    return df.agg(n.alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(f" {unit}")).alias("message"))


def repeated_edges(routes: DataFrame) -> DataFrame:
    return counted(routes, "no repeated undirected edges", F.size("undirected_edge_ids") != F.size(F.array_distinct("undirected_edge_ids")), "offending routes")


def budget(routes: DataFrame) -> DataFrame:
    return counted(routes, "route distance within budget", F.col("distance_m") > F.col("budget_km") * 1000 + 1e-6, "offending routes")


def gaps(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """Gaps that a route's own warnings name already are no fault."""
    from ridgeweave.functions.geometry import length

    both = routes.select("route_id", "warnings").join(lines, "route_id", "left")
    fresh = F.size(F.array_except("gaps", "warnings")) > 0
    return counted(both, "ordered route geometry has no unexplained gaps", F.col("coords").isNull() | (length(F.col("coords")) <= 0) | fresh, "invalid geometries")


def missing_files(routes: DataFrame, present: DataFrame) -> DataFrame:
    """Expected files of routes that ``present`` (path) lacks."""
    parts = [F.concat(F.lit("routes/"), "route_id", F.lit(s)) for s in ROUTE_FILES]
    parts += [F.concat(F.lit("viz/assets/route_samples/"), "route_id", F.lit(".json")), F.concat(F.lit("viz/routes/"), "route_id", F.lit(".html"))]
    expected = routes.select(F.explode(F.array(*parts)).alias("path")).union(routes.sparkSession.createDataFrame([(p,) for p in GLOBAL_FILES], "path string"))
    return expected.join(present, "path", "left_anti")


def artifacts(routes: DataFrame, folder: Path) -> DataFrame:
    spark = routes.sparkSession
    found = [(str(p.relative_to(folder)),) for p in folder.rglob("*")]
    present = spark.createDataFrame(found, "path string")
    return counted(missing_files(routes, present), "route artifacts complete", F.lit(True), "missing artifacts")


def plausible(samples: DataFrame, low: float = -20, high: float = 200) -> DataFrame:
    """Elevations outside the range, or that aren't numbers, by route."""
    z = F.col("elevation_smooth_m")
    bad = z.isNull() | F.isnan(z) | ~z.between(low, high)
    return counted(samples.groupBy("route_id").agg(F.max(bad).alias("bad")), "sampled elevations plausible", F.col("bad"), "sample files outside range")


def fallbacks(directed: DataFrame) -> DataFrame:
    """The sum over both orientations of every edge, so each edge counts twice."""
    name = F.lit("nearest-neighbour interpolation fallback reported").alias("name")
    if "elevation_fallback_count" not in directed.columns:
        return directed.sparkSession.range(1).select(name, F.lit(False).alias("ok"), F.lit("no elevation fallback metadata on graph edges").alias("message"))
    n = F.coalesce(F.sum("elevation_fallback_count"), F.lit(0)).cast("string")
    return directed.agg(n.alias("n")).select(name, F.lit(True).alias("ok"), F.concat(F.lit("fallback count reported: "), "n").alias("message"))


def html(spark: SparkSession, folder: Path) -> DataFrame:
    pages = len(list((folder / "viz" / "routes").glob("*.html")))
    ok = (folder / "viz" / "index.html").exists() and pages > 0
    return spark.createDataFrame([("index.html and detail pages render", ok, f"{pages} detail pages")], "name string, ok boolean, message string")


def diagnostics(routes: DataFrame, directed: DataFrame, lines: DataFrame, samples: DataFrame, folder: Path, low: float = -20, high: float = 200) -> DataFrame:
    """All seven checks in their fixed order."""
    parts = [repeated_edges(routes), budget(routes), gaps(routes, lines), artifacts(routes, folder), plausible(samples, low, high), fallbacks(directed), html(routes.sparkSession, folder)]
    out = parts[0].withColumn("place", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.union(p.withColumn("place", F.lit(k)))
    return out.orderBy("place").drop("place")
