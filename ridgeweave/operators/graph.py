"""Directed edges and start nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.functions.clean import or_default

PROFILES = ("profile_distance", "profile_elevation_raw", "profile_elevation_smooth")
KEPT = ("source_primary", "source_feature_id", "source_row_index", "source_raw_properties_json", "highway", "name", "trail_type", "elevation_fallback_count")


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def directed_edges(edges: DataFrame) -> DataFrame:
    """Both orientations of every edge from one scan.

    The reverse one swaps ends, ascent and descent come from its own columns,
    and its geometry and profile are its own. Where edges have the places of
    their ends (ux, uy, vx, vy), both have those of theirs: src_x, src_y, x, y.
    """
    have = set(edges.columns)
    c = lambda name, default: or_default(F.col(name).cast("double"), default) if name in have else F.lit(default)

    def side(forward: bool) -> Column:
        tag = "fwd" if forward else "rev"
        fields = [
            F.concat("edge_id", F.lit(f":{tag}")).alias("directed_edge_id"),
            F.col("u" if forward else "v").alias("src"),
            F.col("v" if forward else "u").alias("dst"),
            c(f"ascent_{tag}_m", 0.0).alias("ascent_m"),
            c(f"descent_{tag}_m", 0.0).alias("descent_m"),
        ]
        if "ux" in have:
            fields += [F.col(k + c).alias(p + c) for p, k in zip(("src_", ""), "uv" if forward else "vu", strict=True) for c in "xy"]
        if "coords" in have:
            fields.append((F.col("coords") if forward else F.reverse("coords")).alias("coords"))
        if f"{PROFILES[0]}_m" in have:
            fields += [F.col(f"{p}_m" if forward else f"{p}_rev_m").alias(f"{p}_m") for p in PROFILES]
        return F.struct(*fields)

    shared = [F.col("edge_id").alias("undirected_edge_id"), c("length_m", 0.0).alias("length_m"), c("source_confidence", 0.5).alias("source_confidence"), *[F.col(k) for k in KEPT if k in have]]
    return edges.select(*shared, F.explode(F.array(side(True), side(False))).alias("d")).select("d.*", *[x for x in ("undirected_edge_id", "length_m", "source_confidence", *[k for k in KEPT if k in have])])


def landmark_flags(edges: DataFrame, patterns: list[str]) -> DataFrame:
    """``edges`` with the numbers of the patterns that its name matches, and of those on steps."""
    have = set(edges.columns)
    name = F.coalesce(F.col("name"), F.lit("")) if "name" in have else F.lit("")
    steps = F.coalesce(F.col("highway") == "steps", F.lit(False)) if "highway" in have else F.lit(False)
    hits = F.array(*[F.when(name.rlike("(?i)" + p), F.lit(k)) for k, p in enumerate(patterns)]) if patterns else F.array()
    hits = F.filter(hits.cast("array<int>"), lambda x: x.isNotNull())
    return edges.withColumn("landmarks", hits).withColumn("step_landmarks", F.when(steps, hits).otherwise(F.array().cast("array<int>")))


def start_scores(directed: DataFrame) -> DataFrame:
    """Nodes with a way out: best and total ascent, and degree."""
    return directed.groupBy(F.col("src").alias("node_id")).agg(F.max("ascent_m").alias("best_ascent"), F.sum("ascent_m").alias("total_ascent"), F.count("*").alias("degree"))


def start_nodes(directed: DataFrame, nodes: DataFrame, grid_m: float | None, per_grid: int | None, most: int | None) -> DataFrame:
    """Ranked start nodes, at most ``per_grid`` in a cell and ``most`` in all; landmark ends always follow."""
    order = [F.desc("best_ascent"), F.desc("total_ascent"), F.desc("degree"), F.asc("node_id")]
    ranked = start_scores(directed)
    if grid_m and per_grid:
        ranked = ranked.join(nodes.select("node_id", "x", "y"), "node_id")
        place = W.partitionBy(cell(F.col("x"), grid_m), cell(F.col("y"), grid_m)).orderBy(*order)
        ranked = ranked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= per_grid)
    if most is not None and most > 0:
        ranked = ranked.orderBy(*order).limit(most)
    found = ranked.select("node_id")
    if "landmarks" in directed.columns:
        marked = directed.filter(F.size("landmarks") > 0).select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        found = found.union(marked.join(found, "node_id", "left_anti"))
    return found


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """All rows of all layers; columns that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
