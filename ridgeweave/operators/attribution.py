"""Which sources a route's samples come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.config import DEFAULTS
from ridgeweave.functions.clean import present

DATASETS = DEFAULTS["sources"]["data_gov"]
VIEW = "https://data.gov.sg/datasets/{}/view"
PARKS, LAND = "National Parks Board via data.gov.sg", "Singapore Land Authority via data.gov.sg"
# Key, label, publisher, dataset identifier, address and description of each source.
SOURCES = (
    ("nparks_tracks", "NParks Tracks", PARKS, DATASETS["nparks_tracks"], VIEW.format(DATASETS["nparks_tracks"]), "Walking-permitted NParks track segments used for route network geometry."),
    ("central_nature_reserve", "Central Nature Reserve Hiking Trails", PARKS, DATASETS["central_nature_reserve"], VIEW.format(DATASETS["central_nature_reserve"]), "Central Nature Reserve hiking trail geometry used for route network segments."),
    ("park_connector_loop", "Park Connector Loop", PARKS, DATASETS["park_connector_loop"], VIEW.format(DATASETS["park_connector_loop"]), "Park connector loop segments used where they form part of selected routes."),
    ("national_map_line", "SLA National Map Line", LAND, DATASETS["national_map_line"], VIEW.format(DATASETS["national_map_line"]), "Contour lines parsed and interpolated for elevation, ascent, descent, and profile charts."),
    ("osm", "OpenStreetMap walkable paths", "OpenStreetMap contributors via Geofabrik", None, "https://download.geofabrik.de/asia/malaysia-singapore-brunei.html", "Walkable OSM ways used as enrichment for paths, tracks, footways, and steps."),
    ("fixture", "Fixture", "Synthetic test fixture", None, None, "Synthetic route network data used by tests."),
)
# What a record repeats of its first sample, and what stands for a sample.
ATTRIBUTES = ("source_primary", "source_feature_id", "source_row_index", "path_name", "highway", "trail_type", "source_confidence")
POINT = ("sample_index", "lon", "lat", "cum_distance_m", "cum_distance_km", "elevation_raw_m", "elevation_smooth_m", "grade_smooth_pct", "edge_id")
ID_NOTE = "edge_ids are made while the route graph is built; the raw dataset does not hold them."
SOURCE_DDL = "source_key string, label string, publisher string, dataset_id string, url string, description string"


def source_key(value: Column) -> Column:
    return F.when(present(value), F.trim(value.cast("string"))).otherwise("unknown")


def intervals(samples: DataFrame, keys: list[str], order: str = "sample_index") -> DataFrame:
    """``samples`` with ``delta``, the distance to the next one, never below 0; the last of a route goes."""
    nxt = F.lead("cum_distance_m").over(W.partitionBy(*keys).orderBy(order))
    return samples.withColumn("_next", nxt).filter("_next is not null").withColumn("delta", F.greatest(F.lit(0.0), F.col("_next") - F.col("cum_distance_m"))).drop("_next")


def source_records(df: DataFrame, key: str = "source_key") -> DataFrame:
    """``df`` with the description of its source; unlisted sources get one made from their key."""
    known = df.sparkSession.createDataFrame(SOURCES, SOURCE_DDL).withColumnRenamed("source_key", key)
    out = df.join(F.broadcast(known), key, "left")
    made = out["label"].isNull()
    title = F.initcap(F.replace(F.col(key), F.lit("_"), F.lit(" ")))
    return out.withColumns(
        {
            "publisher": F.when(made, "Processed local route data").otherwise(F.col("publisher")),
            "description": F.when(made, F.concat(F.lit("Route network segments tagged as "), F.col(key), F.lit("."))).otherwise(F.col("description")),
            "label": F.when(made, title).otherwise(F.col("label")),
        }
    )


def path_sources(samples: DataFrame, keys: list[str] = ["route_id"], order: str = "sample_index") -> DataFrame:  # noqa: B006
    """Distance, share and confidence by route and source; by counts where a route has no distance.

    Shares are of the route's distance; confidence is weighted by distance.
    """
    s = samples.withColumn("source_key", source_key(F.col("source_primary"))).withColumn("_conf", F.coalesce(F.col("source_confidence").cast("double"), F.lit(0.5)))
    steps = intervals(s, keys, order).filter("delta > 0").groupBy(*keys, "source_key").agg(F.sum("delta").alias("_d"), F.sum(F.col("_conf") * F.col("delta")).alias("_w"))
    every = s.groupBy(*keys, "source_key").agg(F.count("*").alias("_n"), F.avg("_conf").alias("_mean"))
    both = every.join(steps, [*keys, "source_key"], "left").withColumn("_d", F.coalesce("_d", F.lit(0.0)))
    w = W.partitionBy(*keys)
    both = both.withColumns({"_total": F.sum("_d").over(w), "_count": F.sum("_n").over(w)}).filter("_d > 0 or _total <= 0")
    moved = F.col("_total") > 0
    return both.select(
        *keys,
        "source_key",
        F.bround("_d", 1).alias("distance_m"),
        F.bround(F.when(moved, F.col("_d") / F.col("_total")).otherwise(F.col("_n") / F.col("_count")) * 100, 1).alias("share_pct"),
        F.bround(F.when(moved, F.col("_w") / F.col("_d")).otherwise(F.col("_mean")), 2).alias("confidence"),
    )


def feature_id(samples: DataFrame) -> Column:
    fallback = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c).cast("string")) for c in ("edge_id", "undirected_edge_id") if c in samples.columns]
    return F.coalesce(F.when(present(F.col("source_feature_id")), F.col("source_feature_id").cast("string")), *fallback, F.lit("unknown"))


def elevation_source(spark: SparkSession) -> DataFrame:
    """The description of the layer that elevations come from, as one row."""
    return spark.createDataFrame([x for x in SOURCES if x[0] == "national_map_line"], SOURCE_DDL)


def attributes(samples: DataFrame) -> Column:
    """The columns of ATTRIBUTES that a sample has and that hold something, as a JSON object."""
    return F.to_json(F.struct(*[F.when(present(F.col(c)), F.col(c)).alias(c) for c in ATTRIBUTES if c in samples.columns]))


def properties(samples: DataFrame) -> Column:
    """The raw feature's properties where they are a JSON object, else ``attributes``."""
    if "source_raw_properties_json" not in samples.columns:
        return attributes(samples)
    raw = F.get_json_object(F.col("source_raw_properties_json").cast("string"), "$")
    return F.when(raw.startswith("{"), raw).otherwise(attributes(samples))


def lookup(samples: DataFrame) -> Column:
    """What finds a sample's feature in the raw dataset, as a JSON object."""
    row = [F.when(present(F.col("source_row_index")), F.col("source_row_index")).alias("raw_row_index")] if "source_row_index" in samples.columns else []
    return F.to_json(F.struct(feature_id(samples).alias("raw_dataset_feature_id"), *row, F.lit(ID_NOTE).alias("id_note")))


def rounded_point(samples: DataFrame, order: str) -> Column:
    """The columns of POINT that a sample has; fractions keep seven places."""
    kept = [c for c in POINT if c != "sample_index" and c in samples.columns]
    fraction = {f.name for f in samples.schema.fields if f.dataType.typeName() in ("double", "float")}
    return F.struct(F.col(order).alias("sample_index"), *[(F.bround(c, 7) if c in fraction else F.col(c)).alias(c) for c in kept])


def representative(points: Column, most: int = 6) -> Column:
    """At most ``most`` evenly spread elements of an array, first and last included."""
    n = F.size(points)
    index = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (n - 1) / F.lit(most - 1)).cast("int")))
    return F.when(n <= most, points).otherwise(F.transform(index, lambda i: F.get(points, i)))


def used_records(samples: DataFrame, keys: list[str] = ["route_id"], order: str = "sample_index") -> DataFrame:  # noqa: B006
    """One row for each route, source and feature that its samples pass.

    Attributes, properties and lookup are those of the first sample, as JSON
    objects without what is missing there; bounds, elevations and points
    also take in the sample at which each interval ends. The share is of the
    rounded distance.
    """
    s = samples.withColumns({"source_key": source_key(F.col("source_primary")), "feature_id": feature_id(samples)})
    order_w = W.partitionBy(*keys).orderBy(order)
    point = F.struct(F.col(order).alias("sample_index"), "lon", "lat", "cum_distance_m", "elevation_smooth_m", rounded_point(samples, order).alias("shown"))
    first = F.struct(attributes(samples).alias("attributes"), properties(samples).alias("source_properties"), lookup(samples).alias("source_lookup"))
    s = s.withColumns({"_first": first, "_here": point, "_next": F.lead(point).over(order_w)})
    ends = s.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max_by("cum_distance_m", order) - F.min_by("cum_distance_m", order)).alias("_total"))
    steps = s.withColumn("delta", F.greatest(F.lit(0.0), F.col("_next.cum_distance_m") - F.col("cum_distance_m"))).filter("_next is not null and delta > 0")
    group = [*keys, "source_key", "feature_id"]
    edge = F.coalesce(*[F.col(c) for c in ("edge_id", "undirected_edge_id") if c in samples.columns])
    sums = steps.groupBy(*group).agg(F.bround(F.sum("delta"), 1).alias("distance_m"), F.min_by(F.coalesce("source_confidence", F.lit(0.5)), order).alias("source_confidence"), F.min_by("_first", order).alias("_first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), edge.alias("e")))).alias("_edges"))
    both = steps.select(*group, F.explode(F.array("_here", "_next")).alias("p")).dropDuplicates([*group, "p"])
    seen = both.groupBy(*group).agg(
        F.min("p.lat").alias("min_lat"),
        F.max("p.lat").alias("max_lat"),
        F.min("p.lon").alias("min_lon"),
        F.max("p.lon").alias("max_lon"),
        F.min("p.elevation_smooth_m").alias("min_smooth_m"),
        F.max("p.elevation_smooth_m").alias("max_smooth_m"),
        F.min_by("p.elevation_smooth_m", "p.sample_index").alias("start_smooth_m"),
        F.max_by("p.elevation_smooth_m", "p.sample_index").alias("end_smooth_m"),
        F.transform(representative(F.array_sort(F.collect_list("p"))), lambda p: p["shown"]).alias("points"),
    )
    out = sums.join(seen, group).join(ends, keys)
    rounded = {c: F.bround(c, 7) for c in ("min_lat", "max_lat", "min_lon", "max_lon")} | {c: F.bround(c, 1) for c in ("min_smooth_m", "max_smooth_m", "start_smooth_m", "end_smooth_m")}
    edges = F.array_distinct(F.transform(F.filter("_edges", lambda x: x["e"].isNotNull()), lambda x: x["e"]))
    share = F.when(F.col("_total") > 0, F.bround(F.col("distance_m") / F.col("_total") * 100, 1)).otherwise(F.lit(0.0))
    out = out.withColumns(rounded | {"edge_ids": edges, "share_pct": share}).select("*", "_first.*").drop("_edges", "_total", "_first")
    label = source_records(out).withColumnRenamed("label", "source_label")
    return label.select(*keys, "source_key", "source_label", *[c for c in out.columns if c not in (*keys, "source_key")])
