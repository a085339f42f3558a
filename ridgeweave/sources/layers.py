"""The path layers that the settings name, as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeweave.config import Settings
from ridgeweave.operators import paths as P
from ridgeweave.operators.graph import union_layers
from ridgeweave.sources.fetch import layer_file, osm_file
from ridgeweave.sources.geojson import in_box, read_vector
from ridgeweave.sources.ways import read_ways

#: Tags of a way that its path needs; no others are decoded from OSM's blocks.
WAY_TAGS = ("highway", "access", "foot", "name")
LAYERS = ("nparks_tracks", "central_nature_reserve", "park_connector_loop")


def load_osm(spark: SparkSession, settings: Settings) -> DataFrame | None:
    """Walkable ways; None if they are switched off or missing."""
    found = osm_file(settings)
    if found is None or not found.exists():
        return None
    given = settings.get("sources.osm.singapore_bbox_wgs84")
    box = tuple(map(float, given)) if given else None
    suffix = found.suffix.lower()
    if suffix in (".gpkg", ".shp", ".pbf"):
        return P.walkable_ways(read_ways(spark, str(found), list(WAY_TAGS) if suffix == ".pbf" else None, box))
    if suffix not in (".parquet", ".geojson", ".json", ".geojsonl", ".ndjson"):
        raise RuntimeError(f"can't read {found}; convert it to one of the kinds that README names")
    ways = read_vector(spark, str(found))
    return P.walkable_ways(in_box(ways, box) if box else ways)


def load_paths(spark: SparkSession, settings: Settings) -> DataFrame:
    """All layers, normalised, in a fixed order and numbered along it."""
    from pyspark.sql import functions as F

    folder = settings.data_dir / "raw" / "data_gov"
    out = []
    for name in LAYERS:
        if found := layer_file(folder, name):
            layer = read_vector(spark, str(found))
            layer = P.walking_only(layer) if name == "nparks_tracks" else layer
            out.append(P.normalise_layer(layer, name, P.SOURCE_CONFIDENCE[name]))
    if (ways := load_osm(spark, settings)) is not None:
        out.append(P.normalise_layer(ways, "osm", P.SOURCE_CONFIDENCE["osm"]))
    if not out:
        raise FileNotFoundError("no path layers; fetch them or name local files in the settings")
    numbered = [df.withColumn("layer", F.lit(k)) for k, df in enumerate(out)]
    return P.with_ordinals(union_layers(numbered), ["layer", "feature_idx", "part"]).drop("layer")
