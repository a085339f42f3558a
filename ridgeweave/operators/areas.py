"""Area and display names of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Name, least and greatest latitude, least and greatest longitude; the first box that holds a point names it.
AREA_BOXES = (
    ("Bukit Timah Nature Reserve", 1.345, 1.362, 103.768, 103.786),
    ("Dairy Farm Nature Park", 1.360, 1.392, 103.767, 103.786),
    ("Rifle Range Nature Park", 1.375, 1.400, 103.785, 103.810),
    ("MacRitchie", 1.340, 1.365, 103.800, 103.840),
    ("Central Catchment", 1.365, 1.405, 103.800, 103.835),
    ("Zhenghua", 1.392, 1.412, 103.760, 103.782),
    ("Bukit Batok", 1.345, 1.372, 103.745, 103.765),
    ("Bukit Panjang", 1.385, 1.405, 103.750, 103.770),
    ("Western Catchment", 1.380, 1.435, 103.635, 103.690),
    ("Jurong West", 1.330, 1.360, 103.645, 103.682),
    ("Jurong Lake", 1.330, 1.350, 103.720, 103.740),
    ("Kent Ridge", 1.275, 1.305, 103.775, 103.805),
    ("Southern Ridges", 1.260, 1.285, 103.805, 103.830),
    ("Mount Faber", 1.265, 1.275, 103.815, 103.825),
    ("Pearl's Hill", 1.280, 1.290, 103.835, 103.845),
    ("Sentosa", 1.210, 1.260, 103.810, 103.865),
    ("Fort Canning", 1.290, 1.300, 103.840, 103.852),
    ("Marina Bay", 1.275, 1.295, 103.850, 103.870),
    ("Bishan-Ang Mo Kio", 1.365, 1.385, 103.835, 103.850),
    ("Seletar", 1.395, 1.425, 103.855, 103.885),
    ("Lower Seletar", 1.405, 1.425, 103.805, 103.825),
    ("Punggol", 1.395, 1.425, 103.890, 103.925),
    ("Tampines", 1.380, 1.405, 103.918, 103.940),
    ("Pasir Ris", 1.405, 1.430, 103.925, 103.950),
    ("Changi Village", 1.405, 1.425, 103.970, 104.000),
    ("Changi", 1.360, 1.395, 103.950, 103.995),
    ("Pulau Ubin", 1.390, 1.430, 104.025, 104.085),
    ("Admiralty", 1.440, 1.460, 103.765, 103.790),
    ("Woodlands", 1.420, 1.455, 103.670, 103.705),
    ("Kranji", 1.420, 1.435, 103.670, 103.700),
)


def area_of(lat: Column, lon: Column) -> Column:
    """The first box that holds a point, as one expression; null outside all."""
    found = F.lit(None).cast("string")
    for name, south, north, west, east in reversed(AREA_BOXES):
        found = F.when(lat.between(south, north) & lon.between(west, east), F.lit(name)).otherwise(found)
    return found


def area_names(samples: DataFrame, keys: list[str] = ["route_id"], order: str = "sample_index") -> DataFrame:  # noqa: B006
    """``area`` of each route from the boxes that hold most of its samples.

    A second box with a quarter of them makes it a way from one to the other;
    a first box without half of them is named as an area. Equal counts go by
    which box came first.
    """
    named = samples.withColumn("_area", area_of(F.col("lat"), F.col("lon"))).filter("_area is not null")
    counts = named.groupBy(*keys, "_area").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first")))
    pick = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    top = ranked.groupBy(*keys).agg(F.sum("n").alias("total"), pick(1, "_area").alias("a"), pick(1, "n").alias("na"), pick(2, "_area").alias("b"), pick(2, "n").alias("nb"))
    name = F.when(F.col("nb") / F.col("total") >= 0.25, F.concat("a", F.lit(" to "), "b")).when(F.col("b").isNotNull() & (F.col("na") / F.col("total") < 0.5), F.concat("a", F.lit(" area"))).otherwise(F.col("a"))
    return top.select(*keys, name.alias("area"))


def first_names(samples: DataFrame, keys: list[str] = ["route_id"], order: str = "sample_index", most: int = 2) -> DataFrame:  # noqa: B006
    """``names``: the first distinct path names of each route, joined by plus signs."""
    seen = samples.filter(F.coalesce("path_name", F.lit("")) != "").groupBy(*keys, "path_name").agg(F.min(order).alias("first"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("first", "path_name"))
    kept = seen.withColumn("place", place).filter(F.col("place") <= most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path_name"))), lambda x: x["path_name"]), " + ").alias("names"))


def display_names(routes: DataFrame, samples: DataFrame) -> DataFrame:
    """``routes`` with ``display_name``: area, names, distance and gain; half units go to the even digit."""
    r = routes.join(area_names(samples), "route_id", "left").join(first_names(samples), "route_id", "left")
    kind = F.when(F.col("mode") == "loop", "loop").otherwise("route")
    title = F.concat(F.initcap(F.replace(F.col("mode"), F.lit("_"), F.lit(" "))), F.lit(" route"))
    label = (
        F.when(F.col("area").isNotNull() & F.col("names").isNotNull(), F.concat_ws(": ", "area", "names"))
        .when(F.col("names").isNotNull(), F.col("names"))
        .when(F.col("area").isNotNull(), F.concat_ws(" ", F.col("area"), kind))
        .otherwise(title)
    )
    text = F.concat(label, F.lit(" - "), F.call_function("format_number", F.col("distance_m") / 1000, F.lit("0.00")), F.lit(" km, "), F.call_function("format_number", F.col("ascent_m"), F.lit("0")), F.lit(" m gain"))
    return r.withColumn("display_name", text).drop("area", "names")
