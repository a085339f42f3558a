"""Series ordered by distance: differences, grades, smoothing and steep sections.

Every function takes a long table, the columns that identify a series, and the
column that orders it. Windows are partitioned by series, so a table with many
series spreads over the cluster whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ridgeweave.functions.geometry import let


def along(keys: list[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def ascent_descent(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Sums of the rises and of the falls of each series."""
    step = F.col(value) - F.lag(value).over(along(keys, order))
    part = lambda d: F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0))
    return df.withColumn("_step", step).groupBy(*keys).agg(part(F.col("_step")).alias("ascent_m"), part(-F.col("_step")).alias("descent_m"))


def grade(keys: list[str], order: str, distance: str, value: str) -> Column:
    """Slope against the row before, in per cent; 0 for the first row and where distance doesn't grow."""
    w = along(keys, order)
    d, z = F.col(distance) - F.lag(distance).over(w), F.col(value) - F.lag(value).over(w)
    return F.when(d > 0, z / d * 100).otherwise(F.lit(0.0))


def median_spacing(df: DataFrame, keys: list[str], order: str, distance: str) -> DataFrame:
    """Exact median of the positive steps of each series; null if there are none."""
    step = F.col(distance) - F.lag(distance).over(along(keys, order))
    return df.withColumn("_step", step).groupBy(*keys).agg(F.median(F.when(F.col("_step") > 0, F.col("_step"))).alias("spacing_m"))


def steps(values: Column) -> Column:
    """Differences of neighbours in an array."""
    n = F.size(values)
    return F.when(n > 1, F.zip_with(F.slice(values, F.lit(2), n - 1), F.slice(values, F.lit(1), n - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def total_of(values: Column, sign: int) -> Column:
    """Sum of the rises of an array, or of its falls for a sign of -1."""
    return F.aggregate(steps(values), F.lit(0.0), lambda total, d: total + F.greatest(F.lit(0.0), d * sign))


def median(values: Column) -> Column:
    """The middle of an array, or the mean of its two middle values; null for none."""
    return let(F.array_sort(values), lambda s: F.when(F.size(s) > 0, (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2))


def smoothed(distances: Column, values: Column, window_m: float) -> Column:
    """Centred moving mean over an odd number of values that spans about ``window_m``; it shrinks at both ends.

    The number depends on the median of the series' own positive spacings.
    """
    spacing = median(F.filter(steps(distances), lambda d: d > 0))
    reach = F.when(F.size(values) <= 2, 0).otherwise(F.floor(F.greatest(F.lit(1.0), F.rint(F.lit(float(window_m)) / F.coalesce(spacing, F.lit(float(window_m))))) / 2).cast("int"))

    def means(r: Column) -> Column:
        def mean(_: Column, i: Column) -> Column:
            first = F.greatest(F.lit(0), i - r)
            part = F.slice(values, first + 1, i + r - first + 1)
            return F.aggregate(part, F.lit(0.0), lambda a, y: a + y) / F.size(part)

        return F.transform(values, mean)

    return let(reach, means)


def smooth(df: DataFrame, keys: list[str], order: str, distance: str, value: str, window_m: float, out: str) -> DataFrame:
    """``df`` with the moving mean of each series; every series is one array on its way."""
    rows = df.withColumn("_row", F.struct(F.col(order).alias("o"), F.col(distance).cast("double").alias("d"), F.col(value).cast("double").alias("v")))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_all"))
    part = lambda c: F.transform("_all", lambda x: x[c])
    listed = listed.select(*keys, part("o").alias(order), smoothed(part("d"), part("v"), window_m).alias(out))
    means = listed.select(*keys, F.explode(F.arrays_zip(order, out)).alias("_m"))
    return df.join(means.select(*keys, "_m.*"), [*keys, order])


def cumulative(keys: list[str], order: str, length: str) -> Column:
    """What lies before each row."""
    w = along(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0.0))


def steep_sections(df: DataFrame, keys: list[str], order: str, distance: str, slope: str, threshold: float) -> DataFrame:
    """Maximal runs of rows at least as steep as the threshold; what isn't a number is not steep."""
    w = along(keys, order)
    steep = F.coalesce(~F.isnan(slope) & (F.abs(slope) >= threshold), F.lit(False))
    runs = df.withColumn("_steep", steep).withColumn("_run", F.row_number().over(w) - F.sum(F.col("_steep").cast("int")).over(w))
    found = runs.filter("_steep").groupBy(*keys, "_run").agg(F.min(distance).alias("start_distance_m"), F.max(distance).alias("end_distance_m"), F.max(F.abs(slope)).alias("max_abs_grade_pct"))
    return found.drop("_run").withColumn("threshold_pct", F.lit(float(threshold)))


def interpolate(points: DataFrame, queries: DataFrame, keys: list[str], distance: str, value: str, at: str, out: str) -> DataFrame:
    """Linear interpolation of ``points`` at the queries' places, clamped at both ends.

    Both sides are united and sorted once; the last point before and the first
    point after come from windows, so no query meets more than two points.
    """
    known = points.select(*keys, F.col(distance).cast("double").alias("_d"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_q"), *[F.lit(None).cast(t).alias(c) for c, t in queries.dtypes if c not in keys])
    asked = queries.select(*keys, F.col(at).cast("double").alias("_d"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q"), *[c for c in queries.columns if c not in keys])
    w = W.partitionBy(*keys).orderBy("_d", "_q")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    point = F.when(F.col("_q") == 0, F.struct("_d", "_v"))
    both = known.unionByName(asked).withColumns({"_a": F.last(point, True).over(before), "_b": F.first(point, True).over(after)})
    share = (F.col("_d") - F.col("_a._d")) / (F.col("_b._d") - F.col("_a._d"))
    line = F.when(F.col("_a").isNull(), F.col("_b._v")).when(F.col("_b").isNull() | (F.col("_d") == F.col("_a._d")), F.col("_a._v")).otherwise(F.col("_a._v") + share * (F.col("_b._v") - F.col("_a._v")))
    return both.filter("_q = 1").select(*queries.columns, line.alias(out))
