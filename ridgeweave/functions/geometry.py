"""Lines as arrays of (x, y), in Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def segment_lengths(line: Column) -> Column:
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), distance)).otherwise(F.array().cast("array<double>"))


def length(line: Column) -> Column:
    """Planar length."""
    return F.aggregate(segment_lengths(line), F.lit(0.0), lambda a, x: a + x)


def start(line: Column) -> Column:
    return F.get(line, F.lit(0))


def end(line: Column) -> Column:
    return F.element_at(line, -1)


def with_ends(line: Column, first: Column, last: Column) -> Column:
    """The line with both end points replaced."""
    return F.concat(F.array(first), F.slice(line, F.lit(2), F.greatest(F.lit(0), F.size(line) - 2)), F.array(last))


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def stations(total: Column, spacing: float) -> Column:
    """0, spacing, 2 spacing, ... below ``total``, then ``total`` unless the last is close to it."""
    n = F.ceil(total / spacing).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i * F.lit(float(spacing)))
    whole = let(each, lambda d: F.when(is_close(F.element_at(d, -1), total), d).otherwise(F.array_append(d, total)))
    return F.when(total > 0, whole).otherwise(F.array(F.lit(0.0)))


def at(line: Column, where: Column) -> Column:
    """The point at a distance along the line, clamped to it."""

    def walk(lengths: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            size = F.get(lengths, k)
            here = (a["left"] <= size) | (k == F.size(lengths) - 1)
            share = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), a["left"] / size))).otherwise(F.lit(0.0))
            p, q = F.get(line, k), F.get(line, k + 1)
            point = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
            return F.when(a["point"].isNotNull(), a).otherwise(F.struct((a["left"] - size).alias("left"), F.when(here, point).alias("point")))

        none = F.lit(None).cast("struct<x:double,y:double>")
        return F.aggregate(F.sequence(F.lit(0), F.size(lengths) - 1), F.struct(where.cast("double").alias("left"), none.alias("point")), step, lambda a: a["point"])

    return F.when(F.size(line) > 1, let(segment_lengths(line), walk)).otherwise(F.get(line, F.lit(0)))


def densify(line: Column, spacing: float) -> Column:
    """Array of (d, x, y) at the stations of a line."""

    def each(total: Column) -> Column:
        return F.transform(stations(total, spacing), lambda d: let(at(line, d), lambda p: F.struct(d.alias("d"), p["x"].alias("x"), p["y"].alias("y"))))

    return let(length(line), each)


def concatenated(lines: Column, tolerance: float = 2.0) -> Column:
    """(coords, warnings) of lines in order; a shared joint stays once, larger gaps are named."""

    def step(a: Column, line: Column) -> Column:
        first, last = F.get(line, F.lit(0)), F.get(a["coords"], F.size(a["coords"]) - 1)
        n = F.size(a["coords"])
        gap = distance(last, first)
        text = F.format_string("gap %s m before segment %d", F.call_function("format_number", gap, F.lit("0.00")), n)
        rest = F.when(last == first, F.slice(line, F.lit(2), F.size(line))).otherwise(line)
        return F.struct(F.concat(a["coords"], rest).alias("coords"), F.when(gap > tolerance, F.array_append(a["warnings"], text)).otherwise(a["warnings"]).alias("warnings"))

    empty = F.struct(F.array().cast(LINE).alias("coords"), F.array().cast("array<string>").alias("warnings"))

    def guarded(a: Column, line: Column) -> Column:
        begin = F.struct(line.alias("coords"), a["warnings"].alias("warnings"))
        return F.when(F.size(line) == 0, a).when(F.size(a["coords"]) == 0, begin).otherwise(step(a, line))

    def finish(a: Column) -> Column:
        doubled = F.when(F.size(a["coords"]) == 1, F.concat(a["coords"], a["coords"])).otherwise(a["coords"])
        return F.struct(doubled.alias("coords"), a["warnings"].alias("warnings"))

    return F.aggregate(lines, empty, guarded, finish)
