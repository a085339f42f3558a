"""Attribute cleaning as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as yes, which ways are walkable, and the order in which attributes are looked up.
YES = ("1", "true", "t", "yes", "y", "walk", "allowed")
WALKABLE = ("footway", "path", "pedestrian", "steps", "track")
BARRED = ("private", "no")
ID_KEYS = ("OBJECTID", "objectid", "FID", "fid", "id", "ID", "osm_id", "osmid", "osm_way_id")
NAME_KEYS = ("name", "TRAIL_NAME", "PARK", "PCN_LOOP")
TYPE_KEYS = ("TRAIL_TYPE", "TYPE")
ELEVATION_KEYS = ("ELEVATION", "ELEV", "HEIGHT", "CONTOUR", "LEVEL", "NAME")
PREFERRED_KEYS = (*ID_KEYS, "TRAIL_NAME", "TRAIL_TYPE", "ALLOW_WALKING", "NAME", "name", "PARK", "PCN_LOOP", "TYPE", "highway", "access", "foot", "SHAPE.LEN", "length", "INC_CRC", "FMEL_UPD_D")
MOST_PROPERTIES, LONGEST_TEXT, MOST_LISTED = 20, 160, 8
NUMBER = r"[-+]?\d+(?:\.\d+)?"


def truthy(value: Column) -> Column:
    """Whether a flag means yes; a null and a float such as 1.0 don't."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*YES), F.lit(False))


def present(value: Column) -> Column:
    """Not null, blank, or the text of a missing number."""
    text = F.trim(value.cast("string"))
    return value.isNotNull() & (text != "") & (F.lower(text) != "nan")


def first_present(*values: Column) -> Column:
    return F.coalesce(*[F.when(present(v), v.cast("string")) for v in values])


def first_value(values: Column) -> Column:
    """The first of a list as text; null for an empty one and for what is missing."""
    return first_present(F.get(values, F.lit(0)))


def unlisted(value: Column) -> Column:
    """A text as it is, but the first of a list that arrives as JSON."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.startswith("["), F.coalesce(F.when(listed.isNotNull(), first_value(listed)), F.when(listed.isNull(), value))).otherwise(value)


def list_text(values: Column) -> Column:
    """The text of a list's first ``MOST_LISTED`` values."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(values, 1, MOST_LISTED), lambda v: scalar_text(v)), ", "), F.lit("]"))


def or_default(value: Column, default: float) -> Column:
    """``value``, or ``default`` where it is null or zero."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def scalar_text(value: Column) -> Column:
    """The text of a value; whole numbers lose their fraction, blanks become null."""
    text = value.cast("string")
    number = text.try_cast("double")
    whole = text.rlike(r"^[-+]?\d+\.0+$")
    return F.when(present(value), F.when(whole, number.cast("bigint").cast("string")).otherwise(text))


def source_id(values: list[Column], fallback: Column) -> Column:
    """The first present identifier, else the row's own index."""
    return F.coalesce(*[scalar_text(v) for v in values], fallback.cast("string"))


def parse_number(value: Column) -> Column:
    """The first decimal number in a text."""
    return F.nullif(F.regexp_extract(F.trim(value.cast("string")), NUMBER, 0), F.lit("")).try_cast("double")


def median(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    s = F.array_sort(values)
    n = F.size(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def contour_elevation(fields: list[Column], heights: Column | None = None) -> Column:
    """The first field with a number, else the median of the vertices' heights that aren't zero."""
    parts = [parse_number(f) for f in fields]
    if heights is not None:
        parts.append(median(F.filter(heights, lambda z: z.isNotNull() & (z != 0))))
    return F.coalesce(*parts)


def matches_any(value: Column, patterns: list[str]) -> Column:
    """Whether a text holds any of ``patterns`` as they stand, in any case."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(p.lower()) for p in patterns], F.lit(False))


def walkable(highway: Column, access: Column | None = None, foot: Column | None = None) -> Column:
    """Walkable kinds of way that neither access nor foot bars."""
    ok = F.coalesce(F.lower(highway).isin(*WALKABLE), F.lit(False))
    for c in (access, foot):
        if c is not None:
            ok = ok & ~F.lower(F.coalesce(c.cast("string"), F.lit(""))).isin(*BARRED)
    return ok


def compact_properties(properties: Column) -> Column:
    """Of a map of texts: preferred keys, then others while there are fewer than 20; as sorted JSON."""
    held = F.transform_values(F.map_filter(properties, lambda k, v: present(v)), lambda k, v: scalar_text(v))
    order = F.array(*map(F.lit, PREFERRED_KEYS))
    first = F.map_filter(held, lambda k, v: F.array_contains(order, k))
    rest = F.map_entries(F.map_filter(held, lambda k, v: ~F.array_contains(order, k) & (F.length(v) <= LONGEST_TEXT)))
    more = F.slice(rest, F.lit(1), F.greatest(F.lit(0), F.lit(MOST_PROPERTIES) - F.size(first)))
    return F.to_json(F.map_from_entries(F.array_sort(F.concat(F.map_entries(first), more))))
