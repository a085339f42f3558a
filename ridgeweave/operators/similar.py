"""Near-duplicates among sets of parts with lengths, by a prefix-filtered join.

Two sets are near-duplicates if one of three similarities reaches its limit: of
counts, of lengths, or of the shorter one's length that they share. Each of them
asks that a set shares a least part of its own count or length with the other,
taking the one that has less. So in an order of parts from the rarest on, that
set has a shared part among its first ones, up to where what is left could not
make the least share. Only these prefixes look into the index of all parts, and
common parts are hardly ever among them. Candidates are then compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.functions.similarity import near_duplicate
from ridgeweave.scratch import Scratch


def met_pairs(parts: DataFrame) -> DataFrame:
    """(a, b, common, shared, sa, sb, ta, tb) with a < b: the sets ``k`` of parts ``e`` that share one, each pair once, from an inverted index.

    ``parts`` has each (k, e) once, with its length ``n``. An entry of the index
    carries the parts of its set that come before and after its own, so a pair
    is counted where it meets: at its first common part, and at no other. So
    only entries are shuffled, and never pairs. A part that is null counts for
    its set and is shared with none.
    """
    held = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("e", "n"))).alias("l"), F.count("*").alias("s"), F.sum("n").alias("t"))
    held = held.withColumn("l", F.filter("l", lambda x: x["e"].isNotNull()))
    each = held.select("k", "s", "t", F.col("l.e").alias("es"), F.col("l.n").alias("ns"), F.posexplode("l").alias("at", "p"))
    rest = lambda c: F.slice(c, F.col("at") + 2, F.size("es")).alias(c)
    index = each.select(F.col("p.e").alias("e"), F.col("p.n").alias("n"), "k", "s", "t", F.slice("es", F.lit(1), F.col("at")).alias("before"), rest("es"), rest("ns"))
    x, y = index.alias("x"), index.alias("y")
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.k") < F.col("y.k")) & ~F.arrays_overlap("x.before", "y.before"))
    both = F.array_intersect("x.es", "y.es")
    of = lambda one, e: F.get(F.col(f"{one}.ns"), (F.array_position(F.col(f"{one}.es"), e) - 1).cast("int"))
    first = F.least("x.n", "y.n").cast("double")
    more = F.aggregate(F.transform(both, lambda e: F.least(of("x", e), of("y", e)).cast("double")), first, lambda t, n: F.coalesce(t + n, t, n))
    shared = F.when(F.arrays_overlap("x.es", "y.es"), more).otherwise(first)
    side = lambda one, k: [F.col(f"{one}.{c}").alias(c + k) for c in "st"]
    return met.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), (F.size(both) + 1).cast("long").alias("common"), shared.alias("shared"), *side("x", "a"), *side("y", "b"))


def prefixes(parts: DataFrame, share_of_count: float, share_of_length: float) -> DataFrame:
    """(k, e, size, total): the parts of each set from the rarest on, until too little is left in count and in length."""
    order = W.partitionBy("k").orderBy("rank", "e")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("k")
    rows = parts.withColumns({"size": F.count("*").over(whole), "total": F.sum("n").over(whole), "seen": F.row_number().over(order) - 1, "gone": F.coalesce(F.sum("n").over(before), F.lit(0.0))})
    left = (F.col("size") - F.col("seen") >= share_of_count * F.col("size") - 1e-9) | (F.col("total") - F.col("gone") >= (share_of_length - 1e-9) * F.col("total"))
    return rows.filter(left).select("k", "e", "size", "total")


def near_pairs(parts: DataFrame, jaccard: float, length_jaccard: float, containment: float) -> DataFrame:
    """(a, b) with a < b: the near-duplicates among sets ``k`` of parts ``e``, each once, with lengths ``n`` above 0.

    Limits have to be above 0, so sets without a common part are never near.
    """
    if min(jaccard, length_jaccard, containment) <= 0:
        raise ValueError("limits have to be above 0")
    scratch = Scratch(parts.sparkSession, "similar")
    rows = parts.select("k", "e", F.col("n").cast("double").alias("n"))
    rows = scratch.keep(rows.join(rows.groupBy("e").agg(F.count("*").alias("rank")), "e"), "parts")
    first = scratch.keep(prefixes(rows, jaccard, min(containment, 2 * length_jaccard / (1 + length_jaccard))), "prefixes")
    sets = scratch.keep(rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("e", "n"))).alias("parts"), F.count("*").alias("size"), F.sum("n").alias("total")), "sets")
    index = rows.select("e", F.col("k").alias("other")).join(sets.select(F.col("k").alias("other"), F.col("size").alias("m"), F.col("total").alias("whole")), "other")
    less = (F.col("size") <= F.col("m")) | (F.col("total") <= F.col("whole"))
    met = first.join(index, "e").filter((F.col("k") != F.col("other")) & less)
    pairs = scratch.keep(met.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b")).distinct(), "pairs")
    side = lambda x: sets.select(F.col("k").alias(x), *[F.col(c).alias(c + x) for c in ("parts", "size", "total")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.map_zip_with(F.map_filter("partsa", lambda e, _: F.map_contains_key("partsb", e)), F.map_filter("partsb", lambda e, _: F.map_contains_key("partsa", e)), lambda e, x, y: F.least(x, y))
    both = both.withColumn("shared", F.map_values(shared))
    total = F.aggregate("shared", F.lit(0.0), lambda t, x: t + x)
    return both.filter(near_duplicate(F.size("shared"), F.col("sizea"), F.col("sizeb"), total, F.col("totala"), F.col("totalb"), jaccard, length_jaccard, containment)).select("a", "b")
