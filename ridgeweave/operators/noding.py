"""Paths cut where they meet: crossings, touches and overlaps.

Equal segments are compared once, whatever the number of paths that share them.
Segments meet in the grid cells that their boxes cover, each pair in one cell
only. A crossing is computed once for both sides; all other places where paths
meet are corners that exist already, so both sides are cut at the very same
point, and pieces that lie on each other are equal.

A corner is a node where it ends a path, where more than one visit of a path
stops, or where it lies on another segment. Segments in one line that overlap
are cut where the other begins or ends; as their shared part is then cut at
every corner on it, what they share comes out as equal pieces, which stay once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.functions import geometry as G
from ridgeweave.operators.paths import with_ordinals
from ridgeweave.scratch import Scratch

#: Share of a segment's length within which a place counts as its end, and sine below which two segments run in one line.
NEAR, PARALLEL = 1e-9, 1e-12
#: Metres within which a corner lies on a line, and decimals of a computed crossing.
ON_LINE, DECIMALS = 1e-6, 6


#: The ends of a segment as plain numbers, which are less to move than structs.
ENDS = ["ax", "ay", "bx", "by"]


def spot(k: str) -> Column:
    return F.struct(F.col(k + "x").alias("x"), F.col(k + "y").alias("y"))


def numbers(p: Column, to: str) -> list[Column]:
    return [p[c].alias(to + c) for c in "xy"]


def corners(paths: DataFrame) -> DataFrame:
    """(path_ordinal, l): the corners of every path that has two at least; repeated points count once."""
    line = F.filter("coords", lambda p, i: (i == 0) | (p != F.get("coords", i - 1)))
    return paths.select("path_ordinal", line.alias("l")).filter(F.size("l") > 1)


def segments(lines: DataFrame) -> DataFrame:
    """(path_ordinal, i, alone, forward, ax, ay, bx, by): every segment, its ends in an order that doesn't depend on its direction."""
    each = lines.select("path_ordinal", (F.size("l") == 2).alias("alone"), F.posexplode("l").alias("i", "p"), F.get("l", F.col("i") + 1).alias("q")).filter("q is not null")
    return each.select("path_ordinal", "i", "alone", (F.col("p") <= F.col("q")).alias("forward"), *numbers(F.least("p", "q"), "a"), *numbers(F.greatest("p", "q"), "b"))


def meetings(each: DataFrame, cell_m: float) -> DataFrame:
    """Pairs (a, b, c, d) of different segments whose boxes touch, each once, in the first cell that both cover.

    Both sides of the join are the same rows, dealt by cells once; there equal segments become one.
    """
    low = lambda u, v: F.floor(F.least(u, v) / cell_m)
    high = lambda u, v: F.floor(F.greatest(u, v) / cell_m)
    placed = each.select(*ENDS, F.explode(F.sequence(low("ax", "bx"), high("ax", "bx"))).alias("gx"))
    placed = placed.withColumn("gy", F.explode(F.sequence(low("ay", "by"), high("ay", "by")))).repartition("gx", "gy").distinct()
    other = placed.select("gx", "gy", *[F.col(u + k).alias(v + k) for u, v in ("ac", "bd") for k in "xy"])
    met = placed.join(other.hint("merge"), ["gx", "gy"]).filter(F.struct(*ENDS) < F.struct("cx", "cy", "dx", "dy"))
    for k in "xy":
        met = met.filter(F.col("g" + k) == F.greatest(low("a" + k, "b" + k), low("c" + k, "d" + k)))
        for u, v, w, z in ("abcd", "cdab"):
            met = met.filter(F.greatest(u + k, v + k) >= F.least(w + k, z + k))
    return met.select(*[spot(k).alias(k) for k in "abcd"])


def cuts(met: DataFrame) -> DataFrame:
    """(a, b, at): points at which segments are cut, or that become nodes where they are an end of theirs.

    Two ends that meet are left to the count of corners. Rows may repeat.
    """
    v = lambda p, q: (F.col(f"{q}.x") - F.col(f"{p}.x"), F.col(f"{q}.y") - F.col(f"{p}.y"))
    cross = lambda m, n: m[0] * n[1] - m[1] * n[0]
    one, two, off = v("a", "b"), v("c", "d"), v("a", "c")
    turn = met.withColumns({"sine": cross(one, two), "size": F.hypot(*one) * F.hypot(*two), "long": F.hypot(*one)})
    slanted = turn.filter(F.abs("sine") > PARALLEL * F.col("size"))
    t, u = cross(off, two) / F.col("sine"), cross(off, one) / F.col("sine")
    hit = slanted.withColumns({"t": t, "u": u}).filter(F.col("t").between(-NEAR, 1 + NEAR) & F.col("u").between(-NEAR, 1 + NEAR))
    end = lambda k, p, q: F.when(F.col(k) <= NEAR, F.col(p)).when(F.col(k) >= 1 - NEAR, F.col(q))
    hit = hit.withColumns({"e": end("t", "a", "b"), "f": end("u", "c", "d")}).filter("e is null or f is null")
    middle = F.struct(*[F.round(F.col(f"a.{k}") + F.col("t") * (F.col(f"b.{k}") - F.col(f"a.{k}")), DECIMALS).alias(k) for k in "xy"])
    hit = hit.withColumn("at", F.coalesce("e", "f", middle))
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")))).alias("s")
    crossing = hit.select(both, "at").select("s.a", "s.b", "at")
    aligned = turn.filter(F.abs("sine") <= PARALLEL * F.col("size")).filter(F.abs(cross(one, off)) <= ON_LINE * F.col("long"))
    along = lambda p: ((F.col(f"{p}.x") - F.col("a.x")) * one[0] + (F.col(f"{p}.y") - F.col("a.y")) * one[1]) / (F.col("long") * F.col("long"))
    aligned = aligned.withColumns({"tc": along("c"), "td": along("d")})
    inside = lambda k: (F.col(k) > NEAR) & (F.col(k) < 1 - NEAR)
    within = lambda k: ((F.lit(k) - F.least("tc", "td")) > NEAR) & ((F.greatest("tc", "td") - F.lit(k)) > NEAR)
    pair = lambda p, q, at, when: F.when(when, F.struct(F.col(p).alias("a"), F.col(q).alias("b"), F.col(at).alias("at")))
    overlap = F.array(pair("a", "b", "c", inside("tc")), pair("a", "b", "d", inside("td")), pair("c", "d", "a", within(0.0)), pair("c", "d", "b", within(1.0)))
    return crossing.unionByName(aligned.select(F.explode(F.array_compact(overlap)).alias("s")).select("s.a", "s.b", "s.at"))


def stretches(cut: DataFrame, each: DataFrame) -> DataFrame:
    """(path_ordinal, i, j, alone, s, e): what cuts leave of each segment, in its path's direction.

    A segment is cut once for all the paths that share it; cuts that repeat
    count once, in the same shuffle.
    """
    away = F.hypot(F.col("px") - F.col("ax"), F.col("py") - F.col("ay"))
    order = W.partitionBy(*ENDS).orderBy(away, "px", "py")
    at = cut.withColumns({"j": F.dense_rank().over(order) - 1, **{f"l{k}": F.lag(f"p{k}", 1).over(order) for k in "xy"}})
    at = at.withColumn("n", F.max("j").over(W.partitionBy(*ENDS)) + 1).filter("lx is null or lx <> px or ly <> py")
    before = F.when(F.col("j") == 0, spot("a")).otherwise(spot("l"))
    part = lambda j, s, e: F.struct(j.alias("j"), s.alias("s"), e.alias("e"))
    mine, rest = part(F.col("j"), before, spot("p")), F.when(F.col("j") == F.col("n") - 1, part(F.col("n").cast("int"), spot("p"), spot("b")))
    at = at.select(*ENDS, F.col("n").cast("int").alias("n"), F.explode(F.array_compact(F.array(mine, rest))).alias("part"))
    found = each.join(at.hint("merge"), ENDS, "left")
    whole = part(F.lit(0), spot("a"), spot("b"))
    found = found.withColumns({"n": F.coalesce("n", F.lit(0)), "part": F.coalesce("part", whole)})
    way = lambda x, y: F.when(F.col("forward"), x).otherwise(y)
    return found.select("path_ordinal", "i", way(F.col("part.j"), F.col("n") - F.col("part.j")).alias("j"), "alone", way(F.col("part.s"), F.col("part.e")).alias("s"), way(F.col("part.e"), F.col("part.s")).alias("e"))


def pieces_of(paths: DataFrame, cell_m: float) -> DataFrame:
    """(path_ordinal, piece, coords): every path cut where it meets others or itself, equal pieces as often as they occur.

    What is left of a path of one segment is a piece by itself; of others, what
    lies between two places that no other corner shares runs on.
    """
    scratch = Scratch(paths.sparkSession, "noding")
    lines = scratch.keep(corners(paths), "lines")
    each = segments(lines)
    found = cuts(meetings(each, cell_m))
    inner = lines.filter(F.size("l") > 2).select("path_ordinal", F.posexplode("l").alias("i", "p"), F.size("l").alias("n")).filter("i > 0 and i < n - 1").drop("n")
    inner = scratch.keep(inner, "inner")
    bent = not inner.isEmpty()
    if bent:
        found = scratch.keep(found.distinct(), "cuts")
    is_end = (F.col("at") == F.col("a")) | (F.col("at") == F.col("b"))
    cut = found.filter(~is_end).select(*[x for u, v in (("a", "a"), ("b", "b"), ("at", "p")) for x in numbers(F.col(u), v)])
    left = stretches(cut, each)
    pieces = left.filter("alone").select("path_ordinal", F.col("j").alias("piece"), F.array("s", "e").alias("coords"))
    if not bent:
        return pieces
    places = inner.select("p").distinct()
    seen = lines.select(F.explode("l").alias("p")).join(places, "p", "left_semi").groupBy("p").agg(F.count("*").alias("n")).filter("n > 1").select("p")
    nodes = seen.union(found.select(F.col("at").alias("p")).join(places, "p", "left_semi")).distinct()
    stops = inner.join(nodes, "p").select("path_ordinal", "i", F.lit(-1).alias("j"))
    rows = left.filter("not alone").drop("alone").unionByName(stops, allowMissingColumns=True)
    starts = (F.col("j") != 0) | (F.col("i") == 0)
    rows = rows.withColumn("piece", F.sum(starts.cast("int")).over(W.partitionBy("path_ordinal").orderBy("i", "j")).cast("int") - 1).filter("s is not null")
    runs = rows.groupBy("path_ordinal", "piece").agg(F.array_sort(F.collect_list(F.struct("i", "j", "s", "e"))).alias("v"))
    return pieces.unionByName(runs.select("path_ordinal", "piece", F.concat(F.array(F.col("v")[0]["s"]), F.transform("v", lambda x: x["e"])).alias("coords")))


def noded(paths: DataFrame, cell_m: float = 100.0) -> DataFrame:
    """(path_ordinal, piece, coords): the pieces of ``node_lines``, with the path that each was cut from."""
    back = F.reverse("coords")
    lines = pieces_of(paths, cell_m).select("path_ordinal", "piece", F.least("coords", back).alias("key"), (back < F.col("coords")).alias("turned"))
    lines = lines.groupBy("key").agg(F.min(F.struct("path_ordinal", "piece", "turned")).alias("first")).select("first.*", F.when(F.col("first.turned"), F.reverse("key")).otherwise(F.col("key")).alias("coords")).drop("turned")
    return lines.filter(G.length(F.col("coords")) > 0)


def node_lines(paths: DataFrame, cell_m: float = 100.0) -> DataFrame:
    """The pieces of ``paths`` (path_ordinal, coords and more) between the places where they meet.

    A piece lies on the paths that it was cut from, so these are its nearest
    originals; of several the first in order gives its lineage. Defined
    results: paths without length go; a path that meets nothing stays whole; a
    path that meets itself is cut there; of equal pieces, in either direction,
    one stays; an empty table gives no rows.
    """
    out = noded(paths, cell_m).join(paths.drop("coords"), "path_ordinal")
    return with_ordinals(out.withColumnRenamed("path_ordinal", "cut_from"), ["cut_from", "piece"]).drop("cut_from")
