"""From raw vector layers to paths, nodes and edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeweave.functions import clean as C
from ridgeweave.functions import geometry as G
from ridgeweave.functions.crs import to_grid
from ridgeweave.operators.components import components
from ridgeweave.scratch import Scratch

# How far each source is trusted.
SOURCE_CONFIDENCE = {"nparks_tracks": 1.0, "central_nature_reserve": 0.95, "park_connector_loop": 0.9, "osm": 0.65}


def field(properties: str, key: str) -> Column:
    return F.col(properties).getItem(key)


def projected(line: Column) -> Column:
    """A line of degrees in grid metres."""

    def one(p: Column) -> Column:
        x, y = to_grid(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(line, one)


def normalise_layer(layer: DataFrame, source: str, confidence: float, geographic: bool = True) -> DataFrame:
    """Lines of a layer with their lineage.

    ``layer`` has feature_idx, properties (a map of texts) and lines. A feature
    of several lines gives several rows with one feature id; lines without
    length go. The row index is that of the file, before any filter.
    """
    ids = [field("properties", k) for k in C.ID_KEYS]
    line = projected(F.col("line")) if geographic else F.col("line")
    rows = layer.select("feature_idx", "properties", F.posexplode("lines").alias("part", "line")).withColumn("coords", line)
    rows = rows.filter((F.size("coords") > 1) & (G.length(F.col("coords")) > 0))
    first = lambda keys: C.first_present(*[field("properties", k) for k in keys])
    return rows.select(
        F.lit(source).alias("source_primary"),
        F.lit(float(confidence)).alias("source_confidence"),
        C.source_id(ids, F.col("feature_idx")).alias("source_feature_id"),
        F.col("feature_idx").cast("string").alias("source_row_index"),
        C.compact_properties(F.col("properties")).alias("source_raw_properties_json"),
        C.first_present(field("properties", "highway")).alias("highway"),
        first(C.NAME_KEYS).alias("name"),
        C.scalar_text(first(C.TYPE_KEYS)).alias("trail_type"),
        "feature_idx",
        "part",
        "coords",
    )


def walking_only(layer: DataFrame) -> DataFrame:
    """Features that allow walking, where the layer says so at all."""
    flag = field("properties", "ALLOW_WALKING")
    has = layer.filter(F.map_contains_key("properties", "ALLOW_WALKING")).limit(1).count()
    return layer.filter(C.truthy(flag)) if has else layer


def walkable_ways(layer: DataFrame) -> DataFrame:
    p = lambda k: field("properties", k)
    return layer.filter(C.walkable(C.unlisted(p("highway")), p("access"), p("foot")))


def with_ordinals(paths: DataFrame, order: list[str], name: str = "path_ordinal") -> DataFrame:
    """``paths`` with ``name`` from 0 on in the given order.

    Rows are range-partitioned and numbered within their partition; only the
    partitions' counts pass through one place.
    """
    ranged = Scratch(paths.sparkSession, "ordinals").keep(paths.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_before")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` from 1 on within each of a few groups, however large: no task holds one."""
    out = with_ordinals(rows, [group, *order], "_at")
    first = out.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"))
    return out.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_group")


def ends(paths: DataFrame, precision: float) -> DataFrame:
    """(seq, path_ordinal, side, x, y): both ends of every path, rounded half to even."""
    side = lambda k, p: F.struct((F.col("path_ordinal") * 2 + k).alias("seq"), "path_ordinal", F.lit(k).alias("side"), *[(F.rint(p[c] / precision) * precision).alias(c) for c in "xy"])
    return paths.select(F.explode(F.array(side(0, G.start(F.col("coords"))), side(1, G.end(F.col("coords"))))).alias("e")).select("e.*")


def bucket(c: str | Column, tolerance: float) -> Column:
    """The cell of a coordinate: the whole part of an exact division."""
    v = F.col(c) if isinstance(c, str) else c
    rest = v % tolerance
    return F.rint((v - F.when(rest < 0, rest + tolerance).otherwise(rest)) / tolerance).cast("long")


#: Cells along a side of a tile, and how many more its task sees on every side.
TILE, RIM = 64, 2
#: Open ends that a cell keeps one by one; what it holds more leaves all around it open.
OPEN = 64
#: A cell and its eight neighbours.
AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def beside(rows: DataFrame) -> DataFrame:
    """``rows`` once for each cell (cx, cy) of their neighbourhood, with (dx, dy) from that cell to their own."""
    spread = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy")) for dx, dy in AROUND])).alias("c")
    out = rows.withColumn("_c", F.lit(0)).select(*[c for c in rows.columns if c not in ("cx", "cy")], spread).select("*", "c.*").drop("c")
    # Spark judges the nine copies by the size of the file they come from, and would send them whole through the driver
    return out.hint("merge")


def snap_pairs(points: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of distinct points within the tolerance, by an equi-join on grid cells."""
    points = points.select("point", "x", "y", bucket("x", tolerance).alias("cx"), bucket("y", tolerance).alias("cy"))
    home = points.select(F.col("point").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy")
    near = beside(points.select(F.col("point").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy"))
    gap = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return home.join(near, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & (gap <= tolerance)).select("a", "b")


def first_of_cells(points: DataFrame) -> DataFrame:
    """The points that come before all others in their own and the eight cells around."""
    least = points.groupBy("cx", "cy").agg(F.min("point").alias("least"))
    around = beside(least).groupBy("cx", "cy").agg(F.min("least").alias("least"))
    return points.join(around.hint("merge"), ["cx", "cy"]).filter(F.col("point") == F.col("least")).drop("least")


def gap() -> Column:
    """From (x, y) to (nx, ny)."""
    return F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)


def out_of_reach(points: DataFrame, nodes: DataFrame, tolerance: float) -> DataFrame:
    """``points`` without those within the tolerance of an earlier node. A cell holds few nodes, as nodes keep their distance."""
    near = beside(nodes.select(F.col("point").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"), "cx", "cy"))
    reach = points.join(near, ["cx", "cy"]).filter((F.col("node") < F.col("point")) & (gap() <= tolerance)).select("point").distinct()
    return points.join(reach.hint("merge"), "point", "left_anti")


def worked_through(points: DataFrame, tolerance: float, scratch: Scratch) -> DataFrame:
    """(point) of the nodes among points that no earlier node reaches, each component of near points in order.

    A point looks at the nodes of nine cells, so a component takes time in
    proportion to its points.
    """
    label = components(snap_pairs(points, tolerance), scratch)
    named = points.join(label.withColumnRenamed("id", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        found = []
        for point, x, y, cx, cy in group.sort_values("point")[["point", "x", "y", "cx", "cy"]].itertuples(index=False):
            if not any(math.sqrt((nx - x) ** 2 + (ny - y) ** 2) <= tolerance for dx, dy in AROUND for nx, ny in cells.get((cx + dx, cy + dy), ())):
                cells.setdefault((cx, cy), []).append((x, y))
                found.append(point)
        return pd.DataFrame({"point": found}, dtype="int64")

    return named.groupBy("component").applyInPandas(run, "point long")


def settled(tolerance: float, tile: int, rim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A walk through the ends of tile after tile, each in order, that tells which node an end joins.

    A tile's task sees some cells around it, but not what lies beyond: an end
    in the outermost of them may join a node there, so whether it is one is
    open unless a node in sight reaches it, and so on for what it may reach.
    An open end of the tile gets no node_seq and its own place; ``may`` tells
    that it may be a node. It can't be one where its place was met before.
    """
    root, shift = math.sqrt, 1 << 32
    around = [dx * shift + dy for dx, dy in AROUND]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, opened, vague = None, {}, {}, set()
        for batch in batches:
            seqs, joined, nxs, nys, mays = [], [], [], [], []
            for seq, x, y, cx, cy, tx, ty in zip(*[batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("seq", "x", "y", "cx", "cy", "tx", "ty")], strict=True):
                if (tx, ty) != at:
                    # nodes and open ends by cell; no two cells in sight have one key
                    at, near, opened, vague = (tx, ty), {}, {}, set()
                    west, east, south, north = tx * tile, tx * tile + tile - 1, ty * tile, ty * tile + tile - 1
                    least_x, most_x, least_y, most_y = west - rim, east + rim, south - rim, north + rim
                key = cx * shift + cy
                best, node, doubt, met = tolerance, None, key in vague or not (least_x < cx < most_x and least_y < cy < most_y), False
                for n in [n for d in around if key + d in near for n in near[key + d]]:
                    dx, dy = n[0] - x, n[1] - y
                    far = root(dx * dx + dy * dy)
                    if far <= best and n[2]:
                        # of equally near ones the later probe, cells and then nodes in order
                        if far < best or node is None or n[3:] > node[3:]:
                            best, node = far, n
                    elif far <= tolerance and not n[2]:
                        doubt, met = True, met or far == 0
                may = node is None and not met
                if may:
                    node = (x, y, not doubt, cx, cy, seq)
                    if doubt:
                        opened[key] = opened.get(key, 0) + 1
                    if doubt and opened[key] > OPEN:
                        vague.update([key + d for d in around])
                    else:
                        near.setdefault(key, []).append(node)
                if west <= cx <= east and south <= cy <= north:
                    seqs.append(seq)
                    joined.append(None if doubt else node[5])
                    nxs.append(x if doubt else node[0])
                    nys.append(y if doubt else node[1])
                    mays.append(may and doubt)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(joined, pa.int64()), pa.array(nxs, pa.float64()), pa.array(nys, pa.float64()), pa.array(mays, pa.bool_())], ["seq", "node_seq", "nx", "ny", "may"])

    return walk


def snap_in_tiles(points: DataFrame, tolerance: float) -> DataFrame:
    """(seq, node_seq, nx, ny, may) of ``settled`` over all ends, from one shuffle by tile; ends near a side go to its neighbours too."""
    seen = lambda c: F.explode(F.sequence(F.floor((F.col(c) - RIM) / TILE), F.floor((F.col(c) + RIM) / TILE)))
    dealt = points.select("seq", "x", "y", bucket("x", tolerance).alias("cx"), bucket("y", tolerance).alias("cy"))
    dealt = dealt.select("*", seen("cx").alias("tx")).select("*", seen("cy").alias("ty"))
    inorder = dealt.repartition("tx", "ty").sortWithinPartitions("tx", "ty", "seq")
    return inorder.mapInArrow(settled(tolerance, TILE, RIM), "seq long, node_seq long, nx double, ny double, may boolean")


def snap_nodes(points: DataFrame, tolerance: float, scratch: Scratch, rounds: int = 4) -> DataFrame:
    """(seq, node_seq, nx, ny): the node that each end joins.

    In the paths' order a point joins the nearest node so far within the
    tolerance, the later probe winning a tie, or becomes a node. Tiles are
    walked through in that order, with some cells around each, which settles
    all but what depends on a chain of ends from beyond those cells. Of these
    few, in rounds, a point that comes before all in its neighbourhood is a
    node, and what lies within its tolerance is none; chains that are left are
    worked through in their order, each component by itself. Which node such
    an end joins is a join at the end, with the nodes that came before it: a
    handful, as nodes keep their distance. So two ends at one place may join
    different nodes where one was made between them.
    """
    if tolerance <= 0:
        first = points.groupBy("x", "y").agg(F.min("seq").alias("node_seq"))
        return points.join(first, ["x", "y"]).select("seq", "node_seq", F.col("x").alias("nx"), F.col("y").alias("ny"))
    met = scratch.keep(snap_in_tiles(points, tolerance), "met")
    closed = met.filter("node_seq is not null").select("seq", "node_seq", "nx", "ny")
    if not met.filter("node_seq is null").limit(1).count():
        return closed
    cells = [bucket("x", tolerance).alias("cx"), bucket("y", tolerance).alias("cy")]
    opened = scratch.keep(met.filter("node_seq is null").select("seq", F.col("nx").alias("x"), F.col("ny").alias("y"), "may").select("*", *cells), "open")
    sure = met.filter("node_seq = seq").select(F.col("seq").alias("point"), F.col("nx").alias("x"), F.col("ny").alias("y")).select("*", *cells)
    nodes = scratch.keep(sure.join(beside(opened.select("cx", "cy").distinct()).select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select("point", "x", "y", "cx", "cy"), "near")
    left = scratch.keep(out_of_reach(opened.filter("may").select(F.col("seq").alias("point"), "x", "y", "cx", "cy"), nodes, tolerance), "left")
    for _ in range(rounds):
        if not left.limit(1).count():
            break
        new = scratch.keep(first_of_cells(left), "firsts")
        nodes = nodes.unionByName(new.select(nodes.columns))
        left = scratch.keep(out_of_reach(left, new, tolerance), "left")
    else:
        nodes = nodes.unionByName(left.join(worked_through(left, tolerance, scratch), "point").select(nodes.columns))
    nodes = scratch.keep(nodes, "nodes")
    near = beside(nodes.select(F.col("point").alias("node_seq"), F.col("x").alias("nx"), F.col("y").alias("ny"), "cx", "cy"))
    places = opened.groupBy("x", "y", "cx", "cy").agg(F.min("seq").alias("point"))
    probes = places.join(near, ["cx", "cy"]).withColumn("gap", gap()).filter(F.col("gap") <= tolerance)
    found = F.struct("gap", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), (-F.col("node_seq")).alias("last"), "nx", "ny")
    held = probes.groupBy("x", "y").agg(F.collect_list(found).alias("near"))
    best = F.array_min(F.filter("near", lambda n: -n["last"] <= F.col("seq")))
    late = opened.join(held.hint("merge"), ["x", "y"]).withColumn("n", best)
    return closed.unionByName(late.select("seq", (-F.col("n.last")).alias("node_seq"), "n.nx", "n.ny"))


def edges_and_nodes(paths: DataFrame, precision: float = 0.01, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``paths`` with path_ordinal.

    Nodes are numbered by first appearance; edges whose ends join one node
    vanish, though their node stays; edges count up by source.
    """
    scratch = Scratch(paths.sparkSession, "nodes")
    points = scratch.keep(ends(paths, precision), "ends")
    snapped = scratch.keep(snap_nodes(points, tolerance, scratch), "snapped")
    nodes = with_ordinals(snapped.select("node_seq", F.col("nx").alias("x"), F.col("ny").alias("y")).distinct(), ["node_seq"])
    nodes = scratch.keep(nodes.select(F.format_string("n%06d", F.col("path_ordinal") + 1).alias("node_id"), "node_seq", "x", "y"), "nodes")
    held = snapped.join(nodes, "node_seq").select("seq", "node_id", F.struct("x", "y").alias("p"))
    side = lambda k, u: held.filter(F.col("seq") % 2 == k).select(F.floor(F.col("seq") / 2).alias("path_ordinal"), F.col("node_id").alias(u), F.col("p").alias(f"p{u}"))
    both = paths.join(side(0, "u"), "path_ordinal").join(side(1, "v"), "path_ordinal").filter("u <> v")
    coords = G.with_ends(F.col("coords"), F.col("pu"), F.col("pv"))
    both = numbered(both, "source_primary", ["path_ordinal"], "_number")
    have = set(paths.columns)
    measure = lambda c: (C.or_default(F.col(c).cast("double"), 0.0) if c in have else F.lit(0.0)).alias(c)
    edges = both.withColumn("coords", coords).select(
        F.format_string("%s_%06d", "source_primary", "_number").alias("edge_id"),
        "u",
        "v",
        G.length(F.col("coords")).alias("length_m"),
        *[measure(c) for c in ("ascent_fwd_m", "descent_fwd_m", "ascent_rev_m", "descent_rev_m")],
        "source_primary",
        C.or_default(F.col("source_confidence"), 0.5).alias("source_confidence"),
        *[c for c in ("source_feature_id", "source_row_index", "source_raw_properties_json", "highway", "name", "trail_type") if c in have],
        "coords",
    )
    return nodes.select("node_id", "x", "y"), edges
