"""Noding against exact fractions, and snapping against a plain loop."""

import math
import random
from fractions import Fraction as Q

import pytest
from pyspark.sql import functions as F

from ridgeweave.operators import noding, paths
from ridgeweave.scratch import Scratch

LINE = "array<struct<x:double,y:double>>"


def table(spark, lines):
    rows = [(k, "osm", 1.0, k, 0, [(float(x), float(y)) for x, y in pts]) for k, pts in enumerate(lines)]
    return spark.createDataFrame(rows, f"path_ordinal long, source_primary string, source_confidence double, feature_idx long, part int, coords {LINE}")


def pieces(df):
    return sorted((r.feature_idx, [(p.x, p.y) for p in r.coords]) for r in df.collect())


@pytest.mark.parametrize(
    "lines,expected",
    [
        ([[(0, 0), (10, 0)], [(5, 0), (15, 0)]], [(0, [(0, 0), (5, 0)]), (0, [(5, 0), (10, 0)]), (1, [(10, 0), (15, 0)])]),
        ([[(0, 0), (10, 0)], [(10, 0), (0, 0)], [(2, 0), (4, 0)]], [(0, [(0, 0), (2, 0)]), (0, [(2, 0), (4, 0)]), (0, [(4, 0), (10, 0)])]),
        ([[(0, 0), (1, 0), (2, 0)], [(2, 0), (1, 0), (0, 0)]], [(0, [(0, 0), (1, 0)]), (0, [(1, 0), (2, 0)])]),
        ([[(0, 0), (4, 0)], [(2, 0), (2, 3)]], [(0, [(0, 0), (2, 0)]), (0, [(2, 0), (4, 0)]), (1, [(2, 0), (2, 3)])]),
        ([[(0, 0), (1, 1), (2, 0)]], [(0, [(0, 0), (1, 1), (2, 0)])]),
        ([[(0, 0), (4, 0), (4, 4), (2, 4), (2, -4)]], [(0, [(0, 0), (2, 0)]), (0, [(2, 0), (2, -4)]), (0, [(2, 0), (4, 0), (4, 4), (2, 4), (2, 0)])]),
        ([[(0, 0), (0, 0), (3, 0)], [(1, 1), (1, 1)]], [(0, [(0, 0), (3, 0)])]),
    ],
)
def test_lines_are_cut_where_they_meet(spark, lines, expected):
    assert pieces(noding.node_lines(table(spark, lines))) == sorted(expected)


def test_no_lines(spark):
    assert noding.node_lines(table(spark, [[(0, 0), (1, 0)]]).limit(0)).count() == 0


def exact_edges(lines):
    """Every elementary stretch between places where segments meet, by fractions, with the first path that it lies on."""
    segs = [(k, (Q(a[0]), Q(a[1])), (Q(b[0]), Q(b[1]))) for k, pts in enumerate(lines) for a, b in zip(pts, pts[1:], strict=False) if a != b]
    out = {}
    for k, p, q in segs:
        d = (q[0] - p[0], q[1] - p[1])
        on = {Q(0), Q(1)}
        for _, r, s in segs:
            e = (s[0] - r[0], s[1] - r[1])
            det = d[0] * e[1] - d[1] * e[0]
            off = (r[0] - p[0], r[1] - p[1])
            if det:
                t, u = (off[0] * e[1] - off[1] * e[0]) / det, (off[0] * d[1] - off[1] * d[0]) / det
                if 0 <= t <= 1 and 0 <= u <= 1:
                    on.add(t)
            elif off[0] * d[1] == off[1] * d[0]:
                on |= {t for w in (r, s) if 0 <= (t := ((w[0] - p[0]) * d[0] + (w[1] - p[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)) <= 1}
        spots = [(p[0] + t * d[0], p[1] + t * d[1]) for t in sorted(on)]
        for a, b in zip(spots, spots[1:], strict=False):
            key = tuple(sorted((round(round(float(x), 6), 5), round(round(float(y), 6), 5)) for x, y in (a, b)))
            out[key] = min(out.get(key, k), k)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_lines_against_fractions(spark, seed):
    """Small whole coordinates, so lines cross, touch, overlap and repeat often."""
    r = random.Random(seed)
    lines = [[(r.randrange(7), r.randrange(7)) for _ in range(r.randint(2, 4))] for _ in range(14)]
    lines = [x for x in lines if len(set(x)) > 1]
    got = {}
    for k, pts in pieces(noding.node_lines(table(spark, lines), cell_m=2.0)):
        for a, b in zip(pts, pts[1:], strict=False):
            got[tuple(sorted((round(x, 5) + 0.0, round(y, 5) + 0.0) for x, y in (a, b)))] = k
    assert got == exact_edges(lines)


def test_the_lineage_is_that_of_the_nearest_original(spark):
    r = random.Random(7)
    lines = [[(r.uniform(0, 50), r.uniform(0, 50)), (r.uniform(0, 50), r.uniform(0, 50))] for _ in range(12)] + [[(0, 0), (40, 0)], [(10, 0), (50, 0)]]

    def gap(m, line):
        (ax, ay), (bx, by) = line
        t = max(0.0, min(1.0, ((m[0] - ax) * (bx - ax) + (m[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return round(math.hypot(ax + t * (bx - ax) - m[0], ay + t * (by - ay) - m[1]), 5)

    for k, (a, b) in pieces(noding.node_lines(table(spark, lines))):
        middle = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
        assert k == min(range(len(lines)), key=lambda j: (gap(middle, lines[j]), j))


def plainly_snapped(points, tolerance):
    nodes, out, cells = [], [], {}
    for x, y in points:
        bx, by = int(x // tolerance), int(y // tolerance)
        best, where = tolerance, None
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                for k in cells.get((bx + dx, by + dy), ()):
                    gap = math.sqrt((nodes[k][0] - x) ** 2 + (nodes[k][1] - y) ** 2)
                    if gap <= best:
                        best, where = gap, k
        if where is None:
            where = len(nodes)
            nodes.append((x, y))
            cells.setdefault((bx, by), []).append(where)
        out.append(nodes[where])
    return out


@pytest.mark.parametrize("rounds", [0, 4])
@pytest.mark.parametrize("kind", ["cloud", "chain", "grid"])
def test_snapping_in_rounds_is_snapping_in_order(spark, kind, rounds):
    r = random.Random(rounds + 1)
    points = {
        "cloud": [(round(r.uniform(-60, 60), 2), round(r.uniform(-60, 60), 2)) for _ in range(600)],
        "chain": [(round(0.9 * k, 2), float(k % 3)) for k in range(300)],
        "grid": [(float(x), float(y)) for x in range(-8, 8) for y in range(-8, 8)],
    }[kind]
    if kind == "grid":
        r.shuffle(points)
    points += r.choices(points, k=100)
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "seq long, x double, y double")
    got = {x.seq: (x.nx, x.ny) for x in paths.snap_nodes(df, 5.0, Scratch(spark, "snap"), rounds).collect()}
    assert [got[k] for k in range(len(points))] == plainly_snapped(points, 5.0)


@pytest.mark.parametrize("kind, tile, rim", [("cloud", 2, 1), ("sparse", 3, 2), ("grid", 1, 1)])
def test_ends_of_any_tile_join_the_nodes_of_the_whole(spark, monkeypatch, kind, tile, rim):
    monkeypatch.setattr(paths, "TILE", tile)
    monkeypatch.setattr(paths, "RIM", rim)
    monkeypatch.setattr(paths, "OPEN", tile)
    r = random.Random(tile)
    spread = {"cloud": 40, "sparse": 160, "grid": 0}[kind]
    points = [(round(r.uniform(-spread, spread), 1), round(r.uniform(-spread, spread), 1)) for _ in range(400)] if spread else [(x * 2.5, y * 2.5) for x in range(-9, 9) for y in range(-9, 9)]
    r.shuffle(points)
    points += r.choices(points, k=150)
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "seq long, x double, y double")
    got = {x.seq: (points[x.node_seq], (x.nx, x.ny)) for x in paths.snap_nodes(df, 5.0, Scratch(spark, "tiles")).collect()}
    expected = plainly_snapped(points, 5.0)
    assert [got[k] for k in range(len(points))] == [(p, p) for p in expected]


def test_ends_apart_are_settled_by_one_pass_over_tiles(spark):
    """Lines far from each other, as those of orders: no component, no join with neighbouring cells."""
    at = [F.col("id").alias("seq"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.floor(F.col("id") / 8) * 50.0).alias("y")]
    df = spark.range(4000).select(*at)
    out = paths.snap_nodes(df, 5.0, Scratch(spark, "apart"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    expected = plainly_snapped([(r.x, r.y) for r in df.orderBy("seq").collect()], 5.0)
    assert [(r.nx, r.ny) for r in out.orderBy("seq").collect()] == expected


def test_a_large_component_takes_time_in_proportion(spark):
    """A chain that leaves one component of 20,000 points: one pass, nine cells for each."""
    n = 20_000
    df = spark.range(n).select(spark_seq(), (spark_seq() * 3.0).alias("x"), (spark_seq() % 2).cast("double").alias("y"))
    out = paths.snap_nodes(df, 5.0, Scratch(spark, "chain"), 1)
    assert [r.node_seq for r in out.filter("seq < 10").orderBy("seq").collect()] == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]
    assert out.select("node_seq").distinct().count() == n // 2


def spark_seq():
    from pyspark.sql import functions as F

    return F.col("id").alias("seq")


def test_copies_for_neighbouring_cells_are_not_broadcast(spark):
    df = spark.range(40).select(spark_seq(), (spark_seq() * 7.0).alias("x"), (spark_seq() % 2).cast("double").alias("y"))
    points = df.select("x", "y", df["seq"].alias("point"), paths.bucket("x", 5.0).alias("cx"), paths.bucket("y", 5.0).alias("cy"))
    for out in (paths.first_of_cells(points), paths.out_of_reach(points, points, 5.0), paths.snap_pairs(points, 5.0)):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()


def test_equal_segments_and_cells_are_dealt_once(spark):
    """Paths of one segment go to no window over paths, the sides of the meeting are one shuffle, and repeated cuts count once in theirs."""
    lines = [[(0, 0), (10, 0)], [(10, 0), (0, 0)], [(4, 0), (14, 0)], [(4, 0), (14, 0)], [(7, -5), (7, 5)]]
    out = noding.noded(table(spark, lines))
    rows = out.collect()
    assert sorted((r.path_ordinal, r.piece, [tuple(p) for p in r.coords]) for r in rows) == [
        (0, 0, [(0.0, 0.0), (4.0, 0.0)]), (0, 1, [(4.0, 0.0), (7.0, 0.0)]), (0, 2, [(7.0, 0.0), (10.0, 0.0)]),
        (2, 2, [(10.0, 0.0), (14.0, 0.0)]), (4, 0, [(7.0, -5.0), (7.0, 0.0)]), (4, 1, [(7.0, 0.0), (7.0, 5.0)]),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "hashpartitioning(path_ordinal" not in plan
