"""Cleaning, geometry, nodes, elevation, samples, names, checks and files."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeweave import config
from ridgeweave.functions import clean as C
from ridgeweave.functions import crs
from ridgeweave.functions import geometry as G
from ridgeweave.operators import areas, attribution, elevation, graph, noding, paths, qa, samples, series, surface
from ridgeweave.scratch import Scratch
from ridgeweave.sinks import files, pages
from ridgeweave.sources import fetch
from ridgeweave.sources.geojson import read_geojson

LINE = "array<struct<x:double,y:double>>"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def line(spark, *points):
    return F.lit(None).cast(LINE) if not points else F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize("value,expected", [(None, False), ("1", True), ("1.0", False), (" Walk ", True), ("no", False), ("true", True)])
def test_truthy(spark, value, expected):
    assert one(spark, C.truthy(F.lit(value))) is expected


@pytest.mark.parametrize("text,expected", [("35m", 35.0), ("Contour 72.5 m", 72.5), ("0", 0.0), ("", None), ("none", None), ("1e3", 1.0)])
def test_first_number(spark, text, expected):
    assert one(spark, C.parse_number(F.lit(text))) == expected


def test_heights_stand_in_for_fields(spark):
    assert one(spark, C.contour_elevation([F.lit(None).cast("string")], F.array(F.lit(0.0), F.lit(12.0)))) == 12.0


def test_walkable_ways(spark, rows):
    df = spark.createDataFrame([("footway", None), ("path", "yes"), ("residential", None), ("primary", None), ("steps", "private"), (None, None)], "h string, a string")
    assert rows(df.filter(C.walkable(F.col("h"), F.col("a"))), "h") == [("footway",), ("path",)]


def test_properties_are_sorted_capped_json(spark):
    m = F.create_map(*[F.lit(x) for k in range(30) for x in (f"k{k:02d}", "v")], F.lit("OBJECTID"), F.lit("57452.0"), F.lit("blank"), F.lit(" "))
    got = json.loads(one(spark, C.compact_properties(m)))
    assert len(got) == 20 and got["OBJECTID"] == "57452" and list(got) == sorted(got)


@pytest.mark.parametrize("length,spacing,expected", [(100, 25, [0, 25, 50, 75, 100]), (30, 7, [0, 7, 14, 21, 28, 30]), (10.00005, 10, [0, 10]), (0, 5, [0])])
def test_stations(spark, length, spacing, expected):
    assert one(spark, G.stations(F.lit(float(length)), spacing)) == pytest.approx(expected)


def test_points_along_a_bent_line(spark):
    bent = line(spark, (0, 0), (3, 0), (3, 4))
    got = [one(spark, G.at(bent, F.lit(float(d)))) for d in (-1, 0, 3, 5, 7, 9)]
    assert [(p.x, p.y) for p in got] == [(0, 0), (0, 0), (3, 0), (3, 2), (3, 4), (3, 4)]
    assert one(spark, G.length(bent)) == 7


def test_joined_lines_name_their_gaps(spark):
    got = one(spark, G.concatenated(F.array(line(spark, (0, 0), (1, 0)), line(spark, (1, 0), (2, 0)), line(spark, (9, 0), (10, 0)))))
    assert [p.x for p in got.coords] == [0, 1, 2, 9, 10] and got.warnings == ["gap 7.00 m before segment 3"]


def test_projection_there_and_back(spark):
    df = spark.createDataFrame([(103.55 + 0.1 * i, 1.15 + 0.1 * j) for i in range(6) for j in range(5)], "lon double, lat double")
    x, y = crs.to_grid(F.col("lon"), F.col("lat"))
    lon, lat = crs.to_degrees(F.col("x"), F.col("y"))
    got = df.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).toPandas()
    assert np.abs(got.lon - got.a).max() < 1e-9 and np.abs(got.lat - got.b).max() < 1e-9
    o = spark.range(1).select(*crs.to_grid(F.lit(crs.GRID.lon0), F.lit(crs.GRID.lat0))).first()
    assert tuple(o) == pytest.approx((crs.GRID.east0, crs.GRID.north0), abs=1e-6)


def path_table(spark, *lines, **extra):
    data = [(k, "osm", 0.65, [(float(x), float(y)) for x, y in pts]) for k, pts in enumerate(lines)]
    return spark.createDataFrame(data, f"path_ordinal long, source_primary string, source_confidence double, coords {LINE}")


def test_crossing_lines_stay_whole_by_default(spark):
    nodes, edges = paths.edges_and_nodes(path_table(spark, [(0, 0), (10, 10)], [(0, 10), (10, 0)]))
    assert (nodes.count(), edges.count()) == (4, 2)


def test_crossing_lines_are_split_on_demand(spark):
    cut = noding.node_lines(path_table(spark, [(0, 0), (10, 10)], [(0, 10), (10, 0)]))
    nodes, edges = paths.edges_and_nodes(cut)
    assert (nodes.count(), edges.count()) == (5, 4)


def test_ends_snap_in_order(spark, rows):
    nodes, edges = paths.edges_and_nodes(path_table(spark, [(0, 0), (10, 0)], [(12, 0), (20, 0)]), tolerance=3.0)
    assert nodes.count() == 3
    assert rows(edges, "edge_id", "u", "v", "length_m") == [("osm_000001", "n000001", "n000002", 10.0), ("osm_000002", "n000002", "n000003", 10.0)]


def test_snapping_follows_the_order_of_paths(spark):
    rng = np.random.default_rng(3)
    lines = [[tuple(rng.uniform(0, 40, 2)), tuple(rng.uniform(0, 40, 2))] for _ in range(30)]
    nodes: list[tuple] = []
    expected = []
    for pts in lines:
        for p in pts:
            key = tuple(round(v / 0.01) * 0.01 for v in p)
            near = [(math.dist(key, n), -k) for k, n in enumerate(nodes) if math.dist(key, n) <= 5.0]
            if near:
                expected.append(-min(near)[1])
            else:
                nodes.append(key)
                expected.append(len(nodes) - 1)
    got, edges = paths.edges_and_nodes(path_table(spark, *lines), tolerance=5.0)
    assert got.count() == len(nodes)
    pairs = sorted((a, b) for a, b in zip(expected[::2], expected[1::2], strict=True) if a != b)
    assert sorted((int(r.u[1:]) - 1, int(r.v[1:]) - 1) for r in edges.collect()) == pairs


def test_layer_keeps_lineage(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"OBJECTID": 57452, "TRAIL_NAME": "Summit Step", "TRAIL_TYPE": 1, "name": None}, "geometry": {"type": "LineString", "coordinates": [[103.8, 1.35], [103.801, 1.351]]}},
        {"type": "Feature", "properties": {"ALLOW_WALKING": "no"}, "geometry": {"type": "MultiLineString", "coordinates": [[[103.8, 1.35], [103.8, 1.36]], [[103.8, 1.35], [103.8, 1.35]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(f))
    layer = read_geojson(spark, str(tmp_path / "l.geojson"))
    got = {r.source_row_index: r for r in paths.normalise_layer(layer, "nparks_tracks", 1.0).collect()}
    assert set(got) == {"0", "1"}
    assert (got["0"].source_feature_id, got["0"].name, got["0"].trail_type) == ("57452", "Summit Step", "1")
    assert got["1"].source_feature_id == "1"
    assert paths.walking_only(layer).count() == 0


def test_triangles_have_empty_circles():
    xy = np.random.default_rng(1).uniform(0, 100, (200, 2))
    for t in elevation.Triangulation(xy).triangles():
        a, b, c = xy[t]
        m = np.array([b - a, c - a])
        centre = np.linalg.solve(2 * m, (m * m).sum(axis=1))
        assert (((xy - a - centre) ** 2).sum(axis=1) >= (centre @ centre) * (1 - 1e-7)).all()


def test_surface_over_a_plane_and_beyond(spark):
    g = pd.DataFrame([(x, y, 2 * x + y) for x in range(5) for y in range(5)], columns=["x", "y", "elevation_m"])
    at = lambda points, *xy: {(r.x, r.y): (r.z, r.stood_in) for r in surface.elevations(spark.createDataFrame([tuple(map(float, p)) for p in xy], "x double, y double"), *elevation.Surface.of(points).tables(spark)).collect()}
    found = at(g, (1.5, 2.25), (9, 4), (1.5, 2.25))
    assert found[1.5, 2.25] == (pytest.approx(5.25), False) and found[9.0, 4.0] == (12.0, True)
    assert at(g[g.y == 0], (1.2, 0)) == {(1.2, 0.0): (2.0, True)}
    with pytest.raises(ValueError):
        elevation.Surface.of(g[:0])


@pytest.mark.parametrize("kind", ["cloud", "clusters", "line", "one"])
def test_the_nearest_sample_is_that_of_all(spark, monkeypatch, kind):
    monkeypatch.setattr(surface, "LEAF", 4)
    rng = np.random.default_rng(5)
    s = {"cloud": rng.uniform(0, 100, (300, 2)), "clusters": np.concatenate([rng.normal(c, 0.01, (100, 2)) for c in (0, 50, 1000)]), "line": np.array([(k % 40, 0.0) for k in range(90)]), "one": np.array([(3.0, 4.0)])}[kind]
    p = np.unique(np.concatenate([rng.uniform(-200, 300, (150, 2)), s[:20] + 0.5, np.floor(s[:9])]), axis=0)
    samples_of = spark.createDataFrame([(k, float(x), float(y), float(k)) for k, (x, y) in enumerate(s)], "sample long, x double, y double, z double")
    got = {(r.x, r.y): r.sample for r in surface.nearest(spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double"), samples_of, Scratch(spark, "n")).collect()}
    gaps = ((p[:, None, :] - s[None]) ** 2).sum(axis=2)
    assert got == {tuple(v): int(np.argmin(row)) for v, row in zip(map(tuple, p), gaps, strict=True)}


def test_profiles_between_two_contours(spark):
    contours = spark.createDataFrame([(0, 0, 0.0, [(0.0, 0.0), (100.0, 0.0)]), (1, 0, 100.0, [(0.0, 100.0), (100.0, 100.0)])], f"feature_idx long, part int, elevation_m double, coords {LINE}")
    points = elevation.contour_points(contours, 50)
    assert points.count() == 6 and elevation.contour_points(contours, 50, 3).count() == 3
    edges = spark.createDataFrame([("e", [(10.0, 10.0), (10.0, 90.0)])], f"edge_id string, coords {LINE}")
    e = elevation.enrich_edges(edges, *elevation.Surface.of(points.toPandas()).tables(spark)).first()
    assert len(e.profile_distance_m) >= 9 and e.profile_elevation_smooth_m == sorted(e.profile_elevation_smooth_m)
    assert e.ascent_fwd_m == pytest.approx(e.descent_rev_m) and e.elevation_fallback_count == 0


def test_smoothing(spark):
    v, d = [0.0, 10.0, 5.0, 25.0, 20.0], [0.0, 10.0, 20.0, 30.0, 40.0]
    expected = [5, 5, 40 / 3, 50 / 3, 22.5]
    df = spark.createDataFrame([("a", i, d[i], v[i]) for i in range(5)], "k string, i int, d double, v double")
    assert [r.s for r in series.smooth(df, ["k"], "i", "d", "v", 30, "s").orderBy("i").collect()] == pytest.approx(expected)


def test_what_is_no_number_is_not_steep(spark):
    df = spark.createDataFrame([("a", i, float(i), g) for i, g in enumerate([0.0, 15.0, -13.0, float("nan"), 12.0])], "k string, i int, d double, g double")
    got = sorted(tuple(r)[1:4] for r in series.steep_sections(df, ["k"], "i", "d", "g", 12).collect())
    assert got == [(1.0, 2.0, 15.0), (4.0, 4.0, 12.0)]


EDGES = f"edge_id string, u string, v string, length_m double, ascent_fwd_m double, descent_fwd_m double, ascent_rev_m double, descent_rev_m double, source_primary string, source_confidence double, source_feature_id string, source_row_index string, source_raw_properties_json string, highway string, name string, trail_type string, coords {LINE}"


@pytest.fixture
def walk(spark):
    e = spark.createDataFrame([("ab", "a", "b", 100.0, 20.0, 0.0, 0.0, 20.0, "fixture", 1.0, "7", "0", "{}", "steps", "Summit Path", None, [(22000.0, 37000.0), (22100.0, 37000.0)])], EDGES)
    d = graph.directed_edges(e)
    r = spark.createDataFrame([("loop_00500m_001", 0.5, "loop", 1, 100.0, 20.0, 0.0, 200.0, 1.0, ["ab:fwd"], ["ab"], ["a", "b"], [])], files.ROUTE_DDL)
    return r, d


def test_samples_of_one_edge(spark, walk):
    r, d = walk
    s = samples.route_samples(r, d, 25).orderBy("sample_index").collect()
    assert [x.cum_distance_m for x in s] == [0, 25, 50, 75, 100]
    assert [x.elevation_smooth_m for x in s] == pytest.approx([0, 5, 10, 15, 20])
    steep = samples.steep(samples.route_samples(r, d, 10)).collect()
    assert len(steep) == 1 and steep[0].max_abs_grade_pct == pytest.approx(20)


def test_unknown_edges_are_errors(spark, walk):
    r, d = walk
    with pytest.raises(Exception, match="unknown edge"):
        samples.route_samples(r.withColumn("directed_edge_ids", F.array(F.lit("zz:fwd"))), d).collect()


def test_attribution_and_names(spark, walk):
    r, d = walk
    s = samples.route_samples(r, d, 10)
    a = attribution.source_records(attribution.path_sources(s)).first()
    assert (a.label, a.share_pct, a.confidence) == ("Fixture", 100.0, 1.0)
    used = attribution.used_records(s).first()
    assert (used.feature_id, used.distance_m, used.edge_ids, len(used.points)) == ("7", 100.0, ["ab"], 6)
    name = areas.display_names(r, s).first().display_name
    assert "Summit Path" in name and name.endswith("0.10 km, 20 m gain")


def test_source_records_in_full(spark):
    ddl = "route_id string, sample_index int, lon double, lat double, cum_distance_m double, elevation_smooth_m double, grade_smooth_pct double, edge_id string, source_primary string, source_feature_id string, source_row_index string, source_raw_properties_json string, path_name string, highway string, source_confidence double"
    rows = [
        ("r", 0, 103.123456789, 1.5, 0.0, 4.0, None, "e1", "osm", "w1", "12", '{"highway": "path", "n": 1}', "Ridge", "nan", 0.9),
        ("r", 1, 103.2, 1.6, 30.0, 5.0, 3.3, "e1", "osm", "w1", "13", "[1]", "Other", "path", 0.9),
        ("r", 2, 103.3, 1.7, 40.0, 6.0, 1.0, "e2", "old_map", None, None, "{broken", " ", "track", None),
        ("r", 3, 103.4, 1.8, 50.0, 7.0, 1.0, "e2", "old_map", None, None, None, None, "track", None),
    ]
    a, b = attribution.used_records(spark.createDataFrame(rows, ddl).repartition(3)).orderBy(F.desc("distance_m")).collect()
    assert (a.source_label, a.feature_id, a.distance_m, a.share_pct) == ("OpenStreetMap walkable paths", "w1", 40.0, 80.0)
    assert json.loads(a.source_properties) == {"highway": "path", "n": 1}
    assert json.loads(a.attributes) == {"source_primary": "osm", "source_feature_id": "w1", "source_row_index": "12", "path_name": "Ridge", "source_confidence": 0.9}
    assert json.loads(a.source_lookup) == {"raw_dataset_feature_id": "w1", "raw_row_index": "12", "id_note": attribution.ID_NOTE}
    assert a.points[0].asDict() == {"sample_index": 0, "lon": 103.1234568, "lat": 1.5, "cum_distance_m": 0.0, "elevation_smooth_m": 4.0, "grade_smooth_pct": None, "edge_id": "e1"}
    assert (b.source_label, b.feature_id, b.source_confidence) == ("Old Map", "e2", 0.5)
    assert json.loads(b.source_properties) == json.loads(b.attributes) == {"source_primary": "old_map", "highway": "track"}
    assert json.loads(b.source_lookup) == {"raw_dataset_feature_id": "e2", "id_note": attribution.ID_NOTE}
    assert attribution.elevation_source(spark).first().label == "SLA National Map Line"


def test_area_shares(spark):
    bukit, dairy, out = (1.354, 103.777), (1.38, 103.777), (0.0, 0.0)
    data = [("one", k, *bukit) for k in range(2)] + [("two", k, *(bukit if k < 6 else dairy)) for k in range(8)] + [("most", k, *(dairy if k == 9 else bukit)) for k in range(10)] + [("none", 0, *out)]
    got = {r.route_id: r.area for r in areas.area_names(spark.createDataFrame(data, "route_id string, sample_index int, lat double, lon double")).collect()}
    assert got == {"one": "Bukit Timah Nature Reserve", "two": "Bukit Timah Nature Reserve to Dairy Farm Nature Park", "most": "Bukit Timah Nature Reserve"}


def test_files_pages_and_checks(spark, walk, tmp_path):
    r, d = walk
    s, lines = samples.route_samples(r, d), samples.route_lines(r, d)
    out = tmp_path / "routes"
    out.mkdir()
    (out / "old.gpx").write_text("stale")
    files.write_routes(r, s, lines, out)
    files.write_routes_json(r, out / "routes.json")
    assert not (out / "old.gpx").exists() and (out / "loop_00500m_001.gpx").exists()
    back = files.read_routes_json(spark, str(out / "routes.json"))
    assert back.first().undirected_edge_ids == ["ab"]
    pages.render(back, s, lines, tmp_path / "viz")
    page = (tmp_path / "viz" / "routes" / "loop_00500m_001.html").read_text()
    assert "Fixture" in page and "NaN" not in page and "Elevation: " in page
    assert 'id="map"' in page and 'class="elevation"' in page and "Start" in page and "End" in page and 'class="steps"' in page and 'class="steep"' in page
    assert 'data-route="loop_00500m_001"' in (tmp_path / "viz" / "index.html").read_text()
    json.loads((tmp_path / "viz" / "assets" / "routes.geojson").read_text())
    checks = qa.diagnostics(back, d, lines, s, tmp_path).collect()
    assert [c.name for c in checks][0] == "no repeated undirected edges" and len(checks) == 7
    assert [c.ok for c in checks][:3] == [True, True, True] and checks[6].ok
    assert checks[3].ok and (out / "loop_00500m_001_profile.png").read_bytes().startswith(b"\x89PNG")
    assert not list(tmp_path.rglob("_pending*"))


def test_no_routes_still_give_a_table(spark, walk, tmp_path):
    r, d = walk
    none = r.limit(0)
    files.write_routes(none, samples.route_samples(none, d), samples.route_lines(none, d), tmp_path)
    assert (tmp_path / "routes.csv").read_text().startswith("route_id,")


def test_settings_merge(tmp_path):
    (tmp_path / "c.yaml").write_text("routing:\n  beam_width: 5\n  max_start_nodes:\nmodes: [loop]\n")
    s = config.load(tmp_path / "c.yaml")
    assert (s.get("routing.beam_width"), s.get("routing.min_ascent_m"), s.get("modes"), s.get("no.such", 3)) == (5, 30, ["loop"], 3)
    assert s.get("routing.max_start_nodes", 2000) is None and s.data_dir == tmp_path / "data"
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")


def test_downloads_wait_cache_and_hide_addresses(tmp_path):
    import io
    import urllib.error

    (tmp_path / "c.yaml").write_text("sources:\n  data_gov:\n    nparks_tracks: d1\n    central_nature_reserve: d2\n    park_connector_loop: d3\n    national_map_line: d4\n")
    s = config.load(tmp_path / "c.yaml")
    s.make_folders()
    (s.data_dir / "raw" / "data_gov" / "nparks_tracks.geojson").write_text("{}")
    asked, slept = [], []

    def opener(url, timeout):
        asked.append(url)
        if "poll" in url:
            if len(asked) == 1:
                raise urllib.error.HTTPError(url, 429, "slow down", {"Retry-After": "2"}, None)
            return io.BytesIO(json.dumps({"data": {"url": "https://x.test/f.geojson?signed=secret"}}).encode())
        return io.BytesIO(b"{}")

    assert fetch.poll_url("d2", opener=opener, sleep=slept.append).endswith("secret") and slept == [2.0]
    got = fetch.fetch_layers(s, opener)
    assert [r["name"] for r in got] == list(s.get("sources.data_gov"))
    assert not any("d1" in u for u in asked)
    side = (s.data_dir / "raw" / "data_gov" / "national_map_line.json").read_text()
    assert "secret" not in side and json.loads(side)["path"] == "data/raw/data_gov/national_map_line.geojson"
    busy = lambda asked: fetch.Reply("busy", asked_pause=asked)
    assert (fetch.pause(busy(None), 3), fetch.pause(busy("x"), 9), fetch.pause(busy("-1"), 0), fetch.pause(fetch.Reply("pending"), 9)) == (8.0, 60.0, 0.0, 10.0)


def test_lines_of_features_are_numbered_on_along_the_files(spark, tmp_path):
    import json

    from ridgeweave.sources.geojson import in_box, read_geojson_lines

    for k in range(3):
        lines = [json.dumps({"type": "Feature", "id": f"{k}-{i}", "properties": {"at": str(5 * k + i)}, "geometry": {"type": "LineString", "coordinates": [[103.0 + k, 1.0], [103.1 + k, 1.1]]}}) for i in range(5)]
        (tmp_path / f"part-{k}.geojsonl").write_text("\n".join(lines))
    layer = read_geojson_lines(spark, str(tmp_path))
    rows = {r.feature_idx: r.properties["at"] for r in layer.collect()}
    assert rows == {k: str(k) for k in range(15)}
    assert {r.feature_idx for r in in_box(layer, (103.9, 0.0, 104.5, 2.0)).collect()} == set(range(5, 10))


def test_first_of_a_list_and_lists_cut_to_eight(spark):
    from pyspark.sql import functions as F

    from ridgeweave.functions import clean as C

    df = spark.createDataFrame([(["footway", "path"],), ([],), (None,), (["nan"],), ([str(k) for k in range(12)],)], "x array<string>")
    got = [tuple(r) for r in df.select(C.first_value(F.col("x")), C.list_text(F.col("x"))).collect()]
    assert got == [("footway", "[footway, path]"), (None, "[]"), (None, None), (None, "[]"), ("0", "[0, 1, 2, 3, 4, 5, 6, 7]")]
