"""Files by tasks: all or none, in order; pictures and drawings."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeweave.operators import paths, samples
from ridgeweave.sinks import drawing, files, png, writer
from ridgeweave.sources import geojson


def test_files_appear_together_and_old_ones_go(spark, tmp_path):
    (tmp_path / "old.gpx").write_text("stale")
    (tmp_path / "other.txt").write_text("stays")
    df = spark.range(20).repartition(4).select(F.concat(F.lit("sub/r"), F.col("id").cast("string"), F.lit(".gpx")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))
    writer.write_files(df, tmp_path, ("*.gpx",))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["other.txt", "sub"]
    assert {p.name: p.read_text() for p in (tmp_path / "sub").iterdir()} == {f"r{k}.gpx": str(k) for k in range(20)}


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "old.gpx").write_text("old")
    bad = F.when(F.col("id") == 13, F.raise_error("broken")).otherwise(F.lit("x"))
    df = spark.range(20).repartition(4).select(F.concat(F.col("id").cast("string"), F.lit(".gpx")).alias("name"), F.encode(bad.cast("string"), "UTF-8").alias("data"))
    with pytest.raises(Exception, match="broken"):
        writer.write_files(df, tmp_path, ("*.gpx",))
    assert [p.name for p in tmp_path.iterdir()] == ["old.gpx"]
    with pytest.raises(Exception, match="broken"):
        writer.write_joined(df.select(F.decode("data", "UTF-8").alias("value")), tmp_path / "old.gpx")
    assert (tmp_path / "old.gpx").read_text() == "old"


@pytest.mark.parametrize("n", [0, 1, 500])
def test_joined_texts_keep_the_order(spark, tmp_path, n):
    df = spark.range(n).repartition(5).orderBy(F.desc("id")).select(F.col("id").cast("string").alias("value"))
    writer.write_joined(df, tmp_path / "a" / "all.json", "[", ",", "]")
    assert (tmp_path / "a" / "all.json").read_text() == f"[{','.join(map(str, reversed(range(n))))}]"


def test_layers_come_back_from_their_collection(spark, tmp_path):
    rows = [(k, f"n{k}", None if k % 2 else 1.5, [(28000.0 + k, 38700.0), (28010.0, 38710.0 + k)]) for k in range(40)]
    layer = spark.createDataFrame(rows, "path_ordinal long, name string, rank double, coords array<struct<x:double,y:double>>").repartition(4)
    files.write_layer(layer, tmp_path / "l.geojson")
    back = geojson.read_geojson(spark, str(tmp_path / "l.geojson"), 300)
    out = back.select("feature_idx", F.col("properties")["name"].alias("name"), F.transform(paths.projected(F.col("lines")[0]), lambda p: F.array(F.round(p["x"], 3), F.round(p["y"], 3))).alias("l")).orderBy("feature_idx").collect()
    assert [(r.feature_idx, r.name, [tuple(p) for p in r.l]) for r in out] == [(k, n, line) for k, n, _, line in rows]


def pixels(data):
    """The rows of a PNG without filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, held = 8, {}
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(kind + body)
        held[kind] = body
        at += 12 + n
    w, h = struct.unpack_from(">2I", held[b"IHDR"])
    return np.frombuffer(zlib.decompress(held[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_the_picture_follows_the_profile():
    p = pixels(png.profile("route 1", [0, 1, 2], [10, 30, 20]))
    line = (p == np.array(png.LINE)).all(axis=2)
    tops = [int(np.flatnonzero(line[:, x])[0]) for x in (75, 580, 1090)]
    assert tops[1] < tops[2] < tops[0]
    assert pixels(png.profile("none", [], [])).shape == pixels(png.profile("é", [0.0], [float("nan")])).shape


def test_maps_hold_every_kind_of_marker(spark):
    rows = [("r", k, 103.8 + k / 1e4, 1.35, 5.0 * k, "steps" if k == 7 else "path", "Stair" if k == 7 else None, 20.0 if k == 9 else 0.0) for k in range(260)]
    s = spark.createDataFrame(rows, "route_id string, sample_index int, lon double, lat double, cum_distance_m double, highway string, path_name string, grade_smooth_pct double")
    found = [r.asDict() for r in samples.markers(s).orderBy("sample_index").collect()]
    assert {m["kind"] for m in found} == set(drawing.MARKERS)
    svg = drawing.route_map([(r[2], r[3]) for r in rows], found, "<name>")
    assert all(f'class="{k}"' in svg for k in (*drawing.MARKERS, "start", "end")) and "Steps: Stair" in svg and "1.0 km" in svg and "<name>" not in svg
    assert 'class="grade"' in drawing.profile_chart([0.0, 1.0], [3.0, None], [None, 4.0]) and "svg" in drawing.profile_chart([], [], [])


def test_lines_lose_near_points(spark):
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 1, 4, 5, 9, 10)])
    (out,) = spark.range(1).select(samples.simplified(line, 4.0)).first()
    assert [p.x for p in out] == [0, 4, 9, 10]
