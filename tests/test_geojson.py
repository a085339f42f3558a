"""One collection cut at every kind of byte."""

import json
import random

import pytest

from ridgeweave.sources import geojson


def collection(r, n, first):
    words = ['plain', 'with "quotes"', 'back\\slash\\', '{"type":"Feature"}', "]}],[{", "é ß", "\\", '\\"', "a\\\\"]
    out = []
    for k in range(n):
        f = {"type": "Feature", "properties": {"name": r.choice(words), "deep": [{"a": [1, {"b": r.choice(words)}]}], "n": k}, "geometry": {"type": "LineString", "coordinates": [[k, 1], [k + 0.5, 2]]}}
        items = list(f.items())
        r.shuffle(items)
        out.append(dict(items))
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "{x"}}, "extra": [{"type": "Other"}]}
    return {**head, "features": out} if first else {"features": out, **head}


def read(df):
    return [(x.feature_idx, dict(x.properties), x.geom_type, [[(p.x, p.y) for p in line] for line in x.lines]) for x in df.orderBy("feature_idx").collect()]


@pytest.mark.parametrize("seed,chunk,indent", [(1, 97, None), (2, 256, 2), (3, 1 << 20, None)])
def test_parts_of_any_size_give_the_same_features(spark, tmp_path, seed, chunk, indent):
    r = random.Random(seed)
    whole = collection(r, 25, seed % 2 == 0)
    path = tmp_path / "c.geojson"
    path.write_text(json.dumps(whole, indent=indent, ensure_ascii=False))
    out = read(geojson.read_geojson(spark, str(path), chunk))
    assert [(k, p["name"], kind, lines) for k, p, kind, lines in out] == [(k, f["properties"]["name"], "LineString", [[tuple(map(float, v)) for v in f["geometry"]["coordinates"]]]) for k, f in enumerate(whole["features"])]


def test_every_cut_of_a_small_collection():
    """States and depths at each byte, whatever part it begins."""
    data = json.dumps({"features": [{"a": 'x"\\', "b": ["\\\\", {}]}, {"c": "]\\\\\\\""}]}).encode()
    for cut in range(len(data) + 1):
        _, d1, state = geojson.brackets(data[:cut], geojson.OUTSIDE)
        _, d2, end = geojson.brackets(data[cut:], state)
        assert (int(d1[-1]) if len(d1) else 0) + (int(d2[-1]) if len(d2) else 0) == 0 and end == geojson.OUTSIDE


def test_empty_files_and_collections(spark, tmp_path):
    (tmp_path / "a.geojson").write_text("")
    (tmp_path / "b.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    for name in "ab":
        assert geojson.read_geojson(spark, str(tmp_path / f"{name}.geojson")).count() == 0
