"""All stages over a small made-up park, from layers to pages."""

import json

import pytest

from ridgeweave import cli


def feature(points, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": "LineString", "coordinates": points}}


@pytest.fixture
def project(tmp_path):
    raw = tmp_path / "data" / "raw" / "data_gov"
    raw.mkdir(parents=True)
    at = lambda i, j: [103.80 + 0.001 * i, 1.35 + 0.001 * j]
    trails = [feature([at(i, j), at(i, j + 1)], OBJECTID=10 * i + j, TRAIL_NAME=f"Trail {i}", ALLOW_WALKING="yes") for i in range(3) for j in range(3)]
    trails += [feature([at(i, j), at(i + 1, j)], OBJECTID=100 + 10 * i + j, TRAIL_NAME="Summit Path", ALLOW_WALKING="yes") for i in range(2) for j in range(4)]
    trails.append(feature([at(9, 9), at(10, 9)], OBJECTID=999, ALLOW_WALKING="no"))
    contours = [feature([at(-1, j), at(4, j)], NAME=f"{10 + 15 * j} m", FOLDERPATH="Layers/Contour_250K") for j in range(-1, 5)] + [feature([at(0, 0), at(1, 1)], NAME="999", FOLDERPATH="Layers/Roads")]
    for name, features in (("nparks_tracks", trails), ("national_map_line", contours)):
        (raw / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "settings.yaml").write_text("budgets_km: [0.5]\nrouting:\n  beam_width: 30\n  min_ascent_m: 5\nsources:\n  osm:\n    enabled: false\n")
    return tmp_path


def test_from_layers_to_pages(spark, project, capsys):
    run = cli.Run(str(project / "settings.yaml"))
    assert [run.inspect(), run.build_paths(), run.build_elevation(), run.build_graph(), run.search(), run.visualize()] == [0] * 6
    said = capsys.readouterr().out
    assert "Layers/Contour_250K" in said and "12 nodes, 17 edges" in said and "34 directed edges" in said
    routes = json.loads((project / "outputs" / "routes" / "routes.json").read_text())
    assert routes and all(r["distance_m"] <= 500 and r["ascent_m"] >= 5 for r in routes)
    assert any("Summit Path" in r["display_name"] for r in json.loads((project / "outputs" / "viz" / "assets" / "route_summary.json").read_text()))
    run.qa()
    said = capsys.readouterr().out
    failed = [x for x in said.splitlines() if x.startswith("FAILED")]
    assert len(said.splitlines()) == 7 and not failed


def test_unknown_settings_file():
    with pytest.raises(SystemExit):
        cli.main(["qa", "--config", "/no/such/file.yaml"])
