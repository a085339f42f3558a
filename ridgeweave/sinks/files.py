"""Route files: tables through Spark's writers, and one file of each kind for every route."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeweave.operators.samples import features, in_degrees
from ridgeweave.sinks.png import profile
from ridgeweave.sinks.writer import write_files, write_joined

STALE = ("*.geojson", "*_edges.json", "*.gpx", "*_profile.png", "*_profile.svg", "*_samples.parquet", "routes.csv", "routes.json")
COLLECTION = '{"type":"FeatureCollection","features":['
ROUTE_DDL = (
    "route_id string, budget_km double, mode string, rank int, distance_m double, ascent_m double, descent_m double, gain_density_m_per_km double, source_confidence double,"
    " directed_edge_ids array<string>, undirected_edge_ids array<string>, node_ids array<string>, warnings array<string>"
)
ROUTE_FIELDS = [x.split()[0] for x in ROUTE_DDL.split(", ")]
LISTS = ("directed_edge_ids", "undirected_edge_ids", "node_ids", "warnings")


def plain(value: Any) -> Any:
    """Ready for strict JSON: rows become mappings; what isn't a finite number becomes null."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def dump(value: Any) -> str:
    return json.dumps(plain(value), indent=2, allow_nan=False)


def remove_stale(folder: Path, patterns: tuple[str, ...] = STALE) -> None:
    for pattern in patterns:
        for p in folder.glob(pattern):
            if p.is_file():
                p.unlink()


def gpx(route_id: str, points: list) -> str:
    body = "".join(f'<trkpt lat="{p["lat"]!r}" lon="{p["lon"]!r}"><ele>{p["elevation_smooth_m"]!r}</ele></trkpt>' for p in points)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="ridgeweave"><trk><name>{escape(route_id)}</name><trkseg>{body}</trkseg></trk></gpx>'


def files_of(row: dict) -> Iterator[tuple[str, bytes]]:
    """(name, content) of a route's files: line, edges, track, picture and samples."""
    key, points = row["route_id"], row["points"] or []
    scalars = {k: row[k] for k in ROUTE_FIELDS if k not in LISTS}
    line = {"type": "LineString", "coordinates": row["line"]}
    yield f"{key}.geojson", dump({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": scalars, "geometry": line}]}).encode()
    yield f"{key}_edges.json", dump({k: row[k] for k in ("route_id", *LISTS[:3])}).encode()
    yield f"{key}.gpx", gpx(key, points).encode()
    yield f"{key}_profile.png", profile(key, [p["cum_distance_km"] for p in points], [p["elevation_smooth_m"] for p in points])
    yield f"{key}_samples.parquet", samples_file(key, points)


def samples_file(route_id: str, points: list[dict]) -> bytes:
    out = io.BytesIO()
    parquet.write_table(pa.Table.from_pylist([{"route_id": route_id, **p} for p in points]), out)
    return out.getvalue()


def each_file(rows: DataFrame, files: Callable[[dict], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """(name, data) of the files of every row, one row's at a time."""
    schema = pa.schema([("name", pa.string()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (row,) = batch.slice(k, 1).to_pylist()
                names, data = zip(*files(row), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "name string, data binary")


def points_of(samples: DataFrame) -> DataFrame:
    """(route_id, points): the samples of each route in order."""
    rest = [c for c in samples.columns if c not in ("route_id", "sample_index")]
    return samples.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("sample_index", *rest))).alias("points"))


def write_routes(routes: DataFrame, samples: DataFrame, lines: DataFrame, folder: str | Path) -> int:
    """The files of every route, written by tasks, and the table of all; how many routes there are.

    A route's files are one task's work and appear together when the job
    commits; files of earlier runs go in the same commit.
    """
    whole = routes.select(*ROUTE_FIELDS).join(lines.select("route_id", in_degrees(F.col("coords")).alias("line")), "route_id").join(points_of(samples), "route_id", "left")
    write_files(each_file(whole, files_of), folder, STALE)
    write_joined(lines_of(routes, csv_line), Path(folder) / "routes.csv", csv_line(dict(zip(ROUTE_FIELDS, ROUTE_FIELDS, strict=True))) + "\n")
    return routes.count()


def csv_line(row: dict) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([json.dumps(v) if isinstance(v := row[k], list) else v for k in ROUTE_FIELDS])
    return out.getvalue()


def lines_of(routes: DataFrame, line: Callable[[dict], str]) -> DataFrame:
    """(value): a line of text for each route, in the rows' order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line(r) for r in batch.to_pylist()], pa.string())], names=["value"])

    return routes.select(*ROUTE_FIELDS).mapInArrow(run, "value string")


def write_routes_json(routes: DataFrame, path: str | Path) -> None:
    """All routes as one JSON list, joined from what tasks wrote."""
    write_joined(lines_of(routes, dump), path, "[", ",\n", "]\n")


def read_routes_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTE_DDL).option("multiLine", True).json(path)


def write_collection(routes: DataFrame, lines: DataFrame, path: str | Path) -> None:
    """All routes as one GeoJSON collection, its features in the order of their identifiers."""
    write_joined(features(routes, lines).orderBy("route_id").select(F.col("feature").alias("value")), path, COLLECTION, ",\n", "]}\n")


def write_layer(layer: DataFrame, path: str | Path) -> None:
    """Lines in grid metres as one GeoJSON collection in degrees; all other columns are properties.

    Features keep the order of ``path_ordinal`` where the layer has it.
    """
    properties = F.struct(*[c for c in layer.columns if c != "coords"])
    geometry = F.struct(F.lit("LineString").alias("type"), in_degrees(F.col("coords")).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})
    rows = layer.orderBy("path_ordinal") if "path_ordinal" in layer.columns else layer
    write_joined(rows.select(feature.alias("value")), path, COLLECTION, ",\n", "]}\n")
