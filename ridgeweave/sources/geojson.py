"""GeoJSON layers as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeweave.functions.geometry import LINE
from ridgeweave.operators.paths import with_ordinals

GEOMETRY = "struct<type:string,coordinates:string>"
FEATURE = f"struct<id:string,properties:map<string,string>,geometry:{GEOMETRY}>"


BODIES = pa.schema([("n", pa.int32()), ("place", pa.int64()), ("body", pa.string())])


def features_of(rows: DataFrame, column: str = "feature") -> DataFrame:
    """feature_idx, properties, geom_type, lines and heights of features.

    Coordinates are read as text first, as lines and multi-lines nest
    differently. Geometries that aren't lines have none; a feature's own id
    stands in where its properties have no ``id``.
    """
    g = F.col(f"{column}.geometry")
    deep = F.when(g["type"] == "LineString", F.array(F.from_json(g["coordinates"], "array<array<double>>"))).when(g["type"] == "MultiLineString", F.from_json(g["coordinates"], "array<array<array<double>>>")).otherwise(F.array().cast("array<array<array<double>>>"))
    props = F.coalesce(F.col(f"{column}.properties"), F.create_map().cast("map<string,string>"))
    held = F.col(f"{column}.id").isNotNull() & ~F.map_contains_key(props, "id")
    props = F.when(held, F.map_concat(props, F.create_map(F.lit("id"), F.col(f"{column}.id")))).otherwise(props)
    lines = F.transform(F.col("deep"), lambda line: F.transform(line, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    heights = F.flatten(F.transform(F.col("deep"), lambda line: F.transform(line, lambda p: F.get(p, F.lit(2)))))
    return rows.withColumn("deep", deep).select("feature_idx", props.alias("properties"), g["type"].alias("geom_type"), lines.cast(f"array<{LINE}>").alias("lines"), heights.alias("heights"))


#: Bytes of a collection that one task looks for features in.
CHUNK = 1 << 26
QUOTE, BACKSLASH = 34, 92
#: States at a byte: outside of texts, inside of one, behind a backslash in one.
OUTSIDE, INSIDE, ESCAPED = range(3)


def brackets(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, depths after them, state at the end) of the brackets outside of texts; depth counts from 0."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, int), np.empty(0, int), state
    slash = b == BACKSLASH
    escaped = np.zeros(len(b) + 1, bool)
    escaped[0] = state == ESCAPED
    if slash.any() or escaped[0]:
        last = -1
        for k in [*([-1] if escaped[0] else []), *np.flatnonzero(slash).tolist()]:
            if k == -1 or k != last:
                escaped[k + 1] = True
                last = k + 1
    quote = (b == QUOTE) & ~escaped[:-1]
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    kind = np.zeros(256, np.int8)
    kind[[123, 91]], kind[[125, 93]] = 1, -1
    step = kind[b] * ~inside
    places = np.flatnonzero(step)
    end = OUTSIDE if not inside[-1] else ESCAPED if escaped[-1] else INSIDE
    return places, np.cumsum(step[places], dtype=np.int64), end


def opened(path: str):
    """A file for random access, by any path that Arrow can open."""
    from pyarrow import fs

    place, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return place.open_input_file(name)


def features_from(path: str, at: int, size: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects that open at depth 2 within ``size`` bytes from ``at``, read to their own ends."""
    with opened(path) as f:
        f.seek(at)
        held, start, done = b"", None, 0
        while True:
            data = f.read(max(0, min(CHUNK, size - done)) or (1 << 20 if start is not None else 0))
            if not data:
                return
            places, depths, state = brackets(data, state)
            depths = depths + depth
            begin = 0
            for k in np.flatnonzero((depths == 3) | (depths == 2)).tolist():
                p = int(places[k])
                if depths[k] == 3 and data[p] == 123 and start is None and (k == 0 and depth == 2 or k and depths[k - 1] == 2):
                    if done + p >= size:
                        return
                    start, begin, held = at + done + p, p, b""
                elif depths[k] == 2 and data[p] == 125 and start is not None:
                    yield start, held + data[begin : p + 1]
                    start, held = None, b""
            if start is not None:
                held += data[begin:]
            depth = int(depths[-1]) if len(depths) else depth
            done += len(data)


def read_geojson(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """A feature collection, read by many tasks.

    Whether a byte lies within a text, and how deep in brackets, depends on
    all bytes before it. So each task first tells, for every state that its
    part may begin in, the state and depth at its end; these few numbers are
    chained, and each task then knows where it stands and reads the features
    that begin in its part. ``path`` is a file, or several split by commas.
    """
    chunk = chunk or CHUNK
    parts = []
    for n, one in enumerate(path.split(",")):
        with opened(one) as f:
            size = f.size()
        parts += [(n, one, at, min(chunk, size - at)) for at in range(0, size, chunk)]
    if not parts:
        return features_of(spark.createDataFrame([], f"feature_idx long, feature {FEATURE}"))
    table = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartitionByRange(len(rows), "n", "at")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    f.seek(r["at"])
                    data = f.read(r["size"])
                for state in (OUTSIDE, INSIDE, ESCAPED):
                    _, depths, end = brackets(data, state)
                    rows.append({"n": r["n"], "at": r["at"], "state": state, "then": end, "depth": int(depths[-1]) if len(depths) else 0})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("n", pa.int32()), ("at", pa.int64()), ("state", pa.int32()), ("then", pa.int32()), ("depth", pa.int64())]))

    ddl = "n int, path string, at long, size long"
    told = {(r.n, r.at, r.state): (r.then, r.depth) for r in table(parts, ddl).mapInArrow(ends, "n int, at long, state int, then int, depth long").collect()}
    placed, state, depth = [], OUTSIDE, 0
    for n, one, at, size in parts:
        state, depth = (OUTSIDE, 0) if at == 0 else (state, depth)
        placed.append((n, one, at, size, state, depth))
        state, more = told[n, at, state]
        depth += more

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held = []
                for place, body in features_from(r["path"], r["at"], r["size"], r["state"], r["depth"]):
                    held.append({"n": r["n"], "place": place, "body": body.decode("utf-8", "replace")})
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, BODIES)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, BODIES)

    bodies = table(placed, ddl + ", state int, depth long").mapInArrow(read, "n int, place long, body string")
    feature = F.from_json("body", f"struct<type:string,id:string,properties:map<string,string>,geometry:{GEOMETRY}>")
    found = bodies.withColumn("feature", feature).filter("feature.type = 'Feature'").select("n", "place", "feature")
    return features_of(with_ordinals(found, ["n", "place"]).select(F.col("path_ordinal").alias("feature_idx"), "feature"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features one to a line, which Spark splits; the index counts on from 0 along the files."""
    raw = spark.read.schema("id string, properties map<string,string>, geometry " + GEOMETRY).json(path)
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.struct("id", "properties", "geometry").alias("feature"))
    numbered = with_ordinals(placed, ["file", "block", "place"])
    return features_of(numbered.select(F.col("path_ordinal").alias("feature_idx"), "feature"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """A layer by its suffix: Parquet tables of features as written by this library, ways of three kinds, else GeoJSON."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".gpkg", ".shp", ".pbf")):
        from ridgeweave.sources.ways import read_ways

        return read_ways(spark, path)
    return read_geojson_lines(spark, path) if path.endswith((".geojsonl", ".ndjson")) else read_geojson(spark, path)


def in_box(layer: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Features of which some vertex's bounds meet (west, south, east, north)."""
    west, south, east, north = box
    flat = F.flatten("lines")
    x, y = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return layer.filter((F.array_max(x) >= west) & (F.array_min(x) <= east) & (F.array_max(y) >= south) & (F.array_min(y) <= north))
