"""Ways from GeoPackage, Shapefile and OSM's PBF files as Spark data sources.

Each format is read by many tasks: a GeoPackage and a Shapefile by ranges of
rows, a PBF file by runs of blocks. The columns that are asked for, and a box
of degrees, reach the reader as options: other columns are never decoded, and
lines beyond the box are left at their bounds. PBF keeps ways and the places of
their nodes apart; they meet in a join.

Paths must be open to every executor. Defined results: rows count from 0 in the
file's order, whatever is filtered; features without a line have no lines; a
null or missing value has no property; a way keeps the nodes that the file has
and goes if these are fewer than two; an empty layer gives no rows.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ridgeweave.functions.geometry import LINE

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
FEATURES = pa.schema([("feature_idx", pa.int64()), ("properties", pa.map_(pa.string(), pa.string())), ("geom_type", pa.string()), ("lines", pa.list_(pa.list_(POINT))), ("heights", pa.list_(pa.float64()))])
FEATURES_SQL = f"feature_idx long, properties map<string,string>, geom_type string, lines array<{LINE}>, heights array<double>"
BATCH = 2000

Box = tuple[float, float, float, float]


@dataclass
class Rows(InputPartition):
    """Rows from ``low`` to before ``high``; ``first`` is the place of the first one in the file."""

    low: int
    high: int
    first: int


def text(value) -> str | None:
    """A value as the library's properties have it: whole numbers without a fraction."""
    if value is None or value == "":
        return None
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def meets(bounds, box: Box | None) -> bool:
    """Whether (least x, least y, greatest x, greatest y) meets the box."""
    return box is None or (bounds[0] <= box[2] and bounds[2] >= box[0] and bounds[1] <= box[3] and bounds[3] >= box[1])


def shape(parts: list[np.ndarray]) -> tuple[str | None, list, list]:
    """Type, lines and heights of arrays of (x, y) or (x, y, z)."""
    lines = [[{"x": p[0], "y": p[1]} for p in part.tolist()] for part in parts]
    heights = [p[2] if len(p) > 2 else None for part in parts for p in part.tolist()]
    return ("LineString" if len(parts) == 1 else "MultiLineString") if parts else None, lines, heights


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Features of (index, properties, parts) as batches of a bounded number."""
    held: list[dict] = []
    for index, properties, parts in rows:
        kind, lines, heights = shape(parts)
        held.append({"feature_idx": index, "properties": [(k, v) for k, v in properties.items() if v is not None], "geom_type": kind, "lines": lines, "heights": heights})
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_pylist(held, FEATURES)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, FEATURES)


class LayerReader(DataSourceReader):
    """Options: path, layer, columns (a list with commas), box (west, south, east, north), rows (in a partition)."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.layer = options.get("layer")
        self.columns = options["columns"].split(",") if options.get("columns") else None
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None
        self.rows = int(options.get("rows") or 100_000)

    def wanted(self, names: list[str]) -> list[str]:
        return names if self.columns is None else [n for n in names if n in self.columns]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return batches(self.features(partition))


# -- GeoPackage -------------------------------------------------------------------


def wkb_lines(data: bytes) -> list[np.ndarray]:
    """Lines of a well-known binary line or multi-line; none for other kinds."""

    def one(at: int) -> tuple[list[np.ndarray], int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 9 if kind & 0x20000000 else 5
        z = kind & 0x80000000 or kind // 1000 % 10 in (1, 3)
        width = 2 + bool(z) + bool(kind & 0x40000000 or kind // 1000 % 10 in (2, 3))
        kind = (kind & 0x0FFFFFFF) % 1000
        if kind not in (2, 5):
            return [], at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == 2:
            points = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)
            return [points[:, : 3 if z else 2]], at + 8 * n * width
        parts: list[np.ndarray] = []
        for _ in range(n):
            found, at = one(at)
            parts += found
        return parts, at

    return one(0)[0]


def package_geometry(blob: bytes | None, box: Box | None) -> list[np.ndarray] | None:
    """Lines of a package's geometry; None where its bounds miss the box."""
    if not blob or blob[:2] != b"GP":
        return [] if box is None else None
    order, held = ("<" if blob[3] & 1 else ">"), (blob[3] >> 1) & 7
    size = (0, 32, 48, 48, 64)[held]
    if held and box is not None:
        west, east, south, north = struct.unpack_from(order + "4d", blob, 8)
        if not meets((west, south, east, north), box):
            return None
    parts = wkb_lines(blob[8 + size :])
    if box is not None and not held:
        every = np.concatenate([p[:, :2] for p in parts]) if parts else np.empty((0, 2))
        if not len(every) or not meets((*every.min(axis=0), *every.max(axis=0)), box):
            return None
    return parts


class PackageReader(LayerReader):
    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def table(self, c: sqlite3.Connection) -> tuple[str, str, str]:
        """(table, geometry column, key column) of the layer, by default ``lines`` or the first."""
        found = c.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
        names = [t for t, _ in found]
        name = self.layer or ("lines" if "lines" in names else names[0])
        key = next((r[1] for r in c.execute(f'PRAGMA table_info("{name}")') if r[5]), "rowid")
        return name, dict(found)[name], key

    def partitions(self) -> list[Rows]:
        with self.connect() as c:
            name, _, key = self.table(c)
            low, high = c.execute(f'SELECT min("{key}"), max("{key}") FROM "{name}"').fetchone()
            if low is None:
                return [Rows(0, 0, 0)]
            starts = range(low, high + 1, self.rows)
            sizes = [c.execute(f'SELECT count(*) FROM "{name}" WHERE "{key}" >= ? AND "{key}" < ?', (s, s + self.rows)).fetchone()[0] for s in starts]
        return [Rows(s, s + self.rows, sum(sizes[:k])) for k, s in enumerate(starts)]

    def features(self, p: Rows) -> Iterator[tuple]:
        with self.connect() as c:
            name, geometry, key = self.table(c)
            fields = self.wanted([r[1] for r in c.execute(f'PRAGMA table_info("{name}")') if r[1] not in (geometry, key)])
            asked = ", ".join(f'"{f}"' for f in (geometry, *fields))
            for k, (blob, *values) in enumerate(c.execute(f'SELECT {asked} FROM "{name}" WHERE "{key}" >= ? AND "{key}" < ? ORDER BY "{key}"', (p.low, p.high))):
                parts = package_geometry(blob, self.box)
                if parts is not None:
                    yield p.first + k, dict(zip(fields, map(text, values), strict=True)), parts


# -- Shapefile --------------------------------------------------------------------


class ShapefileReader(LayerReader):
    def beside(self, suffix: str) -> str:
        return os.path.splitext(self.path)[0] + suffix

    def partitions(self) -> list[Rows]:
        n = (os.path.getsize(self.beside(".shx")) - 100) // 8
        return [Rows(k, min(n, k + self.rows), k) for k in range(0, n, self.rows)] or [Rows(0, 0, 0)]

    def records(self, p: Rows) -> Iterator[dict[str, str | None] | None]:
        """Properties of the rows; None for a row that is marked as deleted."""
        encoding = open(self.beside(".cpg")).read().strip() if os.path.exists(self.beside(".cpg")) else "utf-8"
        with open(self.beside(".dbf"), "rb") as f:
            head = f.read(32)
            start, width = struct.unpack_from("<HH", head, 8)
            fields, at = [], 1
            for _ in range((start - 33) // 32):
                d = f.read(32)
                fields.append((d[:11].split(b"\0")[0].decode(encoding), at, d[16]))
                at += d[16]
            asked = set(self.wanted([n for n, _, _ in fields]))
            f.seek(start + p.low * width)
            for _ in range(p.low, p.high):
                row = f.read(width)
                yield None if row[:1] == b"*" else {n: row[a : a + w].decode(encoding, "replace").strip(" \0") or None for n, a, w in fields if n in asked}

    def features(self, p: Rows) -> Iterator[tuple]:
        if p.low == p.high:
            return
        with open(self.beside(".shx"), "rb") as f:
            f.seek(100 + 8 * p.low)
            index = np.frombuffer(f.read(8 * (p.high - p.low)), ">i4").reshape(-1, 2) * 2
        with open(self.path, "rb") as f:
            for k, (properties, (at, size)) in enumerate(zip(self.records(p), index.tolist(), strict=True)):
                if properties is None:
                    continue
                f.seek(at + 8)
                head = f.read(min(size, 44))
                (kind,) = struct.unpack_from("<i", head)
                if kind not in (3, 13, 23):
                    if self.box is None:
                        yield p.first + k, properties, []
                    continue
                if not meets(struct.unpack_from("<4d", head, 4), self.box):
                    continue
                parts, points = struct.unpack_from("<2i", head, 36)
                body = f.read(size - 44)
                cuts = np.frombuffer(body, "<i4", parts)[1:]
                xy = np.frombuffer(body, "<f8", 2 * points, 4 * parts).reshape(points, 2)
                if kind == 13:
                    xy = np.column_stack([xy, np.frombuffer(body, "<f8", points, 4 * parts + 16 * points + 16)])
                yield p.first + k, properties, np.split(xy, cuts)


# -- OSM's blocks -----------------------------------------------------------------


def varints(data: bytes) -> np.ndarray:
    """All numbers of a packed field."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    first = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def signed(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < n:
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def block_places(path: str) -> Iterator[tuple[int, int]]:
    """(start, size) of the blobs that hold data; only headers are read."""
    with open(path, "rb") as f:
        while len(head := f.read(4)) == 4:
            header = dict(fields(f.read(int.from_bytes(head, "big"))))
            if header[1] == b"OSMData":
                yield f.tell(), header[3]
            f.seek(header[3], 1)


def blob_data(blob: bytes) -> bytes:
    held = dict(fields(blob))
    if 1 in held:
        return held[1]
    if 3 in held:
        return zlib.decompress(held[3])
    raise ValueError("a block is compressed in a way other than zlib")


class BlocksReader(DataSourceReader):
    """Options: path, kind (nodes or ways), columns (tags to keep), having (a tag that ways must have), blocks (in a partition)."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.kind = options.get("kind", "ways")
        self.columns = set(options["columns"].split(",")) if options.get("columns") else None
        self.having = options.get("having")
        self.blocks = int(options.get("blocks") or 16)

    def partitions(self) -> list[InputPartition]:
        places = list(block_places(self.path))
        return [InputPartition(places[k : k + self.blocks]) for k in range(0, len(places), self.blocks)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            for at, size in partition.value:
                f.seek(at)
                yield from (self.nodes if self.kind == "nodes" else self.ways)(blob_data(f.read(size)))

    def nodes(self, block: bytes) -> Iterator[pa.RecordBatch]:
        held = list(fields(block))
        one = dict(held)
        grain, lat0, lon0 = one.get(17, 100), one.get(19, 0), one.get(20, 0)
        degrees = lambda v, start: 1e-9 * (signed64(start) + grain * v)
        for group in (v for n, v in held if n == 2):
            for n, v in fields(group):
                if n == 2:
                    dense = dict(fields(v))
                    ids, lat, lon = (np.cumsum(signed(varints(dense.get(k, b"")))) for k in (1, 8, 9))
                elif n == 1:
                    node = dict(fields(v))
                    ids, lat, lon = (signed(np.array([node.get(k, 0)], np.uint64)) for k in (1, 8, 9))
                else:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degrees(lon, lon0)), pa.array(degrees(lat, lat0))], names=["id", "x", "y"])

    def ways(self, block: bytes) -> Iterator[pa.RecordBatch]:
        held = list(fields(block))
        words = [v for n, v in fields(dict(held).get(1, b"")) if n == 1]
        rows = []
        for group in (v for n, v in held if n == 2):
            for way in (dict(fields(v)) for n, v in fields(group) if n == 3):
                keys, values = (varints(way.get(k, b"")).tolist() for k in (2, 3))
                tags = {words[k].decode(): words[v].decode() for k, v in zip(keys, values, strict=True)}
                if not tags or (self.having and self.having not in tags):
                    continue
                rows.append({"id": way[1], "tags": [(k, v) for k, v in tags.items() if self.columns is None or k in self.columns], "refs": np.cumsum(signed(varints(way.get(8, b"")))).tolist()})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64()))]))


def signed64(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


# -- the sources ------------------------------------------------------------------


class Packages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ways_gpkg"

    def schema(self) -> str:
        return FEATURES_SQL

    def reader(self, schema) -> DataSourceReader:
        return PackageReader(self.options)


class Shapefiles(Packages):
    @classmethod
    def name(cls) -> str:
        return "ways_shp"

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options)


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_blocks"

    def schema(self) -> str:
        return "id long, x double, y double" if self.options.get("kind") == "nodes" else "id long, tags map<string,string>, refs array<long>"

    def reader(self, schema) -> DataSourceReader:
        return BlocksReader(self.options)


def read_ways(spark: SparkSession, path: str, columns: list[str] | None = None, box: Box | None = None, **options: str | int) -> DataFrame:
    """A layer of lines by its file's suffix: .gpkg, .shp or .pbf."""
    given = {k: str(v) for k, v in options.items()} | ({"columns": ",".join(columns)} if columns else {})
    if path.endswith(".pbf"):
        return read_pbf(spark, path, box, given)
    source = Packages if path.endswith(".gpkg") else Shapefiles
    spark.dataSource.register(source)
    given |= {"box": ",".join(map(repr, box))} if box else {}
    return spark.read.format(source.name()).options(path=path, **given).load()


def read_pbf(spark: SparkSession, path: str, box: Box | None, options: dict[str, str]) -> DataFrame:
    """Ways with a highway and the places of their nodes; areas are no lines.

    A way's references are joined with the nodes by id. Every tag that is
    asked for is a property, those of access among them.
    """
    spark.dataSource.register(Blocks)
    read = lambda kind: spark.read.format(Blocks.name()).options(**{"having": "highway", **options, "path": path, "kind": kind}).load()
    ways = read("ways")
    area = (F.coalesce(F.col("tags")["area"], F.lit("")) == "yes") & (F.get("refs", F.lit(0)) == F.element_at("refs", -1))
    ways = ways.filter(~area & (F.size("refs") > 1))
    places = ways.select(F.col("id").alias("way"), F.posexplode("refs").alias("k", "id")).join(read("nodes").dropDuplicates(["id"]), "id")
    lines = places.groupBy(F.col("way").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p")).filter(F.size("p") > 1)
    if box:
        low, high = (lambda c: F.array_min(F.transform("p", lambda v: v[c]))), (lambda c: F.array_max(F.transform("p", lambda v: v[c])))
        lines = lines.filter((low("x") <= box[2]) & (high("x") >= box[0]) & (low("y") <= box[3]) & (high("y") >= box[1]))
    line = F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    properties = F.map_concat(F.map_filter("tags", lambda k, _: k != "osm_id"), F.create_map(F.lit("osm_id"), F.col("id").cast("string")))
    return ways.join(lines, "id").select(F.col("id").alias("feature_idx"), properties.alias("properties"), F.lit("LineString").alias("geom_type"), F.array(line).alias("lines"), F.array().cast("array<double>").alias("heights"))
