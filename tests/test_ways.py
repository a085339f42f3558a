"""Files of each kind, written here byte by byte and read back."""

import sqlite3
import struct
import zlib

import pytest

from ridgeweave.operators import paths
from ridgeweave.sources import ways

LINES = [
    ({"name": "Ridge", "highway": "path", "rank": 3.0}, [[(103.80, 1.35), (103.81, 1.36), (103.82, 1.35)]]),
    ({"name": None, "highway": "footway", "rank": 1.5}, [[(103.9, 1.30), (103.91, 1.31)], [(103.92, 1.3), (103.93, 1.3)]]),
    ({"name": "Höhe", "highway": "steps", "rank": None}, [[(104.5, 1.0), (104.6, 1.1)]]),
] * 5


def expected(keep=lambda parts: True, columns=("name", "highway", "rank")):
    show = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return [(k, {c: show(v) for c, v in p.items() if v is not None and c in columns}, parts) for k, (p, parts) in enumerate(LINES) if keep(parts)]


def got(df):
    return sorted((r.feature_idx, r.properties, [[(p.x, p.y) for p in line] for line in r.lines]) for r in df.collect())


BOX = (103.0, 1.0, 103.85, 2.0)
IN_BOX = lambda parts: min(x for p in parts for x, _ in p) <= 103.85


def wkb(parts):
    one = lambda p: struct.pack("<BII", 1, 2, len(p)) + b"".join(struct.pack("<2d", *v) for v in p)
    return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 5, len(parts)) + b"".join(map(one, parts))


@pytest.fixture
def package(tmp_path):
    c = sqlite3.connect(tmp_path / "w.gpkg")
    c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    c.executemany("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", [("other",), ("lines",)])
    c.execute("CREATE TABLE other (fid INTEGER PRIMARY KEY, geom BLOB)")
    c.execute("CREATE TABLE lines (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, highway TEXT, rank REAL)")
    for k, (p, parts) in enumerate(LINES):
        xs, ys = [x for part in parts for x, _ in part], [y for part in parts for _, y in part]
        bounds = struct.pack("<4d", min(xs), max(xs), min(ys), max(ys)) if k % 2 else b""
        blob = b"GP\0" + bytes([3 if bounds else 1]) + struct.pack("<i", 4326) + bounds + wkb(parts)
        c.execute("INSERT INTO lines VALUES (?, ?, ?, ?, ?)", (3 * k + 10, blob, *p.values()))
    c.commit()
    c.close()
    return str(tmp_path / "w.gpkg")


@pytest.fixture
def shapefile(tmp_path):
    shp, shx = b"", b""
    for k, (_, parts) in enumerate(LINES):
        flat = [v for p in parts for v in p]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        xs, ys = zip(*flat, strict=True)
        body = struct.pack("<i4d2i", 3, min(xs), min(ys), max(xs), max(ys), len(parts), len(flat)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *v) for v in flat)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(body) // 2)
        shp += struct.pack(">2i", k + 1, len(body) // 2) + body
    (tmp_path / "w.shp").write_bytes(bytes(100) + shp)
    (tmp_path / "w.shx").write_bytes(bytes(100) + shx)
    columns = [("name", 10), ("highway", 10), ("rank", 8)]
    head = struct.pack("<4BIHH20x", 3, 26, 1, 1, len(LINES), 33 + 32 * len(columns), 1 + sum(w for _, w in columns))
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for n, w in columns) + b"\r"
    show = lambda v: b"" if v is None else (f"{v:g}" if isinstance(v, float) else v).encode()
    (tmp_path / "w.dbf").write_bytes(head + b"".join(b" " + b"".join(show(p[n]).ljust(w) for n, w in columns) for p, _ in LINES))
    return str(tmp_path / "w.shp")


@pytest.mark.parametrize("kind", ["package", "shapefile"])
def test_rows_by_ranges(spark, request, kind):
    path = request.getfixturevalue(kind)
    df = ways.read_ways(spark, path, rows=4)
    assert df.rdd.getNumPartitions() > 3
    assert got(df) == expected()
    assert got(ways.read_ways(spark, path, ["highway"], BOX, rows=4)) == expected(IN_BOX, ("highway",))
    normal = paths.normalise_layer(paths.walkable_ways(df), "osm", 0.65)
    assert normal.count() == 20


def number(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def message(*pairs):
    return b"".join(number(k << 3 | (0 if isinstance(v, int) else 2)) + (number(v) if isinstance(v, int) else number(len(v)) + v) for k, v in pairs)


def packed(values):
    last, out = 0, b""
    for v in values:
        d = v - last
        out += number(d << 1 if d >= 0 else (-d << 1) - 1)
        last = v
    return out


@pytest.fixture
def pbf(tmp_path):
    nodes, refs, blocks = {}, [], []
    for _, parts in LINES:
        refs.append([nodes.setdefault(v, 5000 - 7 * len(nodes)) for p in parts for v in p])
    items = list(nodes.items())
    for k in range(0, len(items), 3):
        part = items[k : k + 3]
        dense = message((1, packed([i for _, i in part])), (8, packed([round(y * 1e7) for (_, y), _ in part])), (9, packed([round(x * 1e7) for (x, _), _ in part])))
        blocks.append(message((1, b""), (2, message((2, dense)))))
    for k, (p, _) in enumerate(LINES):
        tags = {c: v for c, v in p.items() if c != "rank" and v is not None}
        words = [b"", *[w.encode() for t in tags.items() for w in t]]
        way = message((1, 900 + k), (2, b"".join(number(1 + 2 * i) for i in range(len(tags)))), (3, b"".join(number(2 + 2 * i) for i in range(len(tags)))), (8, packed([*refs[k], 77])))
        blocks.append(message((1, message(*[(1, w) for w in words])), (2, message((3, way)))))
    blocks.append(message((1, message((1, b""), (1, b"building"), (1, b"yes"))), (2, message((3, message((1, 5), (2, b"\1"), (3, b"\2"), (8, packed(refs[0]))))))))
    with open(tmp_path / "w.osm.pbf", "wb") as f:
        for k, b in enumerate([b"head", *blocks]):
            blob = message((2, len(b)), (3, zlib.compress(b))) if k % 2 else message((1, b))
            head = message((1, b"OSMData" if k else b"OSMHeader"), (3, len(blob)))
            f.write(struct.pack(">I", len(head)) + head + blob)
    return str(tmp_path / "w.osm.pbf")


def test_blocks(spark, pbf):
    flat = lambda parts: [[v for p in parts for v in p]]
    show = lambda df: [(i, p, [[(round(x, 7), round(y, 7)) for x, y in line] for line in lines]) for i, p, lines in got(df)]
    want = [(900 + k, p | {"osm_id": str(900 + k)}, flat(parts)) for k, p, parts in expected(columns=("name", "highway"))]
    df = ways.read_ways(spark, pbf, blocks=2)
    assert show(df) == want
    assert show(ways.read_ways(spark, pbf, ["highway"], BOX, blocks=2)) == [(i, {k: v for k, v in p.items() if k != "name"}, lines) for i, p, lines in want if IN_BOX(lines)]


def test_empty_layers(spark, tmp_path):
    c = sqlite3.connect(tmp_path / "e.gpkg")
    c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    c.execute("INSERT INTO gpkg_geometry_columns VALUES ('l', 'g')")
    c.execute("CREATE TABLE l (id INTEGER PRIMARY KEY, g BLOB)")
    c.commit()
    c.close()
    (tmp_path / "e.osm.pbf").write_bytes(b"")
    for name in ("e.gpkg", "e.osm.pbf"):
        assert ways.read_ways(spark, str(tmp_path / name)).count() == 0
