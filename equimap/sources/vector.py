"""Vector layers in shapefiles and GeoPackages, read one file a task and written from bounded tables.

A feature has `rings`, its parts as arrays of (x, y) without the repeated last corner, outer ones counter-clockwise and holes
clockwise; `kind` is point, line or polygon. Rows without geometry fall away, as do rings of fewer than three corners. An empty
layer or one without a reference system is an error.
"""

from __future__ import annotations

import datetime
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection as R
from ..operators import polygons as G
from ..operators.lineage import cut

from .files import ENCODINGS, truncated
from .raster import write_bytes

#: Most features of one written file, which the driver holds.
MOST_FEATURES = 2_000_000
_SHAPES = {1: "point", 3: "line", 5: "polygon", 8: "point", 11: "point", 13: "line", 15: "polygon", 18: "point", 21: "point", 23: "line", 25: "polygon", 28: "point"}
_WKB = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon"}
_ROW = "layer string, crs string, kind string, rings array<array<struct<x: double, y: double>>>, cells map<string, string>"


def twice_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def _clean(kind: str, rings: list[list[tuple[float, float]]], holes: list[bool]) -> list[list[tuple[float, float]]]:
    """Rings without repeated corners and in their sense; other kinds as they are."""
    if kind != "polygon":
        return [r for r in rings if r]
    out = []
    for ring, hole in zip(rings, holes):
        ring = [p for p, q in zip(ring, ring[1:] + ring[:1]) if p != q]
        if len(ring) > 2 and twice_area(ring):
            out.append(ring[::-1] if (twice_area(ring) > 0) == hole else ring)
    return out


def parse_shp(raw: bytes) -> list[tuple[str, list] | None]:
    """Each record's kind and rings, None for null shapes; heights and measures are left out."""
    out, at = [], 100
    while at + 12 <= len(raw):
        size = struct.unpack_from(">i", raw, at + 4)[0] * 2
        body = raw[at + 8 : at + 8 + size]
        at += 8 + size
        (t,) = struct.unpack_from("<i", body)
        kind = _SHAPES.get(t)
        if kind is None:
            out.append(None)
        elif t in (1, 11, 21):
            out.append((kind, [[struct.unpack_from("<2d", body, 4)]]))
        else:
            first = struct.unpack_from("<i", body, 36)[0]
            if kind == "point":
                starts, n, where = list(range(first)), first, 40
            else:
                n = struct.unpack_from("<i", body, 40)[0]
                starts, where = list(struct.unpack_from(f"<{first}i", body, 44)), 44 + 4 * first
            v = struct.unpack_from(f"<{2 * n}d", body, where)
            points = list(zip(v[::2], v[1::2]))
            rings = [points[a:b] for a, b in zip(starts, starts[1:] + [n])]
            rings = _clean(kind, rings, [twice_area(r) > 0 for r in rings])  # in shapefiles outer rings turn clockwise
            out.append((kind, rings) if rings else None)
    return out


def parse_dbf(raw: bytes, encoding: str | None = None) -> list[dict[str, str | None] | None]:
    """Each record's texts by field, None for deleted ones. Without an encoding the first that decodes all names and texts."""
    n, head, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0], chr(raw[at + 11]), raw[at + 16]))
        at += 32
    rows = [raw[head + i * width : head + (i + 1) * width] for i in range(n)]
    for e in [encoding] if encoding else ENCODINGS[1:]:
        try:
            out = []
            for row in rows:
                cells, at = {}, 1
                for name, t, size in fields:
                    text = row[at : at + size].decode(e).strip(" \0")
                    at += size
                    if t == "D" and len(text) == 8:
                        text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
                    elif t == "L":
                        text = {"t": "true", "y": "true", "f": "false", "n": "false"}.get(text.lower(), "")
                    cells[name.decode(e)] = None if text == "" or (t in "NF" and not text.strip("*")) else text
                out.append(None if row[:1] == b"*" else cells)
            return out
        except UnicodeDecodeError:
            continue
    raise ValueError(f"not in {encoding}")


def parse_wkb(raw: bytes) -> tuple[str, list] | None:
    """kind and rings of well-known binary of two or more dimensions; None for empty and other geometries."""

    def one(at: int) -> tuple[str | None, list, int]:
        o = "<" if raw[at] else ">"
        (t,) = struct.unpack_from(o + "I", raw, at + 1)
        flags, t = t >> 29, t & 0x1FFFFFFF
        dims = 2 + bool(flags & 4) + bool(flags & 2) + {0: 0, 1: 1, 2: 1, 3: 2}.get(t // 1000, 0)
        t, at = t % 1000, at + 5 + 4 * bool(flags & 1)

        def points(at: int, n: int) -> tuple[list, int]:
            v = struct.unpack_from(f"{o}{n * dims}d", raw, at)
            return [p for p in zip(v[::dims], v[1::dims]) if p[0] == p[0]], at + 8 * n * dims

        if t == 1:
            p, at = points(at, 1)
            return "point", [p], at
        (n,) = struct.unpack_from(o + "I", raw, at)
        at += 4
        if t == 2:
            p, at = points(at, n)
            return "line", [p], at
        rings = []
        if t == 3:
            for _ in range(n):
                (k,) = struct.unpack_from(o + "I", raw, at)
                p, at = points(at + 4, k)
                rings.append(p)
            return "polygon", _clean("polygon", rings, [i > 0 for i in range(n)]), at
        for _ in range(n):
            _, more, at = one(at)
            rings += more
        return _WKB.get(t), rings, at

    kind, rings, _ = one(0)
    rings = [r for r in rings if r]
    return (kind, rings) if kind and rings else None


def _columns(rows: DataFrame, properties: str, path: str, crs: str | None) -> DataFrame:
    """layer, crs, kind, rings and the properties, of which a text that isn't of its type is null."""
    if rows.isEmpty():
        raise ValueError(f"no feature in {path}")
    if crs is None and not rows.filter("crs is null").isEmpty():
        raise ValueError(f"no coordinate reference system in {path}")
    wanted = rows.sparkSession.createDataFrame([], properties).schema
    return rows.select("layer", F.coalesce("crs", F.lit(crs)).alias("crs"), "kind", "rings", *[F.col("cells")[f.name].try_cast(f.dataType).alias(f.name) for f in wanted])


def _records(layer, crs, shapes):
    import pandas as pd

    rows = [(layer, crs, s[0], [[{"x": x, "y": y} for x, y in r] for r in s[1]], cells) for s, cells in shapes if s is not None and cells is not None]
    for at in range(0, len(rows), 2000):
        yield pd.DataFrame(rows[at : at + 2000], columns=["layer", "crs", "kind", "rings", "cells"])


def read_shapefiles(spark: SparkSession, path: str, properties: str, crs: str | None = None, encoding: str | None = None) -> DataFrame:
    """All layers of a folder, or of one path without its ending: layer (the stem), crs (its .prj, else the one given), kind,
    rings and the properties (a schema) from its .dbf, whose encoding is that given, named by a .cpg, or found by trying."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf,prj,cpg}").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.read.format("binaryFile").load(path + ".*")
    files = files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("layer"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("end"), "content")
    part = lambda e: files.filter(F.col("end") == e).select("layer", F.col("content").alias(e))
    layers = part("shp").join(part("dbf"), "layer", "left").join(part("prj"), "layer", "left").join(part("cpg"), "layer", "left")

    def scan(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                shapes = parse_shp(bytes(r.shp))
                named = encoding or (bytes(r.cpg).decode("ascii", "ignore").strip() if r.cpg is not None else None)
                cells = parse_dbf(bytes(r.dbf), named) if r.dbf is not None else [{}] * len(shapes)
                if len(cells) != len(shapes):
                    raise ValueError(f"{r.layer}: {len(shapes)} shapes, {len(cells)} records")
                yield from _records(r.layer, bytes(r.prj).decode("utf-8") if r.prj is not None else None, zip(shapes, cells))

    return _columns(layers.mapInPandas(scan, _ROW), properties, path, crs)


def read_geopackage(spark: SparkSession, path: str, properties: str, layer: str | None = None) -> DataFrame:
    """All feature layers of the GeoPackages at a path, or one: layer, crs, kind, rings and the properties (a schema)."""

    def scan(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(raw))
                quoted = lambda s: '"' + s.replace('"', '""') + '"'
                for name, column, srs in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY 1").fetchall():
                    if layer not in (None, name):
                        continue
                    found = db.execute("SELECT organization || ':' || organization_coordsys_id FROM gpkg_spatial_ref_sys WHERE srs_id = ? AND srs_id > 0", (srs,)).fetchone()
                    cur = db.execute(f"SELECT * FROM {quoted(name)}")
                    names = [c[0] for c in cur.description]
                    at = names.index(column)
                    shapes = ((_blob(r[at]), {n: None if v is None else str(v) for k, (n, v) in enumerate(zip(names, r)) if k != at}) for r in cur)
                    yield from _records(name, found[0] if found else None, shapes)
                db.close()

    return _columns(spark.read.format("binaryFile").load(path).select("content").mapInPandas(scan, _ROW), properties, path, None)


def _blob(raw: bytes | None) -> tuple[str, list] | None:
    """A GeoPackage geometry: a header with an envelope of a stated size, then well-known binary."""
    if raw is None or raw[3] & 0x10:
        return None
    return parse_wkb(raw[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[raw[3] >> 1 & 7] :])


def checked(df: DataFrame, size: float, zone: R.Zone | None = None) -> DataFrame:
    """A layer fit for use: an empty one, or one without a system, is an error; features without geometry fall away; polygons whose
    rings cross themselves or each other are rebuilt from simple rings (see polygons.repaired; size: of its lattice), and those
    without an inside fall away. zone: longitudes and latitudes become this transverse Mercator zone's metres."""
    first = df.select("crs").limit(1).collect()
    if not first:
        raise ValueError("an empty layer")
    if not df.filter("crs is null").isEmpty():
        raise ValueError("a layer without a coordinate system")
    rows = df.filter("rings is not null and size(rings) > 0")
    if zone is not None:

        def plane(p):
            x, y = R.to_plane(p["x"], p["y"], zone)
            return F.struct(x.alias("x"), y.alias("y"))

        rows = rows.withColumn("rings", F.transform("rings", lambda r: F.transform(r, plane)))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    polygons = rows.filter("kind = 'polygon'")
    fixed = polygons.drop("rings").join(G.repaired(polygons.select("_row", "rings"), "_row", size), "_row")
    return rows.filter("kind <> 'polygon'").unionByName(fixed).select(*df.columns)


def _held(df: DataFrame, most: int) -> tuple[list[str], list[str], list]:
    rest = [(c, t) for c, t in df.dtypes if c not in ("rings", "kind", "layer", "crs")]
    rows = df.select("rings", *[c for c, _ in rest]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} features")
    return [c for c, _ in rest], [t for _, t in rest], [([[(p["x"], p["y"]) for p in r] for r in row["rings"] or []], row[1:]) for row in rows]


def _removed(spark: SparkSession, path: str) -> None:
    """Takes away a layer's old files, so that none of them stays beside the new ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for old in fs.globStatus(p) or []:
        fs.delete(old.getPath(), False)


def write_shapefile(df: DataFrame, path: str, crs: str, most: int = MOST_FEATURES) -> None:
    """Polygons (rings) and their other columns as path.shp, .shx, .dbf, .prj and .cpg; what was at path.* goes. Names are cut
    to ten characters, texts to 254 bytes are an error beyond. crs is the text of the .prj. A row without rings is a null shape."""
    names, types, rows = _held(df, most)
    shp, shx, box, at = b"", b"", [], 50
    records = []
    for n, (rings, _) in enumerate(rows, 1):
        if rings:
            shut = [(r + r[:1])[::-1] for r in rings]
            pts = [p for r in shut for p in r]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            box += [(min(xs), min(ys)), (max(xs), max(ys))]
            starts = [sum(len(r) for r in shut[:k]) for k in range(len(shut))]
            body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(shut), len(pts)) + struct.pack(f"<{len(shut)}i", *starts) + struct.pack(f"<{2 * len(pts)}d", *[v for p in pts for v in p])
        else:
            body = struct.pack("<i", 0)
        records.append(struct.pack(">2i", n, len(body) // 2) + body)
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    shp = b"".join(records)
    ends = [min((p[0] for p in box), default=0.0), min((p[1] for p in box), default=0.0), max((p[0] for p in box), default=0.0), max((p[1] for p in box), default=0.0)]
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i8d", 1000, 5, *ends, 0, 0, 0, 0)
    shown = lambda v: b"" if v is None else (("T" if v else "F") if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v)).encode()
    cells = [[shown(v) for v in row] for _, row in rows]
    kinds = [("L", 1) if t == "boolean" else ("N" if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") else "C", max([1] + [len(c[k]) for c in cells])) for k, t in enumerate(types)]
    if any(w > 254 for _, w in kinds):
        raise ValueError("a text of more than 254 bytes")
    fields = b"".join(n.encode().ljust(11, b"\0") + t.encode() + struct.pack("<IBB14x", 0, w, 15 if types[k] in ("double", "float") and w > 15 else 0) for k, (n, (t, w)) in enumerate(zip(truncated(names), kinds)))
    today = datetime.date.today()
    dbf = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, len(rows), 33 + len(fields), 1 + sum(w for _, w in kinds)) + fields + b"\r"
    dbf += b"".join(b" " + b"".join(c.rjust(w) if t == "N" else c.ljust(w) for c, (t, w) in zip(row, kinds)) for row in cells) + b"\x1a"
    spark = df.sparkSession
    _removed(spark, path + ".*")
    for end, raw in {"shp": head(len(shp)) + shp, "shx": head(len(shx)) + shx, "dbf": dbf, "prj": crs.encode(), "cpg": b"UTF-8"}.items():
        write_bytes(spark, f"{path}.{end}", raw)


def write_geopackage(layers: dict[str, DataFrame], path: str, srs: int, most: int = MOST_FEATURES) -> None:
    """Polygon layers (rings and other columns) in one GeoPackage of a reference system by its number; an old file goes."""
    db = sqlite3.connect(":memory:")
    db.executescript("""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));""")
    db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("none", -1, "NONE", -1), ("none", 0, "NONE", 0), (f"EPSG:{srs}", srs, "EPSG", srs)])
    kind = lambda t: "INTEGER" if t in ("int", "bigint", "smallint", "tinyint", "boolean") else "REAL" if t in ("double", "float") or t.startswith("decimal") else "TEXT"
    plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
    for name, df in layers.items():
        names, types, rows = _held(df, most)
        quoted = lambda s: '"' + s.replace('"', '""') + '"'
        db.execute(f"CREATE TABLE {quoted(name)} ({', '.join(['_fid INTEGER PRIMARY KEY', '_geom BLOB'] + [f'{quoted(n)} {kind(t)}' for n, t in zip(names, types)])})")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (name, name, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, '_geom', 'MULTIPOLYGON', ?, 0, 0)", (name, srs))
        db.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join(['?'] * (len(names) + 2))})", [(n, _wkb(rings, srs), *map(plain, row)) for n, (rings, row) in enumerate(rows, 1)])
    db.commit()
    spark = layers[next(iter(layers))].sparkSession
    raw = db.serialize()
    db.close()
    for old in (path, path + "-wal", path + "-journal"):
        _removed(spark, old)
    write_bytes(spark, path, raw)


def _wkb(rings: list, srs: int) -> bytes | None:
    """A multipolygon: each counter-clockwise ring with the clockwise ones that follow it."""
    if not rings:
        return None
    parts: list[list] = []
    for r in rings:
        if twice_area(r) > 0 or not parts:
            parts.append([])
        parts[-1].append(r + r[:1])
    one = lambda p: struct.pack("<BII", 1, 3, len(p)) + b"".join(struct.pack("<I", len(r)) + struct.pack(f"<{2 * len(r)}d", *[v for q in r for v in q]) for r in p)
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(one, parts))
