"""Shapefiles and GeoPackages: what is written is read again, and files of other makers' layout are read."""

from __future__ import annotations

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from equimap.sources import vector as V

SQUARE, HOLE, FAR = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)], [(9.0, 9.0), (10.0, 9.0), (9.0, 10.0)]
TYPES = "rings array<array<struct<x: double, y: double>>>, name string, n bigint, share double, a_long_name_of_all int, a_long_name_too int"
KEPT = "name string, n bigint, share double"


def features(spark):
    at = lambda ring: [{"x": x, "y": y} for x, y in ring]
    rows = [([at(SQUARE), at(HOLE), at(FAR)], "北京 one", 1, 0.1 + 0.2, 7, 8), ([at(FAR)], None, None, None, None, None), (None, "no shape", 3, 1e-300, 1, 2)]
    return spark.createDataFrame(rows, TYPES)


def plain(df):
    return {(r.kind, tuple(tuple(sorted((p.x, p.y) for p in ring)) for ring in r.rings), r["name"], r.n, r.share) for r in df.collect()}


WANT = {("polygon", tuple(tuple(sorted(r)) for r in (SQUARE, HOLE, FAR)), "北京 one", 1, 0.1 + 0.2), ("polygon", (tuple(sorted(FAR)),), None, None, None)}


def test_shapefile(spark, tmp_path):
    path = str(tmp_path / "layer")
    (tmp_path / "layer.sbn").write_bytes(b"stale")
    V.write_shapefile(features(spark), path, "PROJCS[plane]")
    assert not (tmp_path / "layer.sbn").exists() and (tmp_path / "layer.shx").stat().st_size == 100 + 3 * 8
    got = V.read_shapefiles(spark, path, KEPT + ", a_long_nam int, a_long_n_1 int")
    assert plain(got) == WANT and {r.crs for r in got.collect()} == {"PROJCS[plane]"} and {r.layer for r in got.collect()} == {"layer"}
    assert {(r.a_long_nam, r.a_long_n_1) for r in got.collect()} == {(7, 8), (None, None)}
    turns = {r.n: [V.twice_area([(p.x, p.y) for p in ring]) for ring in r.rings] for r in got.collect()}
    assert turns[1] == [32.0, -2.0, 1.0]
    V.write_shapefile(features(spark).limit(1), str(tmp_path / "other"), "PROJCS[plane]")
    assert V.read_shapefiles(spark, str(tmp_path), KEPT).groupBy("layer").count().count() == 2
    (tmp_path / "layer.prj").unlink()
    with pytest.raises(ValueError, match="reference system"):
        V.read_shapefiles(spark, path, KEPT)
    assert {r.crs for r in V.read_shapefiles(spark, path, KEPT, crs="EPSG:4526").collect()} == {"EPSG:4526"}
    V.write_shapefile(features(spark).limit(0), path, "x")
    with pytest.raises(ValueError, match="no feature"):
        V.read_shapefiles(spark, path, KEPT)


def test_lines_points_and_encodings():
    line = struct.pack("<i4d2i2i", 3, 0, 0, 1, 1, 2, 5, 0, 2) + struct.pack("<10d", *range(10))
    point = struct.pack("<i2d", 1, 5.0, 6.0)
    many = struct.pack("<i4di4d", 8, 0, 0, 1, 1, 2, 1.0, 2.0, 3.0, 4.0)
    raw = b"\0" * 100 + b"".join(struct.pack(">2i", 1, len(b) // 2) + b for b in (line, point, many, struct.pack("<i", 0)))
    assert V.parse_shp(raw) == [("line", [[(0, 1), (2, 3)], [(4, 5), (6, 7), (8, 9)]]), ("point", [[(5, 6)]]), ("point", [[(1, 2)], [(3, 4)]]), None]
    field = lambda n, t, w: n.ljust(11, b"\0") + t + struct.pack("<IBB14x", 0, w, 0)
    fields = field(b"A", b"C", 6) + field(b"D", b"D", 8) + field(b"L", b"L", 1) + field(b"N", b"N", 3)
    body = b" " + "北京".encode("gbk").ljust(6) + b"20240131" + b"T" + b" 12" + b"*" + b" " * 18 + b" " + b" " * 6 + b" " * 8 + b"?" + b"***"
    dbf = struct.pack("<4BIHH20x", 3, 0, 1, 1, 3, 33 + len(fields), 19) + fields + b"\r" + body
    assert V.parse_dbf(dbf) == [{"A": "北京", "D": "2024-01-31", "L": "true", "N": "12"}, None, {"A": None, "D": None, "L": None, "N": None}]


def test_well_known_binary():
    big = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    high = struct.pack("<BII", 1, 1002, 2) + struct.pack("<6d", 0, 0, 9, 1, 1, 9)
    flagged = struct.pack("<BIIddd", 1, 0xA0000001, 4326, 3.0, 4.0, 5.0)
    assert V.parse_wkb(big) == ("point", [[(1, 2)]]) and V.parse_wkb(high) == ("line", [[(0, 0), (1, 1)]]) and V.parse_wkb(flagged) == ("point", [[(3, 4)]])
    assert V.parse_wkb(struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))) is None and V.parse_wkb(struct.pack("<BII", 1, 3, 0)) is None
    back = struct.pack("<BIII", 1, 3, 1, 5) + struct.pack("<10d", *[v for p in [*SQUARE[::-1], SQUARE[-1]] for v in p])
    assert V.twice_area(V.parse_wkb(back)[1][0]) == 32


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "all.gpkg")
    V.write_geopackage({"one": features(spark), "two": features(spark).limit(1)}, path, 4526)
    got = V.read_geopackage(spark, path, KEPT)
    assert plain(got.filter("layer = 'one'")) == WANT and {r.crs for r in got.collect()} == {"EPSG:4526"} and got.count() == 3
    assert V.read_geopackage(spark, path, KEPT, "two").count() == 1
    db = sqlite3.connect(path)
    assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and db.execute("PRAGMA integrity_check").fetchone()[0] == "ok"
    db.close()
    with pytest.raises(ValueError, match="no feature"):
        V.read_geopackage(spark, path, KEPT, "three")
    with pytest.raises(ValueError, match="more than"):
        V.write_geopackage({"one": features(spark)}, path, 4526, most=2)
    assert V.read_geopackage(spark, path, KEPT).agg(F.sum("n")).first()[0] == 2


def test_checked_layers(spark):
    """Crossing rings are rebuilt, flat ones and missing ones fall away; no system and no rows are errors."""
    from equimap.functions import projection

    kinds = "crs string, kind string, name string, rings array<array<struct<x: double, y: double>>>"
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    rows = [("c", "polygon", "bow", [bow]), ("c", "polygon", "holed", [SQUARE, HOLE]), ("c", "polygon", "flat", [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]), ("c", "line", "line", [[(0.0, 0.0), (1.0, 5.0)]]), ("c", "polygon", "none", None)]
    df = spark.createDataFrame(rows, kinds)
    got = {r["name"]: [[tuple(p) for p in ring] for ring in r.rings] for r in V.checked(df, 3.0).collect()}
    assert set(got) == {"bow", "holed", "line"} and got["line"] == [[(0.0, 0.0), (1.0, 5.0)]]
    assert sorted(V.twice_area(r) for r in got["bow"]) == [8.0, 8.0]
    assert sorted(V.twice_area(r) for r in got["holed"]) == [-2.0, 32.0]
    with pytest.raises(ValueError, match="empty layer"):
        V.checked(df.limit(0), 3.0)
    with pytest.raises(ValueError, match="without a coordinate system"):
        V.checked(df.withColumn("crs", F.lit(None).cast("string")), 3.0)
    small = spark.createDataFrame([("c", "polygon", "p", [[(114.0, 36.0), (114.001, 36.0), (114.001, 36.001), (114.0, 36.001)]])], kinds)
    (r,) = V.checked(small, 50.0, projection.ZONE_38).collect()
    assert V.twice_area([tuple(p) for p in r.rings[0]]) / 2 == pytest.approx(90.2 * 111.0, rel=0.01) and abs(r.rings[0][0].x - 38_500_000) < 200
