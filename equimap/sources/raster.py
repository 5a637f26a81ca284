"""Rasters as tall tables (row, col, value): GeoTIFF and NPY files in and out, guards and a report of what was done."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of the file format; fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, SIZES, PLANAR, PREDICTOR, FORMAT, SCALE, TIE, NODATA = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def parse_tiff(raw: bytes) -> tuple[np.ndarray, dict]:
    """(bands, height, width) and left, top, res, nodata of a striped GeoTIFF, plain or deflated. Other layouts are an error."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in TYPES:
            continue
        fmt = order + TYPES[kind] * n
        size = struct.calcsize(fmt)
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        tags[tag] = struct.unpack(fmt, raw[place : place + size])
    if STRIPS not in tags or tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946) or tags.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("tiles, predictors and compressions other than deflate are not read")
    w, h, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[tags.get(FORMAT, (1,))[0], tags.get(BITS, (1,))[0]]
    parts = [raw[o : o + n] for o, n in zip(tags[STRIPS], tags[SIZES])]
    if tags.get(COMPRESSION, (1,))[0] != 1:
        parts = [zlib.decompress(p) for p in parts]
    data = np.frombuffer(b"".join(parts), np.dtype(kind).newbyteorder(order))
    data = data.reshape(bands, h, w) if tags.get(PLANAR, (1,))[0] == 2 else data.reshape(h, w, bands).transpose(2, 0, 1)
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
    mark = b"".join(tags[NODATA]).split(b"\0")[0].strip() if NODATA in tags else b""
    return data, {"left": tie[3] - tie[0] * scale[0], "top": tie[4] + tie[1] * scale[1], "res": float(scale[0]), "nodata": float(mark) if mark else None}


def make_tiff(data: np.ndarray, left: float, top: float, res: float, nodata: float) -> bytes:
    """A deflated GeoTIFF of one band of 32-bit numbers."""
    h, w = data.shape
    strips = [zlib.compress(np.ascontiguousarray(data[r : r + 64], "<f4").tobytes()) for r in range(0, h, 64)]
    mark = f"{nodata:g}".encode() + b"\0"
    entries = [(WIDTH, "I", (w,)), (HEIGHT, "I", (h,)), (BITS, "H", (32,)), (COMPRESSION, "H", (8,)), (PHOTOMETRIC, "H", (1,)), (STRIPS, "I", None), (SAMPLES, "H", (1,)), (ROWS, "I", (64,)), (SIZES, "I", tuple(map(len, strips))), (PLANAR, "H", (1,)), (FORMAT, "H", (3,)), (SCALE, "d", (res, res, 0.0)), (TIE, "d", (0.0, 0.0, 0.0, left, top, 0.0)), (NODATA, "c", mark)]
    code = {"c": 2, "H": 3, "I": 4, "d": 12}
    head, extra = 8 + 2 + 12 * len(entries) + 4, b""
    sizes = {t: struct.calcsize("<" + f * (len(strips) if v is None else len(v))) for t, f, v in entries}
    start = head + sum(n + n % 2 for n in sizes.values() if n > 4)
    offsets = tuple(int(x) for x in start + np.r_[0, np.cumsum([len(s) for s in strips])[:-1]])
    out = struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for t, f, v in entries:
        v = offsets if v is None else v
        body = bytes(v) if f == "c" else struct.pack("<" + f * len(v), *v)
        out += struct.pack("<HHI", t, code[f], len(v))
        if len(body) <= 4:
            out += body.ljust(4, b"\0")
        else:
            out += struct.pack("<I", head + len(extra))
            extra += body + b"\0" * (len(body) % 2)
    return out + struct.pack("<I", 0) + extra + b"".join(strips)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def meta(spark: SparkSession, path: str) -> DataFrame:
    """path, bands, height, width, left, top, res, nodata of each file."""

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                data, m = parse_tiff(bytes(raw))
                yield pd.DataFrame([{"path": p, "bands": data.shape[0], "height": data.shape[1], "width": data.shape[2], **m}]).astype({"nodata": "float64"})

    return _files(spark, path).select("path", "content").mapInPandas(scan, "path string, bands int, height int, width int, left double, top double, res double, nodata double")


def read_tiff(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """row, col, value of one band of the rasters at a path, one file a task; nodata and numbers that aren't are null."""

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                data, m = parse_tiff(bytes(raw))
                if not 1 <= band <= len(data):
                    raise ValueError(f"band {band} of {len(data)}")
                for r in range(0, data.shape[1], 256):
                    part = data[band - 1, r : r + 256].astype(float)
                    value = np.where(np.isfinite(part) & (part != (np.nan if m["nodata"] is None else m["nodata"])), part, np.nan).ravel()
                    rows, cols = np.divmod(np.arange(part.size), part.shape[1])
                    yield pd.DataFrame({"row": rows + r, "col": cols, "value": value})

    out = _files(spark, path).select("content").mapInPandas(scan, "row long, col long, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def single_band(spark: SparkSession, path: str) -> DataFrame:
    """meta() of rasters that all have one band; others are an error."""
    m = meta(spark, path)
    odd = [r.path for r in m.filter("bands <> 1").select("path").limit(5).collect()]
    if odd:
        raise ValueError(f"more than one band: {odd}")
    return m


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """Writes a file wherever Spark writes."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def _dense(pixels: DataFrame, nodata: float, most: int) -> np.ndarray:
    h, w = pixels.agg(F.max("row") + 1, F.max("col") + 1).first()
    if not h or h * w > most:
        raise ValueError(f"{h} x {w} pixels; a file of one piece holds {most} at most")
    out = np.full((h, w), nodata, float)
    t = pixels.filter("value is not null").select("row", "col", "value").toArrow()
    out[t["row"].to_numpy(), t["col"].to_numpy()] = t["value"].to_numpy()
    return out


def write_tiff(pixels: DataFrame, path: str, left: float, top: float, res: float, nodata: float = -9999.0, most: int = 50_000_000) -> None:
    """One GeoTIFF of at most `most` pixels, which the driver holds."""
    write_bytes(pixels.sparkSession, path, make_tiff(_dense(pixels, nodata, most), left, top, res, nodata))


def write_npy(pixels: DataFrame, path: str, fill: float = float("inf"), most: int = 50_000_000) -> None:
    """One NPY matrix of at most `most` numbers, which the driver holds; what has no row is `fill`."""
    buffer = io.BytesIO()
    np.save(buffer, _dense(pixels, fill, most))
    write_bytes(pixels.sparkSession, path, buffer.getvalue())


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of NPY matrices; numbers that aren't finite have no row."""

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                a = np.atleast_2d(np.load(io.BytesIO(bytes(raw)), allow_pickle=False)).astype(float)
                row, col = np.nonzero(np.isfinite(a))
                yield pd.DataFrame({"row": row, "col": col, "value": a[row, col]})

    return _files(spark, path).select("content").mapInPandas(scan, "row long, col long, value double")


def normalise_all(spark: SparkSession, rasters: dict[str, str], out: str) -> DataFrame:
    """Reads each raster, writes its pixels as Parquet, and reports name, action, least, largest, mean, zeros and missing ones;
    one that fails is reported and doesn't stop the others."""
    from ..operators.spatial import raster_summary

    found = []
    for name, path in rasters.items():
        try:
            single_band(spark, path)
            read_tiff(spark, path).write.mode("overwrite").parquet(f"{out}/{name}")
            s = raster_summary(spark.read.parquet(f"{out}/{name}")).first()
            found.append((name, "written", s.lo, s.hi, s["mean"], s.zeros, s.missing))
        except Exception as e:  # noqa: BLE001  whatever it is goes into the report
            found.append((name, f"failed: {type(e).__name__}", None, None, None, None, None))
    return spark.createDataFrame(found, "name string, action string, lo double, hi double, mean double, zeros long, missing long")
