"""Readers with explicit encodings, column resolution and checks; writers that are read back."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection as P
from ..functions import scalar as S

#: Encodings that are tried in this order.
ENCODINGS = ["utf-8-sig", "utf-8", "gbk", "gb18030", "latin-1"]
#: A guess from byte statistics counts above this confidence; else the first encoding that decodes the file.
SURE = 0.7


def guessed(raw: bytes) -> tuple[str, float]:
    """(encoding, confidence) of a file from statistics of its bytes.

    UTF-8: valid sequences of several bytes; each one halves the doubt. GBK: the share of double bytes that fall into the block
    of frequent characters, times the share of high bytes that pair at all. Latin-1: the share of high bytes that are accented
    letters next to a letter."""
    import numpy as np

    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig", 1.0
    data = np.frombuffer(raw, np.uint8)
    high = data >= 0x80
    n = int(high.sum())
    if not n:
        return "utf-8", 1.0
    try:
        raw.decode()
        leads = int((data >= 0xC0).sum())
        return "utf-8", 1 - 0.5 ** min(leads, 50)
    except UnicodeDecodeError:
        pass
    # double bytes: each run of high bytes is paired from its start; a second byte may also be a low one from 0x40 on
    place = np.arange(len(data))
    run_start = np.maximum.accumulate(np.where(high & ~np.append(False, high[:-1]), place, 0))
    first = high & ((place - run_start) % 2 == 0)
    second = np.append(data[1:], np.uint8(0))
    paired = first & (second >= 0x40) & (second != 0x7F) & (data != 0x80) & (data != 0xFF)
    frequent = paired & (((data >= 0xB0) & (data <= 0xD7)) | ((data >= 0xA1) & (data <= 0xA3))) & (second >= 0xA1)
    gbk = int(frequent.sum()) / max(1, int(first.sum())) * int(paired.sum()) / max(1, int(first.sum()))
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    beside = np.append(False, letter[:-1]) | np.append(letter[1:], False)
    alone = high & ~np.append(False, high[:-1]) & ~np.append(high[1:], False)
    latin = int((alone & (data >= 0xC0) & beside).sum()) / n
    return max((("gbk", gbk), ("latin-1", latin)), key=lambda g: g[1])


def encoding_of(raw: bytes) -> tuple[str, float]:
    """The guess where it is sure and decodes the file; else the first of ENCODINGS that does."""
    e, sure = guessed(raw)
    for name in ([e] if sure > SURE else []) + ENCODINGS:
        if name == "utf-8-sig" and not raw.startswith(b"\xef\xbb\xbf"):
            continue
        try:
            raw.decode(name)
            return name, sure
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1], sure


def encodings(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """path, encoding, confidence, header: each file at a path, judged by all its bytes."""

    def judge(batches):
        import io

        import pandas as pd

        for pdf in batches:
            rows = []
            for at, content in zip(pdf["path"], pdf["content"]):
                e, sure = (encoding, 1.0) if encoding else encoding_of(bytes(content))
                rows.append((at, e, sure, next(csv.reader(io.StringIO(bytes(content).decode(e))), [])))
            yield pd.DataFrame(rows, columns=["path", "encoding", "confidence", "header"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(judge, "path string, encoding string, confidence double, header array<string>")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of the file at a path (of several, that of the first by name)."""
    found = encodings(spark, path).select("path", "encoding").orderBy("path").first()
    return found["encoding"] if found else ENCODINGS[1]


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV files with headers, columns by their names in each file, missing ones null. Each file has its own encoding. Files alike
    are read together: by Spark's reader in pieces where it knows the encoding, else decoded as wholes."""
    groups = encodings(spark, path, encoding).groupBy("encoding", "header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("encoding", "header").collect()
    parts = [_read_alike(spark, g["paths"], g["encoding"], list(g["header"])) for g in groups if g["header"]]
    if not parts:
        return spark.createDataFrame([], schema or "value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if schema:
        wanted = spark.createDataFrame([], schema).schema
        have = set(out.columns)
        out = out.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out


def _read_alike(spark: SparkSession, paths: list[str], e: str, names: list[str]) -> DataFrame:
    if e in ("utf-8", "utf-8-sig", "latin-1"):
        return spark.read.option("header", True).option("encoding", "ISO-8859-1" if e == "latin-1" else "UTF-8").csv(paths)

    def decode(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:  # a file at a time; quoted line breaks stay inside their field
                rows = list(csv.reader(io.StringIO(bytes(content).decode(e))))
                yield pd.DataFrame({"cells": [r for r in rows[1:] if r]})

    files = spark.read.format("binaryFile").load(paths)
    cells = files.select("content").mapInPandas(decode, "cells array<string>")
    return cells.select(*[F.get("cells", i).alias(c) for i, c in enumerate(names)])


def resolve(df: DataFrame, candidates: list[str], required: bool = True) -> str | None:
    """The first column that equals a candidate without regard to case, else the first that contains one."""
    low = {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    for c in candidates:
        for name in df.columns:
            if c.lower() in name.lower():
                return name
    if required:
        raise KeyError(f"none of {candidates} in {df.columns}")
    return None


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def truncated(names: list[str], length: int = 10) -> list[str]:
    """Names cut to a length, made unique by a number at the end."""
    out: list[str] = []
    for n in names:
        cut, i = n[:length], 1
        while cut in out:
            cut = f"{n[: length - len(str(i)) - 1]}_{i}"
            i += 1
        out.append(cut)
    return out


def numeric(c: Column, fill: float | None = None, nodata: tuple[float, ...] = ()) -> Column:
    """A number or null; nodata marks, NaN and infinities are null, then filled."""
    v = c.try_cast("double")
    v = F.when(F.isnan(v) | v.isin(float("inf"), float("-inf"), *nodata), None).otherwise(v)
    return v if fill is None else F.coalesce(v, F.lit(fill))


#: What is done with a layer of an axis to bring it to the main system, zone 38 with its number in the eastings.
ACTIONS = {"zoned": "copy", "dezoned": "shift", "geographic": "reproject", "mixed": "error"}
ZONE_SHIFT = 38_000_000.0


def axis_report(layers: dict[str, DataFrame]) -> DataFrame:
    """layer, n, x0, y0, x1, y1, axis, action: each layer's (x, y) bounds, the axis that they mean, and what has to be done."""
    parts = [df.agg(F.count("x").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).withColumn("layer", F.lit(name)) for name, df in layers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first, last = S.axis_state(F.col("x0"), F.col("y0")), S.axis_state(F.col("x1"), F.col("y1"))
    axis = F.when(first == last, first).otherwise("mixed")
    out = out.withColumn("axis", axis)
    return out.select("layer", "n", "x0", "y0", "x1", "y1", "axis", S.lookup(F.col("axis"), ACTIONS).alias("action"))


def one_axis(layers: dict[str, DataFrame], context: str = "", geographic: bool = False) -> None:
    """Raises unless all layers have the main system's axis, or all are geographic where that is allowed."""
    found = {r["layer"]: r["axis"] for r in axis_report(layers).filter("n > 0").collect()}  # a row for each layer
    if set(found.values()) - {"zoned"} and not (geographic and set(found.values()) == {"geographic"}):
        raise ValueError(f"{context + ': ' if context else ''}mixed coordinate axes: {sorted(found.items())}")


def on_axis(layers: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The layers with (x, y) in the main system, and the report of what was done. A layer whose rows mix axes is an error."""
    report = axis_report(layers)
    done = {}
    for r in report.collect():  # a row for each layer
        df = layers[r["layer"]]
        if r["action"] == "error":
            raise ValueError(f"{r['layer']}: mixed coordinate axes")
        if r["action"] == "shift":
            df = df.withColumn("x", F.col("x") + ZONE_SHIFT)
        elif r["action"] == "reproject":
            x, y = P.to_plane(F.col("x"), F.col("y"), P.ZONE_38)
            df = df.withColumns({"x": x, "y": y})
        done[r["layer"]] = df
    return done, report


def sample_raster(points: DataFrame, pixels: DataFrame, left: float, top: float, res: float) -> DataFrame:
    """points with the value of their pixel (row, col, value); outside, nodata and negative values are 0."""
    keyed = points.withColumn("col", F.floor((F.col("x") - left) / res).cast("long")).withColumn("row", F.floor((top - F.col("y")) / res).cast("long"))
    return keyed.join(pixels, ["row", "col"], "left").withColumn("value", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))


def rasterise(cells: DataFrame, size: float, value: str) -> DataFrame:
    """row, col, value on a raster whose origin is snapped to the cell size: the largest value of each pixel."""
    box = cells.agg((F.floor(F.min("x") / size) * size).alias("x0"), (F.ceil(F.max("y") / size) * size).alias("y1"))
    at = cells.crossJoin(F.broadcast(box))
    return at.groupBy(F.floor((F.col("y1") - F.col("y")) / size).cast("long").alias("row"), F.floor((F.col("x") - F.col("x0")) / size).cast("long").alias("col")).agg(F.max(value).alias("value"))


def write_checked(df: DataFrame, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Writes a table and reads it back; all its columns have to be there."""
    df.write.mode("overwrite").format(fmt).options(**options).save(path)
    back = df.sparkSession.read.format(fmt).options(**options).schema(df.schema).load(path)
    return require(back, df.columns)


def report(df: DataFrame) -> DataFrame:
    """A one-column table of JSON rows."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def null_rates(df: DataFrame) -> DataFrame:
    """name, rate of rows with a value, for each column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "name", "rate")


def write_csv_bom(df: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark at the start of each file: the mark stands before the first column's name."""
    df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).write.mode("overwrite").option("header", True).csv(path)


def write_features(df: DataFrame, path: str, ring: str = "ring") -> None:
    """GeoJSON features, one a line, from rows with a ring (array of x, y); what the path held before goes."""
    shut = F.concat(F.col(ring), F.slice(ring, 1, 1))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(shut, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    rest = [c for c in df.columns if c != ring]
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, properties: str, crs: str | None) -> DataFrame:
    """Polygon features, one a line: their properties (a schema) and ring. No reference system or no feature is an error;
    features without a ring of three corners are dropped, and rings are turned counter-clockwise."""
    if not crs:
        raise ValueError("no coordinate reference system")
    kind = f"geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<{properties}>"
    rows = spark.read.schema(kind).json(path)
    if rows.isEmpty():
        raise ValueError(f"no feature in {path}")
    points = F.transform(F.get("geometry.coordinates", 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    r = rows.select("properties.*", points.alias("_p")).filter(F.size("_p") > 3).withColumn("_p", F.slice("_p", 1, F.size("_p") - 1))
    twice = F.aggregate(F.sequence(F.lit(0), F.size("_p") - 1), F.lit(0.0), lambda a, i: a + F.get("_p", i)["x"] * F.get("_p", (i + 1) % F.size("_p"))["y"] - F.get("_p", (i + 1) % F.size("_p"))["x"] * F.get("_p", i)["y"])
    return r.withColumn("ring", F.when(twice < 0, F.reverse("_p")).otherwise(F.col("_p"))).drop("_p")


def convert_layers(spark: SparkSession, layers: dict[str, DataFrame | None], out: str) -> DataFrame:
    """Writes each layer as Parquet with a CSV beside it; a layer that fails doesn't stop the others. name, rows, error."""
    found = []
    for name, df in layers.items():
        try:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
            back = spark.read.parquet(f"{out}/{name}")
            back.select(*[F.col(c) if t in ("string", "double", "bigint", "int", "boolean", "float") else F.to_json(F.struct(c)).alias(c) for c, t in back.dtypes]).write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")
            found.append((name, back.count(), None))
        except Exception as e:  # noqa: BLE001  whatever it is goes into the inventory
            found.append((name, None, str(e).splitlines()[0][:200] if str(e) else type(e).__name__))
    return spark.createDataFrame(found, "name string, rows long, error string")


def entities(raw: DataFrame, key: str, target: str, order: list[Column], name: str, stages: list[tuple[list[str], str]], wkt: str = "wkt") -> DataFrame:
    """An entity table: canonical ids, the first row of each id in the order, stages by name, points from text, and only rows
    with a target."""
    from ..operators import stats as A

    x, y = S.point_of_wkt(F.col(wkt))
    t = raw.select(S.canonical_id(F.col(key)).alias(key), F.col(target).alias(target), S.first_match(F.col(name), stages).alias("stage"), x.alias("x"), y.alias("y"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    return A.dedupe_first(t, [key], [F.col(f"_o{i}").alias(f"_s{i}") for i in range(len(order))]).filter(F.col(target).isNotNull()).select(key, "stage", "x", "y", target)


def only_kinds(df: DataFrame, kind: str, allowed: list[str], dropped: list[str]) -> DataFrame:
    """Rows of the allowed kinds. The kinds that fall away have to be among the stated ones; others are an error."""
    odd = df.filter(~F.col(kind).isin(*allowed, *dropped)).select(kind).distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unexpected kinds: {sorted(r[0] for r in odd)}")
    return df.filter(F.col(kind).isin(*allowed))


class Registry:
    """Names of inputs under a data folder, which the environment variable EQUIMAP_DATA or a parameter names; normalised
    rasters are made once and kept in a folder beside."""

    def __init__(self, spark: SparkSession, data: str | None = None, work: str | None = None) -> None:
        found = data or os.environ.get("EQUIMAP_DATA")
        if not found:
            raise KeyError("EQUIMAP_DATA")
        self.spark, self.data = spark, found.rstrip("/")
        self.work = (work or f"{self.data}/_normalised").rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.data}/{name}"

    def normalised(self, name: str, make) -> DataFrame:
        """The kept table of this name; make() gives it where there is none yet."""
        at = f"{self.work}/{name}"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            make().write.mode("overwrite").parquet(at)  # nothing, or what a broken write left
        return self.spark.read.parquet(at)
