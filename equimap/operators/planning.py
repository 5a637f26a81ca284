"""Composite indices, priorities, demand grids, evaluation and outlier cells."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import stats as A
from .lineage import cut


#: What is done for a class: fixed values.
STRATEGIES = {"I": "S1", "II": "S2", "III": "S3", "IV": "S4"}


def priority(df: DataFrame, key: str, d1: str, d2: str, d3: str, count: str) -> DataFrame:
    """key, index, priority, rank, cls, strategy: entropy-weighted index of three dimensions, priority from reversed pressure,
    class by quartiles of the index (a missing one is the last class), raised or lowered by the entity's count."""
    w = {r["name"]: r["weight"] for r in A.entropy_weights(df, [d1, d2, d3]).collect()}  # three rows
    t = A.with_totals(df.select(key, d1, d2, d3, F.coalesce(F.col(count), F.lit(0)).alias("_n")), **{f"lo_{c}": F.min(c) for c in (d1, d2, d3)}, **{f"hi_{c}": F.max(c) for c in (d1, d2, d3)})
    n = {c: S.minmax_eps(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), reverse=c == d3) for c in (d1, d2, d3)}
    t = t.select(key, "_n", *[n[c].alias(f"n_{c}") for c in (d1, d2, d3)])
    index = sum((w[c] * F.col(f"n_{c}") for c in (d2, d3)), w[d1] * F.col(f"n_{d1}"))
    t = t.withColumn("index", index).withColumn("priority", 0.5 * F.col(f"n_{d3}") + 0.3 * F.col(f"n_{d2}") + 0.2 * (1 - F.col("index")))
    t = A.with_totals(t, q=F.percentile("index", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    t = t.withColumn("cls", S.count_override(S.quartile_class(F.col("index"), *[F.get("q", i) for i in range(3)]), F.col("_n"))).drop("q")
    return A.ranks(t, "priority", descending=True).select(key, "index", "priority", F.col("rank_min").alias("rank"), "cls", S.lookup(F.col("cls"), STRATEGIES).alias("strategy"))


def monte_carlo(df: DataFrame, key: str, demand: str, unmet: str, runs: int) -> DataFrame:
    """run, coverage: each run scales demand and unmet demand by hashed factors within 5 %."""
    u = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    f = lambda off: 0.95 + 0.1 * S.hash_uniform(F.col(key) + off, F.col("run"))
    return u.groupBy("run").agg((1 - F.sum(F.col(unmet) * f(0)) / F.sum(F.col(demand) * f(17))).alias("coverage"))


def benefit(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many improved by 1 % or 0.1 %, or lost, and mean change."""
    b, a = F.col(before), F.col(after)
    return df.agg(F.count_if(a > 1.01 * b).alias("improved"), F.count_if(a > 1.001 * b).alias("slightly"), F.count_if(a < 0.999 * b).alias("lost"), F.avg(a - b).alias("mean_change"))


def variation(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: population coefficient of variation of the keys' totals, and an alarm below 0.15."""
    t = df.groupBy(key).agg(F.sum(value).alias("t"))
    return t.agg((F.stddev_pop("t") / F.avg("t")).alias("cv")).withColumn("alarm", F.col("cv") < 0.15)


def overlap_scores(pairs: DataFrame, area_a: Column, area_b: Column) -> DataFrame:
    """Median intersection over union and area ratio of matched areas with their overlap."""
    return pairs.agg(F.percentile(F.col("area") / (area_a + area_b - F.col("area")), 0.5).alias("iou"), F.percentile(area_a / area_b, 0.5).alias("ratio"))


def dissolve(cells: DataFrame, key: str, size: float) -> DataFrame:
    """Union of each key's cells (ci, cj): count, area and the box."""
    d = cells.select(key, "ci", "cj").distinct()
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * size * size).alias("area"), F.min("ci").alias("i0"), F.max("ci").alias("i1"), F.min("cj").alias("j0"), F.max("cj").alias("j1"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hull_of(df: DataFrame) -> list[tuple[float, float]]:
    """The corners of the hull of x, y, counter-clockwise. Each task sends its own hull only."""

    def scan(batches):
        keep: list[tuple[float, float]] = []
        for pdf in batches:
            keep = hull(keep + list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        import pandas as pd

        yield pd.DataFrame(keep, columns=["x", "y"])

    return hull([(r.x, r.y) for r in df.select("x", "y").mapInPandas(scan, "x double, y double").collect()])


def hull_area(df: DataFrame, buffer: float) -> DataFrame:
    """One row: area of the hull of x, y with a buffer, and its corners."""
    h = hull_of(df)
    ends = h[1:] + h[:1]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, ends, strict=True)) / 2
    around = sum(math.dist(a, b) for a, b in zip(h, ends, strict=True))
    return df.sparkSession.createDataFrame([(area + around * buffer + math.pi * buffer * buffer, len(h))], "area double, corners int")


def flood(mask: DataFrame) -> DataFrame:
    """row, col of the zero pixels (row, col, zero, edge) that are connected to the raster's edge."""
    zero = cut(mask.filter("zero").select("row", "col", "edge"))
    seen = cut(zero.filter("edge").select("row", "col"))
    front = seen
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    while True:
        near = front.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col")).distinct()
        front = cut(near.join(zero.select("row", "col"), ["row", "col"], "left_semi").join(seen, ["row", "col"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def isolation_scores(df: DataFrame, cols: list[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """df with score: isolation forest. Each tree is grown on `sample` rows of its own, drawn from all rows by hash, and applied to
    all rows; so the driver holds trees * sample rows, whatever the size of df."""
    n = df.count()
    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    draw = F.pmod(F.xxhash64(*cols, F.monotonically_increasing_id()), F.lit(1 << 40))
    rows = cut(rows.withColumn("_row", draw)) if n > sample else rows.withColumn("_row", F.lit(0))
    share = min(1.0, (1.3 * sample + 20) / max(1, n))
    place = lambda t: F.pmod(F.xxhash64("_row", *cols, t, F.lit(seed)), F.lit(1 << 40))
    taken = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), place(t).alias("at"))), lambda s: s["at"] < int(share * (1 << 40)))
    drawn: list[list] = [[] for _ in range(trees)]
    for r in rows.select(*cols, F.explode(taken).alias("s")).collect() if n else []:
        drawn[r["s"]["t"]].append((r["s"]["at"], *r[: len(cols)]))
    own = [np.array(sorted(d)[:sample], float).reshape(-1, len(cols) + 1)[:, 1:] for d in drawn]
    rng = np.random.default_rng(seed)

    def path_length(n: float) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def grow(part, depth, limit):
        lo, hi = part.min(0), part.max(0)
        free = np.flatnonzero(hi > lo)
        if depth >= limit or len(part) < 2 or not len(free):
            return (depth + path_length(len(part)),)
        f = int(rng.choice(free))
        at = float(rng.uniform(lo[f], hi[f]))
        side = part[:, f] < at
        return (f, at, grow(part[side], depth + 1, limit) if side.any() else (depth + 1.0,), grow(part[~side], depth + 1, limit))

    size = min(sample, n)
    forest = [grow(x, 0, math.ceil(math.log2(max(size, 2)))) for x in own if len(x)]
    norm = path_length(size) or 1.0

    def scan(batches):
        def depth(tree, v):
            if len(tree) == 1:
                return np.full(len(v), tree[0])
            out, side = np.empty(len(v)), v[:, tree[0]] < tree[1]
            out[side], out[~side] = depth(tree[2], v[side]), depth(tree[3], v[~side])
            return out

        for pdf in batches:
            v = pdf[cols].fillna(0.0).to_numpy(float)
            yield pdf.assign(score=2 ** (-np.mean([depth(t, v) for t in forest], axis=0) / norm))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", score double"
    return df.mapInPandas(scan, schema)


def service_areas(cells: DataFrame, key: str, size: float) -> DataFrame:
    """key, area, length: each key's distinct cells (key, ci, cj) as one area, and the length of its rim."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    sides = cells.withColumn("s", F.explode(steps)).select(key, (F.col("ci") + F.col("s.a")).alias("ci"), (F.col("cj") + F.col("s.b")).alias("cj"))
    rim = sides.join(cells, [key, "ci", "cj"], "left_anti").groupBy(key).agg((F.count(F.lit(1)) * size).alias("length"))
    return cells.groupBy(key).agg((F.count(F.lit(1)) * size * size).alias("area")).join(rim, key)


def circle_features(overlay: DataFrame, key: str, size: float, zone_area: float, zone_length: float, classes: int) -> DataFrame:
    """key, x1 (area-weighted mean of v), x2 (covered share), pct_c1 ... (shares of classes by whole cells), dominant (the
    first largest), area_km2, compactness; overlay: key, v, cls (from 0), area."""
    means = overlay.groupBy(key).agg((F.sum(F.col("v") * F.col("area")) / F.sum("area")).alias("x1"), (F.sum("area") / zone_area).alias("x2"), (F.count(F.lit(1)) * size * size).alias("_s"))
    p = overlay.groupBy(key).pivot("cls", list(range(classes))).agg(F.count(F.lit(1)) * size * size)
    share = lambda c: F.coalesce(F.col(str(c)), F.lit(0.0)) / F.col("_s")
    shares = F.array(*[share(c) for c in range(classes)])
    return means.join(p, key).select(
        key, "x1", "x2", *[share(c).alias(f"pct_c{c + 1}") for c in range(classes)], F.array_position(shares, F.array_max(shares)).alias("dominant"),
        F.lit(zone_area / 1e6).alias("area_km2"), S.compactness(F.lit(zone_area), F.lit(zone_length)).alias("compactness"),
    )


def band_stats(pairs: DataFrame, key: str, bands: list[str]) -> DataFrame:
    """key and, for each band: mean, median, population deviation, 10th and 90th percentile, and sum (at least 0)."""
    of = lambda b: [F.avg(b).alias(f"{b}_mean"), F.percentile(b, 0.5).alias(f"{b}_median"), F.stddev_pop(b).alias(f"{b}_std"), F.percentile(b, 0.1).alias(f"{b}_p10"), F.percentile(b, 0.9).alias(f"{b}_p90"), F.greatest(F.sum(b), F.lit(0.0)).alias(f"{b}_sum")]
    return pairs.groupBy(key).agg(*[x for b in bands for x in of(b)])


def flagged(scores: DataFrame, share: float = 0.04, keep: Column | None = None) -> DataFrame:
    """scores with outlier: above the quantile that leaves `share` of the rows, unless `keep` holds."""
    q = scores.agg(F.percentile("score", 1 - share).alias("_q"))
    out = F.col("score") > F.col("_q")
    return scores.crossJoin(F.broadcast(q)).withColumn("outlier", out if keep is None else out & ~keep).drop("_q")
