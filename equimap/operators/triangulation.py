"""Delaunay triangulation of any number of points, by tiles.

Each tile triangulates its own points and those around it; the circles of the triangles at its own points are then put to
the other tiles that they reach into, which answer with points inside. Tiles that got answers are triangulated again with
them, until no circle holds a point: then each point's triangles are those of the whole set.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

_EPS = 2.0**-52


def _turn(a, b, c) -> Fraction:
    """Above 0 where c lies left of a -> b, exactly."""
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(x), Fraction(y)) for x, y in (a, b, c))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _holds(a, b, c, p) -> bool:
    """Whether the circle of the triangle a, b, c (counterclockwise) holds p, exactly. Without c: whether p lies left of a -> b or
    between them. Of four points on a circle the greatest counts as a little further out, so that all tiles choose alike."""
    if c is None:
        t = _turn(a, b, p)
        return t > 0 or (t == 0 and min(a, b) < p < max(a, b))
    px, py = Fraction(p[0]), Fraction(p[1])
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(x) - px, Fraction(y) - py) for x, y in (a, b, c))
    d = (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)
    if d:
        return d > 0
    top = max(a, b, c, p)
    return False if top == p else _turn(*{a: (b, c, p), b: (c, a, p), c: (a, b, p)}[top]) > 0


def _circle(a, b, c) -> tuple[float, ...]:
    """ax, ay, ux, uy, w, t: points q + a are inside where w * q * q - 2 * q * u < 0, up to an error of 2 * t * |q|."""
    ax, ay = a
    bx, by = b[0] - ax, b[1] - ay
    if c is None:
        return ax, ay, -by, bx, 0.0, 16 * _EPS * (abs(bx) + abs(by))
    cx, cy = c[0] - ax, c[1] - ay
    d, m = 2 * (bx * cy - by * cx), abs(bx * cy) + abs(by * cx)
    if d <= 256 * _EPS * m:
        return ax, ay, 0.0, 0.0, 1.0, math.inf  # too flat for floats
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
    size = abs(ux) + abs(uy)
    return ax, ay, ux, uy, 1.0, 16 * _EPS * (((abs(cy) + abs(cx)) * bb + (abs(by) + abs(bx)) * cc + 2 * size * m) / d + size)


def _power(c: np.ndarray, x, y) -> tuple[np.ndarray, np.ndarray]:
    qx, qy = x - c[0], y - c[1]
    qq = c[4] * (qx * qx + qy * qy)
    return qq - 2 * (qx * c[2] + qy * c[3]), 16 * _EPS * qq + 2 * c[5] * (np.abs(qx) + np.abs(qy))


def triangles(at: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """The Delaunay triangles of distinct points, of which the first three don't lie on a line, counterclockwise; -1 in the last
    place stands for the outside. Points are added one by one: triangles whose circle holds the new point go, and it is
    joined to the hole's rim."""
    n = len(at)
    a, b, c = (0, 1, 2) if _turn(*at[:3]) > 0 else (0, 2, 1)
    tri = [(a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)]
    point = lambda i: None if i < 0 else at[i]
    circles = np.zeros((6, 2 * n))
    circles[:, :4] = np.array([_circle(*map(point, t)) for t in tri]).T
    for k in 3 + np.random.default_rng(0).permutation(n - 3):
        k = int(k)
        p, m = at[k], len(tri)
        f, e = _power(circles[:, :m], *p)
        bad = np.flatnonzero(f < e).tolist()
        bad = [i for i in bad if f[i] < -e[i] or _holds(*map(point, tri[i]), p)]
        sides = {s for i in bad for s in zip(tri[i], tri[i][1:] + tri[i][:1])}
        new = [(j, k, -1) if i < 0 else (k, i, -1) if j < 0 else (i, j, k) for i, j in sides if (j, i) not in sides]
        slots = bad + list(range(m, m + 2))
        tri += [(0, 0, 0)] * 2
        for s, t in zip(slots, new, strict=True):
            tri[s] = t
        circles[:, slots] = np.array([_circle(*map(point, t)) for t in new]).T
    return tri


def _tiles(points: DataFrame, n: int, most: int) -> DataFrame:
    """points with a tile: strips of x, cut by y, of about `most` points."""
    spark, strips = points.sparkSession, math.ceil(math.sqrt(n / most))
    shares = lambda k: [i / k for i in range(1, k)]
    xs = np.unique(points.agg(F.percentile_approx("x", shares(strips), 100 * strips)).first()[0]) if strips > 1 else np.array([])

    def strip(batches):
        for pdf in batches:
            yield pdf.assign(strip=np.searchsorted(xs, pdf["x"].to_numpy(), "right"))

    kept = cut(points.mapInPandas(strip, f"x double, y double, id {dict(points.dtypes)['id']}, strip long"))
    counts = {r[0]: r[1] for r in kept.groupBy("strip").count().collect()}
    fine = math.ceil(max(counts.values()) / most)
    ys: dict[int, np.ndarray] = {}
    if fine > 1:
        for s, q in kept.groupBy("strip").agg(F.percentile_approx("y", shares(fine), 100 * fine)).collect():
            ys[s] = np.unique(q[:: max(1, round(fine * most / counts[s]))])
    first = np.cumsum([0] + [len(ys.get(s, ())) + 1 for s in range(len(xs) + 1)])

    def tile(batches):
        for pdf in batches:
            s, y, t = pdf["strip"].to_numpy(), pdf["y"].to_numpy(), np.zeros(len(pdf), np.int64)
            for v in np.unique(s):
                t[s == v] = first[v] + np.searchsorted(ys.get(v, np.array([])), y[s == v], "right")
            yield pdf.drop(columns="strip").assign(tile=t)

    return kept.mapInPandas(tile, f"x double, y double, id {dict(points.dtypes)['id']}, tile long").repartition(max(1, min(int(first[-1]), 4 * spark.sparkContext.defaultParallelism)), "tile")


def _along(points: DataFrame) -> DataFrame:
    """a, b: the neighbours of points in tiles that all lie on a line."""
    kind = dict(points.dtypes)["id"]

    def chain(pdf):
        import pandas as pd

        ids = pdf.sort_values(["x", "y"])["id"].tolist()
        return pd.DataFrame({"a": ids[:-1], "b": ids[1:]})

    ends = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in points.groupBy("tile").agg(F.min(F.struct("x", "y", "id")).alias("lo"), F.max(F.struct("x", "y", "id")).alias("hi")).collect())
    between = points.sparkSession.createDataFrame([(s[1][2], t[0][2]) for s, t in zip(ends, ends[1:])], f"a {kind}, b {kind}")
    return points.groupBy("tile").applyInPandas(chain, f"a {kind}, b {kind}").unionByName(between)


def delaunay(points: DataFrame, point_id: str, most: int = 2_000, around: float = 3.0) -> DataFrame:
    """a, b: the edges of the Delaunay triangulation of points x, y. Of points at one place the one of the least id counts, those
    without finite places don't. Tiles hold about `most` points and see those as far around them as `around` points lie."""
    kind = dict(points.dtypes)[point_id]
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf) for c in ("x", "y")]
    own = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(point_id).alias("id")).filter(finite[0] & finite[1])
    own = cut(own.select((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"), "id").groupBy("x", "y").agg(F.min("id").alias("id")))
    n = own.count()
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if n < 2:
        return own.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    pts = cut(_tiles(own, n, most))
    first, last = (tuple(r) for r in own.agg(F.min(F.struct("x", "y", "id")), F.max(F.struct("x", "y", "id"))).first())

    def off(batches):
        """The point farthest from the line, of each batch."""
        for pdf in batches:
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            d = np.abs((last[0] - first[0]) * (y - first[1]) - (last[1] - first[1]) * (x - first[0]))
            for i in np.argsort(-d):
                if _turn(first[:2], last[:2], (x[i], y[i])):
                    yield pdf.iloc[[i]].assign(d=d[i])
                    break

    third = pts.mapInPandas(off, f"x double, y double, id {kind}, tile long, d double").orderBy(F.desc("d"), "x", "y").first()
    if third is None:
        return ordered(_along(pts))
    anchors = [first, last, (third["x"], third["y"], third["id"])]
    boxes = pts.groupBy("tile").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("x")).toPandas().sort_values("tile").to_numpy(float)
    names, box = boxes[:, 0].astype(int), boxes[:, 1:5]
    wide, high = box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]
    margin = around * np.maximum(np.sqrt(wide * high / boxes[:, 5]), np.maximum(wide, high) / boxes[:, 5])
    seen = box + margin[:, None] * [-1, -1, 1, 1]
    parts = pts.rdd.getNumPartitions()

    def spread(batches):
        """Points at the tiles that see them."""
        import pandas as pd

        for pdf in batches:
            pdf = pdf.sort_values("x")
            x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            lo, hi = np.searchsorted(x, seen[:, 0]), np.searchsorted(x, seen[:, 2], "right")
            got = [(i, lo[i] + np.flatnonzero((y[lo[i] : hi[i]] >= seen[i, 1]) & (y[lo[i] : hi[i]] <= seen[i, 3]))) for i in np.flatnonzero(lo < hi)]
            for i, at in got:
                if len(at):
                    out = pdf.iloc[at]
                    yield pd.DataFrame({"tile": names[i], "x": out["x"], "y": out["y"], "id": out["id"], "own": out["tile"] == names[i]})

    def stars(pdf):
        """Edges from own points to greater ones, and circles with the tiles (other) that they reach into."""
        import pandas as pd

        tile = int(pdf["tile"].iloc[0])
        rows = {(x, y): (i, False) for x, y, i in anchors}
        for x, y, i, o in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["id"].tolist(), pdf["own"].tolist()):
            rows[x, y] = (i, o or rows.get((x, y), (i, False))[1])
        at, (ids, mine) = list(rows), zip(*rows.values())
        tri = [t for t in triangles(at) if any(i >= 0 and mine[i] for i in t)]
        edges = sorted({s for t in tri for i in range(3) for s in ((t[i], t[i - 1]), (t[i - 1], t[i])) if min(s) >= 0 and mine[s[0]] and at[s[0]] < at[s[1]]})
        me = int(np.searchsorted(names, tile))
        c = np.array([_circle(*(at[i] if i >= 0 else None for i in t)) for t in tri]).T
        with np.errstate(invalid="ignore"):
            x, y = c[0] + c[2], c[1] + c[3]
            r = np.hypot(c[2], c[3]) * (1 + 1e-9) + 2 * c[5] + 1e-9 * (np.abs(x) + np.abs(y))
            inside = (c[4] > 0) & (x - r >= seen[me, 0]) & (y - r >= seen[me, 1]) & (x + r <= seen[me, 2]) & (y + r <= seen[me, 3])
        asks = []
        for k in np.flatnonzero(~inside):
            if c[4, k]:
                dx, dy = np.maximum(np.maximum(box[:, 0] - x[k], x[k] - box[:, 2]), 0), np.maximum(np.maximum(box[:, 1] - y[k], y[k] - box[:, 3]), 0)
                near = np.hypot(dx, dy) <= r[k]
            else:
                f = np.array([_power(c[:, k], box[:, i], box[:, j]) for i in (0, 2) for j in (1, 3)])
                near = (f[:, 0] <= f[:, 1]).any(0)
            near[me] = False
            corners = [v for i in tri[k] for v in (at[i] if i >= 0 else (math.nan, math.nan))]
            asks += [(None, None, int(names[j]), *corners) for j in np.flatnonzero(near)]
        out = [(ids[i], ids[j], None, *[None] * 6) for i, j in edges] + asks
        out = pd.DataFrame(out, columns=["a", "b", "other", "ax", "ay", "bx", "by", "cx", "cy"], dtype=object)
        return out.assign(tile=tile)

    def answers(asked, held):
        """For each circle the point furthest inside, of those of the tile that it was put to."""
        import pandas as pd

        x, y, i = held["x"].to_numpy(), held["y"].to_numpy(), held["id"].tolist()
        found = set()
        for t, ax, ay, bx, by, cx, cy in asked[["tile", "ax", "ay", "bx", "by", "cx", "cy"]].itertuples(index=False):
            a, b, c = (ax, ay), (bx, by), None if math.isnan(cx) else (cx, cy)
            f, e = _power(np.array(_circle(a, b, c)), x, y)
            e = np.where(np.isnan(e), math.inf, e)
            k = int(np.argmin(f))
            if f[k] >= -e[k]:
                unsure = [j for j in np.flatnonzero(f < e) if (x[j], y[j]) not in (a, b, c) and _holds(a, b, c, (x[j], y[j]))]
                if not unsure:
                    continue
                k = unsure[0]
            found.add((t, k))
        return pd.DataFrame([(t, x[k], y[k], i[k], False) for t, k in sorted(found)], columns=["tile", "x", "y", "id", "own"])

    row = f"tile long, x double, y double, id {kind}, own boolean"
    load = cut(pts.mapInPandas(spread, row))
    out = None
    while True:
        got = cut(load.repartition(parts, "tile").groupBy("tile").applyInPandas(stars, f"a {kind}, b {kind}, other long, ax double, ay double, bx double, by double, cx double, cy double, tile long"))
        asks = got.filter("other is not null").repartition(parts, "other")
        held = pts.join(asks.select(F.col("other").alias("tile")).distinct(), "tile", "left_semi").repartition(parts, "tile")
        new = cut(asks.groupBy("other").cogroup(held.groupBy("tile")).applyInPandas(answers, row).distinct())
        again = new.select("tile").distinct()
        done = got.filter("other is null").join(again, "tile", "left_anti").select("a", "b")
        out = done if out is None else out.unionByName(done)
        if new.isEmpty():
            return ordered(out)
        load = cut(load.join(again, "tile", "left_semi").unionByName(new))
