"""Points, cells, rectangles: joins by shared grid cells, neighbours, densities, interpolation.

A join never compares all pairs of two tables: each side is keyed by the cells of a lattice that it can touch, rows meet
on equal cells, and the exact test follows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection as P
from .lineage import cut
from .stats import quantiles


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _around(n: int) -> Column:
    r = F.sequence(F.lit(-n), F.lit(n))
    return F.flatten(F.transform(r, lambda i: F.transform(r, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def within(points: DataFrame, sites: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """Pairs of a point (x, y, ...) and a site (sx, sy, ...) at most radius apart, with d2. Cells are of the radius."""
    size = size or radius
    n = math.ceil(radius / size)
    near = points.withColumn("o", F.explode(_around(n))).withColumn("ci", cell(F.col("x"), size) + F.col("o.i")).withColumn("cj", cell(F.col("y"), size) + F.col("o.j")).drop("o")
    keyed = sites.withColumn("ci", cell(F.col("sx"), size)).withColumn("cj", cell(F.col("sy"), size))
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    return near.join(keyed, ["ci", "cj"]).drop("ci", "cj").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def _crowded(sites: DataFrame, k: int, radius: float, most: int = 16, share: float = 0.9) -> float:
    """radius, or as small a part of it as leaves `share` of the sites in cells of `most` * k sites at most: where sites are
    crowded in places, or one lies far away, the mean density says nothing."""
    while True:
        n = sites.groupBy(cell(F.col("sx"), radius), cell(F.col("sy"), radius)).agg(F.count(F.lit(1)).alias("n"))
        n = n.agg(F.sum(F.when(F.col("n") <= most * k, F.col("n")).otherwise(0)).alias("ok"), F.sum("n").alias("all"), F.max("n").alias("top"), F.count(F.lit(1)).alias("cells")).first()
        if not n["all"] or n["ok"] >= share * n["all"] or radius < 1e-9:
            return radius
        radius /= 4


def knn(points: DataFrame, sites: DataFrame, k: int, radius: float, point_id: str, site_id: str, exclude_self: bool = False, grow: float = 4.0) -> DataFrame:
    """For each point its k nearest sites (ties by site id): point_id, site_id, d2, rank.

    Sites inside a radius are ranked; points with fewer than k of them are tried again with a larger radius, until it
    spans both tables. The k nearest are inside the radius once k were found there, so the result is exact. The first
    radius is the given one, or less where sites are so dense that a smaller circle holds a few times k of them: by the mean
    density, then by counts of cells."""
    both = points.select("x", "y", F.lit(0).alias("s")).union(sites.select("sx", "sy", F.lit(1)))
    box = both.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.sum("s")).first()
    wide, high = box[0] or 0.0, box[1] or 0.0
    reach = math.hypot(wide, high) + 1.0
    if box[2] and wide * high > 0:
        radius = min(radius, 2 * math.sqrt(wide * high * k / (math.pi * box[2])))
    radius = _crowded(sites, k, radius)
    w = Window.partitionBy(point_id).orderBy("d2", site_id)
    todo, out = points, None
    while True:
        last = radius >= reach
        pairs = within(todo, sites, min(radius, reach))
        if exclude_self:
            pairs = pairs.filter(F.col(point_id) != F.col(site_id))
        got = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if last:
            return got if out is None else out.unionByName(got)
        got = cut(got)
        full = got.filter(F.col("rank") == k).select(point_id)
        done = got.join(full, point_id, "left_semi")
        out = done if out is None else out.unionByName(done)
        todo = cut(todo.join(full, point_id, "left_anti"))
        if todo.isEmpty():
            return out
        radius *= grow


def rect_pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Overlapping rectangles of a (ax0, ay0, ax1, ay1) and b (bx0, ...), with the area of the overlap.

    Rectangles meet on lattice cells that both touch; a pair is counted in its overlap's lower left cell only."""
    span = lambda lo, hi: F.sequence(cell(lo, size), cell(hi, size))
    left = a.withColumn("ci", F.explode(span(F.col("ax0"), F.col("ax1")))).withColumn("cj", F.explode(span(F.col("ay0"), F.col("ay1"))))
    right = b.withColumn("ci", F.explode(span(F.col("bx0"), F.col("bx1")))).withColumn("cj", F.explode(span(F.col("by0"), F.col("by1"))))
    x0, y0 = F.greatest("ax0", "bx0"), F.greatest("ay0", "by0")
    dx, dy = F.least("ax1", "bx1") - x0, F.least("ay1", "by1") - y0
    own = (cell(x0, size) == F.col("ci")) & (cell(y0, size) == F.col("cj"))
    return left.join(right, ["ci", "cj"]).filter((dx > 0) & (dy > 0) & own).withColumn("area", dx * dy).drop("ci", "cj")


def points_in_rects(points: DataFrame, rects: DataFrame, size: float) -> DataFrame:
    """Points (x, y) inside rectangles (bx0, by0, bx1, by1)."""
    span = lambda lo, hi: F.sequence(cell(lo, size), cell(hi, size))
    left = points.withColumn("ci", cell(F.col("x"), size)).withColumn("cj", cell(F.col("y"), size))
    right = rects.withColumn("ci", F.explode(span(F.col("bx0"), F.col("bx1")))).withColumn("cj", F.explode(span(F.col("by0"), F.col("by1"))))
    return left.join(right, ["ci", "cj"]).filter(F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))).drop("ci", "cj")


def density(cells: DataFrame, points: DataFrame, h: float, reach: float = 8.0) -> DataFrame:
    """Gaussian kernel density at cell centres (ci0, cj0, x, y): sum exp(-d2 / 2 h2) / (2 pi h2) over points within
    reach * h, beyond which a point adds less than 1e-14 of its weight."""
    pairs = within(cells, points, reach * h)
    k = F.exp(-F.col("d2") / (2 * h * h)) / (2 * math.pi * h * h)
    got = pairs.groupBy("ci0", "cj0").agg(F.sum(k).alias("density"))
    return cells.join(got, ["ci0", "cj0"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def row_weights(pairs: DataFrame, point_id: str, kernel: str = "idw") -> DataFrame:
    """Row-normalised weights of neighbour pairs with d2. Points all of whose weights are 0, such as those that lie so far out
    that the Gaussian of their distances is 0, have none."""
    d = F.sqrt("d2")
    own = Window.partitionBy(point_id)  # k rows
    if kernel == "idw":
        w = 1 / (d + 1e-9)
    elif kernel == "bisquare":
        bw = F.max(d).over(own)
        w = F.when(d < bw, F.pow(1 - F.pow(d / bw, 2), 2)).otherwise(0.0)
    else:
        (bw,) = quantiles(pairs, d, [0.5])
        w = F.exp(-0.5 * F.pow(d / F.lit((bw or 0.0) + 1e-9), 2))
    total = pairs.withColumn("k", w).withColumn("_t", F.sum("k").over(own)).filter("_t > 0")
    return total.withColumn("w", F.col("k") / F.col("_t")).drop("k", "_t")


def idw(pairs: DataFrame, point_id: str, value: str, power: float = 2.0, hit: float = 0.0) -> DataFrame:
    """Inverse-distance interpolation over neighbour pairs; a site at distance `hit` or less takes all."""
    d = F.sqrt("d2")
    w = F.when(d > hit, 1 / F.pow(F.when(d > hit, d).otherwise(1.0), power)).otherwise(0.0)
    out = pairs.groupBy(point_id).agg(F.min_by(F.when(d <= hit, F.col(value)), "d2").alias("exact"), (F.sum(w * F.col(value)) / F.sum(F.when(w > 0, w))).alias("mean"))
    return out.select(point_id, F.coalesce("exact", "mean").alias("value"))


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    ll = dx * dx + dy * dy
    t = F.when(ll > 0, ((px - x0) * dx + (py - y0) * dy) / F.when(ll > 0, ll).otherwise(1.0)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (x0 + t * dx), py - (y0 + t * dy))


def smooth(grid: DataFrame, passes: int = 2) -> DataFrame:
    """Synchronous relabelling of cells (ci, cj, label, fixed): an urban cell (0) with three neighbours or more, none of
    them urban, becomes wild (1); a wild one with four or more of which 85 % are urban becomes urban."""
    for _ in range(passes):
        out = grid.select("label", F.col("ci").alias("ni"), F.col("cj").alias("nj")).withColumn("o", F.explode(F.filter(_around(1), lambda o: (o["i"] != 0) | (o["j"] != 0))))
        near = out.groupBy((F.col("ni") + F.col("o.i")).alias("ci"), (F.col("nj") + F.col("o.j")).alias("cj")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == 0).cast("double")).alias("u"))
        label = F.when(F.col("fixed"), F.col("label")).when((F.col("label") == 0) & (F.col("n") >= 3) & (F.col("u") == 0), 1).when((F.col("label") == 1) & (F.col("n") >= 4) & (F.col("u") >= 0.85), 0).otherwise(F.col("label"))
        grid = grid.join(near, ["ci", "cj"], "left").withColumn("label", label).drop("n", "u")
    return grid


def moran(values: DataFrame, pairs: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """Moran's I with binary neighbour weights, its expected value and its z score."""
    t = values.agg(F.avg(value).alias("m"), F.count(value).alias("n"), (F.var_pop(value) * F.count(value)).alias("ss"))
    z = values.crossJoin(F.broadcast(t.select("m"))).select(F.col(key).alias("id"), (F.col(value) - F.col("m")).alias("z"))
    e = pairs.select(key, other).join(z.select(F.col("id").alias(key), F.col("z").alias("zi")), key).join(z.select(F.col("id").alias(other), F.col("z").alias("zj")), other)
    i = e.agg(F.sum(F.col("zi") * F.col("zj")).alias("c"), F.count(F.lit(1)).cast("double").alias("s0"))
    own, back = pairs.select(F.col(key).alias("p"), F.col(other).alias("q")), pairs.select(F.col(other).alias("p"), F.col(key).alias("q"))
    # a pair in both directions counts 2 for each of them, else 1; degrees count both directions
    s1 = own.join(back.withColumn("both", F.lit(True)), ["p", "q"], "left").agg(F.sum(F.when(F.col("both"), 2.0).otherwise(1.0)).alias("s1"))
    s2 = own.select("p").unionAll(back.select("p")).groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s2"))
    n, s0, ei = F.col("n"), F.col("s0"), -1 / (F.col("n") - 1)
    vi = (n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) / (s0 * s0 * (n * n - 1) + 1e-9) - ei * ei
    found = i.crossJoin(t).crossJoin(s1).crossJoin(s2).withColumn("moran_i", n / s0 * F.col("c") / F.col("ss"))
    return found.select("moran_i", ei.alias("expected"), ((F.col("moran_i") - ei) / (F.sqrt(F.abs(vi)) + 1e-9)).alias("z"))


def lattice(spark: SparkSession, x0: float, y0: float, nx: int, ny: int, size: float) -> DataFrame:
    """Cells of a lattice with their centres."""
    out = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("ci0"), F.pmod("id", F.lit(ny)).alias("cj0"))
    return out.withColumn("x", x0 + (F.col("ci0") + 0.5) * size).withColumn("y", y0 + (F.col("cj0") + 0.5) * size)


def ray_cast(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points inside a polygon, by counting crossed edges."""
    inside = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y0 != y1:
            crosses = ((F.col("y") < y0) != (F.col("y") < y1)) & (F.col("x") < x0 + (F.col("y") - y0) * ((x1 - x0) / (y1 - y0)))
            inside = inside + crosses.cast("int")
    return points.filter(inside % 2 == 1)


def density_weights(points: DataFrame, key: str, reach: float = 8.0) -> DataFrame:
    """key, w: inverse of the points' own density, scaled to 0.5 ... 2. Gaussian kernel of the full sample covariance with
    Scott's bandwidth; in coordinates whitened by it, the density is that of a round kernel of width 1."""
    m = points.agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy")).first()
    if not m["n"] or m["n"] < 3 or not m["xx"] or m["xx"] * m["yy"] - m["xy"] ** 2 <= 0:
        return points.select(key, F.lit(1.0).alias("w"))
    f = m["n"] ** (-1 / 6)
    a = math.sqrt(m["xx"]) * f
    b = m["xy"] * f * f / a
    c = math.sqrt(m["yy"] * f * f - b * b)
    u = F.col("x") / a
    white = cut(points.select(key, u.alias("x"), ((F.col("y") - b * u) / c).alias("y")))
    pairs = within(white, white.select(F.col("x").alias("sx"), F.col("y").alias("sy")), reach)
    d = pairs.groupBy(key).agg((F.sum(F.exp(-F.col("d2") / 2)) / (m["n"] * 2 * math.pi * a * c)).alias("d"))
    w = d.select(key, (1 / (F.col("d") + 1e-9)).alias("v"))
    ext = w.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return w.crossJoin(F.broadcast(ext)).select(key, (0.5 + 1.5 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)).alias("w"))


def filled(points: DataFrame, sites: DataFrame, point_id: str, radius: float, k: int = 3, factors: tuple[float, ...] = (1.5, 2.0, 3.0)) -> DataFrame:
    """point_id, value, method: the mean of the sites (sid, sx, sy, sv) within a radius, else within one of the larger ones,
    else interpolated from the k nearest points that have a value, else the median of all."""
    far = max(factors) * radius
    pairs = within(points, sites, far).select(point_id, "sv", "d2")  # summed at once, never written
    steps = (1.0, *factors)
    inside = lambda f: F.col("d2") <= (f * radius) ** 2
    means = cut(pairs.groupBy(point_id).agg(*[F.avg(F.when(inside(f), F.col("sv"))).alias(f"m{i}") for i, f in enumerate(steps)]))
    method = F.lit(None).cast("string")
    for i, f in reversed(list(enumerate(steps))):
        method = F.when(F.col(f"m{i}").isNotNull(), F.lit("direct" if f == 1.0 else f"expanded_{f:g}")).otherwise(method)
    known = cut(means.select(point_id, F.coalesce(*[f"m{i}" for i in range(len(steps))]).alias("value"), method.alias("method")).filter("value is not null"))
    rest = points.select(point_id, "x", "y").join(known, point_id, "left_anti")
    n = known.limit(k).count()
    if n == k:
        at = points.select(F.col(point_id).alias("kid"), F.col("x").alias("sx"), F.col("y").alias("sy")).join(known.select(F.col(point_id).alias("kid"), F.col("value").alias("kv")), "kid")
        near = knn(cut(rest), cut(at), k, far, point_id, "kid")
        more = idw(near, point_id, "kv", hit=1.0).select(point_id, "value", F.lit(f"nearest_{k}").alias("method"))
    else:
        med = known.agg(F.percentile("value", 0.5).alias("value"))
        more = rest.select(point_id).crossJoin(F.broadcast(med)).select(point_id, "value", F.lit("median").alias("method"))
    return known.unionByName(more)


def boundary(cells: DataFrame) -> DataFrame:
    """Cells (ci, cj) of a set that have a side towards a cell outside it, with the number of such sides."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    own = cells.select("ci", "cj").distinct()
    sides = own.withColumn("s", F.explode(steps)).select("ci", "cj", (F.col("ci") + F.col("s.a")).alias("ni"), (F.col("cj") + F.col("s.b")).alias("nj"))
    out = sides.join(own.select(F.col("ci").alias("ni"), F.col("cj").alias("nj")), ["ni", "nj"], "left_anti")
    return out.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("sides"))


def bilinear(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """points (x, y in pixels, of which the centres are whole numbers) with value: the weighted mean of the four pixels
    (row, col, value) around, of those that have a value."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = points.withColumn("o", F.explode(corners)).withColumn("row", F.floor("y").cast("long") + F.col("o.a")).withColumn("col", F.floor("x").cast("long") + F.col("o.b"))
    w = (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col")))
    j = p.join(pixels.filter("value is not null"), ["row", "col"]).withColumn("w", w).filter("w > 0")
    got = j.groupBy(*points.columns).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return points.join(got, points.columns, "left")


def reprojected(pixels: DataFrame, left: float, top: float, res: float, zone: P.Zone, size: float) -> tuple[DataFrame, float, float]:
    """A raster in degrees (row, col, value; its upper left corner, degrees of a pixel) on square pixels of `size` metres in
    a zone's plane: row, col, value where there is one, with the plane's left and top. The origin is a multiple of size."""
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("e")
    corners = pixels.select("row", "col", edge)
    x, y = P.to_plane(left + (F.col("col") + F.col("e.a")) * res, top - (F.col("row") + F.col("e.b")) * res, zone)
    box = corners.agg(F.min(x), F.max(y), F.max(x), F.min(y), F.max("row"), F.max("col")).first()
    if box[0] is None:
        return pixels.select("row", "col", "value").limit(0), left, top
    x0, y1 = math.floor(box[0] / size) * size, math.ceil(box[1] / size) * size
    nx, ny = math.ceil((box[2] - x0) / size), math.ceil((y1 - box[3]) / size)
    grid = pixels.sparkSession.range(nx * ny).select(F.floor(F.col("id") / nx).alias("trow"), F.pmod("id", F.lit(nx)).alias("tcol"))
    lon, lat = P.to_degrees(x0 + (F.col("tcol") + 0.5) * size, y1 - (F.col("trow") + 0.5) * size, zone)
    at = grid.select("trow", "tcol", ((lon - left) / res - 0.5).alias("x"), ((top - lat) / res - 0.5).alias("y"))
    at = at.filter(F.col("x").between(-0.5, box[5] + 0.5) & F.col("y").between(-0.5, box[4] + 0.5))
    out = bilinear(at, pixels.select("row", "col", "value")).filter("value is not null")
    return out.select(F.col("trow").alias("row"), F.col("tcol").alias("col"), "value"), x0, y1


def repaired(pixels: DataFrame, nodata: float) -> DataFrame:
    """pixels with value null where it is the nodata mark, below -1e10 or not a number."""
    v = F.col("value")
    return pixels.withColumn("value", F.when((v == nodata) | (v < -1e10) | F.isnan(v), None).otherwise(v))


def raster_summary(pixels: DataFrame) -> DataFrame:
    """One row: least, largest and mean value, zeros and missing ones."""
    return pixels.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(F.col("value").isNull()).alias("missing"))


def ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1])) / 2 if len(ring) > 2 else 0.0


def nearest_segments(points: DataFrame, lines: DataFrame, point_id: str, reach: float, grow: float = 4.0) -> DataFrame:
    """point_id, dist: to the nearest segment (x0, y0, x1, y1) of a table, exactly: segments and points meet on the cells that a
    segment's box touches within a reach; points that find none within it are tried again further."""
    box = points.select(F.col("x").alias("a"), F.col("y").alias("b")).union(lines.select("x0", "y0")).union(lines.select("x1", "y1")).agg(F.max("a") - F.min("a"), F.max("b") - F.min("b")).first()
    far = math.hypot(box[0] or 0.0, box[1] or 0.0) + 1.0
    todo, out = points, None
    d = segment_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    while True:
        r = min(reach, far)
        span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - r, r), cell(F.greatest(a, b) + r, r)))  # noqa: B023, E731
        touched = lines.withColumn("ci", span(F.col("x0"), F.col("x1"))).withColumn("cj", span(F.col("y0"), F.col("y1")))
        pairs = todo.withColumn("ci", cell(F.col("x"), r)).withColumn("cj", cell(F.col("y"), r)).join(touched.select("x0", "y0", "x1", "y1", "ci", "cj"), ["ci", "cj"])
        got = cut(pairs.groupBy(point_id).agg(F.min(d).alias("dist")).filter(F.col("dist") <= r))
        out = got if out is None else out.unionByName(got)
        if reach >= far:
            return out
        todo = cut(todo.join(got.select(point_id), point_id, "left_anti"))
        if todo.isEmpty():
            return out
        reach *= grow
