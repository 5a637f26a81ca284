"""Queries of spatial and network operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import network as N
from ..operators import spatial as G
from ..operators import stats as A
from ..operators.lineage import cut
from .registry import Registry
from .tables import CELLS, HALF, POINTS, ROADS, SIZE, TRAVEL, ZONES, cells, nations, points, read, roads, travel, zones

Q = Registry()
KDE_H = 260.0


def _sites(spark, d):
    return points(spark, d).select(F.col("vec_id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("label").alias("slabel"), F.col("v").alias("sv"))


_KDE = f"kde AS (SELECT ci, cj, sum(CASE WHEN (cx - x) ** 2 + (cy - y) ** 2 <= (8 * {KDE_H}) ** 2 THEN exp(-((cx - x) ** 2 + (cy - y) ** 2) / (2 * {KDE_H}::DOUBLE ** 2)) / (2 * pi() * {KDE_H}::DOUBLE ** 2) ELSE 0 END) AS density FROM c, p GROUP BY ci, cj)"
_ENT = "n AS (SELECT CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj, label, count(*) AS n FROM p GROUP BY 1, 2, 3), t AS (SELECT ci, cj, sum(n) AS t FROM n GROUP BY 1, 2), ent AS (SELECT n.ci, n.cj, -sum(n / t * ln(n / t + 1e-12)) AS h FROM n JOIN t ON n.ci = t.ci AND n.cj = t.cj GROUP BY 1, 2)"


@Q(f"""WITH {POINTS}, {CELLS}, {_KDE}, {_ENT}, j AS (SELECT kde.ci, kde.cj, density, h FROM kde JOIN ent ON kde.ci = ent.ci AND kde.cj = ent.cj),
s AS (SELECT avg(density) AS md, stddev_pop(density) AS sd, avg(h) AS mh, stddev_pop(h) AS sh FROM j),
b AS (SELECT ci, cj, density, h, 0.5 * greatest(-3.5, least(3.5, (density - md) / (sd + 1e-9))) + 0.5 * greatest(-3.5, least(3.5, (h - mh) / (sh + 1e-9))) AS b FROM j, s)
SELECT ci, cj, round(density * 1e6, 4) + 0.0 AS density, round(h, 6) + 0.0 AS diversity, round((b - lo) / (hi - lo + 1e-9), 5) + 0.0 AS vitality FROM b, (SELECT min(b) AS lo, max(b) AS hi FROM b)""")
def vitality_grid(spark, d):
    """Density and category diversity of each cell, blended and scaled to [0, 1]."""
    dens = G.density(cells(spark, d), points(spark, d).select(F.col("x").alias("sx"), F.col("y").alias("sy")), KDE_H)
    p = points(spark, d).select(G.cell(F.col("x"), SIZE).alias("ci0"), G.cell(F.col("y"), SIZE).alias("cj0"), "label")
    j = dens.join(A.entropy(p, ["ci0", "cj0"], "label"), ["ci0", "cj0"])
    j = cut(j.select("ci0", "cj0", "density", "entropy"))  # read three times below
    j = A.with_totals(j, md=F.avg("density"), sd=F.stddev_pop("density"), mh=F.avg("entropy"), sh=F.stddev_pop("entropy"))
    b = j.select("ci0", "cj0", "density", "entropy", (0.5 * S.zscore_clip(F.col("density"), F.col("md"), F.col("sd")) + 0.5 * S.zscore_clip(F.col("entropy"), F.col("mh"), F.col("sh"))).alias("b"))
    b = A.with_totals(b, lo=F.min("b"), hi=F.max("b"))
    return b.select(F.col("ci0").alias("ci"), F.col("cj0").alias("cj"), (F.round(F.col("density") * 1e6, 4) + F.lit(0.0)).alias("density"), S.r6(F.col("entropy")).alias("diversity"), (F.round(S.minmax_eps(F.col("b"), F.col("lo"), F.col("hi")), 5) + F.lit(0.0)).alias("vitality"))


@Q(f"WITH {POINTS}, {ZONES} SELECT z.label AS zone, CAST(count(*) AS BIGINT) AS n, round(avg(v), 4) + 0.0 AS mean, round(median(v), 4) + 0.0 AS median, round(stddev_pop(v), 4) + 0.0 AS std, round(quantile_cont(v, 0.1), 4) + 0.0 AS p10, round(quantile_cont(v, 0.9), 4) + 0.0 AS p90, round(avg((p.label = z.label)::DOUBLE), 6) AS share FROM z JOIN p ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 GROUP BY z.label")
def zonal_stats(spark, d):
    j = G.points_in_rects(points(spark, d), zones(spark, d).withColumnRenamed("label", "zone"), 2 * HALF)
    q = lambda p: F.round(F.percentile("v", p), 4) + F.lit(0.0)
    return j.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("v"), 4) + F.lit(0.0)).alias("mean"), q(0.5).alias("median"), (F.round(F.stddev_pop("v"), 4) + F.lit(0.0)).alias("std"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.round(F.avg((F.col("label") == F.col("zone")).cast("double")), 6).alias("share"))


@Q(f"WITH {POINTS}, {CELLS} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT ci * 100000 + cj) AS BIGINT) AS cells FROM p JOIN c ON ci = CAST(floor(x / 500) AS BIGINT) AND cj = CAST(floor(y / 500) AS BIGINT) GROUP BY label")
def point_in_cell(spark, d):
    p = points(spark, d).withColumn("ci", G.cell(F.col("x"), SIZE)).withColumn("cj", G.cell(F.col("y"), SIZE))
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("ci") * 100000 + F.col("cj")).alias("cells"))


_RECT = f"""WITH {POINTS}, {ZONES}, {CELLS}, o AS (SELECT z.label AS zone, ci, cj, (ci * 7 + cj * 3 + 100000) % 11 AS v, greatest(0, least(bx1, cx + 250) - greatest(bx0, cx - 250)) * greatest(0, least(by1, cy + 250) - greatest(by0, cy - 250)) AS area FROM z, c)"""


@Q(_RECT + " SELECT zone, ci, cj, round(area, 3) AS area FROM o WHERE area > 0")
def rect_overlay(spark, d):
    return _overlay(spark, d).select("zone", "ci", "cj", F.round("area", 3).alias("area"))


def _overlay(spark, d):
    h = SIZE / 2
    a = cells(spark, d).select(F.col("ci0").alias("c_i"), F.col("cj0").alias("c_j"), (F.col("x") - h).alias("ax0"), (F.col("y") - h).alias("ay0"), (F.col("x") + h).alias("ax1"), (F.col("y") + h).alias("ay1"))
    return G.rect_pairs(a, zones(spark, d).withColumnRenamed("label", "zone"), SIZE).withColumnsRenamed({"c_i": "ci", "c_j": "cj"})


@Q(_RECT + " SELECT zone, round(sum(v * area) / sum(area), 6) AS mean, round(sum(area) / 9000000, 6) AS cover FROM o WHERE area > 0.01 GROUP BY zone")
def area_weighted_mean(spark, d):
    o = _overlay(spark, d).filter("area > 0.01").withColumn("v", F.pmod(F.col("ci") * 7 + F.col("cj") * 3 + 100000, F.lit(11)))
    return o.groupBy("zone").agg(F.round(F.sum(F.col("v") * F.col("area")) / F.sum("area"), 6).alias("mean"), F.round(F.sum("area") / (4 * HALF * HALF), 6).alias("cover"))


_KNN = f"{POINTS}, k AS (SELECT a.vec_id, b.vec_id AS sid, a.v, b.v AS sv, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.vec_id) AS rank FROM p a, p b WHERE a.vec_id <> b.vec_id), k6 AS (SELECT * FROM k WHERE rank <= 6)"


def _neighbours(spark, d, k=6):
    return G.knn(points(spark, d), _sites(spark, d), k, 700.0, "vec_id", "sid", exclude_self=True)


@Q(f"WITH {_KNN} SELECT vec_id, sid, CAST(rank AS INTEGER) AS rank, round(sqrt(d2), 4) AS dist FROM k6")
def knn_k6(spark, d):
    return _neighbours(spark, d).select("vec_id", "sid", "rank", F.round(F.sqrt("d2"), 4).alias("dist"))


@Q(f"WITH {_KNN}, w AS (SELECT vec_id, sv, (1 / (sqrt(d2) + 1e-9)) / sum(1 / (sqrt(d2) + 1e-9)) OVER (PARTITION BY vec_id) AS w FROM k6) SELECT vec_id, round(sum(w * sv), 4) + 0.0 AS lag FROM w GROUP BY vec_id")
def spatial_lag(spark, d):
    w = G.row_weights(_neighbours(spark, d), "vec_id")
    return w.groupBy("vec_id").agg((F.round(F.sum(F.col("w") * F.col("sv")), 4) + F.lit(0.0)).alias("lag"))


@Q(f"WITH {_KNN} SELECT vec_id, round(sum(sv / d2) / sum(1 / d2), 4) + 0.0 AS value FROM k6 WHERE d2 > 0 GROUP BY vec_id")
def idw_fill(spark, d):
    return G.idw(_neighbours(spark, d), "vec_id", "sv").select("vec_id", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@Q(f"WITH {_KNN}, m AS (SELECT avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS ss FROM p) SELECT round(n / count(*) * sum((k6.v - m) * (sv - m)) / ss, 6) + 0.0 AS moran_i FROM k6, m GROUP BY n, ss")
def morans_i(spark, d):
    return G.moran(points(spark, d).select("vec_id", "v"), _neighbours(spark, d).select("vec_id", "sid"), "vec_id", "sid", "v").select(S.r6(F.col("moran_i")).alias("moran_i"))


@Q(f"WITH {POINTS}, q AS (SELECT a.vec_id, min(CASE WHEN d <= 400 THEN 1.0 WHEN d <= 600 THEN 1.5 WHEN d <= 800 THEN 2.0 WHEN d <= 1200 THEN 3.0 END) AS f FROM p a LEFT JOIN (SELECT a.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a, p b WHERE b.label = 0 AND a.label <> 0) e ON a.vec_id = e.vec_id WHERE a.label <> 0 GROUP BY a.vec_id) SELECT vec_id, f::DOUBLE AS factor, CASE WHEN f = 1 THEN 'direct' WHEN f IS NULL THEN 'median' ELSE 'expanded' END AS method FROM q")
def fallback_tiers(spark, d):
    a = points(spark, d).filter("label <> 0")
    b = _sites(spark, d).filter("slabel = 0")
    r = F.sqrt("d2")
    f = F.when(r <= 400, 1.0).when(r <= 600, 1.5).when(r <= 800, 2.0).otherwise(3.0)
    got = G.within(a, b, 1200.0).groupBy("vec_id").agg(F.min(f).alias("factor"))
    return a.select("vec_id").join(got, "vec_id", "left").select("vec_id", "factor", F.when(F.col("factor") == 1, "direct").when(F.col("factor").isNull(), "median").otherwise("expanded").alias("method"))


@Q(f"WITH {POINTS}, r AS (SELECT vec_id, greatest(0.0, least(1.0, ((x + 3000) * 6000 + (y + 1000) * 2000) / 40000000.0::DOUBLE)) AS t, x, y FROM p) SELECT vec_id, round(sqrt((x - (-3000 + t * 6000)) ** 2 + (y - (-1000 + t * 2000)) ** 2), 4) AS river, round(sqrt(x * x + y * y), 4) AS centre FROM r")
def nearest_line(spark, d):
    p = points(spark, d)
    return p.select("vec_id", F.round(G.segment_distance(F.col("x"), F.col("y"), *[F.lit(v) for v in (-3000.0, -1000.0, 3000.0, 1000.0)]), 4).alias("river"), F.round(F.hypot("x", "y"), 4).alias("centre"))


@Q(f"WITH {POINTS} SELECT vec_id, round(exp(-2e-7 * ((x - 500) ** 2 + (y + 500) ** 2)), 6) AS f0, round(exp(-2e-7 * ((x + 800) ** 2 + (y - 100) ** 2)), 6) AS f1 FROM p")
def rbf_fixed_anchor(spark, d):
    f = lambda a, b: F.round(F.exp(-2e-7 * (F.pow(F.col("x") - a, 2) + F.pow(F.col("y") - b, 2))), 6)
    return points(spark, d).select("vec_id", f(500, -500).alias("f0"), f(-800, 100).alias("f1"))


_SMOOTH = "g{n} AS (SELECT a.ci, a.cj, CASE WHEN any_value(a.fixed) THEN any_value(a.label) WHEN any_value(a.label) = 0 AND count(b.ci) >= 3 AND coalesce(avg((b.label = 0)::DOUBLE), 0) = 0 THEN 1 WHEN any_value(a.label) = 1 AND count(b.ci) >= 4 AND avg((b.label = 0)::DOUBLE) >= 0.85 THEN 0 ELSE any_value(a.label) END AS label, any_value(a.fixed) AS fixed FROM g{m} a LEFT JOIN g{m} b ON abs(a.ci - b.ci) <= 1 AND abs(a.cj - b.cj) <= 1 AND (a.ci <> b.ci OR a.cj <> b.cj) GROUP BY a.ci, a.cj)"


@Q(f"WITH {POINTS}, {CELLS}, g0 AS (SELECT ci, cj, CASE WHEN (ci * 13 + cj * 7 + 100000) % 5 < 2 THEN 0 ELSE 1 END AS label, (ci + cj + 100000) % 9 = 0 AS fixed FROM c), {_SMOOTH.format(n=1, m=0)}, {_SMOOTH.format(n=2, m=1)} SELECT ci, cj, label FROM g2")
def smooth_grid(spark, d):
    i, j = F.col("ci0"), F.col("cj0")
    g = cells(spark, d).select(i.alias("ci"), j.alias("cj"), F.when(F.pmod(i * 13 + j * 7 + 100000, F.lit(5)) < 2, 0).otherwise(1).alias("label"), (F.pmod(i + j + 100000, F.lit(9)) == 0).alias("fixed"))
    return G.smooth(g).select("ci", "cj", "label")


@Q("SELECT CAST(floor(p_retailprice / 100) AS BIGINT) AS col, CAST(floor((50 - p_size) / 5) AS BIGINT) AS row, max(p_partkey) AS value FROM part GROUP BY 1, 2")
def raster_cells(spark, d):
    p = read(spark, d, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"), "p_partkey")
    return p.groupBy(F.floor(F.col("x") / 100).alias("col"), F.floor((50 - F.col("y")) / 5).alias("row")).agg(F.max("p_partkey").alias("value"))


@Q(f"WITH {ROADS} SELECT a AS origin, b AS node, round(d, 9) AS d FROM d5 WHERE d <= 12")
def sssp_cutoff(spark, d):
    """Shortest paths up to a cutoff between all nations."""
    return N.shortest(cut(N.directed(roads(spark, d))), nations(spark, d), 12.0).withColumn("d", F.round("d", 9))


@Q(f"WITH {ROADS} SELECT d5.a AS origin, e.a AS src, e.b AS dst, round(least(1.0, (12 - d) / w), 6) AS share FROM d5 JOIN e ON d5.b = e.a WHERE d < 12")
def reach_truncate(spark, d):
    e = cut(N.directed(roads(spark, d)))
    return N.reachable(e, N.shortest(e, nations(spark, d), 12.0), 12.0).select("origin", "src", "dst", F.round("share", 6).alias("share"))


@Q(f"WITH {TRAVEL} SELECT i, j, round(t, 6) AS t FROM od")
def od_minutes(spark, d):
    return travel(spark, d).select("i", "j", F.round("t", 6).alias("t"))


_SFCA = f"""{TRAVEL}, dem AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS d FROM customer GROUP BY 1), sup AS (SELECT l_suppkey AS j, sum(l_quantity) AS s FROM lineitem GROUP BY 1),
f AS (SELECT i, j, exp(-0.15 * (t / 5) ** 2) AS f FROM od WHERE t <= 5), l AS (SELECT j, sum(d * f) AS l FROM f JOIN dem USING (i) GROUP BY j), r AS (SELECT sup.j, CASE WHEN s <= 0 THEN 0 WHEN coalesce(l, 0) <= 1e-6 THEN s ELSE s / l END AS r FROM sup LEFT JOIN l ON sup.j = l.j),
a0 AS (SELECT i, sum(r * f) AS a FROM f JOIN r USING (j) GROUP BY i), acc AS (SELECT dem.i, coalesce(a, 0) AS a FROM dem LEFT JOIN a0 ON dem.i = a0.i)"""


def _access(spark, d):
    dem = read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    sup = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("s"))
    return N.two_step(travel(spark, d), sup, dem, 5.0)


@Q(f"WITH {_SFCA} SELECT i, round(a, 5) + 0.0 AS a FROM acc")
def sfca_two_step(spark, d):
    return _access(spark, d).select("i", (F.round("a", 5) + F.lit(0.0)).alias("a"))


@Q(f"WITH {_SFCA} SELECT i, a = 0 OR a <= q AS low FROM acc, (SELECT quantile_cont(a, 0.25) FILTER (a > 0) AS q FROM acc)")
def low_access_mask(spark, d):
    return N.low_access(_access(spark, d)).select("i", "low")


@Q(f"WITH {TRAVEL}, b AS (SELECT i, min(t) FILTER (j % 2 = 0 AND t <= 3) AS p, min(t) FILTER (j % 2 = 1 AND t <= 4) AS m FROM od GROUP BY i) SELECT i, round(CASE WHEN p IS NULL AND m IS NULL THEN NULL ELSE (coalesce(p * 0.667, 0) + coalesce(m * 0.333, 0)) / (CASE WHEN p IS NULL THEN 0 ELSE 0.667 END + CASE WHEN m IS NULL THEN 0 ELSE 0.333 END) END, 6)::DOUBLE AS t FROM b")
def nearest_access(spark, d):
    od = travel(spark, d).withColumn("stage", F.when(F.pmod("j", F.lit(2)) == 0, "primary").otherwise("middle"))
    return N.nearest_time(od, {"primary": 3.0, "middle": 4.0}, {"primary": 0.667, "middle": 0.333}).select("i", F.round("t", 6).alias("t"))


@Q("SELECT o_orderpriority AS cls, round(1 - sum(unmet) / sum(o_totalprice), 6) AS coverage FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.25 ELSE 0 END AS unmet FROM orders) GROUP BY 1")
def coverage_by_class(spark, d):
    unmet = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 0.25).otherwise(0.0)
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cls")).agg(F.round(1 - F.sum(unmet) / F.sum("o_totalprice"), 6).alias("coverage"))


@Q(_RECT + ", a AS (SELECT zone, (ci + cj + 100000) % 3 AS cls, sum(area) AS area FROM o WHERE area > 0 GROUP BY 1, 2) SELECT zone, round(coalesce(sum(area) FILTER (cls = 0), 0), 3) AS c0, round(coalesce(sum(area) FILTER (cls = 1), 0), 3) AS c1, round(coalesce(sum(area) FILTER (cls = 2), 0), 3) AS c2 FROM a GROUP BY zone")
def community_map(spark, d):
    o = _overlay(spark, d).withColumn("cls", F.pmod(F.col("ci") + F.col("cj") + 100000, F.lit(3)))
    p = o.groupBy("zone").pivot("cls", [0, 1, 2]).agg(F.sum("area"))
    return p.select("zone", *[F.round(F.coalesce(F.col(str(k)), F.lit(0.0)), 3).alias(f"c{k}") for k in range(3)])


@Q(f"WITH {POINTS}, h AS (SELECT quantile_cont(v, 0.8) AS q FROM p), {CELLS}, m AS (SELECT CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj, max(v) AS v FROM p GROUP BY 1, 2) SELECT ci, cj, v >= q AS high FROM m, h")
def high_pressure_cells(spark, d):
    p = A.with_totals(points(spark, d), q=F.percentile("v", 0.8))
    return p.groupBy(G.cell(F.col("x"), SIZE).alias("ci"), G.cell(F.col("y"), SIZE).alias("cj")).agg((F.max("v") >= F.max("q")).alias("high"))


@Q(f"WITH {POINTS}, e(x0, y0, x1, y1) AS (VALUES (-2000.0, -2000.0, 2500.0, -1500.0), (2500.0, -1500.0, 1000.0, 2200.0), (1000.0, 2200.0, -2000.0, -2000.0)) SELECT vec_id FROM p, e GROUP BY vec_id HAVING sum(CASE WHEN (y < y0) <> (y < y1) AND x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) THEN 1 ELSE 0 END) % 2 = 1")
def point_in_polygon(spark, d):
    return G.ray_cast(points(spark, d), [(-2000.0, -2000.0), (2500.0, -1500.0), (1000.0, 2200.0)]).select("vec_id")
