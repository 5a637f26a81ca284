"""Queries of regions, service areas, weights, fills, rasters and joins on derived keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection as R
from ..functions import scalar as S
from ..operators import models as M
from ..operators import network as N
from ..operators import planning as P
from ..operators import polygons as PG
from ..operators import spatial as G
from ..operators import stats as A
from ..operators import triangulation as T
from ..operators.lineage import cut
from ..sources import files as IO
from .registry import Registry
from .spatial_queries import _KNN, _RECT, _neighbours, _overlay, _sites
from .tables import CELLS, HALF, POINTS, ROADS, SIZE, ZONES, cells, nations, points, read, roads, zones

Q = Registry()


def _weights_sql(k):
    return f"WITH {_KNN}, r AS (SELECT vec_id, sv, sqrt(d2) AS d FROM k6), w AS (SELECT vec_id, sv, {k} AS w FROM r) SELECT vec_id, round(sum(w * sv) / sum(w), 4) + 0.0 AS lag FROM w GROUP BY vec_id HAVING sum(w) > 0"


def _lag(spark, d, kernel):
    w = G.row_weights(_neighbours(spark, d), "vec_id", kernel)
    return w.groupBy("vec_id").agg((F.round(F.sum(F.col("w") * F.col("sv")), 4) + F.lit(0.0)).alias("lag"))


@Q(_weights_sql("exp(-0.5 * (d / ((SELECT median(d) FROM r) + 1e-9)) ** 2)"))
def gaussian_lag(spark, d):
    return _lag(spark, d, "gaussian")


@Q(_weights_sql("CASE WHEN d < max(d) OVER (PARTITION BY vec_id) THEN (1 - (d / max(d) OVER (PARTITION BY vec_id)) ** 2) ** 2 ELSE 0 END"))
def bisquare_lag(spark, d):
    return _lag(spark, d, "bisquare")


@Q(f"""WITH {_KNN}, m AS (SELECT avg(v) AS m, count(*)::DOUBLE AS n, var_pop(v) * count(*) AS ss FROM p), i AS (SELECT n / count(*) * sum((k6.v - m) * (sv - m)) / ss AS i, count(*)::DOUBLE AS s0, n FROM k6, m GROUP BY n, ss),
s1 AS (SELECT sum(CASE WHEN b.vec_id IS NULL THEN 1 ELSE 2 END)::DOUBLE AS s1 FROM k6 a LEFT JOIN k6 b ON a.vec_id = b.sid AND a.sid = b.vec_id), s2 AS (SELECT sum(k * k)::DOUBLE AS s2 FROM (SELECT count(*) AS k FROM (SELECT vec_id AS p FROM k6 UNION ALL SELECT sid FROM k6) GROUP BY p))
SELECT round(i, 6) + 0.0 AS moran_i, round(-1 / (n - 1), 8) AS expected, round((i + 1 / (n - 1)) / (sqrt(abs((n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1) + 1e-9) - 1 / ((n - 1) * (n - 1)))) + 1e-9), 4) + 0.0 AS z FROM i, s1, s2""")
def moran_z(spark, d):
    m = G.moran(points(spark, d).select("vec_id", "v"), cut(_neighbours(spark, d).select("vec_id", "sid")), "vec_id", "sid", "v")
    return m.select(S.r6(F.col("moran_i")).alias("moran_i"), F.round("expected", 8).alias("expected"), (F.round("z", 4) + F.lit(0.0)).alias("z"))


@Q(f"""WITH {POINTS}, m AS (SELECT count(*)::DOUBLE AS n, var_samp(x) * count(*) ** (-1 / 3.0::DOUBLE) AS a, var_samp(y) * count(*) ** (-1 / 3.0::DOUBLE) AS c, covar_samp(x, y) * count(*) ** (-1 / 3.0::DOUBLE) AS b FROM p),
k AS (SELECT q.vec_id, sum(exp(-0.5 * (c * (q.x - p.x) ** 2 - 2 * b * (q.x - p.x) * (q.y - p.y) + a * (q.y - p.y) ** 2) / (a * c - b * b))) / (any_value(n) * 2 * pi() * sqrt(any_value(a * c - b * b))) AS d FROM p q, p, m GROUP BY q.vec_id), w AS (SELECT vec_id, 1 / (d + 1e-9) AS v FROM k)
SELECT vec_id, round(0.5 + 1.5 * (v - lo) / (hi - lo + 1e-9), 5) AS w FROM w, (SELECT min(v) AS lo, max(v) AS hi FROM w)""")
def density_weights(spark, d):
    return G.density_weights(points(spark, d), "vec_id").select("vec_id", F.round("w", 5).alias("w"))


@Q(f"""WITH {POINTS}, a AS (SELECT * FROM p WHERE label <> 0), b AS (SELECT vec_id AS sid, x AS sx, y AS sy, v AS sv FROM p WHERE label = 0), pr AS (SELECT vec_id, sv, (x - sx) ** 2 + (y - sy) ** 2 AS d2 FROM a, b),
m AS (SELECT vec_id, avg(sv) FILTER (d2 <= 200 ** 2) AS m0, avg(sv) FILTER (d2 <= 300 ** 2) AS m1, avg(sv) FILTER (d2 <= 400 ** 2) AS m2, avg(sv) FILTER (d2 <= 600 ** 2) AS m3 FROM pr GROUP BY vec_id),
kn AS (SELECT vec_id, coalesce(m0, m1, m2, m3) AS value, CASE WHEN m0 IS NOT NULL THEN 'direct' WHEN m1 IS NOT NULL THEN 'expanded_1.5' WHEN m2 IS NOT NULL THEN 'expanded_2' ELSE 'expanded_3' END AS method FROM m WHERE coalesce(m0, m1, m2, m3) IS NOT NULL),
kp AS (SELECT kn.vec_id AS kid, x AS kx, y AS ky, value AS kv FROM kn JOIN a ON kn.vec_id = a.vec_id), rs AS (SELECT * FROM a WHERE vec_id NOT IN (SELECT vec_id FROM kn)),
nn AS (SELECT vec_id, kv, sqrt((x - kx) ** 2 + (y - ky) ** 2) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY (x - kx) ** 2 + (y - ky) ** 2, kid) AS k FROM rs, kp),
id AS (SELECT vec_id, coalesce(min_by(CASE WHEN d <= 1 THEN kv END, d), sum(CASE WHEN d > 1 THEN kv / d ** 2 ELSE 0 END) / sum(CASE WHEN d > 1 THEN 1 / d ** 2 END)) AS value FROM nn WHERE k <= 3 GROUP BY vec_id)
SELECT vec_id, round(value, 4) + 0.0 AS value, method FROM kn UNION ALL SELECT vec_id, round(value, 4) + 0.0, 'nearest_3' FROM id""")
def filled_tiers(spark, d):
    """Direct values, larger radii, then the nearest points that have one."""
    b = _sites(spark, d).filter("slabel = 0").select("sid", "sx", "sy", "sv")
    f = G.filled(cut(points(spark, d).filter("label <> 0")), cut(b), "vec_id", 200.0)
    return f.select("vec_id", (F.round("value", 4) + F.lit(0.0)).alias("value"), "method")


_OD = f"""{POINTS}, {ROADS}, g AS (SELECT * FROM p WHERE label < 5), s AS (SELECT * FROM p WHERE label >= 5), c AS (SELECT g.vec_id AS i, s.vec_id AS j, sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) AS dist, abs(g.v) AS snap, g.vec_id % 25 AS ni, s.vec_id % 25 AS nj, row_number() OVER (PARTITION BY g.vec_id ORDER BY (g.x - s.x) ** 2 + (g.y - s.y) ** 2, s.vec_id) AS k FROM g, s),
o AS (SELECT i, j, CASE WHEN snap <= 500 AND d5.d <= 1.5 THEN d5.d WHEN dist <= CASE WHEN j % 2 = 0 THEN 800 ELSE 1600 END THEN dist * 1.35 / CASE WHEN j % 2 = 0 THEN 75 ELSE 240 END END AS t, snap <= 500 AND d5.d <= 1.5 AS net FROM c LEFT JOIN d5 ON d5.a = ni AND d5.b = nj WHERE k <= 15)"""


@Q(f"WITH {_OD} SELECT i, j, round(t, 5) AS t, CASE WHEN net THEN 'network' ELSE 'straight' END AS source FROM o WHERE t IS NOT NULL")
def od_network(spark, d):
    """Times to the 15 nearest sites: by the nations' roads where the origin snaps, else straight within a limit."""
    p = points(spark, d)
    g = p.filter("label < 5").select(F.col("vec_id").alias("i"), "x", "y", "v")
    s = p.filter("label >= 5").select(F.col("vec_id").alias("j"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    near = G.knn(cut(g), cut(s), 15, 1000.0, "i", "j")
    stage = F.when(F.pmod("j", F.lit(2)) == 0, "primary").otherwise("middle")
    c = near.select("i", "j", stage.alias("stage"), F.sqrt("d2").alias("dist"), F.abs("v").alias("snap_i"), F.pmod("i", F.lit(25)).alias("ni"), F.pmod("j", F.lit(25)).alias("nj"))
    net = N.shortest(cut(N.directed(roads(spark, d))), nations(spark, d), 1.5)
    od = N.od_minutes(c, net, {"primary": 75.0, "middle": 240.0}, {"primary": 800.0, "middle": 1600.0}, 1.5, 500.0)
    return od.select("i", "j", F.round("t", 5).alias("t"), "source")


@Q(f"""WITH {POINTS}, m AS (SELECT DISTINCT CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj FROM p, (SELECT quantile_cont(v, 0.8) AS q FROM p) WHERE v >= q), s(a, b) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0))
SELECT m.ci, m.cj, CAST(count(*) AS BIGINT) AS sides FROM m, s LEFT JOIN m n ON n.ci = m.ci + a AND n.cj = m.cj + b WHERE n.ci IS NULL GROUP BY m.ci, m.cj""")
def boundary_cells(spark, d):
    """The rim of the cells of high pressure."""
    p = A.with_totals(points(spark, d), q=F.percentile("v", 0.8)).filter("v >= q")
    return G.boundary(cut(p.select(G.cell(F.col("x"), SIZE).alias("ci"), G.cell(F.col("y"), SIZE).alias("cj")).distinct()))


@Q(f"""WITH {POINTS}, q AS (SELECT DISTINCT label, CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj FROM p), s(a, b) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
e AS (SELECT q.label, count(*) AS sides FROM q, s LEFT JOIN q n ON n.label = q.label AND n.ci = q.ci + a AND n.cj = q.cj + b WHERE n.ci IS NULL GROUP BY q.label), f AS (SELECT label, min(vec_id) AS first_id FROM p GROUP BY label)
SELECT CAST(rank() OVER (ORDER BY q.label DESC) AS BIGINT) AS number, q.label, first_id, count(*) * 250000.0::DOUBLE AS area, any_value(sides) * 500.0::DOUBLE AS length FROM q JOIN e ON q.label = e.label JOIN f ON q.label = f.label GROUP BY q.label, first_id""")
def service_table(spark, d):
    """Each label's cells as one area, numbered anew, with an attribute, area and length of its rim."""
    p = points(spark, d)
    c = cut(p.select("label", G.cell(F.col("x"), SIZE).alias("ci"), G.cell(F.col("y"), SIZE).alias("cj")).distinct())
    t = P.service_areas(c, "label", SIZE).join(p.groupBy("label").agg(F.min("vec_id").alias("first_id")), "label")
    return A.ranks(t.withColumn("_l", F.col("label").cast("double")), "_l", descending=True).select(F.col("rank_min").alias("number"), "label", "first_id", "area", "length")


@Q(_RECT + """, t AS (SELECT zone, sum(area) AS t, sum(v * area) / sum(area) AS x1, sum(area) / 9000000 AS x2 FROM o WHERE area > 0.01 GROUP BY zone), k AS (SELECT zone, (ci + cj + 100000) % 6 AS cls, count(*) * 250000.0::DOUBLE AS a FROM o WHERE area > 0.01 GROUP BY 1, 2), s AS (SELECT zone, sum(a) AS s FROM k GROUP BY zone)
SELECT k.zone, round(any_value(x1), 5) + 0.0 AS x1, round(any_value(x2), 5) + 0.0 AS x2, """ + ", ".join(f"round(coalesce(sum(a) FILTER (cls = {c}), 0) / any_value(s), 6) AS pct_c{c + 1}" for c in range(6)) + """, CAST(arg_min(cls, (-a, cls)) AS BIGINT) + 1 AS dominant, 9.0::DOUBLE AS area_km2, round(4 * pi() * 9e6 / (12000.0::DOUBLE ** 2 + 1e-9), 6) AS compactness FROM k JOIN t ON k.zone = t.zone JOIN s ON k.zone = s.zone GROUP BY k.zone""")
def lifecircle_features(spark, d):
    """For each zone: area-weighted mean, density, shares of six classes by whole cells, the dominant one, area, compactness."""
    o = _overlay(spark, d).filter("area > 0.01").withColumn("v", F.pmod(F.col("ci") * 7 + F.col("cj") * 3 + 100000, F.lit(11))).withColumn("cls", F.pmod(F.col("ci") + F.col("cj") + 100000, F.lit(6)))
    f = P.circle_features(cut(o), "zone", SIZE, 4 * HALF * HALF, 8 * HALF, 6)
    return f.select("zone", (F.round("x1", 5) + F.lit(0.0)).alias("x1"), (F.round("x2", 5) + F.lit(0.0)).alias("x2"), *[F.round(f"pct_c{c}", 6).alias(f"pct_c{c}") for c in range(1, 7)], "dominant", "area_km2", F.round("compactness", 6).alias("compactness"))


@Q("""WITH p AS (SELECT CASE WHEN p_size = 7 THEN -9999.0 WHEN p_size = 8 THEN -1e11 WHEN p_size < 4 THEN 0.0 ELSE p_retailprice END AS v FROM part), r AS (SELECT CASE WHEN v = -9999 OR v < -1e10 THEN NULL ELSE v END AS v FROM p)
SELECT 'before' AS step, round(min(v), 2) AS lo, round(max(v), 2) AS hi, round(avg(v), 2) AS mean, CAST(count(*) FILTER (v = 0) AS BIGINT) AS zeros, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS missing FROM p UNION ALL SELECT 'after', round(min(v), 2), round(max(v), 2), round(avg(v), 2), CAST(count(*) FILTER (v = 0) AS BIGINT), CAST(count(*) FILTER (v IS NULL) AS BIGINT) FROM r""")
def nodata_repair(spark, d):
    """A raster's figures before and after its nodata marks are repaired."""
    s = F.col("p_size")
    p = read(spark, d, "part").select(F.when(s == 7, -9999.0).when(s == 8, -1e11).when(s < 4, 0.0).otherwise(F.col("p_retailprice")).alias("value"))
    of = lambda df, name: G.raster_summary(df).select(F.lit(name).alias("step"), *[F.round(c, 2).alias(c) for c in ("lo", "hi", "mean")], "zeros", "missing")
    return of(p, "before").unionByName(of(G.repaired(p, -9999.0), "after"))


@Q("""WITH px AS (SELECT p_partkey // 20 AS r, p_partkey % 20 AS c, p_retailprice AS g, p_size * 20.0::DOUBLE AS s FROM part), q AS (SELECT r, c, r + 0.25 AS y, c + 0.6 AS x, g FROM px),
b AS (SELECT q.r, q.c, any_value(q.g) AS g, sum((1 - abs(y - px.r)) * (1 - abs(x - px.c)) * px.s) / sum((1 - abs(y - px.r)) * (1 - abs(x - px.c))) AS s FROM q JOIN px ON px.r IN (q.r, q.r + 1) AND px.c IN (q.c, q.c + 1) GROUP BY q.r, q.c)
SELECT r AS row, c AS col, round((g - s)::DOUBLE / CASE WHEN g + s = 0 THEN 1e-9 ELSE g + s END, 6) + 0.0 AS idx FROM b""")
def aligned_index(spark, d):
    """A difference index of two rasters, of which the second is resampled at a quarter and six tenths of a pixel further."""
    k = F.col("p_partkey")
    px = read(spark, d, "part").select(F.floor(k / 20).alias("row"), F.pmod(k, F.lit(20)).alias("col"), F.col("p_retailprice").alias("g"), (F.col("p_size") * 20.0).alias("s"))
    at = px.select((F.col("row") + 0.25).alias("y"), (F.col("col") + 0.6).alias("x"))
    other = G.bilinear(at, px.select("row", "col", F.col("s").alias("value"))).select(F.floor("y").alias("row"), F.floor("x").alias("col"), "value")
    j = px.join(other, ["row", "col"])
    return j.select("row", "col", S.r6(S.water_index(F.col("g"), F.col("value"))).alias("idx"))


@Q(f"WITH {POINTS}, {ZONES}, {CELLS}, o AS (SELECT z.label AS zone, ci, cj, greatest(0, least(bx1, cx + 250) - greatest(bx0, cx - 250)) * greatest(0, least(by1, cy + 250) - greatest(by0, cy - 250)) AS area FROM z, c) SELECT zone, ci, cj, round(area, 2) AS area FROM o WHERE area > 0.005")
def polygon_overlay(spark, d):
    """Zones and cells as polygons: the same as the overlay of rectangles."""
    ring = lambda x0, y0, x1, y1: F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    z = zones(spark, d).select(F.col("label").alias("zone"), ring("bx0", "by0", "bx1", "by1").alias("ring"))
    h = SIZE / 2
    c = cells(spark, d).select(F.struct(F.col("ci0").alias("ci"), F.col("cj0").alias("cj")).alias("cell"), (F.col("x") - h).alias("x0"), (F.col("y") - h).alias("y0"), (F.col("x") + h).alias("x1"), (F.col("y") + h).alias("y1"))
    c = c.select(F.concat_ws(":", "cell.ci", "cell.cj").alias("cell"), ring("x0", "y0", "x1", "y1").alias("ring"))
    layer = lambda df, key: PG.trapezoids(df.select(key, F.array("ring").alias("rings")), key, SIZE)
    o = PG.overlay_areas(layer(c, "cell"), "cell", layer(z, "zone"), "zone", SIZE).filter("area > 0.005")
    part = lambda i: F.split("cell", ":").getItem(i).cast("long")
    return o.select("zone", part(0).alias("ci"), part(1).alias("cj"), F.round("area", 2).alias("area"))


@Q()
def delaunay_edges(spark, d):
    return T.delaunay(points(spark, d), "vec_id")


@Q(f"WITH {POINTS}, a AS (SELECT vec_id, round(x, 2) AS rx, round(y, 2) AS ry FROM p), b AS (SELECT vec_id AS other, round(x + 0.0001 * (vec_id % 3), 2) AS rx, round(y, 2) AS ry FROM p) SELECT vec_id, other FROM a JOIN b ON a.rx = b.rx AND a.ry = b.ry")
def centroid_join(spark, d):
    """Rows meet on centres that are equal to two decimals."""
    p = points(spark, d)
    other = p.select(F.col("vec_id").alias("other"), (F.col("x") + 0.0001 * F.pmod("vec_id", F.lit(3))).alias("x"), "y")
    return A.near_equal(p.select("vec_id", "x", "y"), other, ["x", "y"], 2).select("vec_id", "other")


@Q("SELECT c_custkey, CASE WHEN s IN ('BUILDING', 'MACHINERY') THEN s WHEN s = 'AUTOMOBILE' THEN 'CAR' WHEN s <> '' AND (contains('AUTOMOBILE', s) OR contains(s, 'AUTOMOBILE')) THEN 'CAR' WHEN s <> '' AND (contains('FURNITURE STORE', s) OR contains(s, 'FURNITURE STORE')) THEN 'HOME' END AS label FROM (SELECT c_custkey, trim(left(c_mktsegment, CAST(c_custkey % 10 AS BIGINT))) AS s FROM customer)")
def community_canon(spark, d):
    s = F.left("c_mktsegment", F.pmod("c_custkey", F.lit(10)))
    return read(spark, d, "customer").select("c_custkey", S.canonical_label(s, ["BUILDING", "MACHINERY"], {"AUTOMOBILE": "CAR", "FURNITURE STORE": "HOME"}).alias("label"))


@Q("SELECT n.n_name AS name, s.s_suppkey AS external_id FROM nation n JOIN (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' ELSE n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON n.n_name = s.name WHERE trim(s.name) <> '' AND lower(trim(s.name)) <> 'nan'")
def external_ids(spark, d):
    """Names with their external ids; blank and missing names are skipped."""
    n = read(spark, d, "nation")
    s = read(spark, d, "supplier").join(n.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.pmod("s_suppkey", F.lit(5)) == 0, "").when(F.pmod("s_suppkey", F.lit(5)) == 1, "nan").otherwise(F.col("n_name"))
    return A.mapped(n.select(F.col("n_name").alias("name")), s.select(name.alias("name"), F.col("s_suppkey").alias("external_id")), "name")


@Q("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'primary' ELSE 'middle' END AS stage, round(s_acctbal, 2) AS x, round(s_nationkey, 2)::DOUBLE AS y, s_acctbal AS target FROM supplier WHERE s_suppkey % 4 <> 0")
def entity_table(spark, d):
    """A raw entity table with ids to canonicalise, repeated ids, points as text, stages by name and missing targets."""
    s = read(spark, d, "supplier")
    wkt = F.concat(F.lit("POINT ("), F.round("s_acctbal", 2).cast("string"), F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(")"))
    name = F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "North Primary").otherwise("South Middle")
    raw = s.select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(".0")).alias("id"), name.alias("name"), wkt.alias("wkt"), F.when(F.pmod("s_suppkey", F.lit(4)) != 0, F.col("s_acctbal")).alias("target"), F.lit(0).alias("row"))
    again = raw.withColumn("row", F.lit(1)).withColumn("target", F.lit(-1.0))
    e = IO.entities(raw.unionByName(again), "id", "target", [F.col("row")], "name", [(["Primary"], "primary"), (["Middle"], "middle")])
    return e.select("id", "stage", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "target")


@Q("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def checked_cleaning(spark, d):
    """Rows of allowed kinds; the kinds that fall away have to be the stated ones."""
    return IO.only_kinds(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"], ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD"])


@Q(f"WITH {POINTS}, a AS (SELECT vec_id, x, y FROM p), r(x0, y0, x1, y1, id) AS (SELECT a.x, a.y, b.x, b.y, a.vec_id FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 WHERE a.label = 0), s AS (SELECT vec_id, id, x, y, x0, y0, x1, y1, greatest(0.0, least(1.0, CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2) ELSE 0 END)) AS t FROM a, r) SELECT vec_id, round(min(sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2)), 3) AS dist FROM s GROUP BY vec_id")
def line_distance(spark, d):
    """Distance to the nearest of a table of segments."""
    p = points(spark, d)
    b = p.select((F.col("vec_id") - 1).alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    lines = p.filter("label = 0").select(F.col("vec_id").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0")).join(b, "id")
    return G.nearest_segments(cut(p.select("vec_id", "x", "y")), cut(lines), "vec_id", 800.0).select("vec_id", F.round("dist", 3).alias("dist"))


@Q(f"WITH {POINTS}, {ZONES} SELECT z.label AS zone, {', '.join(f'round({f}, 4) + 0.0 AS {b}_{n}' for b in ('v', 'x') for n, f in (('mean', f'avg(p.{b})'), ('median', f'median(p.{b})'), ('std', f'stddev_pop(p.{b})'), ('p10', f'quantile_cont(p.{b}, 0.1)'), ('p90', f'quantile_cont(p.{b}, 0.9)'), ('sum', f'greatest(sum(p.{b}), 0)')))} FROM z JOIN p ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 GROUP BY z.label")
def zonal_bands(spark, d):
    """Figures of each band in wide form, and the bands' sums, floored at 0."""
    j = G.points_in_rects(points(spark, d), zones(spark, d).withColumnRenamed("label", "zone"), 2 * HALF)
    return P.band_stats(j, "zone", ["v", "x"]).select("zone", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for b in ("v", "x") for c in (f"{b}_{n}" for n in ("mean", "median", "std", "p10", "p90", "sum"))])


@Q("SELECT p_partkey, round(exp(-0.5 * (p_size / 10.0::DOUBLE) ** 2), 8) AS gauss, round(CASE WHEN p_size < 30 THEN (1 - (p_size / 30.0::DOUBLE) ** 2) ** 2 ELSE 0 END, 8) AS bi, round(1 / (p_size + 1e-9::DOUBLE), 8) AS inv, round(4 * pi() * p_retailprice / (p_size * p_size + 1e-9), 6) AS compact, round(greatest(exp(p_size / 10.0::DOUBLE) * 1.05 - 1e-6, 0), 6) AS back FROM part")
def kernels(spark, d):
    s = F.col("p_size").cast("double")
    return read(spark, d, "part").select("p_partkey", F.round(S.gaussian(s, F.lit(10.0)), 8).alias("gauss"), F.round(S.bisquare(s, F.lit(30.0)), 8).alias("bi"), F.round(S.inverse_distance(s), 8).alias("inv"), F.round(S.compactness(F.col("p_retailprice"), s), 6).alias("compact"), F.round(S.smeared(s / 10, F.lit(1.05)), 6).alias("back"))


@Q()
def rbf_anchors(spark, d):
    """Features of eight learned anchors, with the width of the median distance between points."""
    return M.rbf_features(points(spark, d).select("vec_id", "x", "y"), "vec_id", 8)


@Q()
def grid_inference(spark, d):
    """A model learned on points is applied to the cells; cells without features get the median."""
    p = points(spark, d).select("vec_id", "x", "y", "v", "label")
    return M.grid_predictions(p, ["x", "y"], "v", cells(spark, d).select(F.col("ci0").alias("ci"), F.col("cj0").alias("cj"), F.when(F.pmod("ci0", F.lit(5)) != 0, F.col("x")).alias("x"), "y"))


@Q("SELECT json FROM (SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region)")
def json_report(spark, d):
    return IO.report(read(spark, d, "region").select("r_regionkey", "r_name"))


@Q(f"SELECT CAST(floor((y1 - y) / 500) AS BIGINT) AS row, CAST(floor((x - x0) / 500) AS BIGINT) AS col, round(max(v), 6) + 0.0 AS value FROM (SELECT CAST(embedding[1] AS DOUBLE) * 10000 AS x, CAST(embedding[2] AS DOUBLE) * 10000 AS y, CAST(embedding[3] AS DOUBLE) * 10000 AS v FROM embeddings), (SELECT floor(min(CAST(embedding[1] AS DOUBLE) * 10000) / 500) * 500 AS x0, ceil(max(CAST(embedding[2] AS DOUBLE) * 10000) / 500) * 500 AS y1 FROM embeddings) GROUP BY 1, 2")
def rasterised(spark, d):
    return IO.rasterise(points(spark, d), SIZE, "v").select("row", "col", S.r6(F.col("value")).alias("value"))




@Q()
def grid_lifecircles(spark, d):
    """The cells that each cell reaches within a time over the nations' roads: its own at least, where it reaches no road."""
    at = lambda c: (F.floor(F.col(c) / 5) * 400.0, F.pmod(c, F.lit(5)) * 400.0)
    e = cut(N.directed(roads(spark, d)))
    node = F.pmod(F.col("ci0") * 5 + F.col("cj0"), F.lit(40))
    c = cut(cells(spark, d).select(F.col("ci0").alias("ci"), F.col("cj0").alias("cj"), node.alias("node")))
    dist = N.shortest(e, nations(spark, d).join(c.select("node").distinct(), "node"), 2.0)
    s = N.reachable(e, dist, 2.0).select("origin", "share", *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*at("src"), *at("dst")), strict=True)])
    area = N.isochrone_cells(s, 50.0, 90.0).groupBy("origin").agg((F.count(F.lit(1)) * 2500.0).alias("area"))
    j = c.join(area, c["node"] == area["origin"], "left")
    return j.select("ci", "cj", F.coalesce("area", F.lit(3.141592653589793 * 90 * 90)).alias("area"))


def _sum_sql(terms, one, two):
    return " + ".join(f"({t!r}::DOUBLE * {one}({2 * k} * a) * {two}({2 * k} * b))" for k, t in enumerate(terms, 1))


_Z = R.ZONE_38
_E = 2 * _Z.n**0.5 / (1 + _Z.n)


@Q(f"""WITH {POINTS}, g AS (SELECT vec_id, 114 + x / 4000 AS lon, 36 + y / 4000 AS lat FROM p), s AS (SELECT *, sinh(atanh(sin(radians(lat))) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 114) AS d FROM g),
ab AS (SELECT *, atan2(t, cos(d)) AS a, atanh(sin(d) / sqrt(1 + t * t)) AS b FROM s)
SELECT vec_id, round(38500000 + {_Z.radius!r}::DOUBLE * (b + {_sum_sql(R._forward(_Z.n), "cos", "sinh")}), 3) AS x, round({_Z.radius!r}::DOUBLE * (a + {_sum_sql(R._forward(_Z.n), "sin", "cosh")}), 3) AS y, round(lon, 8) + 0.0 AS lon, round(lat, 8) + 0.0 AS lat FROM ab""")
def reprojected_points(spark, d):
    """Points in degrees, in the plane of a zone, and back in degrees."""
    p = points(spark, d).select("vec_id", (114 + F.col("x") / 4000).alias("lon"), (36 + F.col("y") / 4000).alias("lat"))
    x, y = R.to_plane(F.col("lon"), F.col("lat"), _Z)
    plane = p.select("vec_id", x.alias("x"), y.alias("y"))
    lon, lat = R.to_degrees(F.col("x"), F.col("y"), _Z)
    return plane.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


def _degrees_raster(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").groupBy(F.pmod(k, F.lit(40)).alias("row"), F.pmod(F.floor(k / 40), F.lit(25)).alias("col")).agg(F.avg("p_retailprice").cast("double").alias("value"))


@Q()
def reprojected_raster(spark, d):
    """A raster of hundredths of a degree on kilometre pixels of a zone."""
    out, left, top = G.reprojected(cut(_degrees_raster(spark, d)), 113.6, 36.2, 0.01, _Z, 1000.0)
    return out.select("row", "col", F.round("value", 4).alias("value"), F.lit(left).alias("left"), F.lit(top).alias("top"))
