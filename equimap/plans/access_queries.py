"""Demand around the sites' hull and travel times over roads that the places snap to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demand as D
from ..operators import models as M
from ..operators import network as N
from ..operators import spatial as G
from ..operators.lineage import cut
from ..sources import files as IO
from .registry import Registry
from .tables import POINTS, ROADS, ZONES, points, read, roads, zones

Q = Registry()
#: Distance between neighbouring nations, which stand in five rows around the origin.
STEP = 1400.0


@Q(f"""WITH {POINTS}, s AS (SELECT vec_id AS i, x, y, 200.0::DOUBLE + vec_id % 7 * 50 AS n, abs(v) AS p, 1 + label % 5 AS risk FROM p),
h AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM s a, s b WHERE (a.x <> b.x OR a.y <> b.y) AND NOT EXISTS (SELECT 1 FROM s c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
b AS (SELECT min(x) - 2500 AS ox0, min(y) - 2500 AS oy0, ceil((max(x) - min(x) + 5000) / 250)::BIGINT AS nx, ceil((max(y) - min(y) + 5000) / 250)::BIGINT AS ny FROM s),
l AS (SELECT i * ny + j AS cell, ox0 + (i + 0.5) * 250 AS cx, oy0 + (j + 0.5) * 250 AS cy FROM b, LATERAL (SELECT unnest(range(0, nx)) AS i), LATERAL (SELECT unnest(range(0, ny)) AS j)),
k AS (SELECT cell, cx, cy, x0, y0, x1, y1, unnest([-125, -125, 125, 125]) AS ox, unnest([-125, 125, -125, 125]) AS oy, (x1 - x0) * (cy - y0) - (y1 - y0) * (cx - x0) >= 0 AS side, sqrt(greatest(0, abs(x0 - cx) - 125) ** 2 + greatest(0, abs(y0 - cy) - 125) ** 2) AS d1 FROM l, h),
t AS (SELECT *, greatest(0, least(1, ((cx + ox - x0) * (x1 - x0) + (cy + oy - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM k),
c AS (SELECT cell, cx, cy FROM t GROUP BY ALL HAVING bool_and(side) OR min(least(d1, sqrt((cx + ox - x0 - t * (x1 - x0)) ** 2 + (cy + oy - y0 - t * (y1 - y0)) ** 2))) <= 2500),
e AS (SELECT cell, cx, cy, s.*, greatest(1, sqrt((cx - x) ** 2 + (cy - y) ** 2)) AS d FROM c, s), w AS (SELECT *, 1 / d ** 2 AS w, sum(1 / d ** 2) OVER (PARTITION BY i) AS total FROM e),
g AS (SELECT cell, sum(w / total * n) AS raw, sum(w * p) / sum(w) AS pressure, first(risk ORDER BY d, i) AS risk FROM w GROUP BY cell), f AS (SELECT *, raw * 0.1174 AS demand FROM g WHERE raw * 0.1174 > 0.05),
m AS (SELECT min(demand) AS d0, max(demand) AS d1, min(pressure) AS p0, max(pressure) AS p1 FROM f)
SELECT cell, round(demand, 4) AS demand, round(pressure, 4) AS pressure, risk::INTEGER AS risk, round(greatest(0.01, 0.45 * (demand - d0) / (d1 - d0) + 0.35 * (pressure - p0) / (p1 - p0) + 0.2 * (risk - 1) / 4.0), 5) AS weight FROM f, m""")
def demand_cells(spark, d):
    """Each point is a site; cells of 250 within 2500 of the hull of all."""
    s = points(spark, d).select("vec_id", "x", "y", (200.0 + F.col("vec_id") % 7 * 50).alias("n"), F.abs("v").alias("pressure"), (1 + F.col("label") % 5).cast("int").alias("risk"))
    return D.demand_cells(s, "vec_id").select("cell", F.round("demand", 4).alias("demand"), F.round("pressure", 4).alias("pressure"), "risk", F.round("weight", 5).alias("weight"))


def streets(spark, d):
    """sid, src, dst, w, oneway, reversed and ends: the roads between neighbouring nations, from the lower to the higher one."""
    at = lambda c: ((F.floor(F.col(c) / 5) - 2) * STEP, (F.pmod(c, F.lit(5)) - 2) * STEP)
    r = roads(spark, d).filter("dst - src = 5 or (dst - src = 1 and dst % 5 > 0)")
    return r.select((F.col("src") * 25 + F.col("dst")).alias("sid"), "src", "dst", "w", "oneway", "reversed", *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*at("src"), *at("dst")), strict=True)])


#: The roads as in ROADS, but only neighbours; 32 steps are more than the 24 that a path between 25 nodes has.
_STREETS = ROADS.replace("e1 AS (SELECT a, b, w FROM e0 WHERE a % 8 <> 0 UNION ALL SELECT b, a, w FROM e0 WHERE a % 4 <> 0 OR a % 8 = 0)", "es AS (SELECT a * 25 + b AS sid, a, b, w, a % 8 <> 0 AS ahead, a % 4 <> 0 OR a % 8 = 0 AS back, (a // 5 - 2) * 1400.0::DOUBLE AS x0, (a % 5 - 2) * 1400.0::DOUBLE AS y0, (b // 5 - 2) * 1400.0::DOUBLE AS x1, (b % 5 - 2) * 1400.0::DOUBLE AS y1 FROM e0 WHERE b - a = 5 OR (b - a = 1 AND b % 5 > 0)), e1 AS (SELECT a, b, w FROM es WHERE ahead UNION ALL SELECT b, a, w FROM es WHERE back)")


@Q(f"""WITH {POINTS}, {_STREETS}, t0 AS (SELECT vec_id, p.label, x, y, es.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM p, es),
f AS (SELECT *, sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) AS dist FROM t0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2), sid) = 1),
c AS (SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS straight, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.vec_id) AS k FROM p a, p b WHERE a.label < 5 AND b.label >= 5) WHERE k <= 15),
lv AS (SELECT vec_id AS i, b AS node, (1 - t) * w AS c FROM f WHERE ahead AND dist <= 500 UNION ALL SELECT vec_id, a, t * w FROM f WHERE back AND dist <= 500),
en AS (SELECT vec_id AS j, a AS node, t * w AS c FROM f WHERE ahead UNION ALL SELECT vec_id, b, (1 - t) * w FROM f WHERE back),
w1 AS (SELECT c.i, c.j, lv.c + d5.d + en.c AS net FROM c JOIN lv ON lv.i = c.i JOIN en ON en.j = c.j JOIN d5 ON d5.a = lv.node AND d5.b = en.node
       UNION ALL SELECT c.i, c.j, abs(y.t - x.t) * x.w FROM c JOIN f x ON x.vec_id = c.i AND x.dist <= 500 JOIN f y ON y.vec_id = c.j AND y.sid = x.sid WHERE (y.t >= x.t AND x.ahead) OR (y.t <= x.t AND x.back)),
n AS (SELECT i, j, min(net) AS net FROM w1 GROUP BY i, j HAVING min(net) <= 6),
o AS (SELECT c.i, c.j, coalesce(net, CASE WHEN straight <= CASE WHEN c.j % 2 = 0 THEN 800 ELSE 1600 END THEN straight * 1.35 / CASE WHEN c.j % 2 = 0 THEN 75 ELSE 240 END END) AS t, net IS NOT NULL AS net FROM c LEFT JOIN n ON n.i = c.i AND n.j = c.j)
SELECT i, j, round(t, 5) AS t, CASE WHEN net THEN 'network' ELSE 'straight' END AS source FROM o WHERE t IS NOT NULL""")
def od_snapped(spark, d):
    """Times to the 15 nearest sites: along the streets between the places' feet, else straight within a limit."""
    p = cut(points(spark, d))
    g = p.filter("label < 5").select(F.col("vec_id").alias("i"), "x", "y")
    s = p.filter("label >= 5").select(F.col("vec_id").alias("j"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    stage = F.when(F.pmod("j", F.lit(2)) == 0, "primary").otherwise("middle")
    c = G.knn(g, s, 15, 1000.0, "i", "j").select("i", "j", stage.alias("stage"), F.sqrt("d2").alias("dist"))
    segments = cut(streets(spark, d))
    feet = cut(N.snapped(p.select(F.col("vec_id").alias("pid"), "x", "y"), segments, "pid", 500.0))
    od = N.snapped_minutes(cut(c), feet, segments, {"primary": 75.0, "middle": 240.0}, {"primary": 800.0, "middle": 1600.0}, 6.0, 500.0)
    return od.select("i", "j", F.round("t", 5).alias("t"), "source")


def _layers(spark, d):
    p = points(spark, d).select("vec_id", "x", "y")
    return {"dezoned": p.select("vec_id", (F.col("x") + 500000).alias("x"), F.col("y")), "degrees": p.select("vec_id", (114 + F.col("x") / 4000).alias("x"), (36 + F.col("y") / 4000).alias("y")), "zoned": p.select("vec_id", (F.col("x") + 38500000).alias("x"), "y")}


@Q(f"""WITH {POINTS}, l AS (SELECT 'dezoned' AS layer, x + 500000 AS x, y FROM p UNION ALL SELECT 'degrees', 114 + x / 4000, 36 + y / 4000 FROM p UNION ALL SELECT 'zoned', x + 38500000, y FROM p)
SELECT layer, count(*) AS n, round(min(x), 4) AS x0, round(max(y), 4) AS y1, CASE layer WHEN 'degrees' THEN 'geographic' ELSE layer END AS axis, CASE layer WHEN 'dezoned' THEN 'shift' WHEN 'degrees' THEN 'reproject' ELSE 'copy' END AS action FROM l GROUP BY layer""")
def axis_layers(spark, d):
    """What has to be done with three layers of different axes."""
    return IO.axis_report(_layers(spark, d)).select("layer", "n", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"), "axis", "action")


@Q(f"""WITH {POINTS}, {ZONES}, c AS (SELECT label AS zone, (bx0 + bx1) / 2 AS zx, (by0 + by1) / 2 AS zy FROM z)
SELECT vec_id, zone, round(d, 4) AS dist FROM (SELECT vec_id, zone, sqrt((x - zx) ** 2 + (y - zy) ** 2) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY (x - zx) ** 2 + (y - zy) ** 2, zone) AS n FROM p, c) WHERE n = 1""")
def nearest_zone(spark, d):
    """The nearest feature of each point, the first of equally near ones, however far it is."""
    z = zones(spark, d).select(F.col("label").alias("zone"), ((F.col("bx0") + F.col("bx1")) / 2).alias("sx"), ((F.col("by0") + F.col("by1")) / 2).alias("sy"))
    return G.knn(points(spark, d), cut(z), 1, 1000.0, "vec_id", "zone").select("vec_id", "zone", F.round(F.sqrt("d2"), 4).alias("dist"))


def _classified(spark, d):
    """Parts as cells: score, label, share of water and a cluster."""
    p = read(spark, d, "part")
    score = 20.0 + F.pmod(F.col("p_partkey") * 7, F.lit(200)) / 10
    label = F.when(F.col("p_size") > 46, 2).when(F.pmod("p_partkey", F.lit(3)) == 0, 1).otherwise(0)
    return p.select("p_partkey", score.alias("score"), label.alias("label"), (F.pmod("p_size", F.lit(10)) / 10).alias("water"), F.col("p_brand").alias("cluster"))


_CLASSIFIED = """c AS (SELECT p_partkey, 20.0::DOUBLE + (p_partkey * 7 % 200) / 10 AS score, CASE WHEN p_size > 46 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS label, (p_size % 10) / 10 AS water, p_brand AS cluster FROM part),
v AS (SELECT cluster, first(label ORDER BY n DESC, label) AS vote FROM (SELECT cluster, label, count(*) AS n FROM c GROUP BY ALL) GROUP BY cluster),
r AS (SELECT c.*, CASE WHEN score BETWEEN 27 AND 31 AND label <> 2 AND NOT water > 0.5 THEN vote ELSE label END AS refined FROM c JOIN v USING (cluster))"""


@Q(f"WITH {_CLASSIFIED} SELECT p_partkey, label, refined FROM r")
def refined_labels(spark, d):
    """Cells of the fuzzy band take their cluster's label, water exempt."""
    return M.vote_refined(_classified(spark, d), "cluster", "label", "score", "water").select("p_partkey", "label", "refined")


@Q(f"""WITH {_CLASSIFIED} SELECT refined AS label, count(*) AS cells, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent, round(avg(score), 4) AS score, round(median(score), 4) AS middle, round(avg(water), 4) AS water, count(DISTINCT cluster) AS clusters, count(*) FILTER (refined <> label) AS changed FROM r GROUP BY refined""")
def class_panels(spark, d):
    """The four panels of the classification as one table: classes, scores, water, clusters."""
    r = M.vote_refined(_classified(spark, d), "cluster", "label", "score", "water")
    g = r.groupBy(F.col("refined").alias("l")).agg(F.count(F.lit(1)).alias("cells"), F.avg("score").alias("score"), F.percentile("score", 0.5).alias("middle"), F.avg("water").alias("water"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("refined") != F.col("label")).alias("changed"))
    g = g.crossJoin(F.broadcast(g.agg(F.sum("cells").alias("all"))))  # one row
    four = lambda c: F.round(c, 4).alias(c)
    return g.select(F.col("l").alias("label"), "cells", F.round(100.0 * F.col("cells") / F.col("all"), 4).alias("percent"), four("score"), four("middle"), four("water"), "clusters", "changed")


@Q("""WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS x1, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS own, CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END AS x2, CASE WHEN p_partkey % 7 = 0 THEN 0.5 END AS pct, CASE WHEN p_partkey % 4 = 0 THEN 3 END AS dom, CASE WHEN p_partkey % 4 = 1 THEN 5 END AS cls, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice / 10 END AS km2 FROM part)
SELECT p_partkey, round(coalesce(x1, own, 900.0), 4)::DOUBLE AS x1, coalesce(x2, 25.0)::DOUBLE AS x2, coalesce(pct, 0)::DOUBLE AS pct, coalesce(dom, cls, 0) AS dom, round(coalesce(km2, (SELECT median(km2) FROM g)), 4) AS km2 FROM g""")
def grid_fallbacks(spark, d):
    """Missing features of cells: own value, median, zero share, own class."""
    k = F.col("p_partkey")
    g = read(spark, d, "part").select(
        "p_partkey", F.when(k % 3 > 0, F.col("p_retailprice")).alias("x1"), F.when(k % 5 > 0, F.col("p_size").cast("double")).alias("own"), F.when(k % 2 == 0, F.col("p_size").cast("double")).alias("x2"),
        F.when(k % 7 == 0, 0.5).alias("pct"), F.when(k % 4 == 0, 3).alias("dom"), F.when(k % 4 == 1, 5).alias("cls"), F.when(k % 6 > 0, F.col("p_retailprice") / 10).alias("km2"),
    )
    out = M.grid_features(g, ["x1", "x2"], {"x1": "own"}, {"x1": 900.0, "x2": 25.0}, ["pct"], "dom", "cls", ["km2"])
    return out.select("p_partkey", F.round("x1", 4).alias("x1"), "x2", "pct", "dom", F.round("km2", 4).alias("km2"))
