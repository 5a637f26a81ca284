"""Queries of composite indices, evaluation, set operations and cell operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from ..operators import planning as P
from ..operators import spatial as G
from ..operators.lineage import cut
from .registry import Registry
from .tables import HALF, POINTS, SIZE, ZONES, nations, points, read, roads, zones

Q = Registry()


@Q("""WITH x AS (SELECT min(p_retailprice) l1, max(p_retailprice) h1, min(p_size::DOUBLE) l2, max(p_size::DOUBLE) h2, min((p_partkey % 97)::DOUBLE) l3, max((p_partkey % 97)::DOUBLE) h3, count(*) n FROM part),
z AS (SELECT p_partkey, (p_retailprice - l1) / (h1 - l1) AS z1, (p_size - l2) / (h2 - l2) AS z2, (p_partkey % 97 - l3) / (h3 - l3) AS z3, (p_retailprice - l1) / (h1 - l1 + 1e-9) AS n1, (p_size - l2) / (h2 - l2 + 1e-9) AS n2, (h3 - p_partkey % 97) / (h3 - l3 + 1e-9) AS n3, n FROM part, x),
s AS (SELECT sum(z1) s1, sum(z2) s2, sum(z3) s3 FROM z),
e AS (SELECT -sum(CASE WHEN z1 = 0 THEN 1e-9 ELSE z1 / s1 END * ln(CASE WHEN z1 = 0 THEN 1e-9 ELSE z1 / s1 END)) / ln(max(n)) AS e1, -sum(CASE WHEN z2 = 0 THEN 1e-9 ELSE z2 / s2 END * ln(CASE WHEN z2 = 0 THEN 1e-9 ELSE z2 / s2 END)) / ln(max(n)) AS e2, -sum(CASE WHEN z3 = 0 THEN 1e-9 ELSE z3 / s3 END * ln(CASE WHEN z3 = 0 THEN 1e-9 ELSE z3 / s3 END)) / ln(max(n)) AS e3 FROM z, s),
i AS (SELECT p_partkey, n2, n3, ((1 - e1) * n1 + (1 - e2) * n2 + (1 - e3) * n3) / (3 - e1 - e2 - e3) AS idx FROM z, e),
q AS (SELECT quantile_cont(idx, [0.25, 0.5, 0.75]) AS q FROM i), k AS (SELECT *, 0.5 * n3 + 0.3 * n2 + 0.2 * (1 - idx) AS pr, CASE WHEN idx >= q[3] THEN 'I' WHEN idx >= q[2] THEN 'II' WHEN idx >= q[1] THEN 'III' ELSE 'IV' END AS c, p_partkey % 2500 AS n FROM i, q),
f AS (SELECT *, CASE WHEN c = 'IV' AND n > 2000 THEN 'III' WHEN c = 'II' AND n > 0 AND n < 500 THEN 'III' ELSE c END AS cls FROM k)
SELECT p_partkey, round(idx, 5) + 0.0 AS "index", round(pr, 5) + 0.0 AS priority, rank() OVER (ORDER BY pr DESC) AS rank, cls, 'S' || CASE cls WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 ELSE 4 END AS strategy FROM f""")
def priority_index(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("d2"), F.pmod("p_partkey", F.lit(97)).cast("double").alias("d3"), F.pmod("p_partkey", F.lit(2500)).alias("n"))
    r = P.priority(p, "p_partkey", "p_retailprice", "d2", "d3", "n")
    return r.select("p_partkey", (F.round("index", 5) + F.lit(0.0)).alias("index"), (F.round("priority", 5) + F.lit(0.0)).alias("priority"), "rank", "cls", "strategy")


_U = "((({k} * 1103515245 + r * 12345 + 42) % 1000003) * (({k} * 1103515245 + r * 12345 + 42) % 1000003) + (({k} * 1103515245 + r * 12345 + 42) % 1000003) * 7919 + r * 104729) % 999983 / CAST(999983 AS DOUBLE)"


@Q(f"WITH r AS (SELECT unnest(range(0, 100)) AS r), m AS (SELECT r, 1 - sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END * (0.95 + 0.1 * ({_U.format(k='o_orderkey')}))) / sum(o_totalprice * (0.95 + 0.1 * ({_U.format(k='(o_orderkey + 17)')}))) AS c FROM orders, r GROUP BY r) SELECT CAST(count(*) AS BIGINT) AS runs, round(avg(c), 5) AS mean, round(stddev_samp(c) / avg(c), 5) AS cv FROM m")
def monte_carlo(spark, d):
    o = read(spark, d, "orders").withColumn("unmet", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0.0))
    m = P.monte_carlo(o.select("o_orderkey", "o_totalprice", "unmet"), "o_orderkey", "o_totalprice", "unmet", 100)
    return m.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("coverage"), 5).alias("mean"), F.round(F.stddev_samp("coverage") / F.avg("coverage"), 5).alias("cv"))


@Q("SELECT CAST(count(*) FILTER (b > 1.01 * a) AS BIGINT) AS improved, CAST(count(*) FILTER (b > 1.001 * a) AS BIGINT) AS slightly, CAST(count(*) FILTER (b < 0.999 * a) AS BIGINT) AS lost, round(avg(b - a), 4) AS mean_change FROM (SELECT o_totalprice AS a, o_totalprice * (0.97 + (o_orderkey % 7) / CAST(100 AS DOUBLE)) AS b FROM orders)")
def benefit_report(spark, d):
    o = read(spark, d, "orders").select(F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * (0.97 + F.pmod("o_orderkey", F.lit(7)) / 100)).alias("b"))
    r = P.benefit(o, "a", "b")
    return r.withColumn("mean_change", F.round("mean_change", 4))


@Q("SELECT round(stddev_pop(t) / avg(t), 6) AS cv, stddev_pop(t) / avg(t) < 0.15 AS alarm FROM (SELECT sum(l_quantity) AS t FROM lineitem GROUP BY l_suppkey)")
def total_variation(spark, d):
    r = P.variation(read(spark, d, "lineitem"), "l_suppkey", "l_quantity")
    return r.select(F.round("cv", 6).alias("cv"), "alarm")


@Q(f"WITH {POINTS}, {ZONES}, b AS (SELECT label, bx0 + 400 AS ax0, by0 - 300 AS ay0, bx1 + 200 AS ax1, by1 AS ay1, bx0, by0, bx1, by1 FROM z), o AS (SELECT (ax1 - ax0) * (ay1 - ay0) AS aa, (bx1 - bx0) * (by1 - by0) AS bb, (least(ax1, bx1) - greatest(ax0, bx0)) * (least(ay1, by1) - greatest(ay0, by0)) AS i FROM b) SELECT round(median(i / (aa + bb - i)), 6) AS iou, round(median(aa / bb), 6) AS ratio FROM o")
def overlap_quality(spark, d):
    z = zones(spark, d)
    a = z.select(F.col("label").alias("la"), (F.col("bx0") + 400).alias("ax0"), (F.col("by0") - 300).alias("ay0"), (F.col("bx1") + 200).alias("ax1"), F.col("by1").alias("ay1"))
    p = G.rect_pairs(a, z, 2 * HALF).filter("la = label")
    area = lambda k: (F.col(f"{k}x1") - F.col(f"{k}x0")) * (F.col(f"{k}y1") - F.col(f"{k}y0"))
    r = P.overlap_scores(p, area("a"), area("b"))
    return r.select(F.round("iou", 6).alias("iou"), F.round("ratio", 6).alias("ratio"))


@Q(f"WITH {POINTS}, q AS (SELECT DISTINCT label, CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj FROM p) SELECT label, CAST(count(*) AS BIGINT) AS cells, count(*) * 250000.0::DOUBLE AS area, min(ci) AS i0, max(ci) AS i1, min(cj) AS j0, max(cj) AS j1 FROM q GROUP BY label")
def dissolve_cells(spark, d):
    p = points(spark, d).select("label", G.cell(F.col("x"), SIZE).alias("ci"), G.cell(F.col("y"), SIZE).alias("cj"))
    return P.dissolve(p, "label", SIZE)


@Q()
def hull_buffer(spark, d):
    return P.hull_area(points(spark, d), 500.0)


@Q()
def isolation_outliers(spark, d):
    """Four cells in a hundred stand out; those of label 0 are exempt."""
    scores = P.isolation_scores(points(spark, d).select("vec_id", "x", "y", "v", "label"), ["x", "y", "v"], trees=200)
    return P.flagged(cut(scores), 0.04, F.col("label") == 0).drop("label")


@Q("""WITH RECURSIVE n AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS n, max(p_partkey) AS last FROM part),
g AS (SELECT p_partkey // n AS r, p_partkey % n AS c, p_size % 5 < 2 AS z, p_partkey // n IN (0, last // n) OR p_partkey % n IN (0, n - 1) AS edge FROM part, n),
f AS (SELECT r, c FROM g WHERE z AND edge UNION SELECT g.r, g.c FROM f JOIN g ON g.z AND abs(f.r - g.r) + abs(f.c - g.c) = 1) SELECT r AS row, c AS col FROM f""")
def edge_flood(spark, d):
    """Zero pixels that are connected to the edge of a raster of all parts, as wide as high."""
    n, last = read(spark, d, "part").agg(F.ceil(F.sqrt(F.count(F.lit(1)))), F.max("p_partkey")).first()  # one row
    r, c = F.floor(F.col("p_partkey") / n), F.pmod("p_partkey", F.lit(n))
    m = read(spark, d, "part").select(r.alias("row"), c.alias("col"), (F.pmod("p_size", F.lit(5)) < 2).alias("zero"))
    return P.flood(m.withColumn("edge", F.col("row").isin(0, last // n) | F.col("col").isin(0, n - 1)))


@Q("SELECT o_custkey AS id, 'both' AS side FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, 'first' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_operations(spark, d):
    of = lambda s: read(spark, d, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    a, b = of("F"), of("P")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("first")))


@Q("WITH s AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority)) AS a, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_totalprice > 60000)), []) AS b FROM orders GROUP BY 1) SELECT round(avg((a <> b)::DOUBLE), 6) AS change_rate, CAST(count(*) AS BIGINT) AS n FROM s")
def tag_change_rate(spark, d):
    big = F.when(F.col("o_totalprice") > 60000, F.col("o_orderpriority"))
    s = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"), F.array_sort(F.collect_set(big)).alias("b"))
    return s.agg(F.round(F.avg((F.col("a") != F.col("b")).cast("double")), 6).alias("change_rate"), F.count(F.lit(1)).alias("n"))


@Q("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def top_k(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5)


@Q("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey NOT IN (3, 5, 7, 11)")
def input_cleaning(spark, d):
    c = read(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    gone = spark.createDataFrame([(k,) for k in (3, 5, 7, 11)], "c_custkey long")
    return c.join(F.broadcast(gone), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@Q(f"""WITH {POINTS}, x AS (SELECT CAST(floor(min(x) / 500) AS BIGINT) AS i0, CAST(floor(min(y) / 500) AS BIGINT) AS j0, CAST(floor(max(x) / 500) AS BIGINT) AS i1, CAST(floor(max(y) / 500) AS BIGINT) AS j1 FROM p),
l AS (SELECT i, j, (i + 0.5) * 500 AS cx, (j + 0.5) * 500 AS cy, (i - i0) * (j1 - j0 + 1) + j - j0 AS cell FROM x, LATERAL (SELECT unnest(range(i0, i1 + 1)) AS i), LATERAL (SELECT unnest(range(j0, j1 + 1)) AS j)),
k AS (SELECT cell, v, (cx - x) ** 2 + (cy - y) ** 2 AS d2, row_number() OVER (PARTITION BY cell ORDER BY (cx - x) ** 2 + (cy - y) ** 2, vec_id) AS n FROM l, p)
SELECT CAST(cell AS BIGINT) AS cell, round(sum(v / d2) / sum(1 / d2), 4) + 0.0 AS pressure FROM k WHERE n <= 15 GROUP BY 1""")
def demand_grid(spark, d):
    at = lambda f, c: G.cell(f(c), SIZE)
    i0, j0, i1, j1 = points(spark, d).agg(at(F.min, "x"), at(F.min, "y"), at(F.max, "x"), at(F.max, "y")).first()  # one row
    cells = G.lattice(spark, i0 * SIZE, j0 * SIZE, i1 - i0 + 1, j1 - j0 + 1, SIZE).withColumn("cell", F.col("ci0") * (j1 - j0 + 1) + F.col("cj0"))
    s = points(spark, d).select(F.col("vec_id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("v").alias("sv"))
    return G.idw(G.knn(cells, s, 15, 1500.0, "cell", "sid"), "cell", "sv").select("cell", (F.round("value", 4) + F.lit(0.0)).alias("pressure"))


@Q()
def isochrone_areas(spark, d):
    """Cells within 90 of the reached part of the nations' roads, for all nations; these stand in rows of five."""
    e = cut(N.directed(roads(spark, d)))
    dist = N.shortest(e, nations(spark, d), 6.0)
    at = lambda c: (F.floor(F.col(c) / 5) * 400.0, F.pmod(c, F.lit(5)) * 400.0)
    s = N.reachable(e, dist, 6.0).select("origin", "share", *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (*at("src"), *at("dst")), strict=True)])
    return N.isochrone_cells(s, 50.0, 90.0).groupBy("origin").agg((F.count(F.lit(1)) * 2500.0).alias("area"))
