"""Queries of projections, classifications and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import stats as A
from ..sources import files as IO
from .registry import Registry
from .tables import read

Q = Registry()
R = lambda x: f"round({x}, 6) + 0.0"


@Q("SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) + 0.0 AS z FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)")
def minmax(spark, d):
    o = A.with_totals(read(spark, d, "orders"), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"))
    return o.select("o_orderkey", S.r6(S.minmax(F.col("o_totalprice"), F.col("lo"), F.col("hi"))).alias("z"))


@Q("SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo + 1e-9), 6) + 0.0 AS f, round((hi - o_totalprice) / (hi - lo + 1e-9), 6) + 0.0 AS b FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)")
def minmax_both_ways(spark, d):
    o = A.with_totals(read(spark, d, "orders"), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"))
    a = (F.col("o_totalprice"), F.col("lo"), F.col("hi"))
    return o.select("o_orderkey", S.r6(S.minmax_eps(*a)).alias("f"), S.r6(S.minmax_eps(*a, reverse=True)).alias("b"))


@Q("SELECT event_id, round(greatest(-3.5, least(3.5, (value - m) / (s + 1e-9))), 6) + 0.0 AS z FROM events, (SELECT avg(value) m, stddev_pop(value) s FROM events)")
def zscore_clip(spark, d):
    e = A.with_totals(read(spark, d, "events"), m=F.avg("value"), s=F.stddev_pop("value"))
    return e.select("event_id", S.r6(S.zscore_clip(F.col("value"), F.col("m"), F.col("s"))).alias("z"))


@Q("SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (l_extendedprice - a) / (b - a + 1e-9))), 6) + 0.0 AS z FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.02) a, quantile_cont(l_extendedprice, 0.98) b FROM lineitem)")
def pct_norm(spark, d):
    rows = read(spark, d, "lineitem")
    a, b = (F.lit(q).cast("double") for q in A.quantiles(rows, "l_extendedprice", [0.02, 0.98]))
    l = A.with_totals(rows, lo=F.min("l_extendedprice"), hi=F.max("l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", S.r6(S.percentile_norm(F.col("l_extendedprice"), a, b, F.col("lo"), F.col("hi"))).alias("z"))


@Q("SELECT round(b, 6) AS bound, CAST(count(*) FILTER (o_totalprice > b) AS BIGINT) AS clipped, round(sum(least(o_totalprice, b)), 2) AS total FROM orders, (SELECT quantile_cont(o_totalprice, 0.95) b FROM orders) GROUP BY b")
def winsorize_p95(spark, d):
    o = read(spark, d, "orders")
    o = o.withColumn("b", F.lit(A.quantiles(o, "o_totalprice", [0.95])[0]).cast("double"))
    return o.groupBy("b").agg(F.count_if(F.col("o_totalprice") > F.col("b")).alias("clipped"), F.round(F.sum(F.least("o_totalprice", "b")), 2).alias("total")).select(F.round("b", 6).alias("bound"), "clipped", "total")


@Q("SELECT event_id, round(t, 6) + 0.0 AS t, round(greatest(pow(greatest(t * 0.0743 + 1, 1e-9), 1 / CAST(0.0743 AS DOUBLE)) - 1e-4, 0.0), 6) + 0.0 AS back FROM (SELECT event_id, (pow(greatest(abs(value), 1e-4), CAST(0.0743 AS DOUBLE)) - 1) / CAST(0.0743 AS DOUBLE) AS t FROM events)")
def boxcox_roundtrip(spark, d):
    t = read(spark, d, "events").select("event_id", S.boxcox(F.abs("value"), 0.0743).alias("t"))
    return t.select("event_id", S.r6(F.col("t")).alias("t"), S.r6(S.boxcox_inverse(F.col("t"), 0.0743)).alias("back"))


@Q("SELECT o_orderkey, round(ln(least(o_totalprice, b) + 1e-6), 6) + 0.0 AS y FROM orders, (SELECT quantile_cont(o_totalprice, 0.95) b FROM orders)")
def log_target(spark, d):
    o = read(spark, d, "orders")
    o = o.withColumn("b", F.lit(A.quantiles(o, "o_totalprice", [0.95])[0]).cast("double"))
    return o.select("o_orderkey", S.r6(S.log_target(F.col("o_totalprice"), F.col("b"))).alias("y"))


@Q("SELECT p_partkey, CASE WHEN contains(p_type, 'PROMO') OR contains(p_type, 'ECONOMY') THEN 'primary' WHEN contains(p_type, 'STANDARD') THEN 'middle' WHEN contains(p_type, 'LARGE') THEN 'high' ELSE 'other' END AS level FROM part")
def level_case(spark, d):
    rules = [(["PROMO", "ECONOMY"], "primary"), (["STANDARD"], "middle"), (["LARGE"], "high")]
    return read(spark, d, "part").select("p_partkey", S.first_match(F.col("p_type"), rules, "other").alias("level"))


@Q("SELECT c_custkey, regexp_replace(trim(' ' || c_custkey || '.0 '), '^([+-]?[0-9]+)\\.0+$', '\\1') AS id FROM customer")
def id_canon(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.canonical_id(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 "))).alias("id"))


@Q("SELECT c_custkey, replace(replace(c_name, '#', ''), ' ', '') AS name FROM customer")
def name_clean(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.clean_name(F.col("c_name")).alias("name"))


@Q("SELECT s_suppkey, CASE WHEN s_acctbal >= q[3] THEN 'I' WHEN s_acctbal >= q[2] THEN 'II' WHEN s_acctbal >= q[1] THEN 'III' ELSE 'IV' END AS cls FROM supplier, (SELECT quantile_cont(s_acctbal, [0.25, 0.5, 0.75]) q FROM supplier)")
def quartile_class(spark, d):
    s = A.with_totals(read(spark, d, "supplier"), q=F.percentile("s_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return s.select("s_suppkey", S.quartile_class(F.col("s_acctbal"), *[F.get("q", i) for i in range(3)]).alias("cls"))


@Q("SELECT p_partkey, CASE WHEN c = 'IV' AND p_size > 40 THEN 'III' WHEN c = 'II' AND p_size > 0 AND p_size < 10 THEN 'III' ELSE c END AS cls FROM (SELECT *, CASE WHEN p_retailprice >= 1500 THEN 'II' ELSE 'IV' END AS c FROM part)")
def count_override(spark, d):
    p = read(spark, d, "part").withColumn("c", F.when(F.col("p_retailprice") >= 1500, "II").otherwise("IV"))
    return p.select("p_partkey", S.count_override(F.col("c"), F.col("p_size") * 50).alias("cls"))


@Q("SELECT o_orderkey, CAST(1 + len(list_filter([1000.0, 50000.0, 120000.0, 250000.0], lambda b: b < o_totalprice)) AS INTEGER) AS cls FROM orders")
def break_class(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.break_class(F.col("o_totalprice"), F.array(*[F.lit(b) for b in (1000.0, 50000.0, 120000.0, 250000.0)])).alias("cls"))


@Q("""SELECT p_partkey, round(s, 6) + 0.0 AS score, CASE WHEN p_size > 48 THEN 2 WHEN s >= 31 THEN 0 WHEN s < 27 THEN 1 WHEN bd >= 0.025 THEN 0 ELSE 1 END AS label
FROM (SELECT p_partkey, p_size, bd, 50 * least(1.0, bd / b95) + 25 * least(1.0, rd / r95) + 15 * (1 - g) + 10 * g AS s
      FROM (SELECT p_partkey, p_size, p_retailprice / 50000 AS bd, CAST(p_size AS DOUBLE) AS rd, (p_partkey % 10) / CAST(10 AS DOUBLE) AS g FROM part),
           (SELECT quantile_cont(p_retailprice / 50000, 0.95) AS b95, quantile_cont(CAST(p_size AS DOUBLE), 0.95) AS r95 FROM part))""")
def urban_label(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 50000).alias("bd"), F.col("p_size").cast("double").alias("rd"), (F.pmod("p_partkey", F.lit(10)) / 10).alias("g"))
    p = A.with_totals(p, b=F.percentile("bd", 0.95), r=F.percentile("rd", 0.95))
    score = S.urban_score(F.col("bd"), F.col("rd"), F.col("g"), F.col("g"), F.col("b"), F.col("r"))
    return p.select("p_partkey", S.r6(score).alias("score"), S.urban_label(score, F.col("bd"), F.when(F.col("p_size") > 48, 1.0).otherwise(0.0)).alias("label"))


@Q("SELECT vec_id, CASE WHEN abs(x) <= 720 AND abs(y) <= 180 THEN 'geographic' WHEN abs(x) >= 1e7 THEN 'zoned' ELSE 'dezoned' END AS axis FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10000 AS x, CAST(embedding[2] AS DOUBLE) * 10000 AS y FROM embeddings)")
def axis_state(spark, d):
    from .tables import points

    return points(spark, d).select("vec_id", S.axis_state(F.col("x"), F.col("y")).alias("axis"))


@Q("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.6 ELSE NULL END::DOUBLE AS w, CASE WHEN p_size % 4 = 3 THEN 0.0 ELSE 0.0 END::DOUBLE AS barred, CASE p_size % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 ELSE NULL END::DOUBLE AS coef FROM part")
def road_weights(spark, d):
    kinds = F.array(F.lit("primary"), F.lit("['service', 'track']"), F.lit("footway"), F.lit("unlisted"))
    text = F.get(kinds, F.col("p_size") % 4)
    classes = S.class_list(text)
    table = {"primary": 0.9, "service": 0.8, "track": 0.6, "footway": 0.6}
    return read(spark, d, "part").select("p_partkey", S.least_weight(classes, table).alias("w"), S.restricted(text, ["motorway", "trunk"]).alias("barred"), S.network_coefficient(classes, table, 0.5).alias("coef"))


@Q("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 75, 9) AS walk, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice * l_discount / 240 END, 9) + 0.0 AS bike, round(CASE WHEN l_tax > 0 THEN l_tax ELSE l_extendedprice / (5000 / CAST(60 AS DOUBLE)) END, 6) AS given FROM lineitem")
def travel_times(spark, d):
    m = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.walk_minutes(m), 9).alias("walk"), F.round(S.bike_minutes(m, F.col("l_discount")), 9).alias("bike"), F.round(S.given_or_speed(F.col("l_tax"), m, 5000 / 60), 6).alias("given"))


@Q("SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN '***' WHEN p_retailprice < 1100 THEN '**' WHEN p_retailprice < 1500 THEN '*' ELSE 'ns' END AS star, CASE WHEN p_size <= 10 THEN 'none' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size FROM part")
def label_classes(spark, d):
    p = F.col("p_retailprice")
    pv = F.when(p < 950, 0.0005).when(p < 1100, 0.005).when(p < 1500, 0.03).otherwise(0.5)
    return read(spark, d, "part").select("p_partkey", S.stars(pv).alias("star"), S.size_class(F.col("p_size") * 10 - 100).alias("size"))


@Q("SELECT c_custkey, ceil(least(greatest(CASE WHEN p >= 1 THEN n WHEN p > 0 THEN n / p ELSE n END, 200.0), greatest(n * 3.5, 200.0)) / 50) * 50 AS seats FROM (SELECT c_custkey, CAST(c_custkey % 900 AS DOUBLE) AS n, c_acctbal / 5000 AS p FROM customer)")
def capacity(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(900)).cast("double").alias("n"), (F.col("c_acctbal") / 5000).alias("p"))
    return c.select("c_custkey", S.seats(F.col("n"), F.col("p")).cast("double").alias("seats"))


@Q("SELECT s_suppkey, least(CASE WHEN s < 50 THEN s * 3 ELSE s END, 10000.0) AS supply FROM (SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN CASE s_suppkey % 2 WHEN 0 THEN 1080.0 ELSE 1620.0 END ELSE s_acctbal END AS s FROM supplier)")
def supply_fallback(spark, d):
    from ..operators.models import supply_with_fallback

    stage = F.when(F.col("s_suppkey") % 2 == 0, "primary").otherwise("middle")
    return read(spark, d, "supplier").select("s_suppkey", supply_with_fallback(F.col("s_acctbal"), stage, {"primary": 1080.0, "middle": 1620.0}, 1200.0).alias("supply"))


@Q("SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN quality = toxic THEN quality ELSE 0 END) AS BIGINT) AS voted FROM labels GROUP BY quality, toxic")
def majority_vote(spark, d):
    l = read(spark, d, "labels")
    return l.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(S.majority(F.col("quality"), F.col("toxic"))).cast("long").alias("voted"))


@Q("SELECT name, round(rate, 6) AS rate FROM (SELECT 'o_orderkey' AS name, avg((o_orderkey IS NOT NULL)::DOUBLE) AS rate FROM orders UNION ALL SELECT 'o_totalprice', avg((o_totalprice IS NOT NULL)::DOUBLE) FROM orders)")
def null_rates(spark, d):
    return IO.null_rates(read(spark, d, "orders").select("o_orderkey", "o_totalprice")).select("name", F.round("rate", 6).alias("rate"))


@Q("SELECT event_id, CASE WHEN e.value >= 0 AND e.value < 200 THEN round(coalesce(greatest(p.p_retailprice, 0), 0), 6) + 0.0 ELSE 0.0 END AS value FROM events e LEFT JOIN part p ON p.p_partkey = 1 + CAST(floor(e.value / 10) AS BIGINT) + 20 * CAST(floor((100 - e.user_id % 100) / 10) AS BIGINT)")
def raster_sample(spark, d):
    p = read(spark, d, "events").select("event_id", F.col("value").alias("x"), F.pmod("user_id", F.lit(100)).cast("double").alias("y"))
    px = read(spark, d, "part").select(F.floor((F.col("p_partkey") - 1) / 20).alias("row"), F.pmod(F.col("p_partkey") - 1, F.lit(20)).alias("col"), F.col("p_retailprice").alias("value"))
    return IO.sample_raster(p, px, 0.0, 100.0, 10.0).select("event_id", S.r6(F.col("value")).alias("value"))


@Q("SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS no, CAST(length(html) AS INTEGER) AS n FROM pages WHERE regexp_matches(url, '/(en|de)/')")
def pattern_filter(spark, d):
    p = read(spark, d, "pages").filter(F.col("url").rlike("/(en|de)/"))
    return p.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("no"), F.length("html").alias("n"))


@Q("SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE, 4) AS y FROM embeddings)")
def wkt_points(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.concat(F.lit("POINT ("), F.round(F.get("embedding", 0).cast("double"), 4).cast("string"), F.lit(" "), F.round(F.get("embedding", 1).cast("double"), 4).cast("string"), F.lit(")")).alias("wkt"))
    x, y = S.point_of_wkt(F.col("wkt"))
    return e.select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@Q("SELECT o_orderkey, split_part(replace(o_orderpriority, '-', '_'), '_', 1) AS family, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS risk FROM orders")
def family_and_risk(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", S.family(F.replace("o_orderpriority", F.lit("-"), F.lit("_"))).alias("family"), S.lookup(F.col("o_orderstatus"), {"F": 1, "O": 2}, 3).alias("risk"))
