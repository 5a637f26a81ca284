"""Queries of aggregates, ranks, concentration and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluation as V
from ..operators import models as M
from ..operators import stats as A
from .registry import Registry
from .tables import points, read

Q = Registry()


@Q("SELECT s_suppkey, CAST(rank() OVER (ORDER BY s_acctbal DESC) AS BIGINT) AS rank_min FROM supplier")
def rank_min(spark, d):
    return A.ranks(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", descending=True).select("s_suppkey", "rank_min")


@Q("SELECT p_partkey, rank() OVER (ORDER BY CAST(p_size AS DOUBLE)) + (count(*) OVER (PARTITION BY p_size) - 1) / CAST(2 AS DOUBLE) AS rank_avg FROM part")
def rank_avg(spark, d):
    return A.ranks(read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v")), "v").select("p_partkey", "rank_avg")


@Q("SELECT p_size, round(sum(p_retailprice), 2) AS price, round(sum(sum(p_retailprice)) OVER (ORDER BY p_size), 2) AS cum, CAST(sum(count(*)) OVER (ORDER BY p_size) AS BIGINT) AS n FROM part GROUP BY p_size")
def cumshare(spark, d):
    run = A.running(read(spark, d, "part").select(F.col("p_size").cast("double").alias("s"), "p_retailprice"), "s", ["p_retailprice"])
    return run.select(F.col("s").cast("int").alias("p_size"), F.round("p_retailprice", 2).alias("price"), F.round("cum_p_retailprice", 2).alias("cum"), F.col("cum_n").alias("n"))


@Q("""WITH r AS (SELECT l_extendedprice AS v, l_quantity AS w FROM lineitem),
g AS (SELECT v, sum(w) AS w, sum(v * w) AS vw FROM r GROUP BY v), t AS (SELECT sum(w) AS tw, sum(v * w) AS tv FROM r),
c AS (SELECT w / tw AS dx, vw / tv AS dy, sum(vw) OVER (ORDER BY v) / tv AS y FROM g, t)
SELECT round(1 - sum(dx * (2 * y - dy)), 6) AS gini FROM c""")
def weighted_gini(spark, d):
    return A.weighted_gini(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity").select(F.round("gini", 6).alias("gini"))


@Q("""WITH r AS (SELECT CAST(p_size AS DOUBLE) AS v, p_retailprice AS w FROM part), g AS (SELECT v, sum(w) AS w, sum(v * w) AS vw FROM r GROUP BY v), t AS (SELECT sum(w) AS tw, sum(v * w) AS tv FROM r)
SELECT v, round(sum(w) OVER (ORDER BY v) / tw, 6) AS x, round(sum(vw) OVER (ORDER BY v) / tv, 6) AS y FROM g, t""")
def lorenz(spark, d):
    c = A.lorenz(read(spark, d, "part").select(F.col("p_size").cast("double").alias("v0"), "p_retailprice"), "v0", "p_retailprice")
    return c.select("v", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@Q("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS t FROM n GROUP BY 1)
SELECT n.user_id, round(-sum(n / t * ln(n / t + 1e-12)), 6) + 0.0 AS h, CAST(max(t) AS BIGINT) AS n FROM n JOIN t USING (user_id) GROUP BY n.user_id""")
def entropy_by_user(spark, d):
    return A.entropy(read(spark, d, "events"), ["user_id"], "event_type").select("user_id", S.r6(F.col("entropy")).alias("h"), F.col("total").alias("n"))


@Q("""WITH l AS (SELECT 'p_size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
x AS (SELECT name, min(v) lo, max(v) hi, count(*) n FROM l GROUP BY name), z AS (SELECT l.name, n, (v - lo) / (hi - lo) AS z FROM l JOIN x ON l.name = x.name),
s AS (SELECT name, sum(z) AS s FROM z GROUP BY name), e AS (SELECT z.name, -sum(CASE WHEN z = 0 THEN 1e-9 ELSE z / s END * ln(CASE WHEN z = 0 THEN 1e-9 ELSE z / s END)) / ln(max(n)) AS e FROM z JOIN s ON z.name = s.name GROUP BY z.name)
SELECT name, round((1 - e) / (SELECT sum(1 - e) FROM e), 6) AS weight FROM e""")
def entropy_weights(spark, d):
    return A.entropy_weights(read(spark, d, "part"), ["p_size", "p_retailprice"]).select("name", F.round("weight", 6).alias("weight"))


@Q("""SELECT count(*) AS n, CAST(count(*) FILTER (value = 0) AS BIGINT) AS zeros, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std,
round(stddev_samp(value) / avg(value), 6) AS cv, round(skewness(value), 4) AS skew, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95 FROM events""")
def dist_diag(spark, d):
    x = A.diagnostics(read(spark, d, "events"), "value")
    return x.select("n", "zeros", *[F.round(c, 4 if c == "skew" else 6).alias(c) for c in ("mean", "median", "std", "cv", "skew", "p5", "p95")])


@Q("""WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS a,
rank() OVER (ORDER BY CAST(o_custkey AS DOUBLE)) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE AS b FROM orders) SELECT round(corr(a, b), 6) + 0.0 AS rho FROM r""")
def spearman(spark, d):
    o = read(spark, d, "orders").select("o_totalprice", F.col("o_custkey").cast("double").alias("c"))
    return A.spearman(o, "o_totalprice", "c").select(S.r6(F.col("rho")).alias("rho"))


@Q("""WITH t AS (SELECT CAST(sum(quality * toxic) AS DOUBLE) AS tp, CAST(sum(quality * (1 - toxic)) AS DOUBLE) AS fp, CAST(sum((1 - quality) * toxic) AS DOUBLE) AS fn, CAST(sum((1 - quality) * (1 - toxic)) AS DOUBLE) AS tn, CAST(count(*) AS DOUBLE) AS n FROM labels),
p AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM t)
SELECT round(po, 6) AS po, round((po - pe) / (1 - pe), 6) + 0.0 AS kappa, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM p""")
def kappa(spark, d):
    return A.kappa(read(spark, d, "labels"), "quality", "toxic").select(F.round("po", 6).alias("po"), S.r6(F.col("kappa")).alias("kappa"), F.round("f1", 6).alias("f1"))


@Q("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c),
a AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM c GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM s, a, b""")
def adjusted_rand(spark, d):
    return A.adjusted_rand(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(S.r6(F.col("ari")).alias("ari"))


@Q("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, round(quantile_cont(l_discount, 0.8), 6) AS p80 FROM lineitem GROUP BY l_returnflag")
def group_stats(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.percentile("l_discount", 0.8), 6).alias("p80"))


@Q("""SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS pct_f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS pct_o,
round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS pct_p FROM orders GROUP BY o_custkey""")
def class_shares(spark, d):
    p = read(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    v = {c: F.coalesce(c, F.lit(0.0)) for c in "FOP"}
    total = v["F"] + v["O"] + v["P"]
    return p.select("o_custkey", *[F.round(v[c] / total, 6).alias(f"pct_{c.lower()}") for c in "FOP"])


@Q("SELECT l_suppkey, arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS cheapest, CAST(count(DISTINCT CAST(floor(l_extendedprice / 1000) AS BIGINT)) AS BIGINT) AS bins FROM lineitem GROUP BY l_suppkey")
def first_per_group(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("cheapest"), F.count_distinct(F.floor(F.col("l_extendedprice") / 1000)).alias("bins"))


@Q("SELECT l_suppkey, l_returnflag AS mode FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def mode_per_group(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_suppkey").agg(F.min(F.struct(-F.col("n"), "l_returnflag"))["l_returnflag"].alias("mode"))


@Q("SELECT 'c' AS layer, c_custkey AS id, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def union_layers(spark, d):
    c = read(spark, d, "customer").select(F.lit("c").alias("layer"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return c.unionByName(read(spark, d, "supplier").select(F.lit("s").alias("layer"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")))


@Q("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def dedupe_first(spark, d):
    return A.dedupe_first(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey").alias("_o")])


@Q("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_ids(spark, d):
    big = read(spark, d, "orders").filter("o_totalprice > 200000")
    c = read(spark, d, "customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_semi").select("c_custkey")


@Q("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_ids(spark, d):
    big = read(spark, d, "orders").filter("o_totalprice > 200000")
    c = read(spark, d, "customer")
    return c.join(big, c["c_custkey"] == big["o_custkey"], "left_anti").select("c_custkey")


@Q("SELECT s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS n, round(coalesce(sum(l_quantity), 0), 2) AS qty FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R' GROUP BY s_suppkey")
def left_profile(spark, d):
    per = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n"), F.sum("l_quantity").alias("qty"))
    s = read(spark, d, "supplier")
    return s.join(per, s["s_suppkey"] == per["l_suppkey"], "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("qty", F.lit(0.0)), 2).alias("qty"))


@Q("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name")


@Q("SELECT c_nationkey AS nation, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def key_conflicts(spark, d):
    return A.conflicts(read(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), "nation")


@Q("SELECT round(max(abs(a - b)), 6) AS max_abs, round(median(100 * abs(a - b) / greatest(abs(b), 1e-9)), 6) AS median_rel, round(corr(a, b), 6) AS corr, round(avg((a = b)::DOUBLE), 6) AS equal_rate FROM (SELECT o_totalprice AS a, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1.01 ELSE o_totalprice END AS b FROM orders)")
def compare_tables(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    old = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") * 1.01).otherwise(F.col("o_totalprice")))
    r = A.compare(o, old, "o_orderkey", "o_totalprice")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@Q("""WITH b AS (SELECT unnest(range(0, 200)) AS r), s AS (SELECT s_suppkey - min(s_suppkey) OVER () AS i, s_acctbal + 1000 AS v, count(*) OVER () AS n FROM supplier),
u AS (SELECT r, i, n, ((i * 1103515245 + r * 12345 + 42) % 1000003) AS m FROM s, b), k AS (SELECT r, n, CAST(floor(((m * m + m * 7919 + r * 104729) % 999983) / CAST(999983 AS DOUBLE) * n) AS BIGINT) AS pick FROM u),
m AS (SELECT k.r, avg(s.v) AS mean FROM k JOIN s ON s.i = k.pick GROUP BY k.r)
SELECT CAST(count(*) AS BIGINT) AS runs, round(avg(mean), 4) AS mean, round(quantile_cont(mean, 0.025), 4) AS lo, round(quantile_cont(mean, 0.975), 4) AS hi, round(stddev_samp(mean) / avg(mean), 6) AS cv FROM m""")
def bootstrap_ci(spark, d):
    s = A.with_totals(read(spark, d, "supplier"), k0=F.min("s_suppkey")).select((F.col("s_suppkey") - F.col("k0")).alias("i"), (F.col("s_acctbal") + 1000).alias("v"))
    m = V.resampled(s, "i", s.count(), 200).groupBy("r").agg(F.avg("v").alias("mean"))
    return m.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("mean"), 4).alias("mean"), F.round(F.percentile("mean", 0.025), 4).alias("lo"), F.round(F.percentile("mean", 0.975), 4).alias("hi"), F.round(F.stddev_samp("mean") / F.avg("mean"), 6).alias("cv"))


@Q("SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def histogram(spark, d):
    h = read(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return A.with_totals(h, t=F.sum("n")).select("bin", "n", F.round(100 * F.col("n") / F.col("t"), 6).alias("pct"))


@Q("""SELECT round(avg(abs(a - b) / greatest(abs(a), 0.01)), 6) AS mape, round(median(abs(a - b) / greatest(abs(a), 0.01)), 6) AS mdape, round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*)), 4) AS r2, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse, round(avg(abs(a - b)), 4) AS mae
FROM (SELECT l_extendedprice AS a, l_quantity * 1000.0 AS b FROM lineitem)""")
def regression_scores(spark, d):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * 1000.0
    e, rel = a - b, F.abs(a - b) / F.greatest(F.abs(a), F.lit(0.01))
    l = read(spark, d, "lineitem")
    return l.agg(F.round(F.avg(rel), 6).alias("mape"), F.round(F.lit(A.quantiles(l, rel, [0.5])[0]).cast("double"), 6).alias("mdape"), F.round(1 - F.sum(e * e) / (F.var_pop(a) * F.count(a)), 4).alias("r2"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


@Q("SELECT vec_id, label, round((x - m) / s, 6) + 0.0 AS z FROM (SELECT vec_id, label, embedding[1]::DOUBLE * 10000 AS x FROM embeddings), (SELECT avg(embedding[1]::DOUBLE * 10000) AS m, stddev_pop(embedding[1]::DOUBLE * 10000) AS s FROM embeddings)")
def standardised(spark, d):
    return M.standardise(points(spark, d).select("vec_id", "label", "x"), ["x"]).select("vec_id", "label", S.r6(F.col("x")).alias("z"))


@Q("""WITH b AS (SELECT o_orderkey, o_totalprice, CAST(len(list_filter(q, lambda c: c < o_totalprice)) AS INTEGER) AS bin, (o_orderkey * 1103515245 + 12345) % 1000003 AS u FROM orders, (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders))
SELECT o_orderkey, o_totalprice, bin, CAST((row_number() OVER (PARTITION BY bin ORDER BY u, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM b""")
def strat_folds(spark, d):
    return A.kfolds(read(spark, d, "orders"), "o_orderkey", "o_totalprice")


@Q("SELECT event_type, date_trunc('day', ts) AS start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from ..streaming.windows import windowed

    return windowed(read(spark, d, "events")).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
