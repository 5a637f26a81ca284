"""Queries of accessibility by stage, coverage, fairness, robustness, plans, reviews and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluation as V
from ..operators import models as M
from ..operators import shapley as H
from ..operators import spatial as G
from ..operators import stats as A
from ..operators import text as X
from ..operators.lineage import cut
from .planning_queries import _U
from .registry import Registry
from .spatial_queries import _KNN, _neighbours
from .tables import POINTS, TRAVEL, points, read, travel
from .text_queries import _BASE, LEXICON, NOT, WORDS, _corpus, _demand, _levels, _lexicon

Q = Registry()
LIMITS, SHARES = {"primary": 4.0, "middle": 5.0}, {"primary": 0.667, "middle": 0.333}


def _two_step_sql(name, stage, limit, share, supply):
    return f"""l_{name} AS (SELECT od.j, sum(d * {share} * exp(-0.15 * (t / {limit}) ** 2)) AS l FROM od JOIN dem USING (i) WHERE t <= {limit} AND od.j % 2 = {stage} GROUP BY od.j),
r_{name} AS (SELECT x.j, CASE WHEN x.s <= 0 THEN 0 WHEN coalesce(l, 0) <= 1e-6 THEN x.s ELSE x.s / l END AS r FROM {supply} x LEFT JOIN l_{name} l ON x.j = l.j WHERE x.j % 2 = {stage}),
a_{name} AS (SELECT i, {share} * sum(r * exp(-0.15 * (t / {limit}) ** 2)) AS a FROM od JOIN r_{name} r USING (j) WHERE t <= {limit} GROUP BY i)"""


_ACCESS = f"""{TRAVEL}, dem AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS d FROM customer GROUP BY 1), sup AS (SELECT l_suppkey AS j, sum(l_quantity) AS s FROM lineitem GROUP BY 1),
sup2 AS (SELECT j, CASE WHEN j % 3 = 0 THEN s * 1.4 ELSE s END AS s FROM sup),
{_two_step_sql("p", 0, 4.0, 0.667, "sup")}, {_two_step_sql("m", 1, 5.0, 0.333, "sup")}, {_two_step_sql("p2", 0, 4.0, 0.667, "sup2")}, {_two_step_sql("m2", 1, 5.0, 0.333, "sup2")},
acc AS (SELECT dem.i, d, coalesce(p.a, 0) + coalesce(m.a, 0) AS b, coalesce(p2.a, 0) + coalesce(m2.a, 0) AS a FROM dem LEFT JOIN a_p p ON dem.i = p.i LEFT JOIN a_m m ON dem.i = m.i LEFT JOIN a_p2 p2 ON dem.i = p2.i LEFT JOIN a_m2 m2 ON dem.i = m2.i),
tm AS (SELECT i, min(t) AS tb, min(CASE WHEN j % 3 = 0 THEN t * 0.9 ELSE t END) AS ta FROM od GROUP BY i),
fr AS (SELECT acc.*, tb, ta, 1 + acc.i % 5 AS risk, b = 0 OR b <= (SELECT quantile_cont(b, 0.25) FROM acc WHERE b > 0) AS low FROM acc LEFT JOIN tm ON acc.i = tm.i)"""


def _supply(spark, d, after=False):
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("s"))
    more = F.when(F.pmod("j", F.lit(3)) == 0, F.col("s") * 1.4).otherwise(F.col("s")) if after else F.col("s")
    return s.select("j", more.alias("s"), F.when(F.pmod("j", F.lit(2)) == 0, "primary").otherwise("middle").alias("stage"))


def _people(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("d"))


def _access(spark, d, od, after=False):
    return V.stage_access(od, _supply(spark, d, after), _people(spark, d), LIMITS, SHARES)


@Q(f"WITH {_ACCESS} SELECT i, round(b, 5) + 0.0 AS a FROM acc")
def stage_access(spark, d):
    return _access(spark, d, cut(travel(spark, d))).select("i", (F.round("a", 5) + F.lit(0.0)).alias("a"))


def _fair_rows(spark, d):
    od = cut(travel(spark, d))
    b, a = _access(spark, d, od).withColumnRenamed("a", "b"), _access(spark, d, od, True)
    times = od.groupBy("i").agg(F.min("t").alias("tb"), F.min(F.when(F.pmod("j", F.lit(3)) == 0, F.col("t") * 0.9).otherwise(F.col("t"))).alias("ta"))
    rows = cut(_people(spark, d).join(b, "i").join(a, "i").join(times, "i", "left"))
    rows = A.with_totals(rows, q=F.percentile(F.when(F.col("b") > 0, F.col("b")), 0.25))
    return rows.withColumn("low", (F.col("b") == 0) | (F.col("b") <= F.col("q"))).withColumn("risk", 1 + F.pmod("i", F.lit(5))).drop("q")


_GINI = "(SELECT 1 - sum(w / tw * (2 * y - vw) / tv) FROM (SELECT w, vw, sum(vw) OVER (ORDER BY v) AS y, sum(w) OVER () AS tw, sum(vw) OVER () AS tv FROM (SELECT {v} AS v, sum(d) AS w, sum(d * ({v})) AS vw FROM {t} GROUP BY 1)))"
_LACK = "CASE WHEN b > 0 OR a > 0 THEN 1 - {c} / (SELECT greatest(max(b), max(a), 1e-6) FROM fr) ELSE 1.0 END"
_FAIR = f"""{_ACCESS}, fa AS (SELECT round({_GINI.format(v=_LACK.format(c='b'), t='fr')}, 6) AS gini_before, round({_GINI.format(v=_LACK.format(c='a'), t='fr')}, 6) AS gini_after, round({_GINI.format(v='tb', t='fr')}, 6) AS gini_time_before, round({_GINI.format(v='ta', t='fr')}, 6) AS gini_time_after,
CAST(count(*) FILTER (low) AS BIGINT) AS n_low, CAST(count(*) FILTER (low AND a > b * 1.01) AS BIGINT) AS n_low_improved, coalesce(avg(b) FILTER (low), 0) AS low_before, coalesce(avg(a) FILTER (low), 0) AS low_after, coalesce(avg(b) FILTER (risk >= 4), 0) AS high_before, coalesce(avg(a) FILTER (risk >= 4), 0) AS high_after,
avg((b >= (SELECT quantile_cont(b, 0.25) FROM acc WHERE b > 0))::DOUBLE) AS covered_before, avg((a >= (SELECT quantile_cont(b, 0.25) FROM acc WHERE b > 0))::DOUBLE) AS covered_after, CAST(count(*) FILTER (a > b * 1.001) AS BIGINT) AS n_improved, CAST(count(*) FILTER (a < b * 0.999) AS BIGINT) AS n_degraded FROM fr)"""
_COUNTS = {"n_low", "n_low_improved", "n_improved", "n_degraded"}
_FAIR_COLS = ["gini_before", "gini_after", "gini_time_before", "gini_time_after", "n_low", "n_low_improved", "low_before", "low_after", "high_before", "high_after", "covered_before", "covered_after", "n_improved", "n_degraded"]


@Q(f"WITH {_FAIR} SELECT {', '.join(c if c in _COUNTS else f'round({c}, 5) + 0.0 AS {c}' for c in _FAIR_COLS)} FROM fa")
def benefit_evaluation(spark, d):
    f = V.fairness(_fair_rows(spark, d))
    return f.select(*[F.col(c) if c in _COUNTS else (F.round(c, 5) + F.lit(0.0)).alias(c) for c in _FAIR_COLS])


@Q(f"WITH {_ACCESS}, u AS (SELECT *, CASE WHEN i % 4 = 0 THEN d * 0.25 ELSE 0 END AS unmet FROM fr) SELECT round(1 - sum(unmet) / sum(d), 6) AS coverage, round(1 - sum(unmet) FILTER (risk >= 4) / sum(d) FILTER (risk >= 4), 6) AS high_risk, round(1 - sum(unmet) FILTER (low) / sum(d) FILTER (low), 6) AS low_access FROM u")
def efficiency_report(spark, d):
    rows = _fair_rows(spark, d).withColumn("unmet", F.when(F.pmod("i", F.lit(4)) == 0, F.col("d") * 0.25).otherwise(0.0))
    c = V.coverage(rows, "d", "unmet", F.col("risk") >= 4, F.col("low"))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


def _u(k, off):
    return _U.format(k=f"({k} + {off})" if off else k)


_ROBUST = f"""{_ACCESS}, mc AS (SELECT r, d * (0.95 + 0.1 * ({_u('i', 0)})) AS d, a * (0.9 + 0.2 * ({_u('i', 31)})) AS a, (CASE WHEN i % 4 = 0 THEN d * 0.25 ELSE 0 END) * (0.95 + 0.1 * ({_u('i', 67)})) AS u FROM fr, (SELECT unnest(range(0, 500)) AS r)),
mm AS (SELECT mc.r, d, u, (a - lo) / (hi - lo) AS m FROM mc JOIN (SELECT r, min(a) AS lo, max(a) AS hi FROM mc GROUP BY r) x ON mc.r = x.r),
mg AS (SELECT r, 1 - sum(w / tw * (2 * y - vw) / tv) AS gini FROM (SELECT r, w, vw, sum(vw) OVER (PARTITION BY r ORDER BY v) AS y, sum(w) OVER (PARTITION BY r) AS tw, sum(vw) OVER (PARTITION BY r) AS tv FROM (SELECT r, 1 - m AS v, sum(d) AS w, sum(d * (1 - m)) AS vw FROM mm GROUP BY r, 1 - m)) GROUP BY r),
mr AS (SELECT mm.r, 1 - sum(u) / greatest(sum(d), 1.0) AS coverage, sum(CASE WHEN m < 0.1 THEN d ELSE 0 END) AS gap, any_value(gini) AS gini FROM mm JOIN mg ON mm.r = mg.r GROUP BY mm.r),
ro AS (SELECT CAST(count(*) AS BIGINT) AS runs, avg(coverage) AS coverage_mean, stddev_samp(coverage) / (avg(coverage) + 1e-9) AS coverage_cv, avg(gini) AS gini_mean, stddev_samp(gini) / (avg(gini) + 1e-9) AS gini_cv, avg(gap) AS gap_mean, stddev_samp(gap) / (avg(gap) + 1e-9) AS gap_cv FROM mr)"""


def _robust(spark, d):
    rows = _fair_rows(spark, d).withColumn("unmet", F.when(F.pmod("i", F.lit(4)) == 0, F.col("d") * 0.25).otherwise(0.0))
    return V.robustness(rows, "i", "d", "a", "unmet")


@Q(f"WITH {_ROBUST} SELECT runs, {', '.join(f'round({c}_mean, 4) + 0.0 AS {c}_mean, round({c}_cv, 5) + 0.0 AS {c}_cv' for c in ('coverage', 'gini', 'gap'))} FROM ro")
def robustness_report(spark, d):
    r = _robust(spark, d)
    return r.select("runs", *[(F.round(c, 4 if c.endswith("mean") else 5) + F.lit(0.0)).alias(c) for c in r.columns if c != "runs"])


@Q(f"WITH {_ROBUST}, {_FAIR.replace(_ACCESS + ', ', '')} SELECT round(gini_before - gini_after, 5) + 0.0 AS gini_gain, round(low_after - low_before, 5) + 0.0 AS low_gain, round(high_after - high_before, 5) + 0.0 AS high_gain, gini_before >= gini_after AS gini_ok, coverage_cv < 0.05 AS coverage_ok, gini_cv < 0.10 AS spread_ok FROM fa, ro")
def summary_banner(spark, d):
    b = V.banner(V.fairness(_fair_rows(spark, d)), _robust(spark, d))
    return b.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("gini_gain", "low_gain", "high_gain")], "gini_ok", "coverage_ok", "spread_ok")


@Q(f"""WITH s AS (SELECT s_suppkey - min(s_suppkey) OVER () AS i, count(*) OVER () AS n, s_acctbal + 1000 AS b, (s_acctbal + 1000) * (0.9 + (s_suppkey % 3) / 10.0::DOUBLE) AS a, 1.0 + s_suppkey % 7 AS w FROM supplier),
k AS (SELECT r, n, least(CAST(floor(({_U.format(k='i')}) * n) AS BIGINT), n - 1) AS pick FROM s, (SELECT unnest(range(0, 1000)) AS r)), x AS (SELECT k.r, b, a, w FROM k JOIN s ON s.i = k.pick),
g AS (SELECT r, c, 1 - sum(ww / tw * (2 * y - vw) / tv) AS gini FROM (SELECT r, c, ww, vw, sum(vw) OVER (PARTITION BY r, c ORDER BY v) AS y, sum(ww) OVER (PARTITION BY r, c) AS tw, sum(vw) OVER (PARTITION BY r, c) AS tv FROM (SELECT r, c, v, sum(w) AS ww, sum(v * w) AS vw FROM (SELECT r, 'b' AS c, b AS v, w FROM x UNION ALL SELECT r, 'a', a, w FROM x) GROUP BY r, c, v)) GROUP BY r, c),
p AS (SELECT r, max(gini) FILTER (c = 'b') AS b, max(gini) FILTER (c = 'a') AS a FROM g GROUP BY r)
SELECT CAST(count(*) AS BIGINT) AS runs, round(avg(b), 5) AS before, round(quantile_cont(b, 0.025), 5) AS before_lo, round(quantile_cont(b, 0.975), 5) AS before_hi, round(avg(a), 5) AS after, round(quantile_cont(a, 0.025), 5) AS after_lo, round(quantile_cont(a, 0.975), 5) AS after_hi, round(stddev_pop(a) / (avg(a) + 1e-9), 5) AS after_cv, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 3) AS t FROM p""")
def gini_bootstrap(spark, d):
    s = A.with_totals(read(spark, d, "supplier"), k0=F.min("s_suppkey"))
    v = F.col("s_acctbal") + 1000
    s = s.select((F.col("s_suppkey") - F.col("k0")).alias("i"), v.alias("b"), (v * (0.9 + F.pmod("s_suppkey", F.lit(3)) / 10)).alias("a"), (1.0 + F.pmod("s_suppkey", F.lit(7))).alias("w"))
    g = V.gini_bootstrap(s, "i", s.count(), "b", "a", "w")
    return g.select(*[c if c == "runs" else F.round(c, 3 if c == "t" else 5).alias(c) for c in g.columns])


@Q(f"""WITH {TRAVEL}, x AS (SELECT j, sum(1.0 + i % 5) AS assigned FROM od WHERE t <= 2 GROUP BY j), s AS (SELECT s_suppkey AS j, s_suppkey % 4 AS blocks, 200.0 + s_suppkey % 9 * 50 AS capacity, (200.0 + s_suppkey % 9 * 50) * 0.5 AS age, CASE s_suppkey % 2 WHEN 0 THEN 0.667 ELSE 0.333 END AS share FROM supplier)
SELECT s.j, blocks, blocks * 50.0::DOUBLE AS new_seats, (capacity + blocks * 50)::DOUBLE AS capacity_after, round((age + blocks * 50 * share * 0.95)::DOUBLE, 6) AS age_after, coalesce(assigned, 0)::DOUBLE AS assigned, round((age + blocks * 50 * share * 0.95)::DOUBLE / greatest(coalesce(assigned, 0), 1)::DOUBLE, 6) AS ratio FROM s LEFT JOIN x ON s.j = x.j""")
def plan_tables(spark, d):
    k = F.col("s_suppkey")
    cap = 200.0 + F.pmod(k, F.lit(9)) * 50
    s = read(spark, d, "supplier").select(k.alias("j"), F.pmod(k, F.lit(4)).alias("blocks"), cap.alias("capacity"), (cap * 0.5).alias("age_capacity"), F.when(F.pmod(k, F.lit(2)) == 0, 0.667).otherwise(0.333).alias("share"))
    flows = travel(spark, d).filter("t <= 2").select("j", (1.0 + F.pmod("i", F.lit(5))).alias("x"))
    p = V.plan_table(s, flows)
    return p.select("j", "blocks", "new_seats", "capacity_after", F.round("age_after", 6).alias("age_after"), "assigned", F.round("ratio", 6).alias("ratio"))


@Q("""WITH r AS (SELECT quality AS a, toxic AS b, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS e, CASE WHEN quality = toxic THEN quality ELSE 0 END AS m FROM labels),
x AS (SELECT 'raters' AS name, a AS p, b AS q FROM r UNION ALL SELECT 'engine', e, m FROM r), t AS (SELECT name, sum(p * q)::DOUBLE AS tp, sum(p * (1 - q))::DOUBLE AS fp, sum((1 - p) * q)::DOUBLE AS fn, sum((1 - p) * (1 - q))::DOUBLE AS tn, count(*)::DOUBLE AS n FROM x GROUP BY name),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM t)
SELECT name, round(po, 6) AS po, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1 END, 6) + 0.0 AS kappa, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((SELECT avg((e = a AND e = b)::DOUBLE) FROM r), 6) AS exact FROM k""")
def review_stats(spark, d):
    l = read(spark, d, "labels").select("quality", "toxic", F.when(F.pmod("doc_id", F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("engine"))
    r = V.review(l, "quality", "toxic", "engine")
    return r.select("name", F.round("po", 6).alias("po"), S.r6(F.col("kappa")).alias("kappa"), F.round("f1", 6).alias("f1"), F.round("exact", 6).alias("exact"))


@Q("""WITH x AS (SELECT p_retailprice AS a, p_retailprice + p_size * 10.0 AS b, p_retailprice + (p_partkey % 97) * 3.0 AS t FROM part), r AS (SELECT a, b, t, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE AS rt FROM x),
c AS (SELECT count(*) AS n, corr(ra, rb) AS ab, corr(ra, rt) AS av, corr(rb, rt) AS bt, regr_slope(b, a) AS s1, regr_intercept(b, a) AS i1, regr_slope(t, a) AS s2, regr_slope(t, b) AS s3 FROM r)
SELECT CAST(n AS BIGINT) AS n, round(s1, 5) + 0.0 AS slope_ab, round(i1, 3) + 0.0 AS icept_ab, round(s2, 5) + 0.0 AS slope_at, round(s3, 5) + 0.0 AS slope_bt, round(ab, 5) + 0.0 AS rho_ab, round(av, 5) + 0.0 AS rho_at, round(bt, 5) + 0.0 AS rho_bt,
CASE WHEN ab > 0.4 AND bt > 0.2 AND abs(ab) * sqrt((n - 2) / greatest(1 - ab * ab, 1e-12)) > 1.96 AND abs(bt) * sqrt((n - 2) / greatest(1 - bt * bt, 1e-12)) > 1.96 THEN 'consistent' WHEN bt > 0 AND ab > 0.2 THEN 'same direction' ELSE 'divergent' END AS verdict FROM c""")
def model_consistency(spark, d):
    p = F.col("p_retailprice")
    rows = read(spark, d, "part").select(p.alias("a"), (p + F.col("p_size") * 10.0).alias("b"), (p + F.pmod("p_partkey", F.lit(97)) * 3.0).alias("t"))
    c = V.consistency(rows, "a", "b", "t")
    return c.select("n", "verdict", *[(F.round(x, 3 if x == "icept_ab" else 5) + F.lit(0.0)).alias(x) for x in c.columns if x not in ("n", "verdict")])


@Q(f"WITH {_KNN} SELECT vec_id, round(sum(sv / d2) / sum(1 / d2), 4) + 0.0 AS value, 'interpolated' AS source FROM k6 WHERE d2 > 0 GROUP BY vec_id")
def constant_guard(spark, d):
    """Predictions of a model that learned nothing are replaced by interpolated ones."""
    pred = points(spark, d).select("vec_id", F.lit(1.5).alias("p"))
    g = V.guarded(pred, "vec_id", "p", G.idw(_neighbours(spark, d), "vec_id", "sv"))
    return g.select("vec_id", (F.round("value", 4) + F.lit(0.0)).alias("value"), "source")


@Q("""WITH s AS (SELECT s_suppkey, greatest(0, least(1, 0.7 * ((s_acctbal + 1000) / 11000) + 0.3 * ((s_suppkey % 10) / 10.0::DOUBLE))) AS raw, s_suppkey % 7 = 0 AS imp, (s_suppkey % 5) / 5.0::DOUBLE AS conf FROM supplier),
b AS (SELECT s_suppkey, imp, CASE WHEN imp THEN conf * raw + (1 - conf) * (SELECT avg(raw) FROM s WHERE NOT imp) ELSE raw END AS raw FROM s)
SELECT s_suppkey, round((raw - lo) / (hi - lo), 6) + 0.0 AS score, CASE WHEN imp THEN 'imputed' ELSE 'original' END AS data_source FROM b, (SELECT min(raw) AS lo, max(raw) AS hi FROM b)""")
def soft_score(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k, ((F.col("s_acctbal") + 1000) / 11000).alias("sms"), (F.pmod(k, F.lit(10)) / 10).alias("l3"), (F.pmod(k, F.lit(5)) / 5).alias("conf"))
    return V.soft_score(s, "s_suppkey", "sms", "l3", F.pmod("s_suppkey", F.lit(7)) == 0, "conf").select("s_suppkey", S.r6(F.col("score")).alias("score"), "data_source")


@Q("SELECT data_source, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'imputed' ELSE 'original' END AS data_source FROM supplier) GROUP BY 1")
def imputation_report(spark, d):
    return soft_score(spark, d).groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))


@Q(f"""WITH {POINTS}, q AS (SELECT label, sum(v) * 1 AS pop FROM p WHERE label < 7 GROUP BY label), dm AS (SELECT label, greatest(coalesce(pop, 0), 0) * 0.1174 AS demand FROM q),
e AS (SELECT DISTINCT label, 100.0 + label * 50 AS supply FROM p), x AS (SELECT e.label, supply, coalesce(demand, (SELECT median(demand) FROM dm WHERE demand > 0)) AS demand FROM e LEFT JOIN dm ON e.label = dm.label)
SELECT label, round(demand, 4) + 0.0 AS demand, round(demand / (supply + 1e-9), 5) + 0.0 AS pressure FROM x""")
def pressure_chain(spark, d):
    p = points(spark, d)
    e = p.select("label").distinct().withColumn("supply", 100.0 + F.col("label") * 50)
    x = V.pressure(e, p.filter("label < 7").select("label", F.col("v").alias("pop")), "label")
    return x.select("label", (F.round("demand", 4) + F.lit(0.0)).alias("demand"), (F.round("pressure", 5) + F.lit(0.0)).alias("pressure"))


@Q(f"""WITH {POINTS}, g AS (SELECT vec_id, x, y, CASE WHEN vec_id % 6 = 0 THEN NULL ELSE v END AS v, x AS w FROM p), f AS (SELECT a.vec_id, avg(b.v) AS v FROM g a JOIN g b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 800 ** 2 AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
j AS (SELECT g.vec_id, coalesce(g.v, f.v) AS v, w, CASE WHEN g.v IS NULL AND f.v IS NOT NULL THEN 'refilled' ELSE 'kept' END AS method FROM g LEFT JOIN f ON g.vec_id = f.vec_id),
i AS (SELECT vec_id, method, 0.6 * ((v - l1) / (h1 - l1 + 1e-9)) + 0.4 * ((w - l2) / (h2 - l2 + 1e-9)) AS idx FROM j, (SELECT min(v) AS l1, max(v) AS h1, min(w) AS l2, max(w) AS h2 FROM j))
SELECT vec_id, method, round(idx, 5) + 0.0 AS "index", CASE WHEN idx IS NULL THEN NULL WHEN idx >= 0.6 THEN 'I' WHEN idx >= 0.5 THEN 'II' WHEN idx >= 0.4 THEN 'III' ELSE 'IV' END AS cls, CASE WHEN idx IS NULL THEN 0 ELSE CAST(rank() OVER (ORDER BY idx DESC NULLS LAST) AS BIGINT) END AS rank FROM i""")
def refilled_profile(spark, d):
    """Entities without a value take the mean of those within 800; index, class and rank follow with the weights of before."""
    p = cut(points(spark, d).select("vec_id", "x", "y", F.when(F.pmod("vec_id", F.lit(6)) != 0, F.col("v")).alias("v"), F.col("x").alias("w")))
    near = G.within(p, p.select(F.col("vec_id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("v").alias("sv")), 800.0).filter("vec_id <> sid")
    fill = near.groupBy("vec_id").agg(F.avg("sv").alias("v")).withColumn("w", F.lit(None).cast("double"))
    r = V.refilled(p.select("vec_id", "v", "w"), "vec_id", ["v", "w"], fill, {"v": 0.6, "w": 0.4}, [0.4, 0.5, 0.6])
    return r.select("vec_id", "method", (F.round("index", 5) + F.lit(0.0)).alias("index"), "cls", "rank")


def _sweep_base(window):
    return _BASE.replace("place - 60", f"place - {window}").replace("length(term) + 60", f"length(term) + {window}")


@Q(f"""WITH {_BASE}, n AS (SELECT count(*)::DOUBLE AS n FROM corp),
t(th) AS (VALUES (0.65), (0.75)), r0 AS (SELECT entity, list_sort(list(DISTINCT left(subdim, 2))) AS s FROM lev WHERE confidence >= 0.7 GROUP BY entity), r1 AS (SELECT th, entity, list_sort(list(DISTINCT left(subdim, 2))) AS s FROM lev, t WHERE confidence >= th GROUP BY th, entity),
c AS (SELECT 'threshold' AS parameter, th::DOUBLE AS value, (SELECT count(*) FROM corp LEFT JOIN r0 ON corp.entity = r0.entity LEFT JOIN (SELECT * FROM r1 WHERE r1.th = t.th) q ON corp.entity = q.entity WHERE r0.s IS DISTINCT FROM q.s) / n AS change FROM t, n),
w40 AS (WITH {_sweep_base(40)} SELECT * FROM lev), w80 AS (WITH {_sweep_base(80)} SELECT * FROM lev),
e0 AS (SELECT entity, list_sort(list(subdim)) AS s FROM lev WHERE level = 'E3' GROUP BY entity), e40 AS (SELECT entity, list_sort(list(subdim)) AS s FROM w40 WHERE level = 'E3' GROUP BY entity), e80 AS (SELECT entity, list_sort(list(subdim)) AS s FROM w80 WHERE level = 'E3' GROUP BY entity)
SELECT parameter, value, round(change, 6) AS change FROM c
UNION ALL SELECT 'window', 40, round((SELECT count(*) FROM corp LEFT JOIN e0 ON corp.entity = e0.entity LEFT JOIN e40 ON corp.entity = e40.entity WHERE e0.s IS DISTINCT FROM e40.s) / n, 6) FROM n
UNION ALL SELECT 'window', 80, round((SELECT count(*) FROM corp LEFT JOIN e0 ON corp.entity = e0.entity LEFT JOIN e80 ON corp.entity = e80.entity WHERE e0.s IS DISTINCT FROM e80.s) / n, 6) FROM n""")
def parameter_sweep(spark, d):
    """How many entities' sets of tags change with the threshold, and of third-level sub-dimensions with the window."""
    entities = _corpus(spark, d).select("entity")
    honours = cut(X.official(_corpus(spark, d), _lexicon(spark)))
    found = cut(X.evidence(_corpus(spark, d), _lexicon(spark), WORDS, NOT, others=(40, 80)))
    levels = {w: cut(X.levels(found if w == 60 else found.withColumn("cooccur", F.col(f"cooccur_{w}")), honours)) for w in (60, 40, 80)}
    tags = lambda th: levels[60].filter(F.col("confidence") >= th).select("entity", F.substring("subdim", 1, 2).alias("tag"))
    third = lambda w: levels[w].filter("level = 'E3'").select("entity", F.col("subdim").alias("tag"))
    out = [("threshold", th, V.set_change(tags(0.7), tags(th), entities, "entity", "tag")) for th in (0.65, 0.75)]
    out += [("window", float(w), V.set_change(third(60), third(w), entities, "entity", "tag")) for w in (40, 80)]
    parts = [c.select(F.lit(name).alias("parameter"), F.lit(v).alias("value"), F.round("change", 6).alias("change")) for name, v, c in out]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@Q(f"""WITH {_BASE}, s AS (SELECT raw.entity, raw / (1 + 0.15 * coalesce(rate, 0)) AS base, coalesce(rate, 0) AS rate FROM raw LEFT JOIN ver ON raw.entity = ver.entity), x AS (SELECT base * (1 + 0.15 * rate) AS a, base * (1 + 0.10 * rate) AS b, base * (1 + 0.20 * rate) AS c FROM s),
k AS (SELECT rank() OVER (ORDER BY round(a, 9)) + (count(*) OVER (PARTITION BY round(a, 9)) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY round(b, 9)) + (count(*) OVER (PARTITION BY round(b, 9)) - 1) / 2.0::DOUBLE AS b, rank() OVER (ORDER BY round(c, 9)) + (count(*) OVER (PARTITION BY round(c, 9)) - 1) / 2.0::DOUBLE AS c FROM x)
SELECT 0.10::DOUBLE AS alpha, round(corr(a, b), 4) AS rho FROM k UNION ALL SELECT 0.20, round(corr(a, c), 4) FROM k""")
def alpha_sweep(spark, d):
    """Rank correlation of match scores with those of other weights of the verified rate."""
    rolled, wanted = cut(X.rollup(_levels(spark, d))), cut(_demand(spark, d))
    verified = read(spark, d, "labels").select(F.col("doc_id").alias("entity"), F.col("quality").cast("double").alias("rate"))
    of = lambda alpha: X.match_scores(rolled, wanted, verified, alpha)
    base, out = of(0.15).withColumnRenamed("score", "a"), None
    for alpha in (0.10, 0.20):
        both = base.join(of(alpha).withColumnRenamed("score", "b"), "entity").select(F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))
        row = A.spearman(both, "a", "b").select(F.lit(alpha).alias("alpha"), F.round("rho", 4).alias("rho"))
        out = row if out is None else out.unionByName(row)
    return out


@Q(f"""WITH {_BASE}, g AS (SELECT corp.entity, x.subdim, coalesce(lev.level IN ('E1', 'E3'), false)::INT AS p, coalesce(lev.honour, false)::INT AS q FROM corp CROSS JOIN (SELECT DISTINCT subdim FROM lex) x LEFT JOIN lev ON corp.entity = lev.entity AND x.subdim = lev.subdim),
t AS (SELECT sum(p * q)::DOUBLE AS tp, sum(p * (1 - q))::DOUBLE AS fp, sum((1 - p) * q)::DOUBLE AS fn, sum((1 - p) * (1 - q))::DOUBLE AS tn, count(*)::DOUBLE AS n FROM g)
SELECT round((SELECT count(DISTINCT entity) FROM roll) / (SELECT count(*) FROM corp)::DOUBLE, 6) AS covered, CAST((SELECT count(*) FROM roll) AS BIGINT) AS eligible, round((SELECT avg(honour::INT) FROM roll), 6) AS verified, round((tp + tn) / n, 6) AS po, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) + 0.0 AS kappa FROM t""")
def verification_rates(spark, d):
    """Entities with a domain, domains with an honour, and how evidence agrees with honours over all sub-dimensions."""
    levels = cut(_levels(spark, d))
    rolled = X.rollup(levels)
    dims = spark.createDataFrame([(s,) for s in sorted({s for s, _, _ in LEXICON})], "subdim string")  # the lexicon's few
    every = _corpus(spark, d).select("entity").crossJoin(F.broadcast(dims)).join(levels, ["entity", "subdim"], "left")
    pairs = every.select(F.coalesce(F.col("level").isin("E1", "E3"), F.lit(False)).cast("int").alias("p"), F.coalesce("honour", F.lit(False)).cast("int").alias("q"))
    n = _corpus(spark, d).agg(F.count(F.lit(1)).alias("n"))
    r = rolled.agg(F.count_distinct("entity").alias("e"), F.count(F.lit(1)).alias("eligible"), F.round(F.avg(F.col("honour").cast("double")), 6).alias("verified"))
    k = A.kappa(pairs, "p", "q").select(F.round("po", 6).alias("po"), S.r6(F.col("kappa")).alias("kappa"))
    return r.crossJoin(n).crossJoin(k).select(F.round(F.col("e") / F.col("n"), 6).alias("covered"), "eligible", "verified", "po", "kappa")


@Q(f"WITH {_BASE} SELECT lang, round(avg(confidence) FILTER (subdim = 'T1a'), 6) AS t1a, round(avg(confidence) FILTER (subdim = 'T2a'), 6) AS t2a, round(avg(confidence) FILTER (subdim = 'T3a'), 6) AS t3a, round(avg(confidence) FILTER (subdim = 'T4a'), 6) AS t4a FROM lev JOIN documents ON lev.entity = doc_id GROUP BY lang")
def confidence_heat(spark, d):
    j = _levels(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("entity"), "lang"), "entity")
    p = j.groupBy("lang").pivot("subdim", ["T1a", "T2a", "T3a", "T4a"]).agg(F.round(F.avg("confidence"), 6))
    return p.toDF("lang", "t1a", "t2a", "t3a", "t4a")


@Q("SELECT o_orderkey, round(max(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS best FROM orders")
def running_best(spark, d):
    return A.running_max(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice").select("o_orderkey", F.round("best", 2).alias("best"))


@Q("WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1), l(label) AS (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) SELECT l.label, CAST(coalesce(n, 0) AS BIGINT) AS n, round(100 * coalesce(n, 0) / (SELECT sum(n) FROM c), 6)::DOUBLE AS pct FROM l LEFT JOIN c ON l.label = c.label")
def risk_distribution(spark, d):
    """All five labels, with rows or without."""
    l = spark.createDataFrame([(c,) for c in "FOPXY"], "label string")
    n = read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = A.with_totals(n, t=F.sum("n"))
    return l.join(F.broadcast(t), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(100 * F.col("n") / F.col("t"), F.lit(0.0)), 6).alias("pct"))


@Q("""WITH b AS (SELECT o_orderkey, o_totalprice AS y, CAST(len(list_filter(q, lambda c: c < o_totalprice)) AS INTEGER) AS bin, (o_orderkey * 1103515245 + 12345) % 1000003 AS u FROM orders, (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)),
f AS (SELECT y, bin, CAST((row_number() OVER (PARTITION BY bin ORDER BY u, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM b), m AS (SELECT bin, avg(y) AS m FROM f GROUP BY bin), g AS (SELECT avg(y) AS g FROM f)
SELECT fold, round(sqrt(avg((y - m) ** 2)), 3) AS rmse_a, round(sqrt(avg((y - g) ** 2)), 3) AS rmse_b, round(avg(abs(y - m)), 3) AS mae_a, round(avg(abs(y - g)), 3) AS mae_b FROM f JOIN m ON f.bin = m.bin, g GROUP BY fold""")
def fold_metrics(spark, d):
    """Errors of two predictions in each fold: the bin's mean and the whole mean."""
    f = cut(A.kfolds(read(spark, d, "orders"), "o_orderkey", "o_totalprice"))
    m = f.groupBy("bin").agg(F.avg("o_totalprice").alias("a"))
    j = A.with_totals(f.join(F.broadcast(m), "bin"), b=F.avg("o_totalprice"))
    e = lambda c: F.col("o_totalprice") - F.col(c)
    return j.groupBy("fold").agg(*[F.round(F.sqrt(F.avg(e(c) * e(c))), 3).alias(f"rmse_{c}") for c in "ab"], *[F.round(F.avg(F.abs(e(c))), 3).alias(f"mae_{c}") for c in "ab"])


@Q("SELECT column_name AS name, 'first' AS side FROM (DESCRIBE customer) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE orders)) UNION ALL SELECT column_name, 'second' FROM (DESCRIBE orders) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE customer))")
def column_diff(spark, d):
    return A.column_diff(read(spark, d, "customer"), read(spark, d, "orders"))


@Q("SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def priority_order(spark, d):
    """All rows of each class by rate, ties by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    return read(spark, d, "part").withColumn("place", F.row_number().over(w)).select("p_partkey", "p_size", F.col("place").cast("long").alias("place"))


@Q("""WITH c AS (SELECT label, avg(embedding[1]::DOUBLE * 10000) AS x, avg(embedding[2]::DOUBLE * 10000) AS y FROM embeddings WHERE label < 5 GROUP BY label), a AS (SELECT chr(65 + label) AS name, x + 10 * label AS x, y - 7 * label AS y FROM c),
s AS (SELECT max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM a), k AS (SELECT label, name, sqrt(((c.x - a.x) / sx) ** 2 + ((c.y - a.y) / sy) ** 2) AS cost FROM c, a, s),
p AS (SELECT [k0.name, k1.name, k2.name, k3.name, k4.name] AS names, [k0.cost, k1.cost, k2.cost, k3.cost, k4.cost] AS costs FROM k k0, k k1, k k2, k k3, k k4 WHERE k0.label = 0 AND k1.label = 1 AND k2.label = 2 AND k3.label = 3 AND k4.label = 4 AND len(list_distinct([k0.name, k1.name, k2.name, k3.name, k4.name])) = 5),
b AS (SELECT names, costs FROM p ORDER BY list_sum(costs) LIMIT 1) SELECT unnest(range(0, 5))::INTEGER AS label, unnest(names) AS name, round(unnest(costs), 5) + 0.0 AS cost FROM b""")
def label_alignment(spark, d):
    c = points(spark, d).filter("label < 5").groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    c = cut(c)
    a = c.select(F.char(65 + F.col("label")).alias("name"), (F.col("x") + 10 * F.col("label")).alias("x"), (F.col("y") - 7 * F.col("label")).alias("y"))
    return A.aligned(c, a, "label", "name", ["x", "y"]).select("label", "name", (F.round("cost", 5) + F.lit(0.0)).alias("cost"))


@Q("""WITH c AS (SELECT o_orderstatus AS a, substr(o_orderpriority, 1, 1)::INT % 3 AS b, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT unnest(['F', 'O', 'P']) AS a, unnest([0, 1, 2]) AS k)
SELECT round(max(m)::DOUBLE / (SELECT sum(n) FROM c), 6) AS accuracy FROM (SELECT coalesce(sum(n) FILTER ((a = 'F' AND b = x) OR (a = 'O' AND b = y) OR (a = 'P' AND b = z)), 0) AS m FROM c, (SELECT unnest([0, 1, 2]) AS x) x, (SELECT unnest([0, 1, 2]) AS y) y, (SELECT unnest([0, 1, 2]) AS z) z WHERE x <> y AND y <> z AND x <> z GROUP BY x, y, z)""")
def best_match(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", F.pmod(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(3)).alias("b"))
    return A.best_match(o, "o_orderstatus", "b").select(F.round("accuracy", 6).alias("accuracy"))


@Q()
def contributions_top3(spark, d):
    """The three features of largest mean absolute Shapley value in a boosted model."""
    from .model_queries import _FEATURES, _folds

    c = H.overall(H.shapley(_folds(spark, d), "o_orderkey", _FEATURES, "o_totalprice"))
    return c.select("feature", F.col("strength").alias("importance")).orderBy(F.desc("importance"), "feature").limit(3)


def _cell_values(spark, d):
    p = points(spark, d).select("vec_id", "x", "y", F.hypot("x", "y").alias("far"), F.col("label").cast("double").alias("label"), "v")
    return p, H.shapley(p, "vec_id", ["x", "y", "far", "label"], "v")


@Q()
def shapley_places(spark, d):
    """Each point with its three strongest features, for maps."""
    p, c = _cell_values(spark, d)
    return H.strongest(cut(c), "vec_id").join(p.select("vec_id", "x", "y"), "vec_id")


@Q()
def shapley_dependence(spark, d):
    """For each of the four strongest features the one that it goes together with."""
    p, c = _cell_values(spark, d)
    return H.dependence(cut(c), p, "vec_id", ["x", "y", "far", "label"])
