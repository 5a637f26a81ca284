"""Queries of models and optimisation; those that SQL can't express are tested by their properties (tests/test_models.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as L
from ..operators import evaluation as V
from ..operators import models as M
from ..operators import network as N
from ..operators import regions as R
from ..operators import spatial as G
from ..operators import stats as A
from ..operators.lineage import cut
from .registry import Registry
from .spatial_queries import _KNN, _neighbours
from .tables import points, read, roads

Q = Registry()


@Q(f"WITH {_KNN}, m AS (SELECT avg(v) AS m FROM p) SELECT vec_id, round(0.85 * sum(sv / (sqrt(d2) + 1e-9)) / sum(1 / (sqrt(d2) + 1e-9)) + 0.15 * m, 4) + 0.0 AS value FROM k6, m GROUP BY vec_id, m")
def knn_impute(spark, d):
    known = points(spark, d).select(F.col("v").alias("sv"))
    return M.knn_impute(known, _neighbours(spark, d), "vec_id", "sv").select("vec_id", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@Q()
def kmeans_vote(spark, d):
    k = M.kmeans(points(spark, d).select("vec_id", "x", "y", "label"), ["x", "y"], 6)
    n = k.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    vote = n.groupBy("cluster").agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("voted"))
    return k.join(F.broadcast(vote), "cluster").select("vec_id", "cluster", "voted")


def _folds(spark, d, folds=3):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "o_totalprice", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), F.length("o_orderpriority").cast("double").alias("prio"))
    return cut(o.join(A.kfolds(read(spark, d, "orders"), "o_orderkey", "o_totalprice", folds).select("o_orderkey", "fold"), "o_orderkey"))  # each model reads it many times


_FEATURES = ["c_acctbal", "nation", "prio"]


@Q()
def gbt_cv(spark, d):
    """Scores on held-out folds; cheap orders weigh more."""
    rows = _folds(spark, d).withColumn("w", 0.5 + 1 / (1 + F.col("o_totalprice") / 100000))
    return M.boosted_cv(rows, _FEATURES, "o_totalprice", "fold", rounds=5, weight="w")


@Q()
def importance_topk(spark, d):
    return M.importances(_folds(spark, d), _FEATURES, "o_totalprice")


@Q()
def huber_baseline(spark, d):
    return M.huber(_folds(spark, d, 5), _FEATURES, "o_totalprice", "fold")


@Q()
def tuning_trials(spark, d):
    return M.tune(_folds(spark, d), _FEATURES, "o_totalprice", "fold", trials=8, startup=3)


@Q()
def jenks_breaks(spark, d):
    return M.jenks_breaks(read(spark, d, "orders").select(F.col("o_totalprice").alias("v")), "v")


@Q()
def skater_regions(spark, d):
    p = points(spark, d)
    s = p.select(F.col("vec_id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return R.skater(p, G.knn(p, s, 4, 900.0, "vec_id", "sid", exclude_self=True).select("vec_id", "sid"), "vec_id", ["v"], 6)


def _plan(spark, d):
    """Five cells for each customers' nation and two sites, primary and middle, for each suppliers' nation; minutes grow with
    the nations' distance on a lattice of five columns and with the roads' mean."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    people = read(spark, d, "customer").groupBy((n * 5 + F.pmod(k, F.lit(5))).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("d"), (1 + F.avg("c_acctbal") / 10000).cast("double").alias("w"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    j, good = (n * 2 + F.pmod(k, F.lit(2))).alias("j"), F.greatest(F.col("s_acctbal"), F.lit(0.0)) / 10000
    s = read(spark, d, "supplier").groupBy(j).agg((F.count(F.lit(1)) * 7.0).alias("room"), F.avg(good).cast("double").alias("soft"))
    risk, is_ = F.pmod("j", F.lit(5)), lambda c: c.cast("double")
    price = L.seat_price(risk / 4, risk / 4, F.col("soft"), is_(F.pmod("j", F.lit(7)) == 0), is_(F.pmod("j", F.lit(6)) == 0))
    first = F.pmod("j", F.lit(2)) == 0
    s = cut(s.select("j", "room", F.when(first, 0.667).otherwise(0.333).alias("share"), F.lit(6).alias("most"), price.alias("price"), (risk >= 3).alias("risky"), F.when(first, "primary").otherwise("middle").alias("stage")))
    part = lambda c, f: f(F.col(c) / 5) if f else F.pmod(c, F.lit(5))
    far = sum(F.abs(part("src", f) - part("dst", f)) for f in (F.floor, None))
    each = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("g")
    od = roads(spark, d).select("src", "dst", (6 * far + F.col("w")).alias("t"), each).select((F.col("src") * 5 + F.col("g")).alias("i"), "dst", (F.col("t") + F.col("g")).alias("t"))
    od = cut(od.join(s.select("j", "stage", F.floor(F.col("j") / 2).alias("dst")), "dst").filter(F.col("t") <= F.when(F.col("stage") == "primary", 30.0).otherwise(40.0)).select("i", "j", "t", "stage"))
    access = V.stage_access(od.select("i", "j", "t"), s.select("j", F.col("room").alias("s"), "stage"), people, {"primary": 30.0, "middle": 40.0}, {"primary": 0.667, "middle": 0.333})
    cells = N.low_access(people.join(access, "i", "left").withColumn("a", F.coalesce("a", F.lit(0.0))))
    return cut(cells.select("i", "d", "w", "low")), s, od


@Q()
def allocation_plan(spark, d):
    return L.solve(*_plan(spark, d), budget=100, longest=40.0, rounds=0).sites.withColumn("low_share", F.round("low_share", 6))


@Q()
def allocation_flows(spark, d):
    return L.solve(*_plan(spark, d), budget=100, longest=40.0, rounds=0).flows.withColumn("x", F.round("x", 4))


@Q()
def allocation_gap(spark, d):
    s = L.solve(*_plan(spark, d), budget=100, longest=40.0).summary
    return s.select(F.round("objective", 2).alias("objective"), F.round("bound", 2).alias("bound"), F.round("gap", 4).alias("gap"), "blocks", F.round("unmet", 4).alias("unmet"))


@Q()
def boxcox_lambda(spark, d):
    lam = M.boxcox_lambda(read(spark, d, "orders"), "o_totalprice")
    return spark.createDataFrame([(round(lam, 3),)], "lambda double")
