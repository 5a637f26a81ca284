"""Before and after: accessibility by stage, coverage, fairness with bootstrap, robustness, plan tables, review and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import network as N
from . import stats as A
from .lineage import cut


def stage_access(od: DataFrame, supply: DataFrame, demand: DataFrame, limits: dict[str, float], shares: dict[str, float], beta: float = 0.15) -> DataFrame:
    """i, a: two-step accessibility of each stage (supply has stage) to its share of the demand, weighted by the shares."""
    parts = []
    for stage, limit in limits.items():
        own = supply.filter(F.col("stage") == stage).select("j", "s")
        part = N.two_step(od.join(own.select("j"), "j", "left_semi"), own, demand.select("i", (F.col("d") * shares[stage]).alias("d")), limit, beta)
        parts.append(part.select("i", (F.col("a") * shares[stage]).alias("a")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i").agg(F.sum("a").alias("a"))


def coverage(df: DataFrame, demand: str, unmet: str, high_risk: Column, low_access: Column) -> DataFrame:
    """One row: coverage over all, over high-risk and over low-access rows (null where these have no demand)."""
    rate = lambda keep: F.when(F.sum(F.when(keep, F.col(demand))) > 0, 1 - F.sum(F.when(keep, F.col(unmet))) / F.sum(F.when(keep, F.col(demand))))
    return df.agg(rate(F.lit(True)).alias("coverage"), rate(high_risk).alias("high_risk"), rate(low_access).alias("low_access"))


def _gini(rows: DataFrame, key: str) -> DataFrame:
    """key, gini from rows key, b (bucket), v, w, vw, where a lower bucket has lower values. A row adds w (2 y - vw), y being the
    sum of vw up to it; y is that inside its bucket and what lies in those before. Equal values may be one row or many. Where all values or all
    weights are 0 there is no Gini: it is NaN, as a division of zeros is in SQL."""
    inner = Window.partitionBy(key, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("y", F.sum("vw").over(inner)).groupBy(key, "b").agg(F.sum("w").alias("bw"), F.sum("vw").alias("bv"), F.sum(F.col("w") * (2 * F.col("y") - F.col("vw"))).alias("s"))
    before = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bv").over(before), F.lit(0.0)))
    whole = F.sum("bw") * F.sum("bv")
    gini = 1 - F.sum(F.col("s") + 2 * F.col("ahead") * F.col("bw")) / F.when(whole != 0, whole)
    return sums.groupBy(key).agg(F.when(whole == 0, F.lit(float("nan"))).otherwise(gini).alias("gini"))


def gini_by(df: DataFrame, key: str, value: str, weight: str, buckets: int = 64) -> DataFrame:
    """key, gini: the weighted Gini of each key's rows. Running sums are made per bucket of values with carried offsets, so a
    key of any number of rows is many tasks."""
    per = cut(df.groupBy(key, F.col(value).alias("v")).agg(F.sum(weight).alias("w"), F.sum(F.col(value) * F.col(weight)).alias("vw")).filter("v is not null"))
    return _gini(per.withColumn("b", A.bucket(per, "v", buckets)), key)


def resampled(df: DataFrame, key: str, n: int, runs: int, each: int = 500_000) -> DataFrame:
    """r and the columns of df: n rows drawn with replacement for each run, by a hash. key is 0 ... n - 1.

    Rows are dealt to a task for `each` draws before they are drawn, since a small table is one task. Spark estimates the draws
    as no larger than the table and would send them to all tasks, so the join is one by shuffle."""
    dealt = df.select(F.col(key).alias("_i")).repartition(max(1, n * runs // each), "_i")
    draws = dealt.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    picks = draws.select("r", F.least(F.floor(S.hash_uniform(F.col("_i"), F.col("r")) * n), F.lit(n - 1)).alias(key))
    return picks.join(df.hint("shuffle_hash"), key)


def gini_bootstrap(df: DataFrame, key: str, n: int, before: str, after: str, weight: str, runs: int = 1000, buckets: int = 64) -> DataFrame:
    """One row: weighted Gini before and after with 95 % intervals, variation of the latter, and the paired t."""
    found = []
    for value, name in ((before, "b"), (after, "a")):
        own = df.select(key, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
        own = cut(own.withColumn("b", A.bucket(own, "v", buckets)).withColumn("vw", F.col("v") * F.col("w")))
        found.append(_gini(resampled(own, key, n, runs).filter("v is not null"), "r").withColumnRenamed("gini", name))
    g = found[0].join(found[1], "r")
    q = lambda c, p: F.percentile(c, p)
    d = F.col("b") - F.col("a")
    return g.agg(
        F.count(F.lit(1)).alias("runs"), F.avg("b").alias("before"), q("b", 0.025).alias("before_lo"), q("b", 0.975).alias("before_hi"),
        F.avg("a").alias("after"), q("a", 0.025).alias("after_lo"), q("a", 0.975).alias("after_hi"),
        (F.stddev_pop("a") / (F.avg("a") + 1e-9)).alias("after_cv"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"),
    )


def robustness(df: DataFrame, key: str, demand: str, access: str, unmet: str, runs: int = 500) -> DataFrame:
    """One row: mean and variation of coverage, Gini and gap when demand varies by 5 %, access by 10 % and noise by 5 %."""
    u = df.select(F.col(key).alias("k"), F.col(demand).alias("d"), F.col(access).alias("a"), F.col(unmet).alias("u")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    f = lambda off, half: 1 - half + 2 * half * S.hash_uniform(F.col("k") + off, F.col("r"))
    x = u.select("r", (F.col("d") * f(0, 0.05)).alias("d"), (F.col("a") * f(31, 0.10)).alias("a"), (F.col("u") * f(67, 0.05)).alias("u"))
    ext = x.groupBy("r").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    x = x.join(ext, "r").select("r", "d", "u", S.minmax(F.col("a"), F.col("lo"), F.col("hi")).alias("m"))
    per = x.groupBy("r").agg((1 - F.sum("u") / F.greatest(F.sum("d"), F.lit(1.0))).alias("coverage"), F.sum(F.when(F.col("m") < 0.1, F.col("d")).otherwise(0.0)).alias("gap"))
    per = per.join(gini_by(x.withColumn("v", 1 - F.col("m")), "r", "v", "d"), "r")
    cv = lambda c: F.stddev_samp(c) / (F.avg(c) + 1e-9)
    return per.agg(F.count(F.lit(1)).alias("runs"), *[x for c in ("coverage", "gini", "gap") for x in (F.avg(c).alias(f"{c}_mean"), cv(c).alias(f"{c}_cv"))])


def fairness(df: DataFrame) -> DataFrame:
    """One row from rows d (demand), b, a (access before and after), tb, ta (time before and after, null: unreachable), low,
    risk: Gini of lacking access and of time, low-access and high-risk means, coverage at the first quartile before."""
    t = A.with_totals(df, top=F.greatest(F.max("b"), F.max("a"), F.lit(1e-6)), q=F.percentile(F.when(F.col("b") > 0, F.col("b")), 0.25))
    some = (F.col("b") > 0) | (F.col("a") > 0)
    lack = lambda c: F.when(some, 1 - F.col(c) / F.col("top")).otherwise(1.0)
    rows = t.select("*", lack("b").alias("lb"), lack("a").alias("la"))
    long = rows.select("d", F.explode(F.create_map(*[x for c in ("lb", "la", "tb", "ta") for x in (F.lit(c), F.col(c))])).alias("k", "v"))
    g = gini_by(long, "k", "v", "d").groupBy().pivot("k", ["lb", "la", "tb", "ta"]).agg(F.first("gini"))
    own = lambda c, keep: F.coalesce(F.avg(F.when(keep, F.col(c))), F.lit(0.0))
    low, high = F.col("low"), F.col("risk") >= 4
    one = rows.agg(
        F.count_if(low).alias("n_low"), F.count_if(low & (F.col("a") > F.col("b") * 1.01)).alias("n_low_improved"),
        own("b", low).alias("low_before"), own("a", low).alias("low_after"), own("b", high).alias("high_before"), own("a", high).alias("high_after"),
        F.avg((F.col("b") >= F.col("q")).cast("double")).alias("covered_before"), F.avg((F.col("a") >= F.col("q")).cast("double")).alias("covered_after"),
        F.count_if(F.col("a") > F.col("b") * 1.001).alias("n_improved"), F.count_if(F.col("a") < F.col("b") * 0.999).alias("n_degraded"),
    )
    names = {"lb": "gini_before", "la": "gini_after", "tb": "gini_time_before", "ta": "gini_time_after"}
    return g.withColumnsRenamed(names).crossJoin(one)


def banner(fair: DataFrame, robust: DataFrame) -> DataFrame:
    """One row of the summary: changes of the Gini and of low-access and high-risk means, and whether each target is met."""
    x = fair.crossJoin(robust)
    return x.select(
        (F.col("gini_before") - F.col("gini_after")).alias("gini_gain"), (F.col("low_after") - F.col("low_before")).alias("low_gain"),
        (F.col("high_after") - F.col("high_before")).alias("high_gain"), (F.col("gini_before") >= F.col("gini_after")).alias("gini_ok"),
        (F.col("coverage_cv") < 0.05).alias("coverage_ok"), (F.col("gini_cv") < 0.10).alias("spread_ok"),
    )


def plan_table(sites: DataFrame, flows: DataFrame, block: float = 50.0, enrolment: float = 0.95) -> DataFrame:
    """sites (j, capacity, age_capacity, share, blocks) with new seats, capacities after, assigned demand (flows: j, x) and
    the ratio of supply to it."""
    got = flows.groupBy("j").agg(F.sum("x").alias("assigned"))
    seats = F.col("blocks") * block
    t = sites.join(got, "j", "left").select("j", "blocks", seats.alias("new_seats"), (F.col("capacity") + seats).alias("capacity_after"), (seats * F.col("share") * enrolment).alias("new_age"), "age_capacity", F.coalesce("assigned", F.lit(0.0)).alias("assigned"))
    after = F.col("age_capacity") + F.col("new_age")
    return t.select("j", "blocks", "new_seats", "capacity_after", after.alias("age_after"), "assigned", (after / F.greatest("assigned", F.lit(1.0))).alias("ratio"))


def review(df: DataFrame, one: str, two: str, engine: str) -> DataFrame:
    """name, po, kappa, f1 of binary columns: the two raters, and the engine against their majority; exact: share of rows in
    which the engine agrees with both."""
    both = df.withColumn("_m", S.majority(F.col(one), F.col(two)))
    exact = both.agg(F.avg(((F.col(engine) == F.col(one)) & (F.col(engine) == F.col(two))).cast("double")).alias("exact"))
    a = A.kappa(both, one, two).withColumn("name", F.lit("raters"))
    b = A.kappa(both, engine, "_m").withColumn("name", F.lit("engine"))
    return a.unionByName(b).crossJoin(exact).select("name", "po", "kappa", "f1", "exact")


def consistency(df: DataFrame, a: str, b: str, true: str, strong: float = 0.4, weak: float = 0.2, t_limit: float = 1.96) -> DataFrame:
    """One row: rank correlations of two models and the truth, the trend of each pair, and the verdict; a correlation counts as
    significant when its t exceeds t_limit."""
    n = df.dropna(subset=[a, b, true]).agg(F.count(F.lit(1)).alias("n"), *[f.alias(k) for k, f in (("slope_ab", F.regr_slope(b, a)), ("icept_ab", F.regr_intercept(b, a)), ("slope_at", F.regr_slope(true, a)), ("slope_bt", F.regr_slope(true, b)))])
    out = n
    for name, x, y in (("ab", a, b), ("at", a, true), ("bt", b, true)):
        out = out.crossJoin(A.spearman(df, x, y).withColumnRenamed("rho", f"rho_{name}"))
    sure = lambda c: F.abs(c) * F.sqrt((F.col("n") - 2) / F.greatest(1 - c * c, F.lit(1e-12))) > t_limit
    ab, bt = F.col("rho_ab"), F.col("rho_bt")
    verdict = F.when((ab > strong) & sure(ab) & (bt > weak) & sure(bt), "consistent").when((bt > 0) & (ab > weak), "same direction").otherwise("divergent")
    return out.withColumn("verdict", F.when(ab.isNull() | F.isnan(ab) | bt.isNull() | F.isnan(bt), "constant").otherwise(verdict))


def guarded(pred: DataFrame, key: str, value: str, fallback: DataFrame, least: float = 1e-6) -> DataFrame:
    """key, value, source: predictions, or the fallback (key, value) for all where they are constant."""
    t = A.with_totals(pred.select(key, F.col(value).alias("p")), sd=F.stddev_pop(value))
    j = t.join(fallback.select(key, F.col("value").alias("f")), key, "left")
    flat = F.coalesce(F.col("sd"), F.lit(0.0)) < least
    return j.select(key, F.when(flat, F.col("f")).otherwise(F.col("p")).alias("value"), F.when(flat, "interpolated").otherwise("model").alias("source"))


def soft_score(df: DataFrame, key: str, sms: str, l3: str, imputed: Column, confidence: str) -> DataFrame:
    """key, score: .7 and .3 of two scores, drawn to the known rows' mean by lacking confidence where imputed, scaled."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.coalesce(sms, F.lit(0.0)) + 0.3 * F.coalesce(l3, F.lit(0.0))))
    t = df.select(key, raw.alias("raw"), imputed.alias("imp"), F.coalesce(confidence, F.lit(0.5)).alias("conf"))
    t = A.with_totals(t, gm=F.coalesce(F.avg(F.when(~F.col("imp"), F.col("raw"))), F.lit(0.5)))
    t = t.select(key, "imp", F.when(F.col("imp"), F.col("conf") * F.col("raw") + (1 - F.col("conf")) * F.col("gm")).otherwise(F.col("raw")).alias("raw"))
    t = A.with_totals(t, lo=F.min("raw"), hi=F.max("raw"))
    return t.select(key, S.minmax(F.col("raw"), F.col("lo"), F.col("hi")).alias("score"), F.when(F.col("imp"), "imputed").otherwise("original").alias("data_source"))


def pressure(entities: DataFrame, population: DataFrame, key: str, share: float = 0.1174) -> DataFrame:
    """entities (key, supply) with demand (share of the population's sum, floored at 0; the median of positive demands where
    there is none) and pressure."""
    d = population.groupBy(key).agg((F.greatest(F.coalesce(F.sum("pop"), F.lit(0.0)), F.lit(0.0)) * share).alias("demand"))
    t = entities.join(d, key, "left")
    med = d.agg(F.percentile(F.when(F.col("demand") > 0, F.col("demand")), 0.5).alias("_m"))
    t = t.crossJoin(F.broadcast(med)).withColumn("demand", F.coalesce("demand", "_m")).drop("_m")
    return t.withColumn("pressure", F.col("demand") / (F.col("supply") + 1e-9))


def refilled(df: DataFrame, key: str, cols: list[str], fill: DataFrame, weights: dict[str, float], quartiles: list[float]) -> DataFrame:
    """df with null columns filled from `fill` (key and the same columns), then index, class by old quartiles, and rank; the
    weights and quartiles are those of before."""
    j = df.join(fill.select(key, *[F.col(c).alias(f"_f_{c}") for c in cols]), key, "left")
    j = j.select(key, *[F.coalesce(c, f"_f_{c}").alias(c) for c in cols], F.coalesce(*[F.when(F.col(c).isNull() & F.col(f"_f_{c}").isNotNull(), F.lit("refilled")) for c in cols], F.lit("kept")).alias("method"))
    t = A.with_totals(j, **{f"lo_{c}": F.min(c) for c in cols}, **{f"hi_{c}": F.max(c) for c in cols})
    terms = [weights[c] * S.minmax_eps(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in cols]
    index = sum(terms[1:], terms[0])
    t = t.select(key, "method", index.alias("index"))
    t = t.withColumn("cls", F.when(F.col("index").isNotNull(), S.quartile_class(F.col("index"), *[F.lit(q) for q in quartiles])))
    return A.ranks(t, "index", descending=True).select(key, "method", "index", "cls", F.col("rank_min").alias("rank"))


def set_change(a: DataFrame, b: DataFrame, entities: DataFrame, key: str, tag: str) -> DataFrame:
    """One row: the share of entities whose sets of tags differ between two results."""
    of = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(tag)).alias(name))
    j = entities.join(of(a, "x"), key, "left").join(of(b, "y"), key, "left")
    return j.agg(F.avg((~F.col("x").eqNullSafe(F.col("y"))).cast("double")).alias("change"))
