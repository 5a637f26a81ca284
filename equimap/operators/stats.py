"""Aggregates and order statistics that stay distributed.

Global orders (ranks, running sums) are made without one task seeing all rows: values are first summed up by value, the
distinct values are dealt to buckets at approximate quantiles that are held as constants, and each bucket adds the total
of those before it. Where the cuts fall changes the work, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def with_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """df with one-row aggregates of itself as columns."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in aggs.items()])))


def quantiles(df: DataFrame, value: Column | str, wanted: list[float], plain: int = 50_000, bins: int = 4096) -> list[float | None]:
    """Exact quantiles (linear between neighbours) of the values that aren't null; null where there are none. NaN is the
    largest value.

    F.percentile holds all distinct values in one task, so it is left to at most `plain` rows. Else values are counted in bins,
    those bins in which a wanted rank lies are cut finer, until each holds one value. Only bins are on the driver."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(v.cast("double").alias("v")).filter("v is not null")
    finite = F.abs("v") < float("inf")
    n, below, nan, high, lo, hi = rows.agg(F.count("v"), F.count_if(F.col("v") == float("-inf")), F.count_if(F.isnan("v")), F.count_if(F.col("v") == float("inf")), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    if n <= plain:
        return list(rows.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in wanted]))).first()[0] or [None] * len(wanted))
    at = {r: None for p in wanted for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
    for r in at:
        at[r] = -math.inf if r < below else math.nan if r >= n - nan else math.inf if r >= n - nan - high else None
    todo = {(lo, hi, below): [r for r in at if at[r] is None]}  # ends of a range, values before it: ranks in it
    while todo := {k: rs for k, rs in todo.items() if rs}:
        which, place = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, (a, b, _) in enumerate(todo):
            inside = F.col("v").between(a, b)
            which = F.when(inside, i).otherwise(which)
            place = F.when(inside, F.floor((F.col("v") / 2 - a / 2) / ((b / 2 - a / 2) or 1.0) * (bins - 1)).cast("long")).otherwise(place)
        got = rows.filter(finite).select("v", which.alias("i"), place.alias("bin")).filter("i is not null").groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i", "bin").collect()
        finer: dict[tuple, list[int]] = {}
        for i, ((_, _, before), ranks_) in enumerate(todo.items()):
            for r in (x for x in got if x["i"] == i):
                for k in (k for k in ranks_ if before <= k < before + r["n"]):
                    if r["a"] == r["b"]:
                        at[k] = r["a"]
                    else:
                        finer.setdefault((r["a"], r["b"], before), []).append(k)
                before += r["n"]
        todo = finer

    def between(p: float) -> float:
        k = p * (n - 1)
        a, b = at[math.floor(k)], at[math.ceil(k)]
        return a if a == b else (math.ceil(k) - k) * a + (k - math.floor(k)) * b

    return [between(p) for p in wanted]


def bucket(df: DataFrame, value: str, buckets: int) -> Column:
    cuts = sorted(set(df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.01)))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)"), lambda c: c < F.col(value)))


def running(df: DataFrame, value: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """One row for each distinct value: n, the sums, and cum_n, cum_<sum> over all values up to it."""
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums])
    cols = ["n", *sums]
    per = per.withColumn("_b", bucket(df, value, buckets))
    tot = per.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each bucket
    tot = tot.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in cols])
    inner = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(tot), "_b")
    return out.select(value, *cols, *[(F.col(f"_o_{c}") + F.sum(c).over(inner)).alias(f"cum_{c}") for c in cols])


def ranks(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """df with rank_min (competition) and rank_avg of the value; null values get 0."""
    run = running(df.filter(F.col(value).isNotNull()).select(value), value, [])
    if descending:
        total = df.agg(F.count(value).alias("_all"))
        run = run.crossJoin(F.broadcast(total)).withColumn("rank_min", F.col("_all") - F.col("cum_n") + 1)
    else:
        run = run.withColumn("rank_min", F.col("cum_n") - F.col("n") + 1)
    run = run.select(F.col(value).alias("_v"), "rank_min", (F.col("rank_min") + (F.col("n") - 1) / 2).alias("rank_avg"))
    out = df.join(run, df[value] == run["_v"], "left").drop("_v")
    return out.withColumns({"rank_min": F.coalesce("rank_min", F.lit(0)).cast("long"), "rank_avg": F.coalesce("rank_avg", F.lit(0.0))})


def lorenz(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Cumulative shares of weight and of weighted value, by value; tied values make one point."""
    rows = df.select(F.col(value).alias("v"), F.col(weight).alias("w"), (F.col(value) * F.col(weight)).alias("vw"))
    run = running(rows, "v", ["w", "vw"])
    tot = rows.agg(F.sum("w").alias("tw"), F.sum("vw").alias("tvw"))
    return run.crossJoin(F.broadcast(tot)).select("v", "w", "vw", (F.col("cum_w") / F.col("tw")).alias("x"), (F.col("cum_vw") / F.col("tvw")).alias("y"), (F.col("w") / F.col("tw")).alias("dx"), (F.col("vw") / F.col("tvw")).alias("dy"))


def weighted_gini(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: gini, by trapezoids under the Lorenz curve."""
    curve = lorenz(df, value, weight)
    return curve.agg((1 - F.sum(F.col("dx") * (2 * F.col("y") - F.col("dy")))).alias("gini"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    one = ranks(df.select(a, b).dropna(), a).withColumnRenamed("rank_avg", "ra").drop("rank_min")
    two = ranks(one, b)
    return two.agg(F.corr("ra", "rank_avg").alias("rho"))


def entropy(df: DataFrame, keys: list[str], category: str, eps: float = 1e-12) -> DataFrame:
    """Natural-log Shannon entropy of the category mix of each key."""
    n = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    # sum p ln(p + eps) from counts needs the total first; both levels shuffle on the key
    tot = n.groupBy(*keys).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.join(tot, keys).groupBy(*keys).agg((-F.sum(p * F.log(p + eps))).alias("entropy"), F.max("t").alias("total"))


def entropy_weights(df: DataFrame, cols: list[str]) -> DataFrame:
    """Indicator weights: min-max, column shares, information redundancy. One row for each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("x.*")
    ext = long.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    norm = long.join(F.broadcast(ext), "name").withColumn("z", F.when(F.col("hi") - F.col("lo") < 1e-12, 0.0).otherwise((F.col("v") - F.col("lo")) / F.when(F.col("hi") - F.col("lo") < 1e-12, 1.0).otherwise(F.col("hi") - F.col("lo"))))
    tot = norm.groupBy("name").agg(F.sum("z").alias("s"))
    p = F.when(F.col("z") / F.col("s") == 0, 1e-9).otherwise(F.col("z") / F.col("s"))
    e = norm.join(F.broadcast(tot), "name").groupBy("name").agg((-F.sum(p * F.log(p)) / F.log(F.max("n"))).alias("e"))
    return e.crossJoin(F.broadcast(e.agg(F.sum(1 - F.col("e")).alias("d")))).select("name", ((1 - F.col("e")) / F.col("d")).alias("weight"))


def diagnostics(df: DataFrame, value: str) -> DataFrame:
    """One row of distribution figures; skew is bias-corrected, std is the sample's."""
    v = F.col(value)
    n = F.count(v)
    mid, low, high = (F.lit(q).cast("double") for q in quantiles(df, v, [0.5, 0.05, 0.95]))
    return df.agg(
        n.alias("n"), F.count_if(v == 0).alias("zeros"), F.avg(v).alias("mean"), mid.alias("median"),
        F.stddev_samp(v).alias("std"), (F.stddev_samp(v) / F.avg(v)).alias("cv"),
        (F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        low.alias("p5"), high.alias("p95"),
    )


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement, Cohen's kappa and F1 of two binary columns."""
    c = lambda x, y: F.sum(((F.col(a) == x) & (F.col(b) == y)).cast("double"))
    t = df.agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    return t.select(po.alias("po"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = cells.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    ra = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    rb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    expected = F.col("i") * F.col("j") / pairs(F.col("n"))
    return s.crossJoin(ra).crossJoin(rb).select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2 - expected)).alias("ari"))


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in a total order, by partial aggregation, so that a hot key is no hot task."""
    cols = df.columns
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[F.col(c) for c in cols])).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand for more than one row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checked_join(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """df joined with a lookup table on a derived key; keys that stand for more than one row of it are an error."""
    odd = [r[0] for r in conflicts(lookup, key).limit(5).collect()]
    if odd:
        raise ValueError(f"keys with more than one row: {odd}")
    return df.join(lookup, key)


def compare(new: DataFrame, old: DataFrame, key: str, col: str) -> DataFrame:
    """Largest absolute and median relative difference, correlation and share of equal values."""
    j = new.select(key, F.col(col).alias("a")).join(old.select(key, F.col(col).alias("b")), key)
    d = F.abs(F.col("a") - F.col("b"))
    (mid,) = quantiles(j, 100 * d / F.greatest(F.abs("b"), F.lit(1e-9)), [0.5])
    return j.agg(F.max(d).alias("max_abs"), F.lit(mid).cast("double").alias("median_rel"), F.corr("a", "b").alias("corr"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("equal_rate"))


def kfolds(df: DataFrame, key: str, target: str, k: int = 5, bins: int = 5) -> DataFrame:
    """Folds that each hold a like share of every target bin: by a hashed order inside a bin, in round robin.

    Ranks inside a bin are made per hash bucket, so a bin is no single task."""
    cuts = F.array(*[F.lit(c).cast("double") for c in quantiles(df, target, [i / bins for i in range(1, bins)])])
    rows = df.withColumn("bin", F.size(F.filter(cuts, lambda c: c < F.col(target))))
    u = F.pmod(F.col(key).cast("long") * 1103515245 + 12345, F.lit(1000003))
    rows = rows.withColumn("u", u).withColumn("ub", F.floor(F.col("u") / 15626))
    n = rows.groupBy("bin", "ub").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("ub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(n.select("bin", "ub", before.alias("before"))), ["bin", "ub"])
    at = F.row_number().over(Window.partitionBy("bin", "ub").orderBy("u", key)) + F.col("before") - 1
    return rows.select(key, target, "bin", F.pmod(at, F.lit(k)).cast("int").alias("fold"))


def running_max(df: DataFrame, order: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """df with best: the largest value up to its place in the order (ties of the order count together)."""
    rows = df.withColumn("_o", F.col(order).cast("double"))
    rows = rows.withColumn("_b", bucket(rows, "_o", buckets))
    tops = rows.groupBy("_b").agg(F.max(value).alias("_t"))
    tops = tops.select("_b", F.max("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each bucket
    inner = Window.partitionBy("_b").orderBy("_o").rangeBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(tops), "_b").withColumn("best", F.greatest("_before", F.max(value).over(inner)))
    return out.select(*df.columns, "best")


def column_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, side: columns that only one of two tables has."""
    one, two = set(a.columns), set(b.columns)
    rows = [(c, "first") for c in sorted(one - two)] + [(c, "second") for c in sorted(two - one)]
    return a.sparkSession.createDataFrame(rows, "name string, side string")


def best_match(df: DataFrame, a: str, b: str, most: int = 8) -> DataFrame:
    """One row: the largest share of rows that agree when the labels of one column are matched one to one to those of the
    other. More than `most` labels on a side are an error, since all matchings are tried."""
    from itertools import permutations

    cells = {(r[a], r[b]): r["n"] for r in df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).limit(most * most + 1).collect()}
    left, right = sorted({x for x, _ in cells}, key=str), sorted({y for _, y in cells}, key=str)
    if max(len(left), len(right)) > most:
        raise ValueError(f"more than {most} labels")
    short, long = (left, right) if len(left) <= len(right) else (right, left)
    at = (lambda x, y: cells.get((x, y), 0)) if short is left else (lambda x, y: cells.get((y, x), 0))
    best = max((sum(at(x, y) for x, y in zip(short, p)) for p in permutations(long, len(short))), default=0)
    return df.sparkSession.createDataFrame([(best / sum(cells.values()) if cells else None,)], "accuracy double")


def aligned(centres: DataFrame, anchors: DataFrame, key: str, name: str, cols: list[str], most: int = 8) -> DataFrame:
    """key, name, cost: each cluster's anchor, so that the sum of distances, scaled by the anchors' ranges, is least. Every
    matching is tried; more than `most` clusters are an error."""
    from itertools import permutations

    c = sorted(tuple(r) for r in centres.select(key, *cols).limit(most + 1).collect())
    a = sorted(tuple(r) for r in anchors.select(name, *cols).limit(most + 1).collect())
    if max(len(c), len(a)) > most or len(c) > len(a):
        raise ValueError(f"{len(c)} clusters, {len(a)} anchors; at most {most}, and no more clusters than anchors")
    span = [max(x[k] for x in a) - min(x[k] for x in a) or 1.0 for k in range(1, len(cols) + 1)]
    cost = [[sum(((x[k] - y[k]) / s) ** 2 for k, s in enumerate(span, 1)) ** 0.5 for y in a] for x in c]
    best = min(permutations(range(len(a)), len(c)), key=lambda p: (sum(cost[i][j] for i, j in enumerate(p)), p))
    return centres.sparkSession.createDataFrame([(x[0], a[j][0], cost[i][j]) for i, (x, j) in enumerate(zip(c, best))], f"{key} {dict(centres.dtypes)[key]}, {name} {dict(anchors.dtypes)[name]}, cost double")


def near_equal(a: DataFrame, b: DataFrame, cols: list[str], digits: int) -> DataFrame:
    """Rows of two tables whose columns are equal when rounded; the other columns of both."""
    key = lambda df: df.withColumns({f"_k{i}": F.round(c, digits) for i, c in enumerate(cols)})
    keys = [f"_k{i}" for i in range(len(cols))]
    return key(a).join(key(b).drop(*cols), keys).drop(*keys)


def mapped(names: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """names joined with a lookup table, whose blank and missing keys are skipped."""
    k = F.trim(F.col(key))
    return names.join(lookup.filter(F.col(key).isNotNull() & (k != "") & (F.lower(k) != "nan")), key)
