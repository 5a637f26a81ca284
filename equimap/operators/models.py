"""Models and optimisation: imputation, supply and pressure, folds with boosted trees, breaks, clustering, allocation.

Sequential kernels (breaks, allocation) run over entity tables, whose size is checked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .stats import quantiles
from .tuning import Range, minimise

MOST_ENTITIES = 200_000


def _bounded(df: DataFrame, most: int = MOST_ENTITIES) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entities")
    return rows


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(s))
    return out.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).otherwise(0.0) for c in cols}).select(*df.columns)


def kmeans(df: DataFrame, cols: list[str], k: int, seed: int = 42) -> DataFrame:
    return KMeans(k=k, seed=seed).fit(assembled(df, cols)).transform(assembled(df, cols)).drop("features").withColumnRenamed("prediction", "cluster")


def boosted_cv(df: DataFrame, cols: list[str], target: str, fold: str, seed: int = 42, depth: int = 3, rounds: int = 10, weight: str | None = None, least_rows: int = 1, rate: float = 0.1, share: float = 1.0, only: list | None = None) -> DataFrame:
    """fold, r2_log, r2, rmse, mae, mape, mdape, smearing of boosted trees on each held-out fold (or only the stated ones). The trees learn the log of the
    target, with the rows' weights where there are some; predictions go back by the mean of exp(residual)."""
    y = F.log(F.greatest(F.col(target), F.lit(0.0)) + 1e-6)
    data = assembled(df, cols).select("features", y.alias("label"), F.col(target).alias("raw"), F.col(fold).alias("fold"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    folds = sorted(r[0] for r in data.select("fold").distinct().collect()) if only is None else only
    out = []
    for f in folds:
        gbt = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed, weightCol="weight", minInstancesPerNode=least_rows, stepSize=rate, subsamplingRate=share)
        model = gbt.fit(data.filter(F.col("fold") != f))
        sf = model.transform(data.filter(F.col("fold") != f)).agg(F.avg(F.exp(F.col("label") - F.col("prediction")))).first()[0]
        held = model.transform(data.filter(F.col("fold") == f)).withColumn("p", F.greatest(F.exp("prediction") * sf - 1e-6, F.lit(0.0)))
        r2 = lambda a, b: 1 - F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) / (F.var_pop(a) * F.count(a))
        e = F.col("raw") - F.col("p")
        rel = F.abs(e) / F.greatest(F.abs("raw"), F.lit(0.01)) * 100
        held = cut(held.select("label", "prediction", "raw", "p"))  # read again for each step of the quantile
        got = held.agg(r2("label", "prediction"), r2("raw", "p"), F.sqrt(F.avg(e * e)), F.avg(F.abs(e)), F.avg(rel)).first()
        out.append((int(f), *[float(x) for x in got], *[float(x) for x in quantiles(held, rel, [0.5])], float(sf)))
    return df.sparkSession.createDataFrame(out, "fold int, r2_log double, r2 double, rmse double, mae double, mape double, mdape double, smearing double")


def importances(df: DataFrame, cols: list[str], target: str, least: float = 0.001, ratio: float = 5.0, seed: int = 42) -> DataFrame:
    """Two-stage selection: importances at or above a bound, the largest first, at most one feature for `ratio` rows (but
    five)."""
    model = GBTRegressor(maxDepth=3, maxIter=10, seed=seed, labelCol=target).fit(assembled(df, cols))
    top = max(int(df.count() / ratio), 5)
    rows = sorted(((float(v), c) for v, c in zip(model.featureImportances.toArray(), cols, strict=True) if v >= least), key=lambda x: (-x[0], x[1]))[:top]
    return df.sparkSession.createDataFrame([(c, v, i + 1) for i, (v, c) in enumerate(rows)], "feature string, importance double, rank int")


def huber(df: DataFrame, cols: list[str], target: str, fold: str) -> DataFrame:
    """One row: mean and deviation over the folds of the held-out r2 of a Huber regression; constant columns are left out."""
    spread = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    data = assembled(df, [c for c in cols if (spread[c] or 0.0) > 1e-10]).select("features", F.col(target).alias("label"), F.col(fold).alias("fold"))
    scores = []
    for f in sorted(r[0] for r in data.select("fold").distinct().collect()):
        model = LinearRegression(loss="huber", epsilon=1.35, maxIter=100).fit(data.filter(F.col("fold") != f))
        scores.append(float(RegressionEvaluator(metricName="r2").evaluate(model.transform(data.filter(F.col("fold") == f)))))
    return df.sparkSession.createDataFrame([(float(np.mean(scores)), float(np.std(scores)), len(scores))], "r2 double, r2_std double, folds int")


def tune(df: DataFrame, cols: list[str], target: str, fold: str, trials: int = 20, startup: int = 5, seed: int = 42) -> DataFrame:
    """Trials of boosted trees, a stated one first: trial, parameters, mdape (the mean over the folds that were scored), folds,
    pruned, and the best whole trial up to it. See tuning.minimise."""
    space = {"depth": Range(2, 5, whole=True), "rounds": Range(3, 12, whole=True), "least_rows": Range(1, 30, whole=True), "rate": Range(0.02, 0.3, log=True), "share": Range(0.4, 1.0)}
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())

    def scores(p):
        for f in folds:
            yield boosted_cv(df, cols, target, fold, seed, only=[f], **p).first()["mdape"]

    done = minimise(scores, space, trials, startup, seed, {"depth": 3, "rounds": 6, "least_rows": 10, "rate": 0.1, "share": 0.65})
    best = np.minimum.accumulate([math.inf if x.pruned else x.value for x in done])
    rows = [(t, *[x.params[k] for k in space], x.value, len(x.steps), x.pruned, float(best[t])) for t, x in enumerate(done)]
    return df.sparkSession.createDataFrame(rows, "trial int, depth int, rounds int, least_rows int, rate double, share double, mdape double, folds int, pruned boolean, best double")


def contributions(df: DataFrame, key: str, cols: list[str], target: str, seed: int = 42, depth: int = 3, rounds: int = 10) -> DataFrame:
    """key, feature, contribution: how each feature moved a boosted model's prediction, from node mean to node mean along each
    tree's path; with the feature 'mean' for the trees' roots, a row's contributions add up to its prediction."""
    model = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed, labelCol=target).fit(assembled(df, cols))
    forest = []
    for w, tree in zip(model.treeWeights, model.trees):
        nodes: list[tuple] = []

        def grow(node) -> int:
            me = len(nodes)  # noqa: B023
            nodes.append(())  # noqa: B023
            if node.numDescendants() == 0:
                nodes[me] = (-1, 0.0, -1, -1, float(node.prediction()))  # noqa: B023
            else:
                left, right = grow(node.leftChild()), grow(node.rightChild())
                nodes[me] = (node.split().featureIndex(), float(node.split().threshold()), left, right, float(node.prediction()))  # noqa: B023
            return me

        grow(tree._java_obj.rootNode())
        forest.append((float(w), *[np.array(c) for c in zip(*nodes)]))
    names = [*cols, "mean"]

    def scan(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            got = np.zeros((len(x), len(names)))
            for w, feature, bound, left, right, value in forest:
                at = np.zeros(len(x), int)
                got[:, -1] += w * value[0]
                while (live := np.flatnonzero(feature[at] >= 0)).size:
                    f, here = feature[at[live]], at[live]
                    new = np.where(x[live, f] <= bound[here], left[here], right[here])
                    got[live, f] += w * (value[new] - value[here])
                    at[live] = new
            import pandas as pd

            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": names * len(x), "contribution": got.reshape(-1)})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(scan, f"{key} {dict(df.dtypes)[key]}, feature string, contribution double")


#: Strips of points; a task has the points of two. Points of a leaf, whose box is compared with other leaves' boxes first.
STRIPS, LEAF = 32, 32


def _leaves(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple:
    """Points with counts in order of their leaves; each leaf's start, end, box (x0, y0, x1, y1) and count."""
    leaves = max(1, len(x) // LEAF)
    wide, high = np.ptp(x), np.ptp(y)
    columns = int(min(max(1, round(math.sqrt(leaves * wide / high)) if high > 0 else leaves), leaves))
    column = np.empty(len(x), int)
    column[np.argsort(x, kind="stable")] = np.arange(len(x)) * columns // len(x)
    order = np.lexsort((y, column))
    start = np.arange(0, len(x), LEAF)
    start = np.unique(np.r_[start, np.flatnonzero(np.diff(column[order])) + 1])
    x, y, n = x[order], y[order], n[order]
    box = [f.reduceat(v, start) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
    return x, y, n, start, np.r_[start[1:], len(x)], box, np.add.reduceat(n, start)


def _pair_distances(pdf, lo: float, hi: float):
    """For two strips (side 0 and 1) or one (side 0): the leaves' pairs that lie wholly below lo, as a count, then for the others
    the distances of their points with counts; pairs of leaves at hi or beyond have none."""
    own = pdf["side"].to_numpy()
    strips = [_leaves(*(pdf[c].to_numpy()[own == k] for c in ("x", "y", "n"))) for k in (0, 1) if (own == k).any()]
    if own.min() == 1 or (len(strips) == 1 and pdf["pair"].iloc[0] // STRIPS != pdf["pair"].iloc[0] % STRIPS):
        return
    single = pdf["n"].max() == 1
    ax, ay, an, start, end, box, weight = strips[0]
    bx, by, bn, bstart, bend, bbox, bweight = strips[-1]
    for i in range(len(start)):
        least, most = _box_distances(box, i, bbox)
        part = slice(start[i], end[i])
        after = np.arange(len(bstart)) > i if len(strips) == 1 else np.ones(len(bstart), bool)
        yield None, float(weight[i] * bweight[after & (most < lo)].sum())
        some = np.repeat(after & (most >= lo) & (least < hi), bend - bstart)
        if some.any():
            d = np.hypot(ax[part, None] - bx[None, some], ay[part, None] - by[None, some])
            yield d.ravel(), np.ones(d.size) if single else (an[part, None] * bn[None, some]).ravel()
        if len(strips) == 1:
            j, k = np.triu_indices(end[i] - start[i], 1)
            x, y, n = ax[part], ay[part], an[part]
            yield np.hypot(x[j] - x[k], y[j] - y[k]), n[j] * n[k]
            if (n > 1).any():
                yield np.zeros(int((n > 1).sum())), (n * (n - 1) / 2)[n > 1]


def _box_distances(box, i: int, other) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distances between a point in box i and one in each other box."""
    gap = lambda a0, a1, b0, b1: np.maximum(0.0, np.maximum(a0 - b1, b0 - a1))
    far = lambda a0, a1, b0, b1: np.maximum(a1 - b0, b1 - a0)
    sides = [(box[k][i], box[k + 2][i], other[k], other[k + 2]) for k in (0, 1)]
    return np.hypot(*(gap(*s) for s in sides)) * (1 - 1e-12), np.hypot(*(far(*s) for s in sides)) * (1 + 1e-12)


def distance_quantile(points: DataFrame, quantile: float, most: int | None = None, bins: int = 1 << 13) -> float | None:
    """The quantile (linear between neighbours, as numpy's) of the distances of all pairs of points (x, y); null for fewer than
    two. More than `most` points, where that is given, are an error.

    Points are dealt to strips; a task compares two of them by their leaves' boxes and computes distances only of leaves
    whose distances can lie in the range where the quantile is. That range is found by boxes alone, then by counts of
    distances in bins, cut finer each time."""
    rows = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    per = cut(rows.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    n, size, x0, x1, y0, y1 = per.agg(F.sum("n"), F.count("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = int(n or 0)
    if most is not None and n > most:
        raise ValueError(f"more than {most} points")
    if n < 2:
        return None
    strips = min(STRIPS, 1 + size // 1024)
    cuts = sorted(set(per.approxQuantile("x", [i / strips for i in range(1, strips)], 1 / (8 * strips)))) if strips > 1 else []
    strip = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("x"))) if cuts else F.lit(0)
    to = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("to")
    dealt = per.select("x", "y", "n", strip.alias("strip"), to)
    first = F.col("strip") <= F.col("to")
    pair = F.when(first, F.col("strip") * STRIPS + F.col("to")).otherwise(F.col("to") * STRIPS + F.col("strip"))
    dealt = dealt.select("x", "y", "n", pair.alias("pair"), F.when(first, 0).otherwise(1).alias("side"))
    dealt = dealt.repartition(len(cuts) * 8 + 1, "pair").groupBy("pair")  # stated, since few bytes are much work here

    def bounds(edges):
        def each(pdf):
            """Pairs by the least and by the largest distance that their leaves allow."""
            import pandas as pd

            own = pdf["side"].to_numpy()
            one = pdf["pair"].iloc[0] // STRIPS == pdf["pair"].iloc[0] % STRIPS
            low, high = np.zeros(len(edges)), np.zeros(len(edges))
            if one or 0 < own.sum() < len(own):
                a, b = (_leaves(*(pdf[c].to_numpy()[own == k] for c in ("x", "y", "n"))) for k in (0, 0 if one else 1))
                for i in range(len(a[3])):
                    least, far = _box_distances(a[5], i, b[5])
                    w = a[6][i] * b[6]
                    if one:
                        w = np.where(np.arange(len(w)) > i, w, 0.0)
                        w[i] = a[6][i] * (a[6][i] - 1) / 2
                        least[i] = 0.0
                    for got, d in ((low, least), (high, far)):
                        got += np.bincount(np.clip(np.searchsorted(edges, d, "right") - 1, 0, len(edges) - 1), w, len(edges))
            return pd.DataFrame({"bin": np.arange(len(edges)), "low": low, "high": high})

        return each

    def counts(edges):
        def each(pdf):
            import pandas as pd

            size = len(edges) - 1
            total, pairs, below = np.zeros(size), np.zeros(size, np.int64), 0.0
            for d, w in _pair_distances(pdf, edges[0], edges[-1]):
                if d is None:
                    below += w
                    continue
                below += w[d < edges[0]].sum()
                inside = np.flatnonzero((d >= edges[0]) & (d < edges[-1]))
                d = d[inside]
                at = np.minimum(((d - edges[0]) * (size / (edges[-1] - edges[0]))).astype(np.int64), size - 1)
                at = at - (d < edges[at]) + (d >= edges[at + 1])  # rounded
                total += np.bincount(at, w[inside], size)
                pairs += np.bincount(at, minlength=size)
            some = np.flatnonzero(pairs)
            return pd.DataFrame({"bin": np.r_[-1, some], "n": np.r_[below, total[some]], "pairs": np.r_[0, pairs[some]]})

        return each

    where = quantile * (n * (n - 1) // 2 - 1)
    wanted = [math.floor(where), math.ceil(where)]
    lo, hi = 0.0, math.hypot(x1 - x0, y1 - y0) * (1 + 1e-9) + 1e-300
    edges = np.linspace(lo, hi, min(bins, 4096) + 1)
    got = dealt.applyInPandas(bounds(edges), "bin long, low double, high double").groupBy("bin").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).orderBy("bin").collect()
    start, sure = np.cumsum([r.low for r in got]), np.cumsum([r.high for r in got])  # may be, are below the bin's upper edge
    a, b = np.searchsorted(start, wanted[0], "right"), np.searchsorted(sure, wanted[1], "right")
    lo, hi = float(edges[min(a, len(edges) - 2)]), float(edges[min(b + 1, len(edges) - 1)])
    while True:
        edges = np.linspace(lo, hi, bins + 1)
        got = dealt.applyInPandas(counts(edges), "bin long, n double, pairs long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).orderBy("bin").collect()  # bins at most
        ahead = np.cumsum([r.n for r in got])
        first, last = (int(np.searchsorted(ahead, w, "right")) for w in wanted)
        before = int(ahead[first] - got[first].n)
        a, b = float(edges[got[first].bin]), float(edges[got[last].bin + 1])
        inside = sum(r.pairs for r in got[first : last + 1])
        if inside <= 32 * bins or b - a <= 1e-12 * max(1.0, b) or (a, b) == (lo, hi):
            break
        lo, hi = a, b
    if inside > 32 * bins:  # as many equal distances
        return a

    def kept(pdf):
        import pandas as pd

        out = [(d[k], w[k]) for d, w in _pair_distances(pdf, a, b) if d is not None for k in [(d >= a) & (d < b)] if k.any()]
        return pd.DataFrame({"d": np.concatenate([o[0] for o in out]) if out else np.zeros(0), "n": np.concatenate([o[1] for o in out]) if out else np.zeros(0)})

    found = dealt.applyInPandas(kept, "d double, n double").orderBy("d").toPandas()
    ahead = before + np.cumsum(found["n"].to_numpy())
    low, high = (float(found["d"].iloc[int(np.searchsorted(ahead, w, "right"))]) for w in wanted)
    return low + (high - low) * (where - wanted[0])


def rbf_features(df: DataFrame, key: str, k: int = 8, quantile: float = 0.5, seed: int = 42) -> DataFrame:
    """key, f0 ... : closeness to k learned anchors. The width is a quantile of the distances of all pairs of points."""
    model = KMeans(k=k, seed=seed).fit(assembled(df, ["x", "y"]))
    anchors = sorted(tuple(float(v) for v in c) for c in model.clusterCenters())
    d = distance_quantile(df, quantile)
    gamma = 1 / (2 * d**2 + 1e-9) if d is not None else 0.0
    return df.select(key, *[F.exp(-gamma * (F.pow(F.col("x") - a, 2) + F.pow(F.col("y") - b, 2))).alias(f"f{i}") for i, (a, b) in enumerate(anchors)])


def grid_predictions(points: DataFrame, cols: list[str], target: str, grid: DataFrame, seed: int = 42) -> DataFrame:
    """grid with pred and source: a boosted model learned on points, applied to the rows that have all features; else the
    median of those predictions."""
    model = GBTRegressor(maxDepth=3, maxIter=10, seed=seed, labelCol=target).fit(assembled(points, cols))
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    done = model.transform(assembled(grid.filter(whole), cols)).drop("features").withColumnRenamed("prediction", "pred").withColumn("source", F.lit("model"))
    med = done.agg(F.percentile("pred", 0.5).alias("pred"))
    rest = grid.filter(~whole).crossJoin(F.broadcast(med)).withColumn("source", F.lit("median"))
    return done.unionByName(rest)


def vote_refined(cells: DataFrame, cluster: str, label: str, score: str, water: str, lo: float = 27.0, hi: float = 31.0) -> DataFrame:
    """cells with `refined`: cells whose score lies in the fuzzy band take the commonest label of their cluster (the least of
    equally common ones), except water cells and those of which more than half is water."""
    n = cells.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    vote = n.groupBy(cluster).agg(F.min(F.struct(-F.col("n"), F.col(label).alias("l")))["l"].alias("_vote"))
    fuzzy = F.col(score).between(lo, hi) & (F.col(label) != 2) & ~(F.coalesce(F.col(water), F.lit(0.0)) > 0.5)
    return cells.join(vote, cluster, "left").withColumn("refined", F.when(fuzzy, F.coalesce("_vote", F.col(label))).otherwise(F.col(label))).drop("_vote")


def grid_features(grid: DataFrame, features: list[str], own: dict[str, str], medians: dict[str, float], shares: list[str], dominant: str, own_class: str, whole: list[str]) -> DataFrame:
    """grid with missing features filled: a feature by the cell's own value where it has one (own: feature to column), then by
    the training data's median; shares by 0; the dominant class by the cell's own class, then 0; the `whole` columns by their
    median over the grid."""
    mid = grid.agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in whole]) if whole else None
    out = grid.withColumns({f: F.coalesce(F.col(f), *([F.col(own[f])] if f in own else []), F.lit(float(medians[f]))) for f in features})
    out = out.withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in shares} | {dominant: F.coalesce(F.col(dominant), F.col(own_class), F.lit(0))})
    if mid is None:
        return out
    return out.crossJoin(F.broadcast(mid)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in whole}).drop(*[f"_m_{c}" for c in whole])  # one row


def boxcox_lambda(df: DataFrame, col: str, lo: float = -2.0, hi: float = 2.0, rounds: int = 4, grid: int = 21) -> float:
    """The exponent of largest likelihood: each round tries a grid of exponents in one aggregate and narrows to its best."""
    from ..functions import scalar as S

    y = F.greatest(F.col(col), F.lit(1e-4))
    best = 0.0
    for _ in range(rounds):
        tries = np.linspace(lo, hi, grid).tolist()
        r = df.agg(F.count(F.col(col)).alias("n"), F.sum(F.log(y)).alias("s"), *[F.var_pop(S.boxcox(F.col(col), t)).alias(f"v{i}") for i, t in enumerate(tries)]).first()
        scores = [S.boxcox_likelihood(r["n"], r["s"], r[f"v{i}"], t) for i, t in enumerate(tries)]
        best = tries[int(np.argmax(scores))]
        step = (hi - lo) / (grid - 1)
        lo, hi = best - step, best + step
    return best


def knn_impute(known: DataFrame, pairs: DataFrame, point_id: str, value: str, shrink: float = 0.15) -> DataFrame:
    """Distance-weighted mean of neighbours (pairs with d2 and the value), drawn to the global mean by `shrink`; the
    global mean where fewer than three neighbours are known."""
    mean = known.agg(F.avg(value).alias("m"))
    w = 1 / (F.sqrt("d2") + 1e-9)
    per = pairs.groupBy(point_id).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("v"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    per = per.crossJoin(F.broadcast(mean))
    v = F.when(F.col("n") < 3, F.col("m")).otherwise((1 - shrink) * F.col("v") + shrink * F.col("m"))
    return per.select(point_id, v.alias("value"), (1 / (1 + F.col("sd"))).alias("confidence"), F.when(F.col("n") < 3, "mean").otherwise("knn").alias("source"))


def supply_with_fallback(seats: Column, stage: Column, defaults: dict[str, float], other: float) -> Column:
    """Measured seats, or the stage's default; below 50 times three; at most 10000."""
    from ..functions import scalar as S

    s = F.when(seats.isNull() | (seats <= 0), S.lookup(stage, defaults, other)).otherwise(seats)
    return F.least(F.when(s < 50, s * 3).otherwise(s), F.lit(10000.0))


def _cheapest(cost: np.ndarray, segment, lo: int, hi: int, first: int, last: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j in lo ... hi the least cost[i] + segment(i, j) over the i in first ... min(last, j + most), and its first i.

    That i never moves down as j grows, so each half of a row is searched on one side of its middle only, all middles of
    a depth at once."""
    new, cut = np.full(len(cost), np.inf), np.zeros(len(cost), np.int32)
    lo, hi, first, last = (np.array([x]) for x in (lo, hi, first, last))
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(last, mid + most) - first + 1
        start = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(start - first, size)
        total = cost[i] + segment(i, np.repeat(mid, size))
        best = np.minimum.reduceat(total, start)
        hit = np.flatnonzero(total == np.repeat(best, size))
        new[mid], cut[mid] = best, i[hit[np.searchsorted(hit, start)]]
        lo, hi, first, last = np.r_[lo, mid + 1], np.r_[mid - 1, hi], np.r_[first, cut[mid]], np.r_[cut[mid], last]
        some = lo <= hi
        order = np.argsort(lo[some])
        lo, hi, first, last = (x[some][order] for x in (lo, hi, first, last))
    return new, cut


def _squares(cw: np.ndarray, cy: np.ndarray, cq: np.ndarray):
    """Squared deviation of the values i ... j - 1 from their mean, by running sums of weights, values and squares."""

    def segment(i, j):
        sy = cy[j] - cy[i]
        return (cq[j] - cq[i]) - sy * sy / (cw[j] - cw[i])

    return segment


def _classes(cw: np.ndarray, cy: np.ndarray, cq: np.ndarray, k: int) -> tuple[float, list[int]]:
    """The least squared deviation of k classes and the first value of each class but the first."""
    n = len(cw) - 1
    cost, cuts = np.r_[0.0, np.full(n, np.inf)], []
    for c in range(1, k + 1):
        cost, cut = _cheapest(cost, _squares(cw, cy, cq), c, n, c - 1, n - 1, -1)
        cuts.append(cut)
    out, j = [], n
    for c in range(k, 1, -1):
        j = int(cuts[c - 1][j])
        out.append(j)
    return float(cost[n]), out[::-1]


def jenks(values: list[float], k: int = 5, counts: list[int] | None = None) -> list[float]:
    """Upper bounds of the inner classes of least squared deviation; equal widths with fewer than k distinct values. Exact
    at every size."""
    v = np.asarray(values, float)
    if not len(v):
        return []
    x, at = np.unique(v, return_inverse=True)
    if len(x) < k:
        return np.linspace(x[0], x[-1], k + 1)[1:-1].tolist()
    w = np.bincount(at, counts).astype(float)
    y = x - np.average(x, weights=w)
    cw, cy, cq = (np.r_[0.0, np.cumsum(a)] for a in (w, w * y, w * y * y))
    return [float(x[j - 1]) for j in _classes(cw, cy, cq, k)[1]]


def _may_hold_breaks(cw: np.ndarray, cy: np.ndarray, cq: np.ndarray, one: np.ndarray, live: np.ndarray, k: int, most: float) -> np.ndarray:
    """Blocks of values in or before which classes of a squared deviation of at most `most` can break, of the blocks `live`. Blocks
    of more than one value (not `one`) that hold breaks are left out of the sum, which makes it less than that of any such classes."""

    def least(cw, cy, cq, skip, more, live):
        def between(i, j):
            i, j = i + skip[i], j + more[j]
            sy = cy[j] - cy[np.minimum(i, j)]
            return (cq[j] - cq[np.minimum(i, j)]) - sy * sy / np.maximum(cw[j] - cw[np.minimum(i, j)], 1.0)

        m = len(cw) - 1
        j = np.arange(m) + more
        rows = [np.where(live, cq[j] - cy[j] ** 2 / np.maximum(cw[j], 1.0), np.inf)]
        for _ in range(k - 2):
            rows.append(np.where(live, _cheapest(rows[-1], between, 0, m - 1, 0, m - 1, 0)[0], np.inf))
        return rows

    own, none = one.astype(int), np.zeros(len(one), int)
    left, right = least(cw, cy, cq, 1 - own, none, live), least(*(c[-1] - c[::-1] for c in (cw, cy, cq)), none + 1, own[::-1], live[::-1])
    some = np.zeros(len(one), bool)
    for c in range(k - 1):
        some |= left[c] + right[k - 2 - c][::-1] <= most
    return some & live


def jenks_breaks(df: DataFrame, value: str, k: int = 5, most: int | None = None, plain: int = 200_000, bins: int = 1 << 14) -> DataFrame:
    """Breaks as rows, over all finite values; more than `most` distinct ones, where that is given, are an error.

    The best breaks over more than `plain` distinct values are found by blocks of them. Breaks between blocks bound the least
    squared deviation from above, sums without the blocks that hold breaks from below; blocks that can hold none are never
    looked into again, the others are cut finer, until they hold few enough values. The driver has the blocks' sums only."""
    spark, v = df.sparkSession, F.col(value).cast("double")
    pairs = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs)
    distinct, total, lo, hi, mean = pairs.agg(F.count(F.lit(1)), F.sum("n"), F.min("v"), F.max("v"), F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()
    if most is not None and distinct > most:
        raise ValueError(f"more than {most} distinct values")
    if distinct <= max(plain, k):
        table = pairs.toArrow()
        rows = jenks(table["v"].to_numpy(), k, table["n"].to_numpy())
        return spark.createDataFrame([(i + 1, float(b)) for i, b in enumerate(rows)], "class int, upper double")

    def counted(edges: np.ndarray, single: np.ndarray) -> np.ndarray:
        """bin, values, weight, sum, sum of squares, least and largest value of the bins that start at the edges; only of
        those looked into (single), in order."""

        def scan(batches):
            import pandas as pd

            for pdf in batches:
                x, n = pdf["v"].to_numpy(), pdf["n"].to_numpy(float)
                at = np.searchsorted(edges, x, "right") - 1
                kept = (at >= 0) & single[at]
                x, n, at = x[kept], n[kept], at[kept]
                order = np.argsort(at, kind="stable")
                x, n, at = x[order], n[order], at[order]
                if len(at):
                    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    y, sums = x - mean, lambda a: np.add.reduceat(a, start)  # noqa: B023
                    yield pd.DataFrame({"bin": at[start], "d": np.diff(np.r_[start, len(at)]), "w": sums(n), "y": sums(n * y), "q": sums(n * y * y), "a": np.minimum.reduceat(x, start), "b": np.maximum.reduceat(x, start)})

        got = pairs.mapInPandas(scan, "bin long, d long, w double, y double, q double, a double, b double")
        sums = got.groupBy("bin").agg(*[F.sum(c).alias(c) for c in "dwyq"], F.min("a").alias("a"), F.max("b").alias("b"))
        return sums.toPandas().sort_values("bin")[list("dwyqab")].to_numpy(float)

    whole = np.array([[distinct, total, 0.0, 0.0, lo, hi]], float)
    blocks, some = whole, np.array([True])
    while True:
        inside = blocks[some, 0].sum()
        if inside <= plain:
            break
        # one edge for each block that is done with, as many as its share of values for the others
        parts = np.where(some & (blocks[:, 4] < blocks[:, 5]), np.ceil(bins * blocks[:, 0] / inside).astype(int) + 1, 1)
        edges, single = [], []
        for (_, _, _, _, a, b), p, s in zip(blocks, parts, some):
            t = np.arange(p) / p
            e = np.unique(a * (1 - t) + b * t) if p > 1 else np.array([a])
            if p > 1 and len(e) < 2:
                e = np.array([a, b])  # neighbours
            edges.append(e)
            single.append(np.full(len(e), s))
        new = counted(np.concatenate(edges), np.concatenate(single))
        blocks, live = np.vstack([blocks[~some], new]), np.r_[np.zeros((~some).sum(), bool), np.ones(len(new), bool)]
        order = np.argsort(blocks[:, 4], kind="stable")
        blocks, live = blocks[order], live[order]
        cw, cy, cq = (np.r_[0.0, np.cumsum(blocks[:, c])] for c in (1, 2, 3))
        upper = _classes(cw, cy, cq, k)[0] if len(blocks) >= k else math.inf
        some = _may_hold_breaks(cw, cy, cq, blocks[:, 4] == blocks[:, 5], live, k, upper * (1 + 1e-9) + cq[-1] * 1e-13)
        closed = np.flatnonzero(~some)
        if len(closed):  # neighbours that are done with become one
            runs = np.split(closed, np.flatnonzero(np.diff(closed) > 1) + 1)
            joined = np.array([[*blocks[r, :4].sum(0), blocks[r[0], 4], blocks[r[-1], 5]] for r in runs])
            blocks, some = np.vstack([joined, blocks[some]]), np.r_[np.zeros(len(runs), bool), np.ones(int(some.sum()), bool)]
            order = np.argsort(blocks[:, 4], kind="stable")
            blocks, some = blocks[order], some[order]
        if (blocks[some, 4] == blocks[some, 5]).all():
            break
    ranges = blocks[some][blocks[some, 4] < blocks[some, 5]]
    if len(ranges):
        edges = np.array(sorted({*ranges[:, 4]}))
        ends = ranges[np.argsort(ranges[:, 4]), 5]

        def values(batches):
            for pdf in batches:
                x = pdf["v"].to_numpy()
                at = np.searchsorted(edges, x, "right") - 1
                yield pdf[(at >= 0) & (x <= ends[at])]

        x = pairs.mapInPandas(values, "v double, n long").toPandas()
        v, n = x["v"].to_numpy(), x["n"].to_numpy(float)
        y = v - mean
        rest = np.r_[blocks[~some], blocks[some][blocks[some, 4] == blocks[some, 5]]]
        blocks = np.vstack([rest, np.c_[np.ones(len(v)), n, n * y, n * y * y, v, v]])
        blocks = blocks[np.argsort(blocks[:, 4], kind="stable")]
    cw, cy, cq = (np.r_[0.0, np.cumsum(blocks[:, c])] for c in (1, 2, 3))
    rows = [blocks[j - 1, 5] for j in _classes(cw, cy, cq, k)[1]]
    return spark.createDataFrame([(i + 1, float(b)) for i, b in enumerate(rows)], "class int, upper double")
