"""Exact Shapley values of boosted trees, rows in batches.

A tree's expectation with only some features known follows both children where a split's feature is unknown, weighted by their
training rows. A leaf is reached with a share that is a product over its path's features: 1 or 0 for a known one (whether the
row keeps to all its splits on the path), else the product of the children's weights. So a leaf adds to a feature's value its
own value times the weights of all subsets of the path's other features, which are the coefficients of the product of
(unknown + known * t): they are summed by size instead of being listed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import assembled

#: What a leaf is: its value, and for each feature of its path the splits (bound, whether the row goes left) and the share of
#: rows that keep to them.
Leaf = tuple[float, list[tuple[int, list[tuple[float, bool]], float]]]


def leaves_of(root) -> list[Leaf]:
    """The leaves of a fitted tree (a root node of the JVM's)."""
    out: list[Leaf] = []

    def count(node) -> float:
        return float(node.impurityStats().count())

    def walk(node, path: dict[int, tuple[list, float]]) -> None:
        if node.numDescendants() == 0:
            out.append((float(node.prediction()), [(f, splits, z) for f, (splits, z) in sorted(path.items())]))
            return
        f, bound, total = int(node.split().featureIndex()), float(node.split().threshold()), count(node)
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            splits, z = path.get(f, ([], 1.0))
            walk(child, path | {f: ([*splits, (bound, left)], z * count(child) / total)})

    walk(root, {})
    return out


def forest_of(model: GBTRegressionModel) -> list[Leaf]:
    """All leaves, their values times the trees' weights."""
    return [(w * v, path) for w, tree in zip(model.treeWeights, model.trees, strict=True) for v, path in leaves_of(tree._java_obj.rootNode())]


def values(forest: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows, features) Shapley values of a batch, and what the forest gives without any feature."""
    out, mean = np.zeros(x.shape), 0.0
    for value, path in forest:
        d = len(path)
        zero = np.array([z for *_, z in path])
        mean += value * float(np.prod(zero))
        one = np.array([np.all([(x[:, f] <= b) == left for b, left in splits], axis=0) for f, splits, _ in path], float).reshape(d, len(x))
        size_weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for i, (f, *_) in enumerate(path):
            p = np.zeros((d, len(x)))  # coefficients by the number of known features
            p[0] = 1.0
            for j in range(d):
                if j != i:
                    p[1:], p[0] = p[1:] * zero[j] + p[:-1] * one[j], p[0] * zero[j]
            out[:, f] += value * (one[i] - zero[i]) * (size_weight @ p)
    return out, mean


def shapley(df: DataFrame, key: str, cols: list[str], target: str, seed: int = 42, depth: int = 3, rounds: int = 10) -> DataFrame:
    """key, feature, contribution for each row and feature, and for the feature 'mean' what holds without any; a row's
    contributions add up to the boosted model's prediction."""
    model = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=seed, labelCol=target).fit(assembled(df, cols))
    forest, names = forest_of(model), [*cols, "mean"]

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            got, mean = values(forest, pdf[cols].to_numpy(float))
            rows = np.hstack((got, np.full((len(got), 1), mean)))
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(names)), "feature": names * len(rows), "contribution": rows.reshape(-1)})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(scan, f"{key} {dict(df.dtypes)[key]}, feature string, contribution double")


def strongest(contributions: DataFrame, key: str, top: int = 3) -> DataFrame:
    """key, rank, feature, contribution: each row's strongest features, ties by name."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), "feature")
    return contributions.filter("feature <> 'mean'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(key, "rank", "feature", "contribution")


def overall(contributions: DataFrame) -> DataFrame:
    """feature, strength: the mean size of a feature's contributions."""
    return contributions.filter("feature <> 'mean'").groupBy("feature").agg(F.avg(F.abs("contribution")).alias("strength"))


def dependence(contributions: DataFrame, df: DataFrame, key: str, cols: list[str], top: int = 4) -> DataFrame:
    """feature, partner, strength, r: for each of the strongest features the other one that it acts together with: what a line
    in the feature's own value leaves of its contributions goes most with the product of both values (as distances from their
    means; r is the size of the correlation)."""
    best = overall(contributions).orderBy(F.desc("strength"), "feature").limit(top)
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("partner"), F.col(c).cast("double").alias("v")) for c in cols])).alias("p")).select(key, "p.*")
    long = long.join(F.broadcast(long.groupBy("partner").agg(F.avg("v").alias("m"))), "partner").select(key, "partner", (F.col("v") - F.col("m")).alias("v"))  # a row for each column
    own = contributions.join(best, "feature").join(long.withColumnsRenamed({"partner": "feature", "v": "own"}), [key, "feature"])
    line = own.groupBy("feature").agg(F.regr_slope("contribution", "own").alias("slope"), F.regr_intercept("contribution", "own").alias("base"))
    left = own.join(F.broadcast(line), "feature").withColumn("left", F.col("contribution") - F.coalesce(F.col("base") + F.col("slope") * F.col("own"), F.lit(0.0)))
    r = left.join(long, key).filter("partner <> feature").groupBy("feature", "strength", "partner").agg(F.abs(F.corr("left", F.col("own") * F.col("v"))).alias("r"))
    w = Window.partitionBy("feature").orderBy(F.desc(F.coalesce("r", F.lit(0.0))), "partner")
    return r.withColumn("n", F.row_number().over(w)).filter("n = 1").select("feature", "partner", "strength", F.coalesce("r", F.lit(0.0)).alias("r"))
