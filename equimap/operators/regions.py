"""SKATER regions of any number of entities.

Entities are joined along their least links, at most one step at a time, into fragments of the minimum spanning forest, until
few links between fragments are left; the driver has those links and the fragments' sums only. A cut's gain follows from the
sums on both its sides: between fragments on the driver, inside of them by tasks that know the sums that hang on each entity.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .stats import ranks


def _forest(links: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """Hooks (c, up, a, b) of fragments c on fragments up by the tree's link a, b, and the least links between the fragments that
    are left (w, a, b and the ends' fragments ca, cb), at most `most` of them. In each round coins decide which fragments may
    hook and which are hooked on, so that no chains are made."""
    hooks, r = [], 0
    while links.count() > most:
        sides = links.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "w", "a", "b").unionByName(links.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "w", "a", "b"))
        best = sides.groupBy("c").agg(F.min(F.struct("w", "a", "b", "o")).alias("m"))
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 0  # noqa: B023, E731
        hook = cut(best.filter(coin("c") & ~coin("m.o")).select("c", F.col("m.o").alias("up"), "m.a", "m.b"))
        to = lambda s: hook.select(F.col("c").alias(f"c{s}"), F.col("up").alias(f"u{s}"))  # noqa: B023, E731
        ends = [F.coalesce(f"u{s}", f"c{s}") for s in "ab"]
        moved = links.join(to("a"), "ca", "left").join(to("b"), "cb", "left").filter(ends[0] != ends[1])
        link = F.struct("w", "a", "b", ends[0].alias("ca"), ends[1].alias("cb"))
        links = cut(moved.groupBy(F.least(*ends), F.greatest(*ends)).agg(F.min(link).alias("m")).select("m.*"))
        hooks.append(hook)
        r += 1
    if not hooks:
        return None, links
    up = reduce(DataFrame.unionByName, hooks)
    for _ in range(math.ceil(math.log2(r + 1))):
        over = up.select(F.col("c").alias("up"), F.col("up").alias("_next"))
        up = cut(up.join(over, "up", "left").select("c", F.coalesce("_next", "up").alias("up"), "a", "b"))
    return up, links


def _roots(names, pairs) -> dict:
    """The root of each name, once the pairs are joined; and by the key None the pairs' places that joined two."""
    up, used = {i: i for i in names}, []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for n, (a, b) in enumerate(pairs):
        if root(a) != root(b):
            up[root(a)] = root(b)
            used.append(n)
    return {None: used} | {i: root(i) for i in up}


def _below(names: list, pairs: list[tuple], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the links (pairs) of a forest: the end that lies further from the root (0 or 1), the sums on that end's side, and those of
    the whole tree."""
    at = {v: i for i, v in enumerate(names)}
    near: list[list] = [[] for _ in names]
    for n, (a, b) in enumerate(pairs):
        near[at[a]].append((at[b], n, 1))
        near[at[b]].append((at[a], n, 0))
    up, link, top, order = [-1] * len(names), [-1] * len(names), [-1] * len(names), []
    end = np.zeros(len(pairs), int)
    for start in range(len(names)):
        if top[start] >= 0:
            continue
        top[start] = start
        todo = [start]
        while todo:
            i = todo.pop()
            order.append(i)
            for j, n, e in near[i]:
                if top[j] < 0:
                    top[j], up[j], link[j], end[n] = start, i, n, e
                    todo.append(j)
    sums = sums.copy()
    for i in reversed(order):
        if up[i] >= 0:
            sums[up[i]] += sums[i]
    child = np.zeros(len(pairs), int)
    for i, n in enumerate(link):
        if n >= 0:
            child[n] = i
    return end, sums[child], sums[np.array(top, int)[child]]


def _gains(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """By how much a cut lowers the squared deviation: sums are a count and each column's sum."""
    score = lambda s: (s[:, 1:] ** 2).sum(1) / np.maximum(s[:, 0], 1)
    return score(part) + score(whole - part) - score(whole)


def _best(gains, pairs) -> tuple | None:
    """gain, a, b of the best cut; of equal ones that of the least ids."""
    if not len(gains):
        return None
    top = max(gains)
    return min((p[0], p[1], g) for g, p in zip(gains, pairs) if g >= top - 1e-12 * max(1.0, abs(top)))


def skater(df: DataFrame, edges: DataFrame, key: str, cols: list[str], k: int, most: int = 50_000, share: int = 20_000) -> DataFrame:
    """Regions: the minimum spanning forest of feature distances over an adjacency (two columns of keys), cut k - 1 times where a
    cut lowers the squared deviation most; trees that the adjacency leaves apart count as cut. The driver has at most `most` links,
    a task fragments of about `share` entities."""
    spark, kind, (left, right) = df.sparkSession, dict(df.dtypes)[key], edges.columns[:2]
    xs = [f"x{i}" for i in range(len(cols))]
    v = cut(df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)]))
    end = lambda s: v.select(F.col("id").alias(s), *[F.col(x).alias(s + x) for x in xs])
    w = F.sqrt(sum(((F.col("a" + x) - F.col("b" + x)) * (F.col("a" + x) - F.col("b" + x)) for x in xs), F.lit(0.0)))
    pairs = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a <> b").distinct()
    links = cut(pairs.join(end("a"), "a").join(end("b"), "b").select(F.col("a").alias("ca"), F.col("b").alias("cb"), w.alias("w"), "a", "b"))
    up, rest = _forest(links, most)
    rest = sorted((tuple(r) for r in rest.select("w", "a", "b", "ca", "cb").collect()))
    roots = _roots({f for r in rest for f in r[3:]}, [r[3:] for r in rest])
    between = {(rest[n][1], rest[n][2]): rest[n][3:] for n in roots.pop(None)}
    v = v.withColumn("frag", F.col("id")) if up is None else v.join(up.select(F.col("c").alias("id"), "up"), "id", "left").withColumn("frag", F.coalesce("up", "id")).drop("up")
    v = cut(v.withColumn("piece", F.lit(0)))
    table = spark.createDataFrame(list(roots.items()), f"frag {kind}, part {kind}")
    parts = cut(v.join(F.broadcast(table), "frag", "left").select("id", F.coalesce("part", "frag").alias("part")))
    least = cut(parts.groupBy("part").agg(F.min("id").alias("lo")))
    trees = least.count()
    if trees >= k or trees == 0:
        numbers = ranks(least, "lo").select("part", F.col("rank_min").cast("int").alias("region"))
        return parts.join(numbers, "part").select(F.col("id").alias(key), "region")

    n, mean = (lambda r: (r[0], r[1:]))(v.agg(F.count("id"), *[F.avg(x) for x in xs]).first())
    one = [F.lit(1.0).alias("s0"), *[(F.col(x) - m).alias(f"s{i + 1}") for i, (x, m) in enumerate(zip(xs, mean))]]
    ss = [f"s{i}" for i in range(len(xs) + 1)]
    v = cut(v.select("id", "frag", "piece", *one))
    inner = spark.createDataFrame([], f"a {kind}, b {kind}, frag {kind}, piece int") if up is None else cut(up.select("a", "b", F.col("up").alias("frag"), F.lit(0).alias("piece")))
    sums = {(r["frag"], r["piece"]): np.array(r[2:], float) for r in v.groupBy("frag", "piece").agg(*[F.sum(s) for s in ss]).collect()}
    between = {p: ((f, 0), (g, 0)) for p, (f, g) in between.items()}
    buckets = math.ceil(n / share)
    bucket = F.pmod(F.xxhash64("frag"), F.lit(buckets)).alias("bucket")

    def inside(vs, es):
        import pandas as pd

        links = list(zip(es["a"].tolist(), es["b"].tolist()))
        _, part, whole = _below(vs["id"].tolist(), links, vs[ss].to_numpy(float))
        found = _best(_gains(part, whole).tolist(), links)
        return pd.DataFrame([found] if found else [], columns=["a", "b", "gain"])

    for _ in range(k - trees):
        names, ends = list(sums), list(between)
        far, part, whole = _below(names, list(between.values()), np.array([sums[f] for f in names]))
        hang = [(ends[i][e], *map(float, part[i] if far[i] == 1 - e else whole[i] - part[i])) for i in range(len(ends)) for e in (0, 1)]
        found = [_best(_gains(part, whole).tolist(), ends)]
        if up is not None:
            # what lies beyond a link to another fragment hangs on its end here
            hung = spark.createDataFrame(hang, f"id {kind}, " + ", ".join(f"h{s} double" for s in ss)).groupBy("id").agg(*[F.sum(f"h{s}").alias(f"h{s}") for s in ss])
            loaded = v.join(F.broadcast(hung), "id", "left").select("id", bucket, *[(F.col(s) + F.coalesce(f"h{s}", F.lit(0.0))).alias(s) for s in ss])
            got = loaded.repartition(buckets, "bucket").groupBy("bucket").cogroup(inner.select("a", "b", bucket).repartition(buckets, "bucket").groupBy("bucket"))
            found += [tuple(r) for r in got.applyInPandas(inside, f"a {kind}, b {kind}, gain double").collect()]
        found = [f for f in found if f]
        best = _best([f[2] for f in found], found)
        if best is None:
            break
        a, b, _ = best
        if (a, b) in between:
            del between[a, b]
            continue
        frag, piece = inner.filter((F.col("a") == a) & (F.col("b") == b)).select("frag", "piece").first()
        own = (F.col("frag") == frag) & (F.col("piece") == piece)
        held = {r["id"]: np.array([r[s] for s in ss], float) for r in v.filter(own).collect()}
        root = _roots(held, [(r["a"], r["b"]) for r in inner.filter(own).collect() if (r["a"], r["b"]) != (a, b)])
        new = max(p for f, p in sums if f == frag) + 1
        moved = {i for i in held if root[i] == root[b]}
        sums[frag, piece], sums[frag, new] = sum(s for i, s in held.items() if i not in moved), sum(held[i] for i in moved)
        between = {p: tuple((frag, new) if i in moved else f for i, f in zip(p, fs)) for p, fs in between.items()}
        moves = F.broadcast(spark.createDataFrame([(i, new) for i in moved], f"id {kind}, _new int"))
        v = cut(v.join(moves, "id", "left").withColumn("piece", F.coalesce("_new", "piece")).drop("_new"))
        inner = inner.filter(~((F.col("a") == a) & (F.col("b") == b))).join(moves.withColumnRenamed("id", "a"), "a", "left")
        inner = cut(inner.withColumn("piece", F.coalesce("_new", "piece")).drop("_new"))
    roots = _roots(sums, between.values())
    first: dict = {}
    for f, p, lo in v.groupBy("frag", "piece").agg(F.min("id")).collect():
        r = roots[f, p]
        first[r] = min(lo, first.get(r, lo))
    number = {r: i + 1 for i, r in enumerate(sorted(first, key=first.get))}
    table = spark.createDataFrame([(f, p, number[roots[f, p]]) for f, p in sums], f"frag {kind}, piece int, region int")
    return v.join(F.broadcast(table), ["frag", "piece"]).select(F.col("id").alias(key), "region")
