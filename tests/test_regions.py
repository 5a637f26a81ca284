"""Regions of any number of entities are those of a plain search over the whole tree."""

from __future__ import annotations

import numpy as np
import pytest

from equimap.operators import regions


def plain(x, links, k):
    """Kruskal's tree, cut k - 1 times by trying each link."""

    def parts(tree):
        up = list(range(len(x)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        kept = []
        for a, b in tree:
            if root(a) != root(b):
                up[root(a)] = root(b)
                kept.append((a, b))
        return kept, [root(i) for i in range(len(x))]

    deviation = lambda of: sum(((x[np.array(of) == r] - x[np.array(of) == r].mean(0)) ** 2).sum() for r in set(of))
    tree, of = parts(sorted(links, key=lambda e: (np.sqrt(((x[e[0]] - x[e[1]]) ** 2).sum()), e)))
    while len(set(of)) < k and tree:
        tree = min(([e for e in tree if e != c] for c in tree), key=lambda t: deviation(parts(t)[1]))
        of = parts(tree)[1]
    names = {r: i + 1 for i, r in enumerate(dict.fromkeys(of))}
    return [names[r] for r in of]


@pytest.mark.parametrize(("most", "apart"), [(50, False), (30, True), (10_000, False)])
def test_regions_by_fragments(spark, most, apart):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) + np.repeat([[0, 0], [3, 1], [-2, 4]], 20, axis=0)
    links = {(i, i + 1) for i in range(59) if not (apart and i % 20 == 19)} | {(i, i + 7) for i in range(53) if not apart}
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, u double, v double")
    edges = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in links], "p long, q long")
    got = {r.id: r.region for r in regions.skater(df, edges, "id", ["u", "v"], 6, most, 20).collect()}
    assert [got[i] for i in range(60)] == plain(x, links, 6)
