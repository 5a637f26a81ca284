"""Triangulations by tiles are those of all points at once."""

from __future__ import annotations

import numpy as np
import pytest

from equimap.operators import triangulation


def edges(spark, at, most):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    return sorted((r.a, r.b) for r in triangulation.delaunay(df, "id", most).collect())


def circles_are_empty(at, got):
    """Each edge of a triangle a, b, c in the whole set: by the kernel over all points."""
    k = next(k for k in range(2, len(at)) if triangulation._turn(at[0], at[1], at[k]))
    order = [0, 1, k, *(i for i in range(2, len(at)) if i != k)]
    tri = triangulation.triangles([at[i] for i in order])
    for t in tri:
        a, b, c = (at[order[i]] if i >= 0 else None for i in t)
        assert not any(triangulation._holds(a, b, c, p) for i, p in enumerate(at) if i not in {order[j] for j in t})
    return sorted({tuple(sorted((order[t[i]], order[t[i - 1]]))) for t in tri for i in range(3) if min(t[i], t[i - 1]) >= 0}) == got


@pytest.mark.parametrize("kind", ["apart", "lattice", "crowds"])
def test_tiles_give_the_triangulation_of_all_points(spark, kind):
    rng = np.random.default_rng(3)
    at = {
        "apart": [*map(tuple, rng.normal(size=(150, 2)).tolist()), (40.0, -3.0)],
        "lattice": [(float(i), float(j)) for i in range(11) for j in range(12)],  # all circles hold four points
        "crowds": [tuple((c + rng.normal(size=2) * 1e-4).tolist()) for c in rng.normal(size=(4, 2)) for _ in range(35)],
    }[kind]
    got = edges(spark, at, 25)
    assert circles_are_empty(at, got)


def test_points_on_a_line_at_one_place_or_none(spark):
    at = [(i * 1.0, -2.0 * i) for i in range(40)]
    assert edges(spark, at, 6) == [(i, i + 1) for i in range(39)]
    assert edges(spark, [(0, 0), (0, 0), (1, 1), (float("nan"), 0)], 2) == [(0, 2)] and edges(spark, at[:1], 5) == [] == edges(spark, [], 5)
