"""Queries read whole tables and whole texts."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from equimap.operators import evaluation, models, network, spatial, stats
from equimap.plans import catalog

from .test_queries import DATA, duck, plain  # noqa: F401


def test_corpus_joins_whole_texts(spark, duck):  # noqa: F811
    want = duck.execute("SELECT conv_id, string_agg(text, ' / ' ORDER BY turn, text) FROM conversations WHERE trim(text) <> '' GROUP BY conv_id").fetchall()
    got = catalog.QUERIES["corpus_build"](spark, DATA)
    assert sorted((r.conv_id, r.body) for r in got.collect()) == sorted(want)


def test_points_outside_the_raster_stay_with_zero(spark, duck):  # noqa: F811
    inside = "e.value >= 0 AND e.value < 200"
    want = duck.execute(f"SELECT event_id, CASE WHEN {inside} THEN round(coalesce(greatest(p.p_retailprice, 0), 0), 6) + 0.0 ELSE 0.0 END FROM events e LEFT JOIN part p ON p.p_partkey = 1 + CAST(floor(e.value / 10) AS BIGINT) + 20 * CAST(floor((100 - e.user_id % 100) / 10) AS BIGINT)").fetchall()
    got = [(r.event_id, r.value) for r in catalog.QUERIES["raster_sample"](spark, DATA).collect()]
    outside = {i for (i,) in duck.execute(f"SELECT event_id FROM events e WHERE NOT ({inside})").fetchall()}
    assert outside and all(v == 0 for i, v in got if i in outside)
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def road_costs(duck):  # noqa: F811
    sql = "SELECT c_nationkey, s_nationkey, abs(avg(date_diff('day', o_orderdate, l_shipdate)::DOUBLE)) / 20 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
    out = {}
    for a, b, w in duck.execute(sql).fetchall():
        ways = ([] if a % 8 == 0 else [(a, b)]) + ([(b, a)] if a % 4 or a % 8 == 0 else [])
        for e in ways:
            out[e] = min(w, out.get(e, w))
    return out


def distances(costs, cutoff):
    n = range(25)
    d = {(a, b): 0.0 if a == b else costs.get((a, b), math.inf) for a in n for b in n}
    for k in n:
        for a in n:
            for b in n:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return {k: v for k, v in d.items() if v <= cutoff}


def test_graph_queries_read_the_roads_of_all_nations(spark, road_costs):
    want = distances(road_costs, 12.0)
    got = {(r.origin, r.node): r.d for r in catalog.QUERIES["sssp_cutoff"](spark, DATA).collect()}
    assert {a for a, _ in got} == set(range(25)) and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    share = {(o, a, b): min(1.0, (12.0 - d) / w) for (o, a), d in want.items() for (u, b), w in road_costs.items() if u == a and d < 12.0}
    reach = {(r.origin, r.src, r.dst): r.share for r in catalog.QUERIES["reach_truncate"](spark, DATA).collect()}
    assert set(reach) == set(share) and all(abs(reach[k] - share[k]) < 1e-5 for k in share)


def test_isochrones_of_all_nations(spark, road_costs):
    want = {}
    for (o, a), d in distances(road_costs, 6.0).items():
        for (u, b), w in road_costs.items():
            if u == a and d < 6.0:
                s, (x0, y0), (x1, y1) = min(1.0, (6.0 - d) / w), (a // 5 * 400.0, a % 5 * 400.0), (b // 5 * 400.0, b % 5 * 400.0)
                dx, dy = (x1 - x0) * s, (y1 - y0) * s
                i, j = np.meshgrid(np.arange(-3, 36) * 50.0 + 25.0, np.arange(-3, 36) * 50.0 + 25.0)
                t = np.clip(((i - x0) * dx + (j - y0) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
                near = np.hypot(i - x0 - t * dx, j - y0 - t * dy) <= 90.0
                want[o] = want.get(o, False) | near
    got = {r.origin: r.area for r in catalog.QUERIES["isochrone_areas"](spark, DATA).collect()}
    assert got == {o: near.sum() * 2500.0 for o, near in want.items()}


def test_shortest_refuses_negative_weights(spark):
    e = spark.createDataFrame([(0, 1, -1.0), (1, 0, 0.5)], "src long, dst long, w double")
    with pytest.raises(ValueError):
        network.shortest(e, spark.createDataFrame([(0,)], "node long"), 5.0)


def test_flood_reads_all_parts(spark, duck):  # noqa: F811
    size = dict(duck.execute("SELECT p_partkey, p_size FROM part").fetchall())
    n = math.ceil(math.sqrt(len(size)))
    zero = {(k // n, k % n) for k, s in size.items() if s % 5 < 2}
    todo = [(r, c) for r, c in zero if r in (0, max(size) // n) or c in (0, n - 1)]
    want = set(todo)
    while todo:
        r, c = todo.pop()
        new = {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} & zero - want
        want |= new
        todo += new
    assert {(r.row, r.col) for r in catalog.QUERIES["edge_flood"](spark, DATA).collect()} == want


def test_demand_grid_covers_all_points(spark, duck):  # noqa: F811
    p = np.array(duck.execute("SELECT embedding[1]::DOUBLE * 10000, embedding[2]::DOUBLE * 10000, embedding[3]::DOUBLE * 10000 FROM embeddings ORDER BY vec_id").fetchall())
    at = np.floor(p[:, :2] / 500)
    (i0, j0), (i1, j1) = at.min(0), at.max(0)
    got = {r.cell: r.pressure for r in catalog.QUERIES["demand_grid"](spark, DATA).collect()}
    cells = [(i, j) for i in np.arange(i0, i1 + 1) for j in np.arange(j0, j1 + 1)]
    assert sorted(got) == list(range(len(cells)))
    for k, (i, j) in enumerate(cells):
        d = ((p[:, :2] - [(i + 0.5) * 500, (j + 0.5) * 500]) ** 2).sum(1)
        near = np.argsort(d, kind="stable")[:15]
        assert abs(got[k] - (p[near, 2] / d[near]).sum() / (1 / d[near]).sum()) < 1e-3


def deviation(v, breaks):
    ends = [-np.inf, *breaks, np.inf]
    classes = [v[(v > a) & (v <= b)] for a, b in itertools.pairwise(ends)]
    return sum(((g - g.mean()) ** 2).sum() for g in classes if len(g))


def test_breaks_are_the_best():
    rng = np.random.default_rng(1)
    for n in (5, 8, 12):
        v = np.repeat(np.unique(rng.lognormal(0, 2, n)), 2)
        for k in (2, 4):
            got = models.jenks(v.tolist(), k)
            want = min(deviation(v, c) for c in itertools.combinations(np.unique(v)[:-1], k - 1))
            assert len(got) == k - 1 and abs(deviation(v, got) - want) < 1e-9 * max(1, want)


def test_breaks_of_many_values_use_all_of_them(spark):
    v = np.random.default_rng(2).lognormal(0, 3, 4000)
    df = spark.createDataFrame([(float(x),) for x in [*v, *v[:50]]] + [(None,), (math.nan,), (math.inf,)], "v double")
    got = [r.upper for r in models.jenks_breaks(df, "v").orderBy("class").collect()]
    assert set(got) <= set(v) and got == models.jenks([*v, *v[:50]])
    with pytest.raises(ValueError):
        models.jenks_breaks(df, "v", most=3999)


@pytest.mark.parametrize("plain, bins", [(50, 256), (700, 4096)])
def test_breaks_of_more_values_than_are_collected(spark, plain, bins):
    """The same breaks by blocks as over all values at once, without an error for any number of values."""
    rng = np.random.default_rng(4)
    for v in (rng.uniform(0, 1, 3000), rng.lognormal(0, 3, 3000), np.r_[np.repeat(rng.normal(size=900), 3), rng.normal(1e4, 1, 300)]):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (math.nan,), (-math.inf,)], "v double")
        got = [r.upper for r in models.jenks_breaks(df, "v", plain=plain, bins=bins).orderBy("class").collect()]
        assert got == models.jenks(v)


def test_breaks_query_reads_many_values(spark, duck):  # noqa: F811
    v = [x for (x,) in duck.execute("SELECT o_totalprice FROM orders").fetchall()]
    assert [r.upper for r in catalog.QUERIES["jenks_breaks"](spark, DATA).orderBy("class").collect()] == models.jenks(v)


@pytest.mark.parametrize("bins", [3, 4096])
def test_quantiles_in_bins(spark, bins):
    """The same as numpy's, however far out, equal or few the values are, and without all of them in one task."""
    rng = np.random.default_rng(3)
    some = [0.0, 0.02, 0.25, 0.5, 0.731, 0.98, 1.0]
    for v in (rng.normal(size=501).tolist(), [1.0] * 50 + [2.0] * 51 + [1e300, -1e300], [7.0]):
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        assert stats.quantiles(df, "v", some, plain=0, bins=bins) == pytest.approx(np.quantile(v, some).tolist(), rel=1e-12)
    odd = spark.createDataFrame([(x,) for x in (math.nan, math.inf, -math.inf, 1.0, 2.0)], "v double")
    got = stats.quantiles(odd, F.col("v"), [0.0, 0.25, 0.5, 0.75, 1.0], plain=0, bins=bins)
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    assert stats.quantiles(odd.limit(0), "v", [0.5]) == [None]


@pytest.mark.parametrize("name", ["regression_scores", "pct_norm", "gaussian_lag", "gbt_cv"])
def test_no_percentile_in_one_task(spark, name, monkeypatch):
    """Tables of more than a few rows aren't given to F.percentile, which would hold all their values in one task."""
    small = stats.quantiles
    asked = []

    def counted(df, value, wanted, **more):
        asked.append(wanted)
        return small(df, value, wanted, plain=0)

    for m in (stats, models, spatial):
        monkeypatch.setattr(m, "quantiles", counted)
    monkeypatch.setattr(F, "percentile", lambda *_: pytest.fail("percentile"))
    assert catalog.QUERIES[name](spark, DATA).count() > 0 and asked


def test_draws_are_dealt_and_not_broadcast(spark):
    """200 draws of a table for each row are many tasks' work and stay where they are."""
    df = spark.range(2000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    rows = evaluation.resampled(df, "i", 2000, 200, each=50_000)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan
    assert rows.count() == 400_000


def test_gini_of_resampled_rows(spark):
    """The same as plain sums over each run's rows in order; null values are drawn and left out."""
    rng = np.random.default_rng(1)
    v = [None if k % 11 == 0 else float(x) for k, x in enumerate(rng.integers(1, 9, 60))]
    df = spark.createDataFrame([(i, x, x and x * 2 + i, 1.0 + i % 3) for i, x in enumerate(v)], "i long, b double, a double, w double")
    drawn = evaluation.resampled(df, "i", 60, 8).collect()
    assert len(drawn) == 480

    def gini(rows):
        rows = sorted(rows)
        y, s = 0.0, 0.0
        for x, w in rows:
            y += x * w
            s += w * (2 * y - x * w)
        return 1 - s / sum(w for _, w in rows) / y

    want = [gini([(r[c], r.w) for r in drawn if r.r == k and r[c] is not None]) for c in "ba" for k in range(8)]
    got = evaluation.gini_bootstrap(df, "i", 60, "b", "a", "w", runs=8, buckets=5).first()
    assert (got.runs, got.before, got.after) == (8, pytest.approx(np.mean(want[:8])), pytest.approx(np.mean(want[8:])))


def test_fairness_where_all_times_are_zero(spark):
    """Sites so many that each place has one at no distance: no Gini of times, as in SQL, and no error."""
    df = spark.createDataFrame([(1.0, 2.0 + i, 3.0 + i, 0.0, 0.0, i < 2, 1 + i % 5) for i in range(6)], "d double, b double, a double, tb double, ta double, low boolean, risk int")
    got = evaluation.fairness(df).first()
    assert math.isnan(got.gini_time_before) and math.isnan(got.gini_time_after) and 0 < got.gini_before < 1 and got.n_low == 2


@pytest.mark.parametrize("kernel, left", [("gaussian", {1}), ("bisquare", {1})])
def test_weights_that_are_all_zero(spark, kernel, left):
    """A point far out (gaussian), or one with equally far neighbours (bisquare), has no weights; the others keep theirs."""
    far = [(2, 4, 1e8), (2, 5, 1e8)]
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 4.0), (1, 4, 9.0), *far], "p long, s long, d2 double")
    got = spatial.row_weights(pairs, "p", kernel).collect()
    assert {r.p for r in got} == left and sum(r.w for r in got) == pytest.approx(1)


def test_windows_are_judged_in_one_scan(spark, monkeypatch):
    """The sweep reads the texts once for all windows, with the evidence of each alone."""
    from equimap.operators import text as X
    from equimap.plans import text_queries as T

    corpus, lexicon = T._corpus(spark, DATA), T._lexicon(spark)
    got = X.evidence(corpus, lexicon, T.WORDS, T.NOT, others=(40, 80)).collect()
    for w in (40, 80):
        alone = {(r.entity, r.subdim): r.cooccur for r in X.evidence(corpus, lexicon, T.WORDS, T.NOT, window=w).collect()}
        assert {(r.entity, r.subdim): r[f"cooccur_{w}"] for r in got} == alone and alone
    calls, evidence = [], X.evidence
    monkeypatch.setattr(X, "evidence", lambda *a, **k: calls.append(k) or evidence(*a, **k))
    catalog.QUERIES["parameter_sweep"](spark, DATA)
    assert len(calls) == 1


def test_models_read_a_written_table(spark):
    """Folds are joined and numbered once, not again in each pass of each model."""
    from equimap.plans import model_queries

    plan = model_queries._folds(spark, DATA)._jdf.queryExecution().analyzed().toString()
    assert "LogicalRDD" in plan and "Join" not in plan and "Window" not in plan
