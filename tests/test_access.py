"""Snapping, times between feet and the demand grid against plain versions."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from equimap.operators import demand as D
from equimap.operators import network as N
from equimap.plans import catalog

SEGMENTS = "sid long, src long, dst long, w double, oneway boolean, reversed boolean, x0 double, y0 double, x1 double, y1 double"


def streets(seed, n=4):
    rng = random.Random(seed)
    at = {k: (k // n * 10.0, k % n * 10.0) for k in range(n * n)}
    pairs = [(a, a + n) for a in range(n * n - n)] + [(a, a + 1) for a in range(n * n) if (a + 1) % n]
    return [(i, a, b, rng.uniform(0.5, 3), rng.random() < 0.4, rng.random() < 0.5, *at[a], *at[b]) for i, (a, b) in enumerate(pairs)]


def split_times(segments, feet, i, cutoff):
    """Dijkstra on the graph whose segments are cut at all feet."""
    edges: dict = {}
    for sid, a, b, w, one, rev, *_ in segments:
        stops = [(0.0, ("n", a))] + sorted((t, ("f", p)) for p, (s, t) in feet.items() if s == sid) + [(1.0, ("n", b))]
        for (t0, u), (t1, v) in zip(stops, stops[1:]):
            same = t0 == t1 and u[0] == v[0]  # two feet in one place
            if not (one and rev) or same:
                edges.setdefault(u, []).append((v, (t1 - t0) * w))
            if not one or rev or same:
                edges.setdefault(v, []).append((u, (t1 - t0) * w))
    done, heap = {}, [(0.0, ("f", i))]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done or d > cutoff:
            continue
        done[u] = d
        for v, w in edges.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return {p: done["f", p] for p in feet if ("f", p) in done}


@pytest.mark.parametrize("seed", [1, 2])
def test_between_feet(spark, seed):
    segments = streets(seed)
    rng = random.Random(seed + 10)
    feet = {p: (rng.randrange(len(segments)), rng.choice([0.0, 1.0, rng.random(), rng.random()])) for p in range(30)}
    s = spark.createDataFrame(segments, SEGMENTS)
    f = spark.createDataFrame([(p, sid, t) for p, (sid, t) in feet.items()], "pid long, sid long, t double")
    pairs = spark.range(30).select(F.col("id").alias("i")).crossJoin(spark.range(30).select(F.col("id").alias("j"))).filter("i <> j")
    got = {(r.i, r.j): r.net for r in N.between_feet(pairs, f, s, 7.0).collect()}
    want = {(i, j): d for i in feet for j, d in split_times(segments, feet, i, 7.0).items() if i != j}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_snapping(spark):
    segments = streets(3)
    s = spark.createDataFrame(segments, SEGMENTS)
    rng = random.Random(4)
    points = [(i, rng.uniform(-5, 60), rng.uniform(-5, 35)) for i in range(60)] + [(60, 10.0, 10.0), (61, 5000.0, -3.0)]
    got = {r.pid: r for r in N.snapped(spark.createDataFrame(points, "pid long, x double, y double"), s, "pid", 2.0).collect()}
    assert len(got) == len(points)
    for p, x, y in points:
        best = None
        for sid, *_, x0, y0, x1, y1 in segments:
            t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
            key = (math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)), sid)
            best = min(best or key, key)
        assert (got[p].dist, got[p].sid) == (pytest.approx(best[0], abs=1e-9), best[1]), p


def test_demand_is_conserved(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 300, 1.0, 2, 0.1), (2, 1000.0, 400.0, 500, 3.0, 5, 0.5), (3, 300.0, 900.0, 0, 2.0, 1, 0.9)], "s long, x double, y double, n long, pressure double, risk int, sms double")
    rows = D.demand_cells(sites, "s", size=250.0, reach=1000.0).collect()
    assert sum(r.raw for r in rows) == pytest.approx(800)
    assert {r.risk for r in rows} == {1, 2, 5} and all(1.0 <= r.pressure <= 3.0 for r in rows)
    scored = D.demand_cells(sites, "s", "sms", size=250.0, reach=1000.0).collect()
    assert len(scored) == len(rows) and {r.cell: r.demand for r in scored} == {r.cell: r.demand for r in rows}
    assert {round(r.weight, 6) for r in scored} != {round(r.weight, 6) for r in rows}
    # a lone site: every cell within reach of the point
    one = D.demand_cells(sites.filter("s = 1"), "s", size=250.0, reach=1000.0).collect()
    assert sum(r.raw for r in one) == pytest.approx(300)
    assert all(math.hypot(max(0, abs(r.x) - 125), max(0, abs(r.y) - 125)) <= 1000 for r in one)
    with pytest.raises(ValueError, match="more than 2"):
        D.demand_cells(sites, "s", most=2)


def test_demand_of_many_sites(spark):
    """More sites than 20,000; nothing of theirs is gathered into one row, and counts still add up."""
    sites = spark.range(20_001).select("id", (F.col("id") % 141 * 7.0).alias("x"), (F.floor(F.col("id") / 141) * 7.0).alias("y"), F.lit(10).alias("n"), F.lit(2.0).alias("pressure"), (1 + F.col("id") % 5).cast("int").alias("risk"))
    rows = D.demand_cells(sites, "id", size=500.0, reach=800.0).collect()
    assert sum(r.raw for r in rows) == pytest.approx(200_010) and all(r.pressure == pytest.approx(2.0) for r in rows)
    cell = min(rows, key=lambda r: (r.x, r.y))
    near = min((max(1.0, math.hypot(cell.x - i % 141 * 7, cell.y - i // 141 * 7)), i) for i in range(20_001))[1]
    assert cell.risk == 1 + near % 5


def test_od_snapped_uses_both_ways(spark):
    got = catalog.QUERIES["od_snapped"](spark, "/root/testdata/sf0.001").groupBy("source").count().collect()
    assert {r.source for r in got} <= {"network", "straight"} and got


def test_axis_guard(spark):
    from equimap.sources import files

    at = lambda rows: spark.createDataFrame(rows, "x double, y double")
    zoned, dezoned, degrees = at([(38_500_000.0, 4_000_000.0), (38_510_000.0, 4_010_000.0)]), at([(500_000.0, 4_000_000.0)]), at([(114.0, 36.0)])
    mixed = at([(38_500_000.0, 4_000_000.0), (500_000.0, 4_000_000.0)])
    report = {r.layer: (r.axis, r.action, r.n) for r in files.axis_report({"z": zoned, "d": dezoned, "g": degrees, "m": mixed, "e": zoned.limit(0)}).collect()}
    assert report["z"] == ("zoned", "copy", 2) and report["d"] == ("dezoned", "shift", 1) and report["g"] == ("geographic", "reproject", 1) and report["m"] == ("mixed", "error", 2) and report["e"][2] == 0
    files.one_axis({"z": zoned, "e": zoned.limit(0)})
    files.one_axis({"g": degrees, "h": degrees}, geographic=True)
    for layers, geographic in (({"z": zoned, "d": dezoned}, False), ({"z": zoned, "g": degrees}, True), ({"m": mixed}, False), ({"g": degrees}, False)):
        with pytest.raises(ValueError, match="step 4: mixed coordinate axes"):
            files.one_axis(layers, "step 4", geographic)
    done, _ = files.on_axis({"z": zoned, "d": dezoned, "g": degrees})
    assert done["z"].first().x == 38_500_000.0 and done["d"].first().x == 38_500_000.0
    assert done["g"].first().x == pytest.approx(38_500_000.0, abs=1e-3) and done["g"].first().y == pytest.approx(3_985_586, abs=2000)
    files.one_axis(done)
    with pytest.raises(ValueError, match="m: mixed"):
        files.on_axis({"m": mixed})
