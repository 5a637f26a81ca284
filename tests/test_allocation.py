"""The plan of new seats: flows and blocks against brute force, all constraints by SQL."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest

from equimap.operators import allocation as L
from equimap.plans import catalog, model_queries

DATA = "/root/testdata/sf0.001"


def cheapest(cost, demand, room):
    """Least cost of whole units, one after the other, over all states of the sites."""
    states = {(0,) * len(room): 0.0}
    for i in [i for i, d in enumerate(demand) for _ in range(int(d))]:
        new: dict = {}
        for state, v in states.items():
            for k in range(len(room) + 1):
                if np.isinf(cost[i, k]) or (k < len(room) and state[k] >= room[k]):
                    continue
                to = tuple(n + (k == j) for j, n in enumerate(state))
                new[to] = min(new.get(to, np.inf), v + cost[i, k])
        states = new
    return min(states.values())


def case(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 6), rng.integers(1, 4)
    cost = rng.integers(0, 20, (n, m + 1)).astype(float)
    cost[:, -1] = rng.integers(15, 40, n)
    cost[:, :-1][rng.random((n, m)) < 0.3] = np.inf
    return rng, cost, rng.integers(0, 4, n), rng.integers(0, 4, m)


@pytest.mark.parametrize("seed", range(40))
def test_flows_blocks_and_bound(seed):
    rng, cost, demand, room = case(seed)
    flow = L.Flow(cost, demand.astype(float), room.astype(float))
    assert flow.total() == pytest.approx(cheapest(cost, demand, room))
    m = len(room)
    price, most, risky, budget = rng.integers(-5, 15, m).astype(float), rng.integers(0, 3, m), rng.random(m) < 0.5, int(rng.integers(0, 5))
    z = L._greedy(flow, np.full(m, 2.0), price, most, risky, budget, 0.5)
    may = lambda q: sum(q) <= budget and q[risky].sum() >= 0.5 * sum(q)
    assert may(z) and (z <= most).all()
    cost_of = lambda q: cheapest(cost, demand, room + 2 * q) + price @ q
    assert flow.total() + price @ z == pytest.approx(cost_of(z))
    best = min(cost_of(np.array(q)) for q in itertools.product(*[range(n + 1) for n in most]) if may(np.array(q)))
    bound = L._bound(cost, demand.astype(float), room.astype(float), np.full(m, 2.0), price, most, risky.astype(float), budget, 0.5, cost_of(z), 30, 0.0)
    assert bound <= best + 1e-6 <= cost_of(z) + 2e-6


def test_constraints_by_sql(spark):
    cells, sites, od = model_queries._plan(spark, DATA)
    p = L.solve(cells, sites, od, budget=100, longest=40.0)
    c = duckdb.connect()
    for name, df in {"cells": cells, "sites": sites, "od": od, "plan": p.sites, "unmet": p.cells, "flows": p.flows, "summary": p.summary}.items():
        c.register(name, df.toArrow())
    none = lambda sql: c.execute(sql).fetchone()[0] == 0
    assert none("SELECT count(*) FROM cells LEFT JOIN (SELECT i, sum(x) AS x FROM flows GROUP BY i) USING (i) LEFT JOIN unmet USING (i) WHERE unmet IS NULL OR abs(coalesce(x, 0) + unmet - d) > 1e-4")
    assert none("SELECT count(*) FROM sites JOIN plan USING (j) LEFT JOIN (SELECT j, sum(x) AS x FROM flows GROUP BY j) USING (j) WHERE coalesce(x, 0) > room + blocks * 50 * share * 0.95 + 1e-4 OR blocks > most OR blocks < 0 OR seats <> 50 * blocks")
    assert none("SELECT count(*) FROM flows ANTI JOIN od ON flows.i = od.i AND flows.j = od.j")
    assert c.execute("SELECT sum(seats) <= 5000 AND sum(seats) FILTER (risky) >= 0.5 * sum(seats) FROM plan JOIN sites USING (j)").fetchone()[0]
    cost = """WITH e AS (SELECT i, d, w * CASE WHEN low THEN 3 ELSE 1 END AS e FROM cells) SELECT (SELECT sum(5 * t / 40 * e * x) FROM flows JOIN od USING (i, j) JOIN e USING (i))
    + (SELECT sum(500 * e * unmet) FROM unmet JOIN e USING (i)) + (SELECT sum((price - 200 * low_share) * seats) FROM plan JOIN sites USING (j)), (SELECT objective FROM summary), (SELECT gap FROM summary)"""
    again, objective, gap = c.execute(cost).fetchone()
    assert again == pytest.approx(objective, rel=1e-6) and 0 <= gap < 0.02


def test_two_runs_are_equal(spark):
    one, two = (sorted(map(tuple, catalog.QUERIES["allocation_flows"](spark, DATA).collect())) for _ in range(2))
    assert one == two and one


def test_empty_and_null_rows(spark):
    cells = spark.createDataFrame([(1, 5.0, 1.0, None), (2, None, None, True), (3, -1.0, 1.0, False)], "i long, d double, w double, low boolean")
    sites = spark.createDataFrame([(1, None, 1.0, 2, 0.0, None)], "j long, room double, share double, most int, price double, risky boolean")
    od = spark.createDataFrame([(1, 1, 4.0), (1, 1, 9.0), (None, 1, 1.0), (9, 1, 1.0)], "i long, j long, t double")
    p = L.solve(cells, sites, od, budget=3, longest=40.0)
    assert [r.blocks for r in p.sites.collect()] == [0]  # no risky site, so none may be built
    assert {r.i: r.unmet for r in p.cells.collect()} == {1: 5.0, 2: 0.0, 3: 0.0}
    p = L.solve(cells.limit(0), sites.limit(0), od, budget=3, longest=40.0)
    assert p.sites.count() == p.cells.count() == p.flows.count() == 0 and p.summary.first().objective == 0
