"""The demand grid: cells around the sites' hull, among which the sites' counts are split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .lineage import cut
from .planning import hull_of
from .spatial import lattice

#: Side of a cell, reach beyond the hull, share of school age, least demand of a cell, and the weights of demand,
#: pressure, risk and score.
SIZE, REACH, SCHOOL_AGE, LEAST = 250.0, 2500.0, 0.1174, 0.05
WEIGHTS, WEIGHTS_SCORED, LEAST_WEIGHT = (0.45, 0.35, 0.20), (0.40, 0.33, 0.20, 0.07), 0.01
#: Pairs of a site and a cell that one task weighs. Cells are few by the hull's area, sites are as many as there are.
PAIRS = 20_000_000


def near_hull(hull: list[tuple[float, float]], size: float, reach: float) -> Column:
    """Whether the cell around (x, y) comes within reach of a convex polygon: its centre is inside all sides, or a corner of
    it is within reach of a side, or a corner of the polygon within reach of it. reach is at least the cell's diagonal."""
    h = size / 2
    sides = list(zip(hull, hull[1:] + hull[:1], strict=True))
    ring = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*a, *b), ("x0", "y0", "x1", "y1"), strict=True)]) for a, b in sides])
    inside = F.forall(ring, lambda s: (s["x1"] - s["x0"]) * (F.col("y") - s["y0"]) - (s["y1"] - s["y0"]) * (F.col("x") - s["x0"]) >= 0)

    def to_side(s: Column, px: Column, py: Column) -> Column:
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["x0"]) * dx + (py - s["y0"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))))
        return F.hypot(px - (s["x0"] + t * dx), py - (s["y0"] + t * dy))

    corners = [to_side_at for a in (-h, h) for b in (-h, h) for to_side_at in [lambda s, a=a, b=b: to_side(s, F.col("x") + a, F.col("y") + b) <= reach]]
    box = lambda s: F.hypot(F.greatest(F.lit(0.0), F.abs(s["x0"] - F.col("x")) - h), F.greatest(F.lit(0.0), F.abs(s["y0"] - F.col("y")) - h)) <= reach
    near = F.exists(ring, lambda s: box(s) | corners[0](s) | corners[1](s) | corners[2](s) | corners[3](s))
    return near if len(hull) < 3 else inside | near


def demand_cells(sites: DataFrame, site_id: str, score: str | None = None, size: float = SIZE, reach: float = REACH, most: int | None = None) -> DataFrame:
    """cell, x, y, raw, demand, pressure, risk, weight of the cells of more than LEAST demand.

    sites: site_id, x, y, n (count), pressure, risk (1 to 5), and a score where one is named. Each site's count is split among
    all cells within reach of the sites' hull by the inverse squared distance (of 1 at least), so that cells' shares add up
    to it. Pressure and score are means of all sites by the same distances; risk is that of the nearest site, the least id
    of equally near ones."""
    spark = sites.sparkSession
    if most is not None and sites.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sites")
    hull = hull_of(sites)
    if not hull:
        raise ValueError("no sites")
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]
    x0, y0 = min(xs) - reach, min(ys) - reach
    nx, ny = (math.ceil((max(v) + reach - o) / size) for v, o in ((xs, x0), (ys, y0)))
    cells = cut(lattice(spark, x0, y0, nx, ny, size).filter(near_hull(hull, size, reach)).select((F.col("ci0") * ny + F.col("cj0")).alias("cell"), "x", "y"))
    value = F.col(score).cast("double") if score else F.lit(0.0)
    fields = [F.col(site_id).alias("i"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("n").cast("double").alias("n"), F.col("pressure").cast("double").alias("p"), F.col("risk").alias("risk"), value.alias("score")]
    plain = cut(sites.select(*fields))
    tasks = max(1, plain.count() * cells.count() // PAIRS)
    # each task sums over the cells, or sites, that it has; only sums are shuffled
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    square = F.greatest(F.lit(1.0), dx * dx + dy * dy)
    w = 1 / square
    met = lambda df, cells=cells: df.repartition(tasks).crossJoin(F.broadcast(cells))
    total = met(plain).groupBy("i").agg(F.sum(w).alias("total"))
    split = cut(plain.join(total, "i").withColumn("share", F.col("n") / F.col("total")))
    sums = cut(met(split).groupBy("cell", "x", "y").agg(F.sum(w * F.col("share")).alias("raw"), (F.sum(w * F.col("p")) / F.sum(w)).alias("pressure"), (F.sum(w * F.col("score")) / F.sum(w)).alias("score"), F.min(F.sqrt(square)).alias("near")))
    # the least of a structure would be found by sorting all pairs, so the nearest are looked up by their distance
    nearest = met(plain, sums.select("cell", "x", "y", "near")).filter(F.sqrt(square) == F.col("near")).groupBy("cell").agg(F.min(F.struct("i", "risk"))["risk"].alias("risk"))
    grid = sums.join(nearest, "cell").select("cell", "x", "y", "raw", "pressure", "score", "risk")
    grid = cut(grid.withColumn("demand", F.col("raw") * SCHOOL_AGE).filter(F.col("demand") > LEAST))
    ends = grid.agg(*[f(c).alias(f"{n}_{c}") for c in ("demand", "pressure", "score") for f, n in ((F.min, "lo"), (F.max, "hi"))])  # one row
    unit = lambda c: S.minmax(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    parts = [unit("demand"), unit("pressure"), (F.col("risk") - 1) / 4.0] + ([unit("score")] if score else [])
    weight = sum((w * p for w, p in zip(WEIGHTS_SCORED if score else WEIGHTS, parts, strict=True)), F.lit(0.0))
    return grid.crossJoin(F.broadcast(ends)).select("cell", "x", "y", "raw", "demand", "pressure", "risk", F.greatest(F.lit(LEAST_WEIGHT), weight).alias("weight"))
