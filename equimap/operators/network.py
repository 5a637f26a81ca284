"""Road graphs, shortest paths with a cutoff, reachability, travel times and two-step accessibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .lineage import cut


def directed(edges: DataFrame) -> DataFrame:
    """src, dst, w: both directions of edges that aren't one-way, the other one only of reversed ones; the cheapest of
    parallel edges."""
    ahead = edges.filter(~(F.col("oneway") & F.col("reversed"))).select("src", "dst", "w")
    back = edges.filter(~F.col("oneway") | F.col("reversed")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return ahead.unionByName(back).groupBy("src", "dst").agg(F.min("w").alias("w"))


def shortest(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """origin, node, d: least cost up to cutoff from each origin, by rounds of relaxation over all origins at once.

    Only distances that got better are relaxed again; each round is checkpointed, so lineage stays short and a lost
    executor costs one round. It ends when no distance gets better; negative weights, with which it need not end, are an
    error."""
    if not edges.filter("w < 0").isEmpty():
        raise ValueError("negative weights")
    dist = cut(sources.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("d")))
    front = dist
    while True:
        step = front.join(edges, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d")).filter(F.col("d") <= cutoff)
        step = step.groupBy("origin", "node").agg(F.min("d").alias("nd"))
        better = cut(step.join(dist, ["origin", "node"], "left").filter(F.col("d").isNull() | (F.col("nd") < F.col("d"))).select("origin", "node", F.col("nd").alias("d")))
        if better.isEmpty():
            return dist
        dist = cut(dist.unionByName(better).groupBy("origin", "node").agg(F.min("d").alias("d")))
        front = better


def reachable(edges: DataFrame, dist: DataFrame, cutoff: float) -> DataFrame:
    """Edges reached from an origin, with the share of the edge inside the cutoff."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cutoff - F.col("d")) / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)))
    return dist.join(edges, F.col("node") == F.col("src")).select("origin", "src", "dst", "w", share.alias("share")).filter("share > 0")


def isochrone_cells(segments: DataFrame, size: float, buffer: float) -> DataFrame:
    """Distinct cells within buffer of reached segments (origin, x0, y0, x1, y1, share): origin, ci, cj."""
    x1 = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("share")
    y1 = F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("share")
    s = segments.select("origin", "x0", "y0", x1.alias("xe"), y1.alias("ye"))
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - buffer) / size).cast("long"), F.floor((F.greatest(a, b) + buffer) / size).cast("long")))
    from .spatial import segment_distance

    cells = s.withColumn("ci", span(F.col("x0"), F.col("xe"))).withColumn("cj", span(F.col("y0"), F.col("ye")))
    d = segment_distance((F.col("ci") + 0.5) * size, (F.col("cj") + 0.5) * size, F.col("x0"), F.col("y0"), F.col("xe"), F.col("ye"))
    return cells.filter(d <= buffer).select("origin", "ci", "cj").distinct()


def od_minutes(candidates: DataFrame, network: DataFrame, speed: dict[str, float], limit: dict[str, float], cutoff: float, snap: float, detour: float = 1.35) -> DataFrame:
    """i, j, t, source: travel times of candidate pairs (i, j, stage, dist, snap_i, ni, nj): the network's time (origin, node,
    d) from node ni to nj where the origin snaps within `snap` and the target is within the cutoff, else the straight way
    times a detour within the stage's limit, else no row."""
    net = network.filter(F.col("d") <= cutoff).select(F.col("origin").alias("ni"), F.col("node").alias("nj"), F.col("d").alias("net"))
    j = candidates.join(net, ["ni", "nj"], "left")
    by_net = F.when(F.col("snap_i") <= snap, F.col("net"))
    straight = F.when(F.col("dist") <= S.lookup(F.col("stage"), limit), F.col("dist") * detour / S.lookup(F.col("stage"), speed))
    j = j.withColumn("t", F.coalesce(by_net, straight)).withColumn("source", F.when(by_net.isNotNull(), "network").otherwise("straight"))
    return j.filter("t is not null").select("i", "j", "t", "source")


def two_step(od: DataFrame, supply: DataFrame, demand: DataFrame, t_max: float, beta: float = 0.15) -> DataFrame:
    """i, a: accessibility by two-step floating catchments over od (i, j, t), supply (j, s), demand (i, d)."""
    f = S.decay(F.col("t"), F.lit(t_max), beta)
    pairs = od.withColumn("f", f).filter("f > 0")
    load = pairs.join(demand, "i").groupBy("j").agg(F.sum(F.col("d") * F.col("f")).alias("load"))
    r = supply.join(load, "j", "left").select("j", F.when(F.col("s") <= 0, 0.0).when(F.coalesce("load", F.lit(0.0)) <= 1e-6, F.col("s")).otherwise(F.col("s") / F.when(F.col("load") > 1e-6, F.col("load")).otherwise(1.0)).alias("r"))
    got = pairs.join(r, "j").groupBy("i").agg(F.sum(F.col("r") * F.col("f")).alias("a"))
    return demand.select("i").join(got, "i", "left").select("i", F.coalesce("a", F.lit(0.0)).alias("a"))


def nearest_time(od: DataFrame, limits: dict[str, float], weights: dict[str, float]) -> DataFrame:
    """i, t: weighted nearest times of the stages, of those that there are; od has stage."""
    best = [F.min(F.when((F.col("stage") == s) & (F.col("t") <= m), F.col("t"))).alias(f"t_{s}") for s, m in limits.items()]
    per = od.groupBy("i").agg(*best)
    total = sum((F.when(F.col(f"t_{s}").isNotNull(), F.lit(w)).otherwise(0.0) for s, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(f"t_{s}") * w, F.lit(0.0)) for s, w in weights.items()), F.lit(0.0))
    return per.select("i", F.when(total > 0, value / F.when(total > 0, total).otherwise(1.0)).alias("t"))


def low_access(df: DataFrame, a: str = "a") -> DataFrame:
    """df with low: no access, or at most the first quartile of positive access."""
    q = df.agg(F.percentile(F.when(F.col(a) > 0, F.col(a)), 0.25).alias("q"))
    return df.crossJoin(F.broadcast(q)).withColumn("low", (F.col(a) == 0) | (F.col(a) <= F.col("q")))


def snapped(points: DataFrame, segments: DataFrame, point_id: str, reach: float, grow: float = 4.0) -> DataFrame:
    """point_id, sid, t, dist: the nearest segment (sid, x0, y0, x1, y1) of each point (x, y), the least sid of equally near ones;
    t is the foot's place on it, from 0 to 1. Points and segments meet on cells; points that find none within the reach are
    tried again further, until it spans everything."""
    from .spatial import cell

    ends = segments.select(F.col("x0").alias("a"), F.col("y0").alias("b")).union(segments.select("x1", "y1"))
    box = points.select(F.col("x").alias("a"), F.col("y").alias("b")).union(ends).agg(F.max("a") - F.min("a"), F.max("b") - F.min("b")).first()
    far = (box[0] or 0.0) + (box[1] or 0.0) + 1.0
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = dx * dx + dy * dy
    t = F.when(long > 0, ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / F.when(long > 0, long)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    todo, out = points, None
    while True:
        r = min(reach, far)
        span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - r, r), cell(F.greatest(a, b) + r, r)))  # noqa: B023, E731
        touched = segments.withColumn("ci", span(F.col("x0"), F.col("x1"))).withColumn("cj", span(F.col("y0"), F.col("y1")))
        pairs = todo.withColumn("ci", cell(F.col("x"), r)).withColumn("cj", cell(F.col("y"), r)).join(touched, ["ci", "cj"]).withColumn("t", t)
        pairs = pairs.withColumn("dist", F.hypot(F.col("x") - (F.col("x0") + F.col("t") * dx), F.col("y") - (F.col("y0") + F.col("t") * dy)))
        best = pairs.groupBy(point_id).agg(F.min(F.struct("dist", "sid", "t")).alias("b")).select(point_id, "b.sid", "b.t", "b.dist")
        got = cut(best if reach >= far else best.filter(F.col("dist") <= r))
        out = got if out is None else out.unionByName(got)
        if reach >= far:
            return out
        todo = cut(todo.join(got.select(point_id), point_id, "left_anti"))
        if todo.isEmpty():
            return out
        reach *= grow


def between_feet(pairs: DataFrame, feet: DataFrame, segments: DataFrame, cutoff: float) -> DataFrame:
    """i, j, net: least cost up to cutoff between the feet (pid, sid, t) of pairs (i, j) on segments (sid, src, dst, w, oneway,
    reversed), as if segments were split at the feet.

    A way leaves its first segment by one end and comes into its last by one, or stays on one segment. So only the nodes between
    are searched, and each pair meets four combinations of ends."""
    ahead, back = ~(F.col("oneway") & F.col("reversed")), ~F.col("oneway") | F.col("reversed")
    on = feet.join(segments, "sid")
    end = lambda allowed, node, cost: F.when(allowed, F.struct(F.col(node).alias("node"), (cost * F.col("w")).alias("c")))
    inner = lambda *ways: F.explode(F.array_compact(F.array(*ways)))
    rest = 1 - F.col("t")
    leave = cut(on.select(F.col("pid").alias("i"), inner(end(ahead, "dst", rest), end(back, "src", F.col("t"))).alias("e")).select("i", F.col("e.node").alias("origin"), F.col("e.c").alias("out")))
    enter = on.select(F.col("pid").alias("j"), inner(end(ahead, "src", F.col("t")), end(back, "dst", rest)).alias("e")).select("j", F.col("e.node").alias("node"), F.col("e.c").alias("in"))
    starts = pairs.select("i").distinct().join(leave, "i").select(F.col("origin").alias("node")).distinct()
    nodes = shortest(cut(directed(segments.select("src", "dst", "w", "oneway", "reversed"))), starts, cutoff)
    through = pairs.join(leave, "i").join(enter, "j").join(nodes, ["origin", "node"]).select("i", "j", (F.col("out") + F.col("d") + F.col("in")).alias("net"))
    a = on.select(F.col("pid").alias("i"), "sid", F.col("t").alias("ti"), "w", ahead.alias("ahead"), back.alias("back"))
    b = feet.select(F.col("pid").alias("j"), "sid", F.col("t").alias("tj"))
    step = F.col("tj") - F.col("ti")
    same = pairs.join(a, "i").join(b, ["j", "sid"]).filter(((step >= 0) & F.col("ahead")) | ((step <= 0) & F.col("back"))).select("i", "j", (F.abs(step) * F.col("w")).alias("net"))
    return through.unionByName(same).groupBy("i", "j").agg(F.min("net").alias("net")).filter(F.col("net") <= cutoff)


def snapped_minutes(candidates: DataFrame, feet: DataFrame, segments: DataFrame, speed: dict[str, float], limit: dict[str, float], cutoff: float, snap: float, detour: float = 1.35) -> DataFrame:
    """i, j, t, source: travel times of candidate pairs (i, j, stage, dist) whose places have feet (pid, sid, t, dist): by the
    network where the origin snaps within `snap` and the cutoff holds, else straight times a detour within the stage's limit,
    else no row."""
    near = feet.filter(F.col("dist") <= snap).select(F.col("pid").alias("i"))
    net = between_feet(candidates.select("i", "j").join(near, "i", "left_semi"), feet, segments, cutoff)
    j = candidates.join(net, ["i", "j"], "left")
    straight = F.when(F.col("dist") <= S.lookup(F.col("stage"), limit), F.col("dist") * detour / S.lookup(F.col("stage"), speed))
    j = j.withColumn("t", F.coalesce("net", straight)).withColumn("source", F.when(F.col("net").isNotNull(), "network").otherwise("straight"))
    return j.filter("t is not null").select("i", "j", "t", "source")
