"""The driver's tables in the roles of points, cells, zones, sites, travel times, roads and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial as G

#: Side of a cell; half width of a service area.
SIZE, HALF = 500.0, 1500.0


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double") * 10000
    return e.select("vec_id", at(0).alias("x"), at(1).alias("y"), "label", at(2).alias("v"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold a point, with their centres."""
    p = points(spark, d).select(G.cell(F.col("x"), SIZE).alias("ci0"), G.cell(F.col("y"), SIZE).alias("cj0")).distinct()
    return p.withColumn("x", (F.col("ci0") + 0.5) * SIZE).withColumn("y", (F.col("cj0") + 0.5) * SIZE)


def zones(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle around the mean of each label's points."""
    m = points(spark, d).groupBy("label").agg(F.round(F.avg("x"), 3).alias("mx"), F.round(F.avg("y"), 3).alias("my"))
    return m.select("label", (F.col("mx") - HALF).alias("bx0"), (F.col("my") - HALF).alias("by0"), (F.col("mx") + HALF).alias("bx1"), (F.col("my") + HALF).alias("by1"))


def travel(spark: SparkSession, d: str) -> DataFrame:
    """i (customer's nation), j (supplier), t (minutes)."""
    l, o, c = (read(spark, d, n) for n in ("lineitem", "orders", "customer"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    return j.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("l_suppkey").alias("j")).agg((F.abs(F.avg(days)) / 20).alias("t"))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """node: all nations, which are the nodes of the road graph."""
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))


def roads(spark: SparkSession, d: str) -> DataFrame:
    """src (customer's nation), dst (supplier's nation), w (minutes), oneway, reversed; each fourth nation's roads are
    one-way, and half of those reversed."""
    l, o, c, s = (read(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    e = j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg((F.abs(F.avg(days)) / 20).alias("w"))
    return e.withColumn("oneway", F.pmod("src", F.lit(4)) == 0).withColumn("reversed", F.pmod("src", F.lit(8)) == 0)


POINTS = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10000 AS x, CAST(embedding[2] AS DOUBLE) * 10000 AS y, label, CAST(embedding[3] AS DOUBLE) * 10000 AS v FROM embeddings)"
CELLS = "c AS (SELECT DISTINCT CAST(floor(x / 500) AS BIGINT) AS ci, CAST(floor(y / 500) AS BIGINT) AS cj, (floor(x / 500) + 0.5) * 500 AS cx, (floor(y / 500) + 0.5) * 500 AS cy FROM p)"
ZONES = "z AS (SELECT label, round(avg(x), 3) - 1500 AS bx0, round(avg(y), 3) - 1500 AS by0, round(avg(x), 3) + 1500 AS bx1, round(avg(y), 3) + 1500 AS by1 FROM p GROUP BY label)"
TRAVEL = "od AS (SELECT CAST(c_nationkey AS BIGINT) AS i, l_suppkey AS j, abs(avg(CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE))) / 20 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
#: The directed roads between nations, and shortest distances by squaring their min-plus matrix: 32 steps are more than the
#: 24 that a path between 25 nations has.
ROADS = """e0 AS (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, abs(avg(CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE))) / 20 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
e1 AS (SELECT a, b, w FROM e0 WHERE a % 8 <> 0 UNION ALL SELECT b, a, w FROM e0 WHERE a % 4 <> 0 OR a % 8 = 0), e AS (SELECT a, b, min(w) AS w FROM e1 GROUP BY a, b),
d0 AS (SELECT a, b, min(d) AS d FROM (SELECT a, b, w AS d FROM e UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0.0::DOUBLE FROM nation) GROUP BY a, b), """ + ", ".join(f"d{k + 1} AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON x.b = y.a GROUP BY x.a, y.b)" for k in range(5))
