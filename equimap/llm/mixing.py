"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and the results are normalised. The exponent is bisected: it is
lowered from 1 until the weights reach a target entropy, or until a source would be repeated more often than allowed.
The weights of a budget are then realised as block permutations: each pass over a source has its own permutation, made
of blocks of about BLOCK_DOCS documents in hashed order. Whole passes take all documents; the last, partial one takes
whole blocks in order up to the budget, and of the block on the edge the documents that still fit. So only sums of
blocks are put in order, never all documents of a source.

A source's realised tokens fall short of its budget by less than one document (and by the rounding of doubles, a part in
10^9 of a pass). Tokens are words between white space;
another column can be named instead.

Cases: a null source and an empty one are the same source. A null text has no tokens and is in each whole pass. A source
without tokens has weight 0 and one whole pass. Repeated rows are documents of their own. An empty table gives an empty
result. More than MOST_SOURCES sources raise an error, since their totals are held on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, table, with_row_ids

TARGET_ENTROPY = 0.9999  # of the largest that the number of sources allows: a nearly even mix
MOST_REPEATS = 4.0
BLOCK_DOCS = 1000
MOST_SOURCES = 1_000_000
#: Sources whose plans are sent to all tasks; those of more sources are joined, a source's rows dealt to SALTS parts.
SENT_SOURCES, SALTS = 10_000, 16
#: A quota this close to a whole number of passes, as a share, is that number: doubles are no closer for large sources.
SLACK = 1e-9
#: Bits of a block's hash that are put in order first.
SLOT_BITS = 12
SEED = 17


def weights(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    top = max(tokens.values(), default=0)
    raw = {k: (n / top) ** alpha if n else 0.0 for k, n in tokens.items()}
    total = sum(raw.values()) or 1.0
    return {k: v / total for k, v in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def exponent(tokens: dict[str, int], budget: float | None, target_entropy: float = TARGET_ENTROPY, most_repeats: float = MOST_REPEATS, rounds: int = 60) -> float:
    """The largest exponent up to 1 whose weights reach the entropy, or the least that keeps to the repeats."""
    live = {k: n for k, n in tokens.items() if n}
    if len(live) < 2:
        return 1.0
    goal = target_entropy * math.log(len(live))

    def enough(a: float) -> bool:
        return entropy(weights(live, a)) >= goal

    def too_often(a: float) -> bool:
        w = weights(live, a)
        b = cover(live, w) if budget is None else budget
        return max(w[k] * b / n for k, n in live.items()) > most_repeats

    def least(holds) -> float:
        """Bisects for the largest exponent of [0, 1] where holds is true; it is true below some point."""
        if holds(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    return min(1.0, max(least(enough), least(too_often) if too_often(0.0) else 0.0))


def cover(tokens: dict[str, int], w: dict[str, float]) -> float:
    """The least budget at which every source is passed once."""
    return max((n / w[k] for k, n in tokens.items() if n), default=0.0)


def plan(tokens: dict[str, int], docs: dict[str, int], budget: float | None, target_entropy: float, most_repeats: float, block_docs: int) -> list[tuple]:
    """source, weight, whole passes, tokens of the partial pass, blocks."""
    a = exponent(tokens, budget, target_entropy, most_repeats)
    w = weights(tokens, a)
    b = cover(tokens, w) if budget is None else budget
    out = []
    for k, n in sorted(tokens.items()):
        passes = w[k] * b / n if n else 1.0
        whole = round(passes)
        if abs(passes - whole) > SLACK * max(1, whole):
            whole = int(passes)
        if budget is None:
            whole = max(1, whole)
        rest = min(n - 1, int((passes - whole) * n)) if n and passes > whole * (1 + SLACK) else 0
        out.append((k, w[k], whole, rest, max(1, docs[k] // block_docs)))
    return out


def planned(rows: DataFrame, plan_df: DataFrame, sources: int) -> DataFrame:
    """rows with their source's plan. A source may hold most rows, so where plans aren't sent its rows are split."""
    if sources <= SENT_SOURCES:
        return rows.join(F.broadcast(plan_df), "source")
    salted = plan_df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"]).drop("salt")


def mixture(
    base: DataFrame,
    scratch: Scratch,
    source: str = "source",
    text: str = "text",
    budget_share: float | None = 1.0,
    target_entropy: float = TARGET_ENTROPY,
    most_repeats: float = MOST_REPEATS,
    block_docs: int = BLOCK_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """rid, source, n_tokens, weight, pass, block, place: one row for each time a document is used; (pass, block rank by
    hash, place) is its order. base has a unique rid. budget_share: the budget as a share of all tokens; None: the least
    that passes every source once."""
    spark = base.sparkSession
    rows = scratch.put(base.select("rid", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens")))
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = {r["source"]: r["t"] for r in totals}
    budget = None if budget_share is None else budget_share * sum(tokens.values())
    plans = plan(tokens, {r["source"]: r["d"] for r in totals}, budget, target_entropy, most_repeats, block_docs)
    plan_df = spark.createDataFrame(plans, "source string, weight double, whole long, rest long, blocks long")
    use = planned(rows, plan_df, len(plans))
    full = use.filter("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))))
    hashed = lambda df: df.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "pass", "rid"), F.col("blocks"))).withColumn("place", F.xxhash64(F.lit(seed + 1), "pass", "rid"))
    full = hashed(full).select("rid", "source", "n_tokens", "weight", "pass", "block", "place")
    part = scratch.put(hashed(use.filter("rest > 0").withColumn("pass", F.col("whole") + 1)))
    sums = part.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    # blocks in hashed order: by the hash's first bits, whose sums are carried on, so that no task sees all blocks of a source
    sums = scratch.put(sums.withColumn("h", F.xxhash64(F.lit(seed + 2), "block")).withColumn("slot", F.shiftright("h", 64 - SLOT_BITS)))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = sums.groupBy("source", "slot").agg(F.sum("t").alias("ts"))
    slots = slots.select("source", "slot", ahead(Window.partitionBy("source").orderBy("slot"), "ts").alias("carried"))
    inner = Window.partitionBy("source", "slot").orderBy("h", "block")
    ranked = sums.join(slots, ["source", "slot"]).withColumn("before", F.col("carried") + ahead(inner, "t"))
    open_ = scratch.put(ranked.filter("before < rest").select("source", "block", "before", (F.col("before") + F.col("t") <= F.col("rest")).alias("fits")))
    near = part.join(open_, ["source", "block"])
    inside = near.filter("fits")
    edge = near.filter("not fits").withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("place", "rid").rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["rid", "source", "n_tokens", "weight", "pass", "block", "place"]
    return full.unionByName(inside.select(*cols)).unionByName(edge.filter("upto <= rest").select(*cols))


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    base = with_row_ids(narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "doc_id", scratch, "text", "source")
    out = mixture(base.select("rid", "text", "source"), scratch)
    return out.join(base.select("rid", "doc_id"), "rid").select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "pass", "block", "place")
