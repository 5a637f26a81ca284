"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

An n-gram of up to ORDER bytes is its own exact 64-bit name (its bytes behind a leading one), so no hash can collide.
Counts are summed up within tasks, then by name in the shuffle. Lower orders count the distinct bytes that stand before
an n-gram. Each order has three discounts from its counts of counts, and a count join with the order's contexts and with
the order below gives each n-gram its whole interpolated probability; a context that is known keeps the weight of what
it leaves to the order below.

Scoring joins documents with the counts shard by shard: shards hold the n-grams of three bytes or more by the two bytes
before the last, at most about SHARD_ENTRIES of them; n-grams of one and two bytes (65,792 at most) go with each shard.
A shard is sent to the scan of the documents, which adds up the log probabilities of those bytes that the shard answers;
more shards mean more scans, whose sums are added. So no n-gram of a document is shuffled, and no shard outgrows its
bound except where two bytes alone have more n-grams.

Trusted text: documents with a label of quality 1 and not toxic. One in HELD_OUT of them, by a hash of its row id, doesn't
train the model. Perplexity is the exponential of the mean negative log probability of a document's bytes, A-Z in lower
case; the threshold is a quantile of the perplexities of the held-out trusted documents of its language (of all held-out
ones where it has none; of all trusted ones where none is held out).

Cases: a null or empty text has no bytes: its perplexity is null and it isn't kept. A null language is one of its own, as
is an empty one.
Null or repeated ids get row numbers inside, and each row is judged. Without trusted text all perplexities are null and
every document with text is kept. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow, runs, table, tidied, with_row_ids

ORDER = 5
QUANTILE = 0.99
#: One in so many trusted documents sets the thresholds instead of training the model.
HELD_OUT = 5
SHARD_ENTRIES = 4_000_000
#: Languages whose limits are sent to all tasks; beyond them they are joined.
MOST_LANGUAGES = 10_000
#: Distinct n-grams that a task gathers before it sends them on.
FLUSH = 2_000_000
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def names(data: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length 1 to order, the names of the n-grams that end at each byte of a run of documents; 0 where the
    document has too few bytes before."""
    x = _LOWER[data]
    place = np.arange(len(x)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for k in range(1, order + 1):
        v = np.full(len(x), 1, np.int64)
        for j in range(k - 1, -1, -1):
            v = (v << 8) | (x if j == 0 else np.concatenate((np.zeros(min(j, len(x)), np.int64), x[: max(len(x) - j, 0)])))
        v[place < k - 1] = 0
        out.append(v)
    return out


def counted(docs: DataFrame, order: int) -> DataFrame:
    """g, n: n-grams of `order` bytes, and shorter ones at a document's start, with counts, summed up within tasks."""

    def scan(batches):
        import pyarrow as pa

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            g = np.concatenate([a for a, _ in kept])
            n = np.concatenate([b for _, b in kept])
            key, at = np.unique(g, return_inverse=True)
            return key, np.bincount(at, n).astype(np.int64)

        for batch in batches:
            for _, data, offsets in runs(batch.column(0)):
                every = names(data, offsets, order)
                best = every[0]
                for v in every[1:]:
                    best = np.where(v > 0, v, best)
                g, n = np.unique(best, return_counts=True)
                kept.append((g, n))
                size += len(g)
            if size > FLUSH:
                kept = [merged()]
                size = len(kept[0][0])
                if size > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["g", "n"])
                    kept, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["g", "n"])

    return docs.select("text").mapInArrow(tidied(scan), "g long, n long")


def _longer(g: Column, k: int) -> Column:
    """Whether a name has more than k bytes."""
    return g >= F.lit(1 << (8 * (k + 1)))


def _suffix(g: Column, k: int) -> Column:
    """Name of the last k bytes."""
    return g.bitwiseAND(F.lit((1 << (8 * k)) - 1)).bitwiseOR(F.lit(1 << (8 * k)))


def discounts(df: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more."""
    r = df.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(r[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(x, 0.01), k + 0.99) for k, x in enumerate(d)]


class Model:
    """probs: g, lp (log of the whole probability of each known n-gram); weights: c, lw (log of what a known context
    leaves to the order below). Names tell the lengths apart."""

    def __init__(self, trusted: DataFrame, scratch: Scratch, order: int = ORDER) -> None:
        self.order = order
        raw = scratch.put(counted(trusted, order).groupBy("g").agg(F.sum("n").alias("n")))
        levels = {order: raw.filter(_longer(F.col("g"), order - 1))}
        for k in range(order - 1, 0, -1):
            # continuation counts: distinct bytes before; at a document's start there is none and the count itself stands
            above = levels[k + 1].select(_suffix(F.col("g"), k).alias("g"), F.lit(1).cast("long").alias("n"))
            start = raw.filter(_longer(F.col("g"), k - 1) & ~_longer(F.col("g"), k)) if k < order else raw.limit(0)
            levels[k] = scratch.put(above.unionByName(start).groupBy("g").agg(F.sum("n").alias("n")))
        self.probs = self.weights = None
        below = None
        for k in range(1, order + 1):
            df, d = levels[k], discounts(levels[k])
            own = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            context = F.shiftright("g", 8).alias("c")
            ctx = scratch.put(df.select(context, "n", own.alias("d")).groupBy("c").agg(F.sum("n").alias("s"), F.sum("d").alias("d")))
            rows = df.select("g", context, (F.col("n") - own).alias("a")).join(ctx, "c").withColumn("lower", F.lit(0).cast("long") if k == 1 else _suffix(F.col("g"), k - 1))
            if k == 1:
                p = F.col("a") / F.col("s") + F.col("d") / F.col("s") / 256
            else:
                rows = rows.join(below.withColumnsRenamed({"g": "lower", "p": "q"}), "lower")
                p = F.col("a") / F.col("s") + F.col("d") / F.col("s") * F.col("q")
            below = scratch.put(rows.select("g", p.alias("p")))
            lp, lw = below.select("g", F.log("p").alias("lp")), ctx.select("c", F.log(F.col("d") / F.col("s")).alias("lw"))
            self.probs = lp if self.probs is None else self.probs.unionByName(lp)
            self.weights = lw if self.weights is None else self.weights.unionByName(lw)
        self.probs, self.weights = scratch.put(self.probs), scratch.put(self.weights)
        self.known = not self.probs.isEmpty()

    def shards(self, most: int = SHARD_ENTRIES):
        """Shards in turn; the driver holds one at a time."""
        # both tables by the two bytes before the last: of an n-gram (at least three bytes) and of a context (two)
        g2 = F.when(_longer(F.col("g"), 2), F.shiftright("g", 8).bitwiseAND(F.lit(0xFFFF))).otherwise(-1)
        c2 = F.when(_longer(F.col("c"), 1), F.col("c").bitwiseAND(F.lit(0xFFFF))).otherwise(-1)
        probs, weights = self.probs.withColumn("k", g2), self.weights.withColumn("k", c2)
        sizes = probs.select("k").unionAll(weights.select("k")).filter("k >= 0").groupBy("k").count().orderBy("k").collect()  # 65,536 rows at most
        cuts, size = [0], 0
        for k, n in sizes:
            if size and size + n > most:
                cuts.append(k)
                size = 0
            size += n
        for lo, hi in zip(cuts, [*cuts[1:], 1 << 16], strict=True):
            inside = (F.col("k") < 0) | F.col("k").between(lo, hi - 1)
            tables = []
            for df, key, value in ((probs, "g", "lp"), (weights, "c", "lw")):
                t = df.filter(inside).select(key, value).toArrow()
                a, b = t.column(0).to_numpy(), t.column(1).to_numpy()
                at = np.argsort(a)
                tables.append((a[at], b[at].astype(np.float32)))
            yield lo, hi, *tables


def find(tab: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each key, and whether it is there."""
    names_, values = tab
    if not len(names_):
        return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(names_, keys), len(names_) - 1)
    return values[at], names_[at] == keys


def log_probabilities(every: list[np.ndarray], lo: int, hi: int, probs, weights) -> np.ndarray:
    """Log probability of each byte that the shard answers, else 0."""
    order = len(every)
    out = np.zeros(len(every[0]), np.float64)
    two = (every[2] >> 8) & 0xFFFF if order > 2 else np.zeros(len(out), np.int64)
    # bytes with fewer than two before them are answered by the first shard
    early = every[2] == 0 if order > 2 else np.ones(len(out), bool)
    todo = np.flatnonzero(np.where(early, lo == 0, (two >= lo) & (two < hi)))
    for k in range(order, 0, -1):
        g = every[k - 1][todo]
        lp, hit = find(probs, g)
        hit &= g > 0
        out[todo[hit]] += lp[hit]
        todo, g = todo[~hit], g[~hit]
        if not len(todo):
            break
        lw, known = find(weights, g >> 8)
        known &= g > 0
        out[todo[known]] += lw[known]
    out[todo] += -np.log(256.0)
    return out


def scored(docs: DataFrame, shard, order: int) -> DataFrame:
    """rid, n (bytes), lp: summed log probabilities that one shard answers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(shard)

    def scan(batches):
        import pyarrow as pa

        lo, hi, probs, weights = shared.value
        for batch in batches:
            for i, data, offsets in runs(batch.column(1), 1 << 19):
                lp = log_probabilities(names(data, offsets, order), lo, hi, probs, weights)
                total = np.concatenate(([0.0], np.cumsum(lp)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(offsets) - 1), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]])], names=["rid", "n", "lp"])

    return docs.select("rid", "text").mapInArrow(tidied(scan), "rid long, n long, lp double")


def perplexities(docs: DataFrame, model: Model, scratch: Scratch, most: int = SHARD_ENTRIES) -> DataFrame:
    """rid, n_bytes, perplexity. docs: rid, text."""
    parts = [scratch.put(scored(docs, shard, model.order)) for shard in model.shards(most)]
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("rid").agg(F.max("n").alias("n"), F.sum("lp").alias("lp"))
    return out.select("rid", F.col("n").alias("n_bytes"), F.when(F.col("n") > 0, F.exp(-F.col("lp") / F.col("n"))).alias("perplexity"))


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, held_out: int = HELD_OUT, order: int = ORDER) -> DataFrame:
    """One row for each row of docs: id, n_bytes, perplexity, threshold, kept."""
    base = with_row_ids(narrow(docs, id_col, text, lang), id_col, scratch, text, lang).select("rid", F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    good = narrow(labels, "doc_id", "quality", "toxic").filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id")).distinct()
    held = F.pmod(F.xxhash64("rid", F.lit("held")), F.lit(held_out)) == 0
    # by sorted merge at any size: the labels grow with the documents, so they are never sent to all tasks
    model = Model(base.filter(~held).join(good.hint("merge"), "id", "left_semi").select("text"), scratch, order)
    rows = base.select("rid", "id", "lang")
    if not model.known:
        n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
        return base.select(F.col("id").alias(id_col), n.alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (n > 0).alias("kept"))
    rows = scratch.put(rows.join(perplexities(base.select("rid", "text"), model, scratch), "rid"))
    known = rows.filter("perplexity is not null").join(good, "id", "left_semi").withColumn("held", held)
    at = lambda which: F.percentile_approx(F.when(which, F.col("perplexity")), quantile, 10000)
    limits = known.groupBy(F.col("lang").alias("of")).agg(at(F.col("held")).alias("own"))
    whole = known.agg(F.coalesce(at(F.col("held")), at(F.lit(True))).alias("all"))
    limits = scratch.put(limits)
    small = limits.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    out = rows.join(F.broadcast(limits) if small else limits, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(whole))
    threshold = F.coalesce("own", "all")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_bytes", F.round("perplexity", 6).alias("perplexity"), F.round(threshold, 6).alias("threshold"), kept.alias("kept"))


def op8_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op8"))
