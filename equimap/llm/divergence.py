"""Source divergence audit: which sources of a language differ, and in which terms.

Terms are runs of letters, A-Z lower-cased. A language keeps the terms that at least `least_docs` of its documents hold. Each
group (language, source) and each language gives every kept term a smoothed share in whole parts of SCALE; all arithmetic is
exact. A term's divergence in a group is the distance of the group's share and another one.

* Terms (part `term`: the group's share above the language's, the highest `top`): a group's terms are put into buckets by their
  count there. The bucket's highest share less the least share that the language gives one of its terms is a bound for all of
  them. Buckets are evaluated best first, some more in each round for all groups that aren't finished; a group is finished once
  the bounds of its unseen buckets are strictly below its value at rank `top`.
* Pairs (part `pair`: the sum of distances over all kept terms): a source gives all terms that it lacks the same share, so
  only postings matter. What a source's postings add against another's share of a lacking term follows from the histogram of
  its shares; terms that both hold are corrected for from the terms' postings, packed by tiles of sources, into matrices
  that a task adds up. So the work grows with postings, and rows are made for pairs of sources only.

Texts are counted inside tasks first: a task sends a term of a group once for each FLUSH entries at most.

Cases: null texts, languages and sources count as ''. Groups without terms, and languages without kept terms, have their pairs
(value 0 in the latter) and no term rows. Ties are in the order of the item's bytes. Repeated rows are documents of their own.
An empty table gives no rows. Other columns aren't read. A language of more than MOST_SOURCES sources raises an error, since
its pairs alone would be more than 10 billion rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, table, tidied

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Buckets for each doubling of the count; buckets of a group in the first round, doubled each time.
FINENESS = 8
FIRST_BUCKETS = 4
#: Sources of a tile; matrices that a task holds at once; entries that a task counts before it sends them.
TILE = 256
MATRICES = 32
FLUSH = 300_000
MOST_SOURCES = 100_000

#: Bytes that aren't letters become spaces, A-Z become lower case.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d: a term's occurrences and documents by group, as counted in tasks; a null term for each group."""

    def scan(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed():
            for (lang, source), (n, d) in found.items():
                size = len(n) + 1
                same = [pa.array([x] * size, pa.string()) for x in (lang, source)]
                term = pa.array([None, *n], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*same, term, pa.array([0, *n.values()], pa.int64()), pa.array([0, *[d[t] for t in n]], pa.int64())], names=["lang", "source", "term", "n", "d"])
            found.clear()

        held = 0
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_LETTERS).split()
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                d.update(set(words))
                held += len(n) - before
                if held > FLUSH:
                    yield from flushed()
                    held = 0
        yield from flushed()

    return docs.mapInArrow(tidied(scan), "lang string, source string, term string, n long, d long")


def share(n: str, total: str, terms: str, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * terms)); null without terms."""
    above = f"cast({SCALE} as decimal(10, 0)) * cast({n} + {smoothing} as decimal(20, 0))"
    return F.expr(f"case when {terms} > 0 then 1 + ({above}) div cast({total} + {smoothing} * {terms} as decimal(20, 0)) end")


def profiles(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, no, v, zero: the share of a term that the group lacks) and their postings (lang, source, no, zero,
    term, n, p: the group's share, q: the language's)."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text"))
    each = scratch.put(counted(plain).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    terms = each.filter("term is not null")
    kept = scratch.put(terms.groupBy("lang", "term").agg(F.sum("n").alias("m"), F.sum("d").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"))
    held = scratch.put(terms.drop("d").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("m").alias("of_lang"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
    groups = each.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "of_lang", "of_group"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = scratch.put(groups.withColumn("zero", share("0", "of_group", "v")))
    if not groups.filter(F.col("no") >= MOST_SOURCES).isEmpty():
        raise ValueError(f"more than {MOST_SOURCES} sources of a language")
    posts = held.join(groups, ["lang", "source"]).select("lang", "source", "no", "zero", "term", "n", share("n", "of_group", "v").alias("p"), share("m", "of_lang", "v").alias("q"))
    return groups, scratch.put(posts)


def top_terms(posts: DataFrame, scratch: Scratch, top: int = TOP, first_buckets: int = FIRST_BUCKETS) -> DataFrame:
    """lang, source, item, value, rank: the terms whose share in the group is above the language's, by the difference."""
    group = ["lang", "source"]
    posts = posts.withColumn("bucket", F.floor(F.log2(F.col("n")) * FINENESS).cast("int"))
    bounds = posts.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound")).filter("bound > 0")
    bounds = scratch.put(bounds.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket"))))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    best, live, done, more = None, None, 0, first_buckets
    while True:
        picked = bounds.filter((F.col("turn") > done) & (F.col("turn") <= done + more))
        picked = picked if live is None else picked.join(live, group, "left_semi")
        now = posts.join(picked.select(*group, "bucket"), [*group, "bucket"], "left_semi").filter("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        now = now if best is None else best.drop("rank").unionByName(now)
        best = scratch.put(now.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
        done, more = done + more, 2 * more
        kth = best.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        unseen = bounds.filter(F.col("turn") > done).groupBy(*group).agg(F.max("bound").alias("bound"))
        live = scratch.put(unseen.join(kth, group, "left").filter("kth is null or bound >= kth").select(*group))
        if live.isEmpty():
            return best


def corrections(posts: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), value: what the terms that both hold change in their distance."""
    posts = posts.withColumn("tile", F.expr(f"no div {tile}"))
    packs = scratch.put(posts.groupBy("lang", "term", "tile").agg(F.collect_list(F.struct((F.col("no") % tile).alias("at"), "p", "zero")).alias("x")))
    columns = lambda side, x: [F.col(f"tile_{side}"), *[F.col(f"{x}.{c}").alias(f"{c}_{side}") for c in ("at", "p", "zero")]]
    left, right = (packs.select("lang", "term", F.col("tile").alias(f"tile_{s}"), F.col("x").alias(f"x_{s}")) for s in "ab")
    met = left.join(right, ["lang", "term"]).filter("tile_a <= tile_b").select("lang", *columns("a", "x_a"), *columns("b", "x_b"))

    def scan(batches):
        held: dict[tuple[str, int, int], np.ndarray] = {}

        def flushed():
            for (lang, i, j), m in held.items():
                a, b = np.nonzero(m)
                value, a, b = m[a, b], a + i * tile, b + j * tile
                ok = a < b
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(ok.sum()), pa.string()), *[pa.array(x[ok].astype(np.int64)) for x in (a, b, value)]], names=["lang", "a", "b", "value"])
            held.clear()

        for batch in batches:
            lang, i, j = (batch.column(c).to_pylist() for c in ("lang", "tile_a", "tile_b"))
            lists = {}
            for c in ("at", "p", "zero"):
                for s in "ab":
                    column = batch.column(f"{c}_{s}")
                    lists[c + s] = column.flatten().to_numpy().astype(np.int64), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
            for r in range(batch.num_rows):
                get = lambda c: lists[c][0][lists[c][1][r] : lists[c][1][r + 1]]  # noqa: B023, E731
                if (lang[r], i[r], j[r]) not in held:
                    if len(held) == MATRICES:
                        yield from flushed()
                    held[lang[r], i[r], j[r]] = np.zeros((tile, tile), np.int64)
                pa_, za, pb, zb = get("pa")[:, None], get("zeroa")[:, None], get("pb"), get("zerob")
                change = np.abs(pa_ - pb)
                change -= np.abs(pa_ - zb)
                change -= np.abs(za - pb)
                change += np.abs(za - zb)
                held[lang[r], i[r], j[r]][get("ata")[:, None], get("atb")] += change
        yield from flushed()

    return met.mapInArrow(tidied(scan), "lang string, a long, b long, value long")


def lacking(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: two rows for each pair, which add up to its distance if no term were in both."""
    hist = posts.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("lang", "no").agg(F.collect_list("p").alias("p"), F.collect_list("k").alias("k"))
    others = groups.groupBy("lang").agg(F.collect_list("no").alias("others"), F.collect_list("zero").alias("zeros"))
    rows = groups.select("lang", "no", "v", "zero").join(hist, ["lang", "no"], "left").join(others, "lang")
    rows = rows.select("lang", "no", "v", F.coalesce("zero", F.lit(0)).alias("zero"), F.coalesce("p", F.expr("cast(array() as array<bigint>)")).alias("p"), F.coalesce("k", F.expr("cast(array() as array<bigint>)")).alias("k"), "others", "zeros")

    def scan(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                lang, no, v, zero = (batch.column(i)[r].as_py() for i in range(4))
                p, k, others, zeros = (np.array(batch.column(i)[r].as_py(), np.int64) for i in range(4, 8))
                z = zeros if len(zeros) == len(others) else np.zeros(len(others), np.int64)
                order = np.argsort(p)
                p, k = p[order], k[order]
                below_n, below_sum = np.append(0, np.cumsum(k)), np.append(0, np.cumsum(k * p))
                at = np.searchsorted(p, z)
                n, total = below_n[-1], below_sum[-1]
                apart = (total - below_sum[at]) - (n - below_n[at]) * z + below_n[at] * z - below_sum[at]
                value = apart - n * np.abs(zero - z) + np.where(no < others, v * np.abs(zero - z), 0)
                ok = others != no
                a, b = np.minimum(no, others)[ok], np.maximum(no, others)[ok]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), *[pa.array(x) for x in (a, b, value[ok])]], names=["lang", "a", "b", "value"])

    return rows.mapInArrow(tidied(scan), "lang string, a long, b long, value long")


def pair_distances(groups: DataFrame, posts: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """lang, source, item, value, rank: the distance of each source to each other one of its language."""
    sums = lacking(groups, posts).unionByName(corrections(posts, scratch, tile)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = sums.select("lang", "value", ways.alias("w")).select("lang", "w.x", "w.y", "value")
    names = lambda no, source: groups.select("lang", F.col("no").cast("long").alias(no), F.col("source").alias(source))
    found = both.join(names("x", "source"), ["lang", "x"]).join(names("y", "item"), ["lang", "y"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, top: int = TOP, tile: int = TILE, first_buckets: int = FIRST_BUCKETS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    groups, posts = profiles(docs, scratch, least_docs)
    pairs = pair_distances(groups, posts, scratch, tile).withColumn("part", F.lit("pair"))
    terms = top_terms(posts, scratch, top, first_buckets).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(narrow(table(spark, sf_dir, "documents"), "text", "lang", "source"), Scratch(spark, "op12"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     occ AS (SELECT lang, source, i, term, count(*) AS n FROM (SELECT lang, source, i, unnest(w) AS term FROM d) GROUP BY ALL),
     kept AS (SELECT lang, term, sum(n) AS m FROM occ GROUP BY ALL HAVING count(*) >= 30),
     langs AS (SELECT lang, sum(m) AS total, count(*) AS v FROM kept GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     gc AS (SELECT lang, source, term, sum(n) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
     gt AS (SELECT lang, source, sum(n) AS total FROM gc GROUP BY ALL),
     p AS (SELECT g.lang, g.source, kept.term, coalesce(gc.n, 0) AS n,
                  1 + 1000000000::HUGEINT * (coalesce(gc.n, 0) + 5) // (coalesce(gt.total, 0) + 5 * v) AS p, 1 + 1000000000::HUGEINT * (m + 5) // (langs.total + 5 * v) AS q
           FROM g JOIN kept ON g.lang = kept.lang JOIN langs ON g.lang = langs.lang
                LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = kept.term),
     far AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
     terms AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 50
"""
