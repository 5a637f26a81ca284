"""Evidence from tiered texts: co-occurrence in a window, levels, roll-up, demand, match scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Confidence of an evidence level; fixed values.
CONFIDENCE = {"E1": 1.0, "E2": 0.9, "E3": 0.7, "E4": 0.4, "E5": 0.2, "E0": 0.0}
#: Most terms of a lexicon, which is sent to all tasks.
MOST_TERMS = 100_000


#: Code points of a piece of a text in which windows are cut out; a window is then no further from its piece's start.
PIECE = 2048


def terms_of(lexicon: DataFrame, most: int = MOST_TERMS) -> tuple[DataFrame, int]:
    """One row with all terms as an array, which is sent to all tasks, and the longest term's length. More than `most`
    terms are an error."""
    n, longest = lexicon.agg(F.count(F.lit(1)), F.max(F.length("term"))).first()
    if n > most:
        raise ValueError(f"more than {most} terms")
    return F.broadcast(lexicon.agg(F.collect_list(F.struct("subdim", "kind", "term")).alias("terms"))), longest or 0


def positions(text: Column, word: Column) -> Column:
    """All places of a word, from 1, without overlaps."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)

    def places(ps: Column) -> Column:
        before = S.running_sums(F.transform(F.slice(ps, 1, F.size(ps) - 1), lambda x: F.length(x) + F.length(word)))
        return S.bound(before, lambda at: F.transform(F.sequence(F.lit(1), F.size(ps) - 1), lambda i: F.get(at, i) - F.length(word) + 1))

    return S.bound(pieces, lambda ps: F.when(F.size(ps) > 1, places(ps)).otherwise(F.expr("cast(array() as array<int>)")))


def pieces_of(text: Column, reach: int) -> Column:
    """The text in pieces of PIECE code points, each with `reach` more on both sides."""
    start = lambda k: F.greatest(F.lit(1), k * PIECE + 1 - reach)
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / PIECE).cast("int")), lambda k: F.substring(text, start(k), k * PIECE + PIECE + reach - start(k) + 1))


def window_text(pieces: Column, reach: int, at: Column, length: Column, width: int) -> Column:
    """The text from width before a place to width after the word there, out of pieces_of(text, reach)."""
    k = F.floor((at - 1) / PIECE).cast("int")
    start = F.greatest(F.lit(1), at - width)
    return F.substring(F.get(pieces, k), start - F.greatest(F.lit(1), k * PIECE + 1 - reach) + 1, at - start + length + width)


def _any_word(segment: Column, words: list[str], but: Column | None = None) -> Column:
    out = F.lit(False)
    for w in words:
        hit = F.contains(segment, F.lit(w))
        out = out | (hit if but is None else hit & (but != w))
    return out


def evidence(corpus: DataFrame, lexicon: DataFrame, entity_words: list[str], negations: list[str], window: int = 60, own: int = 20, others: tuple[int, ...] = ()) -> DataFrame:
    """For each entity and sub-dimension of the lexicon: anchors (distinct hits), cooccur, self_hit, words (first six hits);
    cooccur_<width> for each other window, judged in the same scan.

    corpus: entity, text. lexicon: subdim, kind (anchor, self), term. The lexicon is a bounded table of terms. A text is read
    once; all its hits are judged in its row, and only what was found goes on."""
    terms, longest = terms_of(lexicon.filter(F.col("kind").isin("anchor", "self")))
    reach = max(window, own, *others) + longest
    rows = corpus.select("entity", F.lower("text").alias("text")).crossJoin(terms)
    text = F.col("text")

    def judged(t: Column, pieces: Column) -> Column:
        size, anchor = F.length(t["term"]), t["kind"] == "anchor"
        near = lambda p, width, use: S.bound(window_text(pieces, reach, p, size, width), use)
        co = lambda at, width: F.exists(at, lambda p: near(p, width, lambda x: _any_word(x, entity_words, t["term"]) & ~_any_word(x, negations)))
        me = lambda at: F.exists(at, lambda p: near(p, own, lambda x: ~_any_word(x, negations)))
        got = S.bound(positions(text, t["term"]), lambda at: F.struct((anchor & co(at, window)).alias("co"), (~anchor & me(at)).alias("me"), *[(anchor & co(at, w)).alias(f"co_{w}") for w in others]))
        return F.struct(t["subdim"].alias("subdim"), t["kind"].alias("kind"), t["term"].alias("term"), got.alias("got"))

    there = F.filter("terms", lambda t: F.contains(text, t["term"]))
    hits = S.bound(there, lambda ts: F.when(F.size(ts) > 0, S.bound(pieces_of(text, reach), lambda ps: F.transform(ts, lambda t: judged(t, ps)))))
    hits = rows.select("entity", F.explode(hits).alias("h")).select("entity", "h.subdim", "h.kind", "h.term", "h.got.co", "h.got.me", *[f"h.got.co_{w}" for w in others])
    return hits.groupBy("entity", "subdim").agg(
        F.count_distinct(F.when(F.col("kind") == "anchor", F.col("term"))).alias("anchors"),
        F.max("co").alias("cooccur"),
        F.max("me").alias("self_hit"),
        F.array_join(F.slice(F.array_sort(F.collect_set("term")), 1, 6), ", ").alias("words"),
        *[F.max(f"co_{w}").alias(f"cooccur_{w}") for w in others],
    )


def official(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entity and sub-dimension pairs with an honour term in an official text."""
    terms, _ = terms_of(lexicon.filter("kind = 'honor'"))
    found = F.array_distinct(F.transform(F.filter("terms", lambda t: F.contains(F.col("text"), t["term"])), lambda t: t["subdim"]))
    rows = docs.select("entity", F.lower("text").alias("text")).crossJoin(terms)
    return rows.select("entity", F.explode(found).alias("subdim")).distinct().withColumn("honour", F.lit(True))


def levels(found: DataFrame, honours: DataFrame) -> DataFrame:
    """entity, subdim, level, confidence, honour. A self-evident hit counts as a co-occurrence."""
    j = found.join(honours, ["entity", "subdim"], "full")
    no = F.lit(False)
    honour, co = F.coalesce("honour", no), F.coalesce("cooccur", no) | F.coalesce("self_hit", no)
    n = F.coalesce("anchors", F.lit(0))
    level = F.when(honour & co, "E1").when(honour, "E2").when(co, "E3").when(n >= 2, "E4").when(n == 1, "E5").otherwise("E0")
    conf = F.lit(0.0)
    for k, v in CONFIDENCE.items():
        conf = F.when(level == k, v).otherwise(conf)
    return j.select("entity", "subdim", level.alias("level"), conf.alias("confidence"), honour.alias("honour"))


def rollup(levelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """entity, domain (first two letters of the sub-dimension), subdim, confidence, honour: the best one at or above the
    threshold; a tie goes to one with an honour, then to the first."""
    rows = levelled.filter(F.col("confidence") >= threshold).withColumn("domain", F.substring("subdim", 1, 2))
    w = Window.partitionBy("entity", "domain").orderBy(F.desc("confidence"), F.desc("honour"), "subdim")  # a few rows
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k", "level")


def entity_types(rolled: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, domains, type: none, the one domain, double, or several, with the dominant domain."""
    per = rolled.groupBy("entity").agg(F.count(F.lit(1)).alias("domains"), F.min(F.struct(-F.col("confidence"), (~F.col("honour")).alias("h"), "domain"))["domain"].alias("dominant"))
    j = entities.join(per, "entity", "left").withColumn("domains", F.coalesce("domains", F.lit(0)))
    kind = F.when(F.col("domains") == 0, "none").when(F.col("domains") == 1, F.concat(F.lit("single_"), F.col("dominant"))).when(F.col("domains") == 2, "double").otherwise("several")
    return j.select("entity", F.col("domains").cast("long").alias("domains"), "dominant", kind.alias("type"))


def demand(areas: DataFrame, preferences: DataFrame) -> DataFrame:
    """entity, dim, demand: preferences (class, dim, w) weighted by area shares (entity, class, area); the mean
    preference where an entity has no area."""
    mean = preferences.groupBy("dim").agg(F.avg("w").alias("mean"))
    tot = areas.groupBy("entity").agg(F.sum("area").alias("t"))
    got = areas.join(tot, "entity").join(F.broadcast(preferences), "class").groupBy("entity", "dim").agg(F.sum(F.when(F.col("t") > 0, F.col("area") / F.when(F.col("t") > 0, F.col("t")).otherwise(1.0) * F.col("w"))).alias("d"))
    return areas.select("entity").distinct().crossJoin(F.broadcast(mean)).join(got, ["entity", "dim"], "left").select("entity", "dim", F.coalesce("d", "mean").alias("demand"))


def match_scores(rolled: DataFrame, wanted: DataFrame, verified: DataFrame, alpha: float = 0.15) -> DataFrame:
    """entity, score in [0, 1]: sum of confidence times demand, raised by the verified rate, over the largest."""
    s = rolled.join(wanted, (rolled["entity"] == wanted["entity"]) & (rolled["domain"] == wanted["dim"])).groupBy(rolled["entity"]).agg(F.sum(F.col("confidence") * F.col("demand")).alias("s"))
    raw = s.join(verified, "entity", "left").withColumn("raw", F.col("s") * (1 + alpha * F.coalesce("rate", F.lit(0.0))))
    top = raw.agg(F.max("raw").alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("entity", F.when(F.col("top") > 0, F.col("raw") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).otherwise(0.0).alias("score"))


def mismatches(scores: DataFrame) -> DataFrame:
    """scores with mismatch: at most the value at place n div 4 of the sorted scores."""
    from . import stats

    n = scores.count()
    run = stats.running(scores, "score", [])
    cut = run.filter(F.col("cum_n") > n // 4).agg(F.min("score").alias("cut"))
    return scores.crossJoin(F.broadcast(cut)).select("entity", "score", (F.col("score") <= F.col("cut")).alias("mismatch"))


def health(corpus: DataFrame, names: DataFrame, least: int, markers: list[str]) -> DataFrame:
    """One row: rows, blanks, placeholders, names without text, and OK, WARN or FAIL."""
    t = F.coalesce(F.col("text"), F.lit(""))
    a = corpus.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim(t) == "").alias("blank"), F.count_if(_any_word(F.lower(t), markers)).alias("placeholders"))
    m = names.join(corpus.select("entity"), "entity", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    status = F.when(F.col("n_rows") < least, "FAIL").when((F.col("placeholders") > 0) | (F.col("missing") > 0), "WARN").otherwise("OK")
    return a.crossJoin(m).withColumn("status", status)
