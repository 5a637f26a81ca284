"""Queries of the text and evidence operators. The lexicon is in the language of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from .registry import Registry
from .tables import read

Q = Registry()
LEXICON = [
    ("T1a", "anchor", "tion"), ("T1a", "anchor", "thin"), ("T1a", "self", "thin"), ("T1a", "honor", "the the"),
    ("T2a", "anchor", "ment"), ("T2a", "anchor", "eau"), ("T2a", "self", "eau"), ("T2a", "honor", "est"),
    ("T3a", "anchor", "sch"), ("T3a", "self", "sch"), ("T3a", "honor", "und"), ("T4a", "anchor", "ando"), ("T4a", "self", "ando"),
]
WORDS, NOT = ["the", "les", "der", "los"], ["worthless", "pathetic"]
PREFERENCES = [("en", "T1", 0.45), ("en", "T2", 0.21), ("fr", "T1", 0.1), ("fr", "T2", 0.4), ("de", "T3", 0.5), ("es", "T4", 0.6)]


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "subdim string, kind string, term string")


def _corpus(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("entity"), "text")


def _levels(spark, d):
    return X.levels(X.evidence(_corpus(spark, d), _lexicon(spark), WORDS, NOT), X.official(_corpus(spark, d), _lexicon(spark)))


def _rows(items):
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in items)


_BASE = f"""lex(subdim, kind, term) AS (VALUES {_rows(LEXICON)}), corp AS (SELECT doc_id AS entity, lower(text) AS text FROM documents),
hit0 AS (SELECT entity, subdim, kind, term, text, string_split(text, term) AS ps FROM corp JOIN lex ON contains(text, term) AND kind <> 'honor'),
hit AS (SELECT entity, subdim, kind, term, text, i, CAST(1 + list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(term) AS BIGINT) AS place FROM hit0, LATERAL (SELECT unnest(range(1, len(ps))) AS i)),
seg AS (SELECT *, substr(text, greatest(1, place - 60), place - greatest(1, place - 60) + length(term) + 60) AS wide, substr(text, greatest(1, place - 20), place - greatest(1, place - 20) + length(term) + 20) AS near FROM hit),
ev AS (SELECT entity, subdim, count(DISTINCT term) FILTER (kind = 'anchor') AS anchors,
  coalesce(bool_or(kind = 'anchor' AND ({' OR '.join(f"(contains(wide, '{w}') AND term <> '{w}')" for w in WORDS)}) AND NOT ({' OR '.join(f"contains(wide, '{w}')" for w in NOT)})), false) AS co,
  coalesce(bool_or(kind = 'self' AND NOT ({' OR '.join(f"contains(near, '{w}')" for w in NOT)})), false) AS me FROM seg GROUP BY entity, subdim),
hon AS (SELECT DISTINCT entity, subdim, true AS honour FROM corp JOIN lex ON contains(text, term) AND kind = 'honor'),
lev0 AS (SELECT coalesce(ev.entity, hon.entity) AS entity, coalesce(ev.subdim, hon.subdim) AS subdim, coalesce(honour, false) AS honour, coalesce(co, false) AS co, coalesce(me, false) AS me, coalesce(anchors, 0) AS n FROM ev FULL JOIN hon ON ev.entity = hon.entity AND ev.subdim = hon.subdim),
lev1 AS (SELECT *, CASE WHEN honour AND (co OR me) THEN 'E1' WHEN honour THEN 'E2' WHEN co OR me THEN 'E3' WHEN n >= 2 THEN 'E4' WHEN n = 1 THEN 'E5' ELSE 'E0' END AS level FROM lev0),
lev AS (SELECT entity, subdim, level, CASE level WHEN 'E1' THEN 1.0 WHEN 'E2' THEN 0.9 WHEN 'E3' THEN 0.7 WHEN 'E4' THEN 0.4 WHEN 'E5' THEN 0.2 ELSE 0.0 END::DOUBLE AS confidence, honour FROM lev1),
roll AS (SELECT * FROM (SELECT entity, left(subdim, 2) AS domain, subdim, confidence, honour, row_number() OVER (PARTITION BY entity, left(subdim, 2) ORDER BY confidence DESC, honour DESC, subdim) AS k FROM lev WHERE confidence >= 0.7) WHERE k = 1),
pref(class, dim, w) AS (VALUES {_rows(PREFERENCES)}), mean AS (SELECT dim, avg(w::DOUBLE) AS mean FROM pref GROUP BY dim), area AS (SELECT doc_id AS entity, lang AS class, CAST(n_chars AS DOUBLE) AS area FROM documents),
dem AS (SELECT a.entity, mean.dim, coalesce(pref.w::DOUBLE, mean) AS demand FROM area a CROSS JOIN mean LEFT JOIN pref ON pref.class = a.class AND pref.dim = mean.dim),
ver AS (SELECT doc_id AS entity, CAST(quality AS DOUBLE) AS rate FROM labels),
raw AS (SELECT r.entity, sum(confidence * demand) * (1 + 0.15 * coalesce(max(rate), 0)) AS raw FROM roll r JOIN dem ON r.entity = dem.entity AND r.domain = dem.dim LEFT JOIN ver ON r.entity = ver.entity GROUP BY r.entity),
sco AS (SELECT entity, raw / (SELECT max(raw) FROM raw) AS score FROM raw)"""


@Q(f"WITH {_BASE} SELECT entity, subdim, level, confidence, honour FROM lev")
def evidence_level(spark, d):
    return _levels(spark, d)


@Q(f"WITH {_BASE} SELECT entity, domain, subdim, confidence, honour FROM roll")
def rollup_domain(spark, d):
    return X.rollup(_levels(spark, d)).select("entity", "domain", "subdim", "confidence", "honour")


@Q(f"""WITH {_BASE}, dom AS (SELECT entity, count(*) AS domains, arg_min(domain, (-confidence, NOT honour, domain)) AS dominant FROM roll GROUP BY entity)
SELECT corp.entity, CAST(coalesce(domains, 0) AS BIGINT) AS domains, dominant, CASE coalesce(domains, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'single_' || dominant WHEN 2 THEN 'double' ELSE 'several' END AS type FROM corp LEFT JOIN dom ON corp.entity = dom.entity""")
def entity_type(spark, d):
    return X.entity_types(X.rollup(_levels(spark, d)), _corpus(spark, d).select("entity"))


def _demand(spark, d):
    areas = read(spark, d, "documents").select(F.col("doc_id").alias("entity"), F.col("lang").alias("class"), F.col("n_chars").cast("double").alias("area")).filter("area > 0")
    return X.demand(areas, spark.createDataFrame(PREFERENCES, "class string, dim string, w double"))


@Q(f"WITH {_BASE} SELECT entity, dim, round(demand, 6) AS demand FROM dem")
def demand_vector(spark, d):
    return _demand(spark, d).select("entity", "dim", F.round("demand", 6).alias("demand"))


def _scores(spark, d, alpha=0.15):
    verified = read(spark, d, "labels").select(F.col("doc_id").alias("entity"), F.col("quality").cast("double").alias("rate"))
    return X.match_scores(X.rollup(_levels(spark, d)), _demand(spark, d), verified, alpha)


@Q(f"WITH {_BASE} SELECT entity, round(score, 6) AS score FROM sco")
def match_score(spark, d):
    return _scores(spark, d).select("entity", F.round("score", 6).alias("score"))


@Q(f"WITH {_BASE}, cut AS (SELECT score AS cut FROM (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM sco) WHERE k = n // 4 + 1) SELECT entity, round(score, 6) AS score, score <= cut AS mismatch FROM sco, cut")
def mismatch_q1(spark, d):
    return X.mismatches(_scores(spark, d)).select("entity", F.round("score", 6).alias("score"), "mismatch")


@Q("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (trim(text) = '') AS BIGINT) AS blank, CAST(count(*) FILTER (contains(lower(text), 'lorem') OR contains(lower(text), 'todo')) AS BIGINT) AS placeholders, CAST((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS missing, CASE WHEN count(*) < 99 THEN 'FAIL' ELSE 'WARN' END AS status FROM documents JOIN labels USING (doc_id)")
def health_check(spark, d):
    names = read(spark, d, "documents").select(F.col("doc_id").alias("entity"))
    corpus = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("entity"), "text")
    return X.health(corpus, names, 99, ["lorem", "todo"])


@Q("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(text, ' / ' ORDER BY turn, text) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def corpus_build(spark, d):
    c = read(spark, d, "conversations").filter(F.trim("text") != "")
    per = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("x"))
    return per.select("conv_id", "n", F.array_join(F.transform("x", lambda r: r["t"]), " / ").alias("body"))


@Q(f"WITH {_BASE} SELECT entity, subdim, array_to_string(list_sort(list(DISTINCT term))[1:6], ', ') AS words FROM hit WHERE kind IN ('anchor', 'self') GROUP BY entity, subdim")
def evidence_words(spark, d):
    """The first six hits of each sub-dimension, in order."""
    return X.evidence(_corpus(spark, d), _lexicon(spark), WORDS, NOT).select("entity", "subdim", "words")
