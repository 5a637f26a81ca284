"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Cases, for every stage: columns are known by place, so names that clash or differ in case only do no harm (of columns with
the same name the first is meant); null or repeated ids get row numbers inside; an empty table gives an empty one. The
stages' docstrings say what becomes of null texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equimap.llm import block_naming, jaccard_join, language_id, mixing, winnowing
from equimap.llm.common import LEAST_BATCHES, Scratch, numbered, table

#: A document is rejected if its best language scores less than this share of the way from chance to certainty.
ABOVE_CHANCE = 0.1
#: Near duplicates: five words, similarity of 0.8 or more.
NEAR = jaccard_join.Rule(words=5, num=80, den=100)
#: How often mixing may use a document to bring its source closer to an even share.
MOST_USES = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was recognised: those with a letter whose best language scores clearly above chance, which
    is 1 / (languages learned). Null, empty and letterless texts go; each repeated row is judged for itself.

    The texts go to Python workers when the caller writes the rows, so the session's Arrow batches are made smaller here: they
    are held outside the JVM's heap."""
    for k, v in LEAST_BATCHES.items():
        spark.conf.set(k, v)
    base, names = numbered(docs)
    net = language_id.fit(base, names["doc_id"], names["text"], names["lang"])
    found = language_id.predicted(spark, net, F.col(names["text"]))
    chance = 1 / len(net.languages) if net else 1.0
    kept = base.filter((found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= chance + ABOVE_CHANCE * (1 - chance)))
    return kept.toDF(*docs.columns)


def _kept(docs: DataFrame, label: str, decide) -> DataFrame:
    """The rows of docs whose rid decide(base, scratch) returns; base has rid, doc_id, text, source."""
    base, names = numbered(docs)
    scratch = Scratch(docs.sparkSession, label)
    base = block_naming.with_row_ids(base, names["doc_id"], scratch, *[c for c in base.columns if c != names["doc_id"]])
    plain = base.select("rid", F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"), F.col(names["source"]).alias("source"))
    kept = decide(plain, scratch).select("rid")
    return base.join(kept, "rid").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id (of repeated rows any one). Null counts as an empty text."""
    return _kept(docs, "exact", lambda base, sc: block_naming.dedup_groups(base, sc).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least row id, which is the doc_id where those are unique and
    not null. Documents without words are linked with nothing and stay; so do their repeated rows."""
    return _kept(docs, "near", lambda base, sc: jaccard_join.jaccard_components(base, sc, NEAR).filter("rid = comp"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a passage of the benchmark. Null and empty texts stay; repeated rows are judged each."""
    return _kept(docs, "benchmark", lambda base, sc: winnowing.decontaminate(base, table(spark, sf_dir, "benchmark"), sc).filter(F.size("spans") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document: the columns of documents, and n_tokens, weight, pass, block, place (with as many _
    behind them as it takes to differ from all columns of documents).

    The weights are those of a nearly even mix as far as no source has to be used more than MOST_USES times. The budget is the
    least that passes every source once, so every document is used, those without text included. A null source and an empty
    one are the same; repeated rows are used each."""
    base, names = numbered(docs)
    scratch = Scratch(docs.sparkSession, "mix")
    base = block_naming.with_row_ids(base, names["doc_id"], scratch, *[c for c in base.columns if c != names["doc_id"]])
    uses = mixing.mixture(base, scratch, names["source"], names["text"], budget_share=None, most_repeats=MOST_USES)
    found = base.join(uses.drop("source"), "rid")
    taken, out = {c.lower() for c in docs.columns}, []
    for c in ("n_tokens", "weight", "pass", "block", "place"):
        name = c
        while name in taken:
            name += "_"
        out.append((c, name))
    return found.select(*[f"c{i}" for i in range(len(docs.columns))], *[c for c, _ in out]).toDF(*docs.columns, *[n for _, n in out])


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", benchmark),
    ("mixing", mix),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
