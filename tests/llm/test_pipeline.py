"""The pipeline's stages against brute force, on awkward rows."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import components, contaminated

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, path):
    rng = np.random.default_rng(5)
    voc = {"en": ["the", "with", "and", "house", "tree", "walk"], "de": ["und", "schoen", "nicht", "haus", "baum", "geht"]}
    items = [(k, " ".join(f"bench{k}x{j}" for j in range(14))) for k in range(3)]
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        w = [voc[lang][k] + str(rng.integers(0, 30)) for k in rng.integers(0, 6, 40)]
        if i % 10 == 3:
            w[5:5] = items[i % 3][1].split()
        rows.append((i, " ".join(w), lang, "hot" if i % 3 else f"s{i % 4}", 0))
    rows += [(200 + k, rows[k][1], rows[k][2], "hot", 0) for k in range(6)]
    rows += [(300 + k, rows[20 + k][1] + " more", rows[20 + k][2], "hot", 0) for k in range(6)]
    rows += [(400, None, "en", None, 0), (401, "", None, "s1", 0), (402, "12 34", "de", "s1", 0), (403, "x " * 5000, None, None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r[0]: r for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            want = {i for i, r in kept.items() if re.search(r"[^\W\d_]", r[1] or "")}
        elif name == "exact_dedup":
            want = {max(j for j in kept if kept[j][1] == t) for t in {r[1] for r in kept.values()}}
        elif name == "ngram_jaccard_join":
            c = components([(i, r[1]) for i, r in kept.items()], corpus_pipeline.NEAR)
            want = {root for _, root in c.values()}
            assert len(want) < len(kept)
        elif name == "benchmark_decontamination":
            want = {i for i, r in kept.items() if contaminated(r[1], items)[1] == 0}
            assert len(want) < len(kept)
        else:
            want = set(kept)
        assert got == want, name
        kept = {i: kept[i] for i in got}
    assert docs.groupBy("doc_id", "pass").count().filter("count > 1").isEmpty()


def test_run_is_the_stages(spark, tmp_path):
    made(spark, tmp_path)
    a = corpus_pipeline.run(spark, str(tmp_path))
    assert a.count() > 0 and {"doc_id", "text", "pass", "weight"} <= set(a.columns)


CLASHING = ["rid", "RID", "keep_id", "score", "lang_pred", "name", "n", "c0", "comp", "weight", "pass", "Block", "n_tokens", "spans", "items", "n_words", "kept", "id"]


def test_clashing_names_and_empty_tables(spark, tmp_path):
    rows, _ = made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    wide = docs.select(*docs.columns, *[F.lit(1).alias(c) for c in CLASHING if c != "RID"])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out, plain = stage(spark, wide, str(tmp_path)), stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/wide{k}")
        back = spark.read.parquet(f"{tmp_path}/wide{k}")
        assert back.columns[: len(wide.columns)] == wide.columns and len({c.lower() for c in back.columns}) == len(back.columns)
        assert sorted(r[0] for r in back.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect()), name
    none = wide.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_columns_that_differ_in_case_only(spark, tmp_path):
    rows, _ = made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(30)
    wide = docs.select(*docs.columns, F.lit("x").alias("TEXT"), F.lit(0).alias("Doc_Id"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns[:7] == wide.columns and out.count() > 0, name


def test_null_and_repeated_rows_in_every_stage(spark, tmp_path):
    """Ids that are null or repeated, null columns, and a very long text."""
    _, items = made(spark, tmp_path)
    long = "the house and the tree " * 40_000
    rows = [(None, "the house with a tree", "en", None, None), (7, "the house with a tree", None, "s", 1), (7, "the house with a tree", None, "s", 1), (8, long, "en", "s", 2), (9, long + "walk", "en", "s", 3), (None, None, None, None, None), (10, "with " + items[0][1], "en", "", 4), (11, "und nicht das haus", "de", "t", 5), (11, "und nicht das haus", "de", "t", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).select(*docs.columns)
        counts[name] = out.count()
        assert counts[name] <= len(rows) or name == "mixing"
        if name == "exact_dedup":
            assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in out.collect()) == [(-1, ""), (7, "the h"), (8, "the h"), (9, "the h"), (10, "with "), (11, "und n")]
        if name == "mixing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {None, 7, 8, 9, 10, 11}
    assert counts["ngram_jaccard_join"] == 5 and counts["benchmark_decontamination"] == 8
