"""Every query on awkward tables: nulls in any column, repeated rows, ties, very long texts, clashing names, empty tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from equimap.llm import block_naming, mixing, queries
from equimap.llm.common import Scratch

from .test_operators import base_spans, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the house under their tree " * 30_000
ROWS = [
    (None, "the house with that tree", "en", "a", 1), (None, "the house with that tree", "en", "a", 1), (1, "the house with that tree", None, None, None),
    (2, None, None, None, None), (3, "", "en", "", 0), (4, LONG, "en", "a", 1), (5, LONG + "end", "en", "a", 1), (6, "und nicht werden", "de", "b", 1),
    (6, "und nicht werden", "de", "b", 1), (7, "12 34", "de", "b", 1), (8, 'token = "0f0f0fa81b29c7d3e4f50617283940a5b6c7d8e9" a@b.com', "en", "b", 1),
    (9, "The House With That Tree", "en", "c", 1), (10, "bench one two three four five six seven eight nine ten", "en", "c", 1),
]
#: Names that operators use inside.
CLASHING = ["rid", "id", "n", "h", "name", "level", "keep", "kept", "comp", "key", "s", "cands", "spans", "hits", "lp", "held", "of", "place", "block", "weight", "score", "lang_pred", "t", "turns"]


def written(spark, path, empty=False):
    """All tables; columns with clashing names, some in other letters than their own."""
    tables = {
        "documents": spark.createDataFrame(ROWS, DOCS),
        "benchmark": spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, "bench one"), (2, None), (2, "")], "item_id long, text string"),
        "labels": spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 1, 0), (None, 1, 0), (7, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://A.com/en/1", "<article>x</article>"), (None, None, None), (1, "http://A.com/en/1", "<article>x</article>"), (2, "x", "")], "page_id long, url string, html string"),
        "conversations": spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, "</s>"), (2, 0, "assistant", "y" * 200_000)], "conv_id long, turn long, role string, text string"),
    }
    for name, df in tables.items():
        extra = [c for c in CLASHING if c not in {x.lower() for x in df.columns}]
        df = df.select(*df.columns, *[F.lit(1).alias(c.upper() if i % 2 else c) for i, c in enumerate(extra)])
        (df.limit(0) if empty else df.repartition(3)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("awkward"))


def rows(spark, name, path):
    return queries.QUERIES[name](spark, path).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, name, tmp_path):
    got = rows(spark, name, written(spark, tmp_path, empty=True))
    assert len(got) == (1 if name == "op4_chat_format" else 0)  # that one adds a conversation of its own


def test_exact_dedup(spark, awkward):
    texts = [(i, t or "") for i, t, *_ in ROWS]
    keep = {t: max((j for j, u in texts if u == t and j is not None), default=None) for _, t in texts}
    got = rows(spark, "op2_exact_dedup", awkward)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, keep[t], sum(u == t for _, u in texts), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert sum(r.kept for r in got) == len(keep) and {r.doc_id for r in got if r.kept and r.group_size == 3} == {1}


def test_blocks_of_their_real_size(spark):
    """Texts that differ in one byte of one of many blocks, at the production block size."""
    base = "".join(chr(97 + i * i % 26) for i in range(70 * block_naming.BLOCK_BYTES + 7))
    texts = [(0, base), (1, base), (2, base[:-1]), (3, "X" + base[1:]), (4, base[:-1] + "X"), (5, base[: 35 * 2048] + "X" + base[35 * 2048 + 1 :]), (6, base + base)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in block_naming.exact_dedup(df, Scratch(spark, "t")).collect()}
    assert got == {0: (1, 2), 1: (1, 2), **{i: (i, 1) for i in range(2, 7)}}


def test_jaccard_join(spark, awkward):
    known = [(i, t) for i, t, *_ in ROWS if i is not None]
    want = components(list(dict(known).items()), queries.jaccard_join.Rule())
    got = rows(spark, "op3_jaccard_join", awkward)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert (r.n_shingles, r.component_id) == (3, 1)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_chat_format(spark, awkward):
    got = {r.conv_id: r for r in rows(spark, "op4_chat_format", awkward)}
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars) for k, r in got.items()} == {
        1: (3, sha(("user", "hi"), ("assistant", ""), ("assistant", "")), 0),
        None: (1, sha(("", "</s>")), 0),
        2: (1, sha(("assistant", "y" * 200_000)), 200_000),
        -7: (2, sha(("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")), 21),
    }


def test_personal_data(spark, awkward):
    got = rows(spark, "op5_personal_data", awkward)
    assert Counter((r.doc_id, r.n_email) for r in got) == Counter((i, sum(x.startswith("email") for x in base_spans(t))) for i, t, *_ in ROWS)


def test_temperature_mix(spark, awkward):
    got = rows(spark, "op6_temperature_mix", awkward)
    tokens = {(i, s or ""): len((t or "").split()) for i, t, _, s, _ in ROWS}
    assert all(tokens[r.doc_id, r.source] == r.n_tokens for r in got)
    assert {r.source for r in got} >= {"a"} and max(Counter((r["pass"], r.block, r.place) for r in got).values()) == 1


def test_decontaminate(spark, awkward):
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows(spark, "op7_decontaminate", awkward))
    want = Counter((i, len((t or "").split()), 0, 0, False) for i, t, *_ in ROWS if i not in (8, 10))
    assert got - Counter({k: v for k, v in got.items() if k[0] == 8}) == want + Counter([(10, 11, 11, 2, True)])


def test_quality(spark, awkward):
    got = rows(spark, "op8_quality_perplexity", awkward)
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t, *_ in ROWS)
    assert all((r.perplexity is None) == (r.n_bytes == 0) and (r.n_bytes > 0 or not r.kept) for r in got)


def test_language_id(spark, awkward):
    got = rows(spark, "op10_language_id", awkward)
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (2, 3, 7)} == {"und"}
    assert all(r.held_out for r in got if r.doc_id is None) and all(0 <= r.score <= 1 for r in got)


def test_secret_scan(spark, awkward):
    got = rows(spark, "op1_secret_scan", awkward)
    assert [(r.doc_id, r.start, r.end) for r in got if r.is_secret] == [(8, 9, 49)]


def test_block_permutations_against_plain_loops(spark):
    """Which documents the partial pass takes, and in which order, with many blocks in many slots."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 3 == 1, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 2).cast("string"))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"))
    got = mixing.mixture(df, Scratch(spark, "t"), block_docs=5, target_entropy=0.95)
    got = {(r.rid, r["pass"]) for r in got.collect()}
    docs: dict[str, dict[int, int]] = {}
    for r in df.collect():
        docs.setdefault(r.source, {})[r.rid] = len(r.text.split())
    tokens = {s: sum(d.values()) for s, d in docs.items()}
    want = set()
    for source, _, whole, rest, blocks in mixing.plan(tokens, {s: len(d) for s, d in docs.items()}, float(sum(tokens.values())), 0.95, mixing.MOST_REPEATS, 5):
        want |= {(i, p) for i in docs[source] for p in range(1, whole + 1)}
        ids = spark.createDataFrame([(i, whole + 1) for i in docs[source]], "rid long, pass long")
        at = ids.withColumn("block", F.pmod(F.xxhash64(F.lit(mixing.SEED), "pass", "rid"), F.lit(blocks).cast("long"))).withColumn("place", F.xxhash64(F.lit(mixing.SEED + 1), "pass", "rid")).withColumn("h", F.xxhash64(F.lit(mixing.SEED + 2), "block"))
        left = rest
        per: dict[tuple, list] = {}
        for r in at.collect():
            per.setdefault((r.h, r.block), []).append((r.place, r.rid))
        for block in sorted(per):
            if left <= 0:
                break
            total = sum(docs[source][i] for _, i in per[block])
            used = 0
            for _, i in sorted(per[block]):
                used += docs[source][i]
                if total <= left or used <= left:
                    want.add((i, whole + 1))
            left -= total
    assert got == want
