"""Resampling, divergence and token counts against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from equimap.llm import divergence, importance, personal_data, queries, token_counts
from equimap.llm.common import Scratch, with_row_ids

from .test_cases import ROWS, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("awkward"))


# --- 11


def brute_resample(docs, target, longest, buckets, least_words, percent, seed):
    """(id, row, features, weight, score, eligible) and the drawn ones in order."""
    def found(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(found(text)[1])
    for text in target:
        t.update(found(text)[1])
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for row, (i, text) in enumerate(docs):
        n, f = found(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * a / ((s[x] + 1) * b))) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, row, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words))
    eligible = sorted((r for r in out if r[5]), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, eligible[: percent * len(eligible) // 100]


@pytest.mark.parametrize(("longest", "least_words", "percent", "range_rows"), [(1, 3, 30, 10), (3, 1, 100, 7), (2, 0, 50, 10_000), (1, 5, 0, 5)])
def test_resampling(spark, longest, least_words, percent, range_rows):
    rng = random.Random(longest)
    words = ["alpha", "BETA", "Größe", "x" * 300, "42", "ω", "gamma", "delta", "eps"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(i, "alpha beta gamma delta eps alpha") for i in range(300, 420)]  # a third of all rows are copies
    docs += [(1000, None), (1001, "")]
    target = ["alpha beta gamma", None, "Größe gamma " + "x" * 300]
    want, top = brute_resample(docs, target, longest, 97, least_words, percent, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = importance.resampled(with_row_ids(df, "doc_id", Scratch(spark, "t"), "text"), spark.createDataFrame([(t,) for t in target], "text string"), Scratch(spark, "t"), longest, 97, least_words, percent, 5, range_rows).collect()
    rank = {r[0]: n for n, r in enumerate(top, 1)}
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r.rank or 0) for r in got) == sorted((i, f, w, s, rank.get(i, 0)) for i, _, f, w, s, _ in want)


def test_merge_opens_only_what_overlaps():
    rng = np.random.default_rng(3)
    rows = np.zeros(5000, importance.ROW)
    rows["neg"], rows["id"], rows["rid"] = rng.integers(-50, 50, 5000), rng.integers(0, 9, 5000), np.arange(5000)
    keys = ["neg", "lost", "id", "rid"]
    blocks = [np.sort(r, order=keys) for r in np.array_split(rows, 13)]
    blocks = sorted((b for r in blocks for b in np.array_split(r, 9)), key=lambda b: tuple(b[0])[:4])
    got = np.concatenate(list(importance.merged(iter(blocks))))
    assert (got == np.sort(rows, order=keys)).all()
    tree = importance.Tournament()
    apart = [np.sort(rows, order=keys)[i : i + 50] for i in range(0, 5000, 50)]
    seen, importance.Tournament = importance.Tournament, lambda: tree
    try:
        assert len(np.concatenate(list(importance.merged(iter(apart))))) == 5000
    finally:
        importance.Tournament = seen
    assert tree.size <= 2  # of a hundred blocks that don't overlap


def test_resampling_of_awkward_rows(spark, awkward):
    docs = [(i, t) for i, t, *_ in ROWS]
    target = ["one two three four five six seven eight nine ten eleven", "bench one", None, ""]
    want, top = brute_resample(docs, target, 1, 10_000, 20, 10, 2024)
    got = queries.QUERIES["op11_importance_resample"](spark, awkward).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, f, w, s) for i, _, f, w, s, _ in want)
    assert sum(r["rank"] is not None for r in got) == len(top)


# --- 12


def brute_divergence(docs, least_docs, top):
    df, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        w = TERM.findall(lower(text))
        df[lang or ""].update(set(w))
        n[lang or "", source or ""].update(w)
    out = []
    for lang in df:
        kept = sorted(t for t, c in df[lang].items() if c >= least_docs)
        sources = sorted(s for x, s in n if x == lang)
        shares = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least_docs", "top", "tile", "first"), [(1, 3, 2, 1), (4, 50, 256, 4), (9, 2, 3, 1), (10_000, 5, 2, 1)])
def test_divergence(spark, least_docs, top, tile, first):
    rng = random.Random(least_docs)
    words = [f"{a}{b}" for a in "abcdefghé" for b in "XyzÄ"]
    docs = []
    for _ in range(400):
        s = rng.choice(["s0", "s0", "s1", "s2", "s3", "s4", "", None])
        lean = words[: 9 + 4 * int((s or "s0")[1:])]
        docs.append((" 1".join(rng.choices(lean, k=rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), s))
    docs += [("", "xx", "only"), (None, "yy", "a"), ("..", "yy", "b"), ("hot " * 500, "en", "s1")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    got = divergence.divergence(df, Scratch(spark, "t"), least_docs, top, tile, first).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute_divergence(docs, least_docs, top)


def test_divergence_stops_early(spark, monkeypatch):
    """Buckets behind the bound are never evaluated, ties at the edge are."""
    rows = [("en", "s", 0, 1, f"t{i}", 1 << (i % 20), 10**6 * (i % 20 + 1), 10**3) for i in range(400)]
    posts = spark.createDataFrame(rows, "lang string, source string, no int, zero long, term string, n long, p long, q long")
    seen = []
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, *a: (seen.append(df.columns), put(self, df, *a))[1])
    got = divergence.top_terms(posts, Scratch(spark, "t"), 30, 1).collect()
    want = sorted(((-(p - q), t) for *_, t, _, p, q in rows))[:30]
    assert [(r.item, r.value) for r in sorted(got, key=lambda r: r["rank"])] == [(t, -v) for v, t in want]
    assert sum("item" in c for c in seen) == 2  # rounds of 1 and 2 of the twenty buckets


def test_divergence_of_awkward_rows(spark, awkward):
    got = queries.QUERIES["op12_source_divergence"](spark, awkward).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute_divergence([(t, lang, s) for _, t, lang, s, _ in ROWS], 30, 50)


# --- 13


@pytest.fixture(scope="module")
def model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path(token_counts.MODEL)
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture(scope="module")
def transducer(model):
    return token_counts.Transducer(token_counts.Vocabulary.read(model[0]))


def counts(transducer, texts, **k):
    raw = [t.encode() for t in texts]
    return transducer.counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), **k).tolist()


TEXTS = ["", " ", "Hello world", "  a  b\n\nc\t", "</s>[INST] <unk> <s> <0x0A> x", "你好 😀 é́", "\x00a▁b▁▁", "a" * 5000, " " * 3000, "ab" * 4000, "=-" * 3000 + "é" * 999, "aaaa" * 9000 + "b", "1234567" * 99]


@pytest.mark.parametrize(("chunk", "warm"), [(256, 48), (40, 2), (64, 16), (10_000, 48)])
def test_token_counts_are_the_library_s(model, transducer, chunk, warm):
    rng = random.Random(chunk)
    pieces = list(transducer.scores)
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 300))) for _ in range(40)]
    texts += ["".join(rng.choices(abc, k=rng.randint(1, 3000))) for abc in ("einrst=", " =-/*#_", "abcdeinrst", "0 \n\t", "▁ a") for _ in range(8)]
    assert counts(transducer, texts, chunk=chunk, warm=warm) == [len(x) for x in model[1].encode(texts)]


def test_states_outside_a_map_are_added(model, transducer, monkeypatch):
    """Where the characters before a chunk mislead, its real state is put into the map and the scan repeated."""
    texts = ["".join(random.Random(i).choices("einrst", k=4000)) for i in range(5)]
    read, wrong = transducer.read, []

    def misled(cls, begin, size, state):
        to, n = read(cls, begin, size, state)
        if len(size) and len(set(size.tolist())) == transducer.longest and not wrong:
            wrong.append(True)
            to = np.full_like(to, transducer.start)
        return to, n

    monkeypatch.setattr(transducer, "read", misled)
    assert counts(transducer, texts, chunk=80, warm=8) == [len(x) for x in model[1].encode(texts)]
    assert wrong


def test_forgotten_states(model, monkeypatch):
    fresh = token_counts.Transducer(token_counts.Vocabulary.read(model[0]))
    monkeypatch.setattr(token_counts, "MOST_STATES", 20)
    for t in TEXTS[2:7] * 2:
        assert counts(fresh, [t, t]) == [len(model[1].encode(t))] * 2


def test_vocabularies_that_do_not_fit(tmp_path):
    with pytest.raises(ValueError, match="no pieces"):
        token_counts.Vocabulary({"▁": -1.0, "ab": -2.0, "a": -3.0})


def test_token_counts_of_awkward_rows(spark, awkward, model):
    got = queries.QUERIES["op13_token_counts"](spark, awkward).collect()
    want = Counter((i, len((t or "").encode()), len(model[1].encode(t or "")), len(model[1].encode(t or "")) > 4096) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_token_counts_of_a_table(spark, model):
    got = queries.QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts) and all(r.n_tokens == len(model[1].encode(texts[r.doc_id])) for r in got)
    assert spark.createDataFrame([("a b", 1)], "text string, text_ long").select(token_counts.token_counts(spark, F.col("text"), model[0])).first()[0] == 2


# --- 5 and 1, on labelled findings


def planted_spans():
    """(id, text, added): texts with the span that the method should add (start, end), or none."""
    rng = random.Random(9)
    word = lambda: rng.choice(["house", "garden", "letter", "winter", "paper", "river", "music"])
    some = lambda k: " ".join(word() for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for i in range(600):
        kind = i % 12
        head, body, tail = some(4) + " ", "", " " + some(3)
        if kind < 3:  # plain ones, from which the labelers' worth is learned
            head, body = [("mail me at ", f"{word()}.{digits(2)}@{word()}.com"), ("call ", f"+49 {digits(3)} {digits(6)}"), ("server ", f"{rng.randint(11, 99)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}.7")][kind]
        elif kind < 5:
            head, body = f"{some(2)} contact ", rng.choice([f"{word()} [at] {word()}.org", f"{word()}(at){word()} (dot) com", f"{word()}.{digits(2)} (at) {word()}.de"])
        elif kind < 7:
            head, body = f"{some(2)} phone ", rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        elif kind < 8:
            head, body = "order ", f"{digits(3)}-{digits(3)}-{digits(4)}"
        elif kind < 9:
            head, body = "part ", f"+{digits(1)} {digits(2)}"
        elif kind < 10:
            head, body = "invoice ", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"
        added = (len(some_text := head), len(some_text) + len(body)) if 3 <= kind < 7 else None
        out.append((i, head + body + tail, added))
    return out


def test_added_spans_of_a_labelled_fixture(spark):
    """Obfuscated addresses and phones without a plus are added; order and part numbers and failed matches aren't."""
    rows = planted_spans()
    found = personal_data.personal_data(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), Scratch(spark, "t")).collect()
    added = {(r.doc_id, s.s, s.e) for r in found for s in r.spans if not s.base}
    wanted = {(i, *a) for i, _, a in rows if a}
    precision, recall = len(added & wanted) / max(1, len(added)), len(added & wanted) / len(wanted)
    print(f"precision {precision:.3f}, recall {recall:.3f} of {len(wanted)}")
    assert precision > 0.95 and recall > 0.6


def test_keys_of_a_shape_that_was_never_trained(spark):
    """The tables' keys, whose shape no made finding has, and nothing else."""
    path = "/root/testdata/sf0.01"
    planted = re.compile(r'(?i)token = "([0-9a-f]{40})"')
    want = Counter((r.doc_id, hashlib.sha256(m[1].encode()).hexdigest()) for r in spark.read.parquet(f"{path}/documents.parquet").collect() for m in planted.finditer(r.text or ""))
    got = queries.QUERIES["op1_secret_scan"](spark, path).filter("is_secret").collect()
    assert want and Counter((r.doc_id, r.secret_sha256) for r in got) == want
