"""Each operator against a brute-force version, and its defined edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from equimap.llm import block_naming, chat_format, jaccard_join, kneser_ney, language_id, mixing, personal_data, secret_scan, url_filter, winnowing
from equimap.llm.common import Scratch, with_row_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def made(n, seed=0, size=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = out[int(rng.integers(0, len(out)))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                if w:
                    w[int(rng.integers(0, len(w)))] = f"w{rng.integers(0, 500)}"
        else:
            w = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(1, size)))]
        out.append((i, " ".join(w)))
    return out


# --- 2


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.octet_length(b).cast("long") % 2])
def test_exact_dedup(spark, route):
    """Also where different blocks share a route, so that only their bytes tell them apart."""
    texts = [(1, "a" * 10), (2, "a" * 10), (3, None), (4, ""), (5, "ab" * 5), (6, "a" * 9), (None, "zz"), (8, "zz"), (8, "zz"), (9, "é" * 7), (10, "a" * 11)]
    got = block_naming.exact_dedup(docs(spark, texts), Scratch(spark, "t"), block_bytes=2, route=route).collect()
    norm = [(i, t or "") for i, t in texts]
    assert len(got) == len(texts)
    keep = {}
    for i, t in norm:
        if i is not None:
            keep[t] = max(keep.get(t, i), i)
    want = Counter((i, keep[t], sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len({t for _, t in norm})


def test_block_names_are_places_on_every_cluster(spark):
    texts = [(i, "x" * (i % 7) + str(i % 40) * (i % 5)) for i in range(120)]
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = docs(spark, texts).repartition(int(parts)).withColumn("rid", F.col("doc_id"))
        got = block_naming.identities(rows, Scratch(spark, "t"), block_bytes=2).collect()
        seen.append({r.rid: (r.level, r["name"]) for r in got})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(set(seen[0].values())) == len({t for _, t in texts})
    h = spark.range(5000).select(F.xxhash64("id").alias("h"))
    order = sorted((r.h % 2**64, r["name"]) for r in block_naming._named(h, ["h"]).collect())
    assert [n for _, n in order] == list(range(5000))


def test_exact_dedup_empty(spark):
    assert block_naming.exact_dedup(docs(spark, []), Scratch(spark, "t")).count() == 0


# --- 3


def components(rows, rule):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + rule.words]) for j in range(max(1, len(w) - rule.words + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("rule", [jaccard_join.Rule(), jaccard_join.Rule(5, 80, 100), jaccard_join.Rule(2, 60, 100)])
def test_jaccard_join(spark, rule):
    rows = [*made(150, rule.words), (900, None), (901, ""), (902, "One"), (903, "one"), (904, "one two"), (905, "x " * 3000), (906, "x " * 3001)]
    d = with_row_ids(docs(spark, rows).repartition(3), "doc_id", Scratch(spark, "t"), "text")
    sc = Scratch(spark, "t")
    d = sc.put(d)
    got = jaccard_join.with_component_ids(d, jaccard_join.jaccard_components(d, sc, rule), "doc_id", sc).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows, rule)


def test_jaccard_join_odd_ids(spark):
    d = docs(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "q r s t")])
    sc = Scratch(spark, "t")
    base = with_row_ids(d, "doc_id", sc, "text")
    got = jaccard_join.with_component_ids(base, jaccard_join.jaccard_components(base, sc), "doc_id", sc).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, 5), (5, 5), (5, 5), (7, 7)])
    e = with_row_ids(docs(spark, []), "doc_id", sc, "text")
    assert jaccard_join.jaccard_components(e, sc).count() == 0


def test_tiles_lose_no_pair():
    """The later rounds' test of bitmaps passes every linked pair."""
    rng = np.random.default_rng(1)
    rule = jaccard_join.Rule(3, 80, 100)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = []
    for _ in range(30):
        s = base.copy()
        s[rng.integers(0, 200, int(rng.integers(0, 40)))] = rng.integers(0, 1 << 63)
        sets.append(np.unique(s)[: int(rng.integers(150, 201))])
    maps = [jaccard_join.bitmap(s, jaccard_join.bits_for(len(s), rule)).tobytes() for s in sets]
    a, b = jaccard_join.passing(np.array([len(s) for s in sets]), np.arange(30), maps, rule, None)
    seen = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    for i in range(30):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in seen


# --- 4


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "[", "<s", "plain\n", None, "[ROLE]x<s>", "<" + "\\" * 3 + "/s>"]
    rows = [(1, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(texts)] + [(2, 0, "user", "hi"), (None, 1, "assistant", "a"), (None, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat_format.digests(chat_format.examples(df)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = chat_format.examples(df.filter("conv_id = 1")).collect()
    assert all(r.formatted.count("</s>") == r.formatted.count("<s>[ROLE]") for r in one)
    assert chat_format.digests(chat_format.examples(df.limit(0))).count() == 0


# --- 5

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum((x * 2 - 9 * (x > 4)) if k % 2 else x for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [
        None, "", "a@b.com_x@c.de é@q.fr x@y", "1.2.3.4.5.6.7.8 999.1.1.1 01.2.3.4", "4111 1111 1111 1111 5 4111-1111-1111-1111 4111111111111112",
        "call +1 (555) 555-5555 now +33 1 23 45 67 89. + 1 +12 +1234567", "1 2 3 " * 40, "9" * 5000, "x" * 20000 + "@a.b", "1 " * 8000, "user [at] site [dot] com",
        "é a@b.de 1.1.1.1 b@c.com +1 555 555 5555 " * 200,
    ]
    texts += ["".join("ab.@+- 0123456789()é"[i] for i in rng.integers(0, 20, 400)) for _ in range(60)]
    rows = [*enumerate(texts), (None, "a@b.com"), (3, texts[3]), (3, texts[3])]
    d = docs(spark, rows)
    d.select(*d.columns, *[F.lit(1).alias(c) for c in ("cands", "_t", "spans", "n_email", "_b_ip")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = personal_data.op5_personal_data(spark, str(tmp_path)).collect()
    want = Counter((i, *[sum(x.startswith(k) for x in base_spans(t)) for k in personal_data.KINDS], hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows)
    assert Counter(tuple(r[:6]) for r in got) == want
    for r in got:  # what is added stands among the base spans, in the same order
        spans = [tuple(int(v) if v.isdigit() else personal_data.KINDS.index(v) for v in x.split(":")) for x in r.spans.split(",") if x]
        assert spans == sorted(spans) and len(spans) >= sum(r[1:5])
    assert personal_data.personal_data(d.limit(0), Scratch(spark, "t")).count() == 0


def test_personal_data_in_a_table_of_numbers(spark):
    """A megabyte of short matches, and many wide matches beside many base spans, in seconds."""
    began = time.time()
    d = docs(spark, [(1, "123," * 250_000), (2, "10.2.3.4 555-123-4567, " * 20_000)])
    got = {r.doc_id: r.n for r in personal_data.candidates(d).select("doc_id", F.size("cands").alias("n")).collect()}
    assert got == {1: 0, 2: 40_000} and time.time() - began < 90


def test_wide_matches_never_touch_base_spans(spark):
    texts = ["a@b.com (at) x.de", "call 555-123-4567 or +1 555-123-4567 now", "1.2.3.4 (555) 123-4567 x", "4111 1111 1111 1111 555-123-4567"]
    for r in personal_data.candidates(docs(spark, list(enumerate(texts)))).collect():
        base = [(c.s, c.e) for c in r.cands if c.base]
        wide = [(c.s, c.e) for c in r.cands if c.f_test == 0]
        assert not any(a < e and s < b for a, b in base for s, e in wide)
    assert any(c.f_test == 0 for c in r.cands)


def test_added_spans_follow_the_classifier(spark):
    """EM, classifier and choice again, in plain numpy."""
    rng = np.random.default_rng(8)
    texts = []
    for i in range(400):
        kind = i % 5
        n = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
        span = [f"u{i} [at] site{i} [dot] com", f"({n(3)}) {n(3)}-{n(4)}", f"{n(16)}", f"+{n(3)} {n(3)} {n(20)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}"][kind]
        texts.append((i, f"{['mail me', 'phone', 'card', 'serial', 'ip'][kind]} {span} end"))
    d = docs(spark, texts)
    cands = personal_data.candidates(d.select("doc_id", "text")).collect()
    cells = Counter(tuple(c[x] for x in ("kind", *personal_data.VOTES, *personal_data.FEATURES)) for r in cands for c in r.cands)
    keys = sorted(cells)
    n = np.array([cells[k] for k in keys], float)
    kinds, votes, forms = np.array([k[0] for k in keys]), np.array([k[1:5] for k in keys]), np.array([k[5:] for k in keys])
    post = np.clip(0.5 + 0.2 * votes.sum(1), 0.05, 0.95)
    for _ in range(personal_data.ROUNDS):
        new = post.copy()
        for k in set(kinds):
            own = kinds == k
            yes, no = 1 + (n * post)[own].sum(), 1 + (n * (1 - post))[own].sum()
            odds = np.full(own.sum(), math.log(yes / no))
            for v in range(4):
                for x in (-1, 1):
                    at = votes[own][:, v] == x
                    a = 1.1 + x + (n * post)[own][at].sum()
                    b = 1.1 - x + (n * (1 - post))[own][at].sum()
                    odds[at] += math.log(a / (yes + 2.3)) - math.log(b / (no + 2.3))
            new[own] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        post = new

    def score(c):
        own = kinds == c.kind
        yes, no = 1 + (n * post)[own].sum(), 1 + (n * (1 - post))[own].sum()
        odds = math.log(yes / no)
        for j, f in enumerate(personal_data.FEATURES):
            at = own & (forms[:, j] == c[f])
            odds += math.log((0.5 + (n * post)[at].sum()) / (yes + 4)) - math.log((0.5 + (n * (1 - post))[at].sum()) / (no + 4))
        return 1 / (1 + math.exp(-odds))

    want = {r.doc_id: [(c.kind, c.s, c.e) for c in r.cands if c.base or score(c) > personal_data.THRESHOLD] for r in cands}
    got = {r.doc_id: [(c.kind, c.s, c.e) for c in r.spans] for r in personal_data.personal_data(d, Scratch(spark, "t")).collect()}
    assert got == want
    assert any(len(want[r.doc_id]) > sum(c.base for c in r.cands) for r in cands) and any(len(want[r.doc_id]) < len(r.cands) for r in cands)


def test_reliabilities_find_the_better_labeler():
    cells = [{"kind": 0, "n": n, "v_form": a, "v_list": b, "v_words": 0, "v_edge": a} for a, b, n in ((1, 1, 40), (1, -1, 35), (-1, 1, 30), (-1, -1, 45))]
    post, rates = personal_data.reliabilities(cells)
    assert post[0] > 0.9 and post[3] < 0.1 and post[1] > post[2]
    assert rates[0, "v_form", 1][0] > rates[0, "v_list", 1][0]


# --- 7


def contaminated(t, items, n=10):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit, got = split(t), set(), set()
    for i, x in items:
        v = split(x)
        k = min(n, len(v))
        windows = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
        for a in range(len(w) - k + 1):
            if k and tuple(w[a : a + k]) in windows:
                hit |= set(range(a, a + k))
                got.add(str(i))
    return len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()


@pytest.mark.parametrize("broadcast_windows", [10**6, 3])
def test_decontaminate(spark, broadcast_windows):
    rng = np.random.default_rng(4)
    pick = lambda n: " ".join(WORDS[i] for i in rng.integers(0, 3, n))
    items = [(k, pick(int(rng.integers(0, 40)))) for k in range(12)] + [(50, "Short item"), (51, None), (52, "same " * 12), (9, "dup id of nine words is here now then so")]
    texts = [(i, f"{pick(15)} {items[i % 16][1] or ''} {pick(12)}") for i in range(40)] + [(90, None), (91, "same " * 30), (92, "SHORT, item!"), (93, ""), (94, (items[3][1] + " é ") * 200)]
    d = with_row_ids(docs(spark, texts), "doc_id", Scratch(spark, "t"), "text")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.decontaminate(d, b, Scratch(spark, "t"), broadcast_windows=broadcast_windows)
    got = found.select("rid", "n_words", *winnowing.digest(found)).collect()
    assert {r.rid: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == {i: contaminated(t, items) for i, t in texts}
    for r in found.collect():  # in order, apart from each other, inside the text
        flat = [x for s in r.spans for x in (s.start, s.end)]
        assert flat == sorted(set(flat)) and all(0 <= x <= r.n_words for x in flat) and r["items"] == sorted(r["items"])
    assert winnowing.decontaminate(d, b.limit(0), Scratch(spark, "t")).filter("size(spans) > 0").count() == 0
    assert winnowing.decontaminate(d.limit(0), b, Scratch(spark, "t")).count() == 0


def test_decontaminate_a_word_repeated_very_often(spark):
    """An item and a document of one word: the cost is not the product of their lengths."""
    d = with_row_ids(docs(spark, [(1, "same " * 200_000), (2, "other " * 50)]), "doc_id", Scratch(spark, "t"), "text")
    b = spark.createDataFrame([(k, "same " * (300 + k)) for k in range(5)], "item_id long, text string")
    found = winnowing.decontaminate(d, b, Scratch(spark, "t"))
    assert {r.rid: (r.n_words, r.n_hit, r.n_items) for r in found.select("rid", "n_words", *winnowing.digest(found)).collect()} == {1: (200_000, 200_000, 5), 2: (50, 0, 0)}


# --- 9


def test_cascade_of_a_small_list_over_many_keys(spark):
    """Each level is bounded by the list, not by the universe."""
    universe = spark.range(300_000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 6000 == 0).alias("listed"))
    cascade = url_filter.Cascade(universe, Scratch(spark, "t"), 1000)
    sizes = [bits for _, bits, _ in cascade.levels]
    assert sizes[0] < 50 * 25 and all(b <= a for a, b in zip(sizes, sizes[1:]))
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).isEmpty()
    with pytest.raises(ValueError, match="level 0 has 50 keys"):
        url_filter.Cascade(universe, Scratch(spark, "t"), 20)


@pytest.mark.parametrize("shard_bits", [10**8, 200])
def test_cascade_is_exact(spark, shard_bits):
    pages = spark.createDataFrame([(i, f"http://h{i % 700}.Example.com/en/{i}") for i in range(900)] + [(1000, None), (1001, "nothing"), (1002, "x://")], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example.com",) for i in range(0, 700, 3)] + [(None,), ("elsewhere.org",), ("h0.example.com",)], "key string")
    got = url_filter.judged(pages, listed, Scratch(spark, "t"), shard_bits=shard_bits, most_shards=3).collect()
    assert len(got) == 903
    for r in got:
        assert r.in_list == (r.page_id < 900 and (r.page_id % 700) % 3 == 0), r
    none = url_filter.judged(pages, listed.limit(0), Scratch(spark, "t"))
    assert none.filter("in_list").count() == 0
    assert url_filter.url_filter(pages.limit(0), listed, Scratch(spark, "t")).count() == 0


def test_listed_hosts(spark):
    html = lambda x: f"<html><article>{x}</article></html>"
    rows = [("http://a.x/1", html("one")), ("http://b.x/1", html("one")), ("http://b.x/2", html("two")), ("http://b.x/3", html("three")), ("http://b.x/4", html("four")), ("http://c.x/1", html("own")), ("http://c.x/2", html("own")), ("http://w.spam-farm.x/1", None), ("http://d.x/", html("")), ("http://e.x/", html("")), (None, html("one")), ("http://A.x/2", None)]
    got = {r.key for r in url_filter.listed_hosts(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"a.x", "w.spam-farm.x", ""}


def test_url_filter_cases(spark, tmp_path):
    """Null ids, repeated rows, clashing names, an empty table, and a very long url."""
    rows = [(None, "http://A.spam-farm.com/x"), (1, "http://ok.com/en/" + "y" * 300_000), (1, "http://ok.com/de/?q#f"), (1, "http://ok.com/de/?q#f"), (2, None), (3, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("z").alias(c) for c in ("html", "host", "key", "in_list", "listed", "rule", "URL2", "shard")])
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.host, r.path[:5], r.rule, r.verdict) for r in url_filter.op9_url_filter(spark, str(tmp_path)).collect())
    assert got == Counter([(None, "a.spam-farm.com", "/x", None, "block"), (1, "ok.com", "/en/y", "com/en/", "block"), (1, "ok.com", "/de/", None, "allow"), (1, "ok.com", "/de/", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow")])
    pages.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/pages.parquet")
    assert url_filter.op9_url_filter(spark, f"{tmp_path}/empty").count() == 0


def test_rules(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "http://x.example.com/en/70?q", "http://example.net/de/9", "http://q.example.net/de/8", "http://xcom/en/", "HTTP://A.ORG/es/#f", "http://org/es/", None]
    want = ["com/en/", "example.com/en/7", "example.com/en/7", "net/de/", "example.net/de/8", None, "org/es/", "org/es/", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.url_filter(df, spark.createDataFrame([], "key string"), Scratch(spark, "t")).collect()
    assert [r.rule for r in sorted(got, key=lambda r: r.page_id)] == want


def test_verdicts_of_rules(spark):
    """Each rule's word is the contract's, and a rule goes before the list."""
    want = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://b.example.com/en/71", "example.com/en/7", "allow"), ("http://a.net/de/1", "net/de/", "allow"),
        ("http://w.listed.net/de/2", "net/de/", "allow"), ("http://b.example.net/de/81", "example.net/de/8", "block"), ("http://a.org/es/", "org/es/", "block"),
        ("http://w.listed.net/en/", None, "block"), ("http://a.net/en/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string")
    got = url_filter.url_filter(df, spark.createDataFrame([("w.listed.net",)], "key string"), Scratch(spark, "t")).collect()
    assert [(r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == [w[1:] for w in want]


# --- 10


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, label = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    mask = np.ones((5, 4))
    mask[3:, 1] = 0

    def loss():
        p = net.probabilities(x)
        return float(-(np.log(p[:, np.arange(4), label]) * mask).sum() / mask.sum())

    got = net.gradients(x, mask, label)
    for name in ("uf", "ucb", "v", "b", "wxf"):
        at = np.unravel_index(int(np.abs(got[name]).argmax()), got[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - got[name][at]) < 2e-3 * max(1, abs(got[name][at]))


def test_no_language_is_left_out(spark):
    rows = [(i, f"word{i} text", f"l{i % 201:03}") for i in range(201 * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.fit(d, per_language=1, epochs=1)
    net = language_id.fit(d.filter("lang <> 'l200'"), per_language=1, epochs=1)
    assert net.languages == [f"l{k:03}" for k in range(200)]


def test_language_id(spark):
    rng = np.random.default_rng(6)
    voc = {"en": ["the", "with", "and", "house"], "de": ["und", "schön", "nicht", "Haus"], "fr": ["été", "les", "où", "maison"]}
    texts, langs = [], {}
    for i in range(240):
        langs[i] = list(voc)[i % 3]
        texts.append((i, " ".join(voc[langs[i]][k] for k in rng.integers(0, 4, 40))))
    more = [(900, None), (901, ""), (902, "123 !!"), (903, "the " * 20000)]
    d = docs(spark, texts + more, {**langs, 900: "en", 901: "en", 902: None})
    net = language_id.fit(d, epochs=4)
    judged = lambda d, net: d.select("doc_id", language_id.held_out("doc_id").alias("held_out"), language_id.predicted(spark, net, F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")
    out = {r.doc_id: r for r in judged(d, net).collect()}
    held = [i for i in range(240) if out[i].held_out]
    assert held and np.mean([out[i].lang_pred == langs[i] for i in held]) > 0.95
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in out.values())
    none = judged(d, language_id.fit(d.limit(0)))
    assert none.filter("lang_pred <> 'und'").count() == 0


# --- 6


@pytest.mark.parametrize("size", [1e3, 1e9, 1e11, 1e13])
def test_plan_loses_no_pass(size):
    """Whatever the sources' sizes: with the budget that passes each once, each has a whole pass; quotas add up to a budget."""
    rng = np.random.default_rng(int(size) % 97)
    for _ in range(300):
        skew = rng.integers(1, 5)
        tokens = {f"s{i}": int(size * rng.random() ** skew) + 1 for i in range(20)}
        docs = dict.fromkeys(tokens, 100)
        for budget in (None, float(sum(tokens.values()))):
            a = mixing.exponent(tokens, budget)
            w = mixing.weights(tokens, a)
            want = mixing.cover(tokens, w) if budget is None else budget
            for k, _, whole, rest, _ in mixing.plan(tokens, docs, budget, mixing.TARGET_ENTROPY, mixing.MOST_REPEATS, 10):
                assert 0 <= rest < tokens[k] and (budget or whole >= 1)
                assert abs(whole * tokens[k] + rest - w[k] * want) <= 1 + 2e-9 * w[k] * want


@pytest.mark.parametrize("share", [1.0, None])
def test_mixing_really_bisects(spark, share):
    """On the test tables, in the query's form and the pipeline's: an exponent below 1, a partial pass and a repeat."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id as rid", "text", "source")
    counted = rows.selectExpr("coalesce(source, '') as s", r"regexp_count(coalesce(text, ''), '\\S+') as n").groupBy("s").sum("n").collect()
    tokens = {r[0]: r[1] for r in counted}
    budget = None if share is None else float(sum(tokens.values()))
    a = mixing.exponent(tokens, budget)
    assert 0 < a < 1
    assert abs(mixing.entropy(mixing.weights(tokens, a)) - mixing.TARGET_ENTROPY * math.log(len(tokens))) < 1e-9
    passes = defaultdict(set)
    for r in mixing.mixture(rows, Scratch(spark, "t"), budget_share=share).collect():
        passes[r.source, r["pass"]].add(r.rid)
    whole = Counter(s for s, p in passes if p == 1 and len(passes[s, 1]) == rows.filter(F.coalesce("source", F.lit("")) == s).count())
    assert any(p == 2 and passes[s, 1] and len(passes[s, 2]) < len(passes[s, 1]) for s, p in passes)  # a repeat, and partial
    assert share == 1.0 or len(whole) == len(tokens)


def test_plans_that_are_joined(spark, monkeypatch):
    base = spark.range(400).selectExpr("id as rid", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "repeat('w ', cast(id % 9 as int)) as text")
    want = sorted(map(tuple, mixing.mixture(base, Scratch(spark, "t"), block_docs=9).collect()))
    monkeypatch.setattr(mixing, "SENT_SOURCES", 2)
    assert sorted(map(tuple, mixing.mixture(base, Scratch(spark, "t"), block_docs=9).collect())) == want


def test_exponent():
    tokens = {"a": 1000, "b": 100, "c": 10}
    a = mixing.exponent(tokens, None, 0.8, 100.0)
    w = mixing.weights(tokens, a)
    assert abs(mixing.entropy(w) - 0.8 * math.log(3)) < 1e-6
    a = mixing.exponent(tokens, 1110.0, 0.99, 3.0)
    w = mixing.weights(tokens, a)
    assert abs(max(w[k] * 1110 / n for k, n in tokens.items()) - 3) < 1e-6


def test_mixture(spark):
    rng = np.random.default_rng(8)
    texts = [(i, "w " * int(rng.integers(1, 30))) for i in range(600)] + [(700, None), (701, "")]
    sources = {i: "hot" if i % 3 else f"s{i % 5}" for i, _ in texts} | {700: None}
    base = with_row_ids(docs(spark, texts, None, sources), "doc_id", Scratch(spark, "t"), "text", "source")
    tokens, largest = defaultdict(int), 30
    for i, t in texts:
        tokens[sources[i] or ""] += len((t or "").split())
    for share in (1.0, None):
        rows = mixing.mixture(base, Scratch(spark, "t"), budget_share=share, block_docs=20).collect()
        w = mixing.weights(tokens, mixing.exponent(tokens, None if share is None else sum(tokens.values()) * share))
        budget = mixing.cover(tokens, w) if share is None else sum(tokens.values()) * share
        used = defaultdict(int)
        for r in rows:
            used[r.source] += r.n_tokens
        for k, n in tokens.items():
            if n:
                assert w[k] * budget - largest - 1 <= used[k] <= w[k] * budget + 1, k
        assert len({(r.rid, r["pass"]) for r in rows}) == len(rows)
        if share is None:
            assert {r.rid for r in rows} == {i for i, _ in texts}
    assert mixing.mixture(base.limit(0), Scratch(spark, "t")).count() == 0


# --- 8


def brute_probabilities(texts, order):
    """Interpolated modified Kneser-Ney from dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = t.lower().encode()
        for i in range(len(b)):
            k = min(order, i + 1)
            grams[k][b[i + 1 - k : i + 1]] += 1
    levels = {order: Counter({g: n for g, n in grams[order].items()})}
    for k in range(order - 1, 0, -1):
        c = Counter()
        for g in levels[k + 1]:
            c[g[1:]] += 1
        for g, n in grams[k].items():
            c[g] += n
        levels[k] = c
    disc = {}
    for k, c in levels.items():
        n = [sum(v == j for v in c.values()) for j in range(5)]
        if not n[1] or not n[2]:
            disc[k] = [0.5, 0.75, 0.9]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
            disc[k] = [min(max(x, 0.01), j + 0.99) for j, x in enumerate(d)]
    followers = {k: defaultdict(dict) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            followers[k][g[:-1]][g] = n

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        here = followers[k].get(g[:-1])
        if not here:
            return p(g[1:])
        s = sum(here.values())
        left = sum(disc[k][min(n, 3) - 1] for n in here.values()) / s
        own = here.get(g, 0)
        return (own - disc[k][min(own, 3) - 1] if own else 0) / s + left * p(g[1:])

    return p


@pytest.mark.parametrize("most", [10**6, 15])
def test_kneser_ney(spark, most):
    rng = np.random.default_rng(9)
    texts = [" ".join(WORDS[i] for i in rng.integers(0, 10, int(rng.integers(1, 12)))) for _ in range(25)]
    other = [*texts[:3], "Qq zz!", "é alpha", "a", ""]
    model = kneser_ney.Model(docs(spark, list(enumerate(texts))).select("text"), Scratch(spark, "t"), order=4)
    d = docs(spark, list(enumerate(other))).withColumnRenamed("doc_id", "rid")
    got = {r.rid: r.perplexity for r in kneser_ney.perplexities(d, model, Scratch(spark, "t"), most).collect()}
    p = brute_probabilities(texts, 4)
    for i, t in enumerate(other):
        b = t.lower().encode()
        if not b:
            assert got[i] is None
            continue
        lp = sum(math.log(p(b[max(0, j - 3) : j + 1])) for j in range(len(b)))
        assert abs(got[i] - math.exp(-lp / len(b))) < 1e-3 * got[i], t


def test_quality(spark, tmp_path):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(WORDS[k] for k in rng.integers(0, 10, 30))) for i in range(200)] + [(500, "%% ## 00 !! ~~ ^^ 99 || {{ }} " * 4), (501, None), (502, ""), (None, "alpha beta gamma delta"), (503, "alpha beta " * 30_000), (7, WORDS[0]), (7, WORDS[0])]
    texts = [(i, t) for i, t in texts if i != 7] + [(7, "alpha beta gamma"), (7, "alpha beta gamma")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(500, 0, 0), (None, 1, 0), (3, 1, 0), (160, 1, 1)], "doc_id long, quality int, toxic int")
    langs = {i: (None, "", "de", "en")[i % 4] if i % 4 != 2 or i < 40 else "de" for i in range(200)}
    d = docs(spark, texts, langs).select("*", *[F.lit("x").alias(c) for c in ("rid", "own", "all", "of", "perplexity", "n", "id")])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumns({c: F.lit(1) for c in ("id", "rid", "lang")}).write.parquet(f"{tmp_path}/labels.parquet")
    base = Scratch(spark, "t").put(with_row_ids(d.select("doc_id", "text", "lang"), "doc_id", Scratch(spark, "t"), "text", "lang"))
    got = kneser_ney.quality(base.select("doc_id", "text", "lang"), labels, Scratch(spark, "t"), order=4).collect()
    assert len(got) == len(texts) and sum(r.doc_id == 7 for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[501].perplexity is None and not by[501].kept and not by[502].kept and not by[500].kept and by[503].n_bytes == 330_000
    # every row is kept by its own threshold, and thresholds are those of held-out trusted rows of the language
    for r in got:
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.threshold)
    whole = [r.threshold for r in got]
    assert len({(langs.get(r.doc_id, "en"), r.threshold) for r in got}) <= 4 and all(x is not None for x in whole)
    assert kneser_ney.op8_quality_perplexity(spark, str(tmp_path)).count() == len(texts)
    free = kneser_ney.quality(d, labels.limit(0), Scratch(spark, "t")).collect()
    assert sum(r.kept for r in free) == len(texts) - 2
    assert kneser_ney.quality(d.limit(0), labels, Scratch(spark, "t")).count() == 0


def test_thresholds_are_quantiles_of_held_out_trusted_documents(spark):
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(WORDS[k] for k in rng.integers(0, 10, int(rng.integers(1, 30))))) for i in range(300)]
    langs = {i: (None, "", "de")[i % 3] for i in range(300)}
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.quality(docs(spark, texts, langs), labels, Scratch(spark, "t"), order=3, quantile=0.9).collect()}
    held = {r.rid for r in spark.range(200).select(F.col("id").alias("rid")).filter(F.pmod(F.xxhash64("rid", F.lit("held")), F.lit(kneser_ney.HELD_OUT)) == 0).collect()}
    assert 20 < len(held) < 60
    for lang in (None, "", "de"):
        own = sorted(got[i].perplexity for i in held if langs[i] == lang)
        want = own[math.ceil(0.9 * len(own)) - 1]
        assert all(abs(got[i].threshold - want) < 1e-6 for i in range(300) if langs[i] == lang)
    model = kneser_ney.Model(docs(spark, [(i, t) for i, t in texts if i < 200 and i not in held]).select("text"), Scratch(spark, "t"), 3)
    again = {r.rid: r.perplexity for r in kneser_ney.perplexities(docs(spark, texts).selectExpr("doc_id as rid", "text"), model, Scratch(spark, "t")).collect()}
    assert all(abs(again[i] - got[i].perplexity) < 1e-5 for i in range(300))


# --- 1


COMMON = ["the", "and", "tion", "with", "that", "house", "under", "their", "which", "there", "nicht", "werden", "que", "para", "dans", "ment"]


def test_dictionary_is_counted_over_all_documents(spark):
    texts = [(i, "House house tree ab") for i in range(5)] + [(8, "rare Tree"), (9, None), (10, "")]
    words = secret_scan.learned_words(docs(spark, texts), Scratch(spark, "t"), most=2)
    assert words.top == ["house", "tree"]
    n = np.full((26, 26), 0.05)
    for w, k in (("house", 10), ("tree", 6), ("rare", 1)):
        for a, b in zip(w, w[1:]):
            n[ord(a) - 97, ord(b) - 97] += k
    assert np.allclose(words.log, np.log(n / n.sum(axis=1, keepdims=True)))
    assert words.covered("xhousetreehous") == 9
    assert secret_scan.learned_words(docs(spark, []), Scratch(spark, "t")).top == []


def test_forest_votes_as_its_trees_do():
    """Against a walk down each tree, row by row."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    forest = secret_scan.Forest(trees=7, depth=5).fit(x, y)

    def walk(tree, row):
        at = 0
        while tree[0][at] >= 0:
            at = tree[2][at] if row[tree[0][at]] <= tree[1][at] else tree[3][at]
        return tree[4][at]

    want = [sum(walk(t, row) for t in forest.trees) / 7 for row in x]
    assert np.allclose(forest.predict(x), want) and ((forest.predict(x) >= 0.5) == (y == 1)).mean() > 0.85
    for feature, bound, left, right, value in forest.trees:  # a leaf's value is the mean label of the bootstrap rows there
        assert ((value >= 0) & (value <= 1)).all() and (left[feature >= 0] > 0).all()


def test_secrets_of_formats_that_were_never_trained():
    words = secret_scan.Words.of(COMMON)
    unseen = ("github", "stripe", "aws", "path", "uuid")
    forest = secret_scan.train(secret_scan.made_findings(words, 1500, without=unseen), words)
    precision, recall = secret_scan.judged(forest, secret_scan.made_findings(words, 600, seed=9, only=unseen), words)
    assert precision > 0.8 and recall > 0.8, (precision, recall)


def test_findings_are_split(spark):
    words = secret_scan.Words.of(COMMON)
    found = secret_scan.made_findings(words, 900)
    table_ = spark.createDataFrame([*found, (None, 0, 3, 1), ("x", None, 1, 1)], secret_scan.FINDINGS)
    fit, held = secret_scan.bounded(table_)
    assert set(fit) | set(held) == set(found) and not set(fit) & set(held) and 100 < len(held) < 260
    assert len(sum(secret_scan.bounded(table_, 50), [])) == 50
    precision, recall = secret_scan.judged(secret_scan.train(fit, words), held, words)
    assert precision > 0.95 and recall > 0.95
    with pytest.raises(ValueError):
        secret_scan.train([], words)


def test_secret_scan(spark, tmp_path):
    words = secret_scan.Words.of(COMMON)
    forest = secret_scan.train(secret_scan.made_findings(words, 900), words)
    secret = "0f" * 3 + "a81b29c7d3e4f50617283940a5b6c7d8e9"
    texts = [(1, f'éé token = "{secret}" x'), (2, "thetionandwithundertheir"), (3, None), (4, ""), (None, "x" * 100000), (1, f'éé token = "{secret}" x')]
    d = docs(spark, texts).withColumns({c: F.lit(0) for c in ("score", "start", "Is_Secret", "w")})
    got = secret_scan.scan(d, forest, words).collect()
    real = [r for r in got if r.is_secret]
    assert [(r.doc_id, r.start, r.end, r.secret_sha256) for r in real] == [(1, 12, 52, hashlib.sha256(secret.encode()).hexdigest())] * 2
    assert {(r.doc_id, r.end - r.start) for r in got if not r.is_secret} == {(2, 24), (None, 100000)}
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert secret_scan.op1_secret_scan(spark, str(tmp_path)).count() == 4
    assert secret_scan.scan(docs(spark, []), forest, words).count() == 0
