"""Benchmark decontamination by winnowing.

Words are hashed, K consecutive word hashes make a k-gram hash, and of each window of WINDOW words the least k-gram hash is
kept as its fingerprint. Equal windows of a document and an item have equal fingerprints, so every shared run of WINDOW
words or more is found. Items of fewer words are one window of their own length.

1. Items give a table of their windows: two 64-bit hashes of the window's words, and the fingerprint.
2. One scan of the documents keeps the windows whose fingerprint may be one of the items'; two bitmaps of a bounded size
   (fingerprints, windows) tell, whatever the number of items. So a hit is extended to all windows around it that match.
3. These windows are joined with the items' windows on both hashes. Each distinct window meets a document once, whatever
   the number of items that hold it; items are joined to the documents' distinct windows afterwards.
4. The matched windows of a document are united to spans of words.

Nothing of the items is held on the driver, and no task gathers more than the windows of one document.

Hashes stand for words (64 bits) and windows (128 bits).

Cases: a null text has no words (n_words 0, not contaminated). A null item id is listed as an empty string. Repeated
item ids count once. Repeated rows of documents each give their row. A document without words, an item without words
and an empty table on either side match nothing. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Marks, Scratch, byte_table, hash_words, marked, mix64, narrow, runs, table, tidied, with_row_ids

WINDOW = 10
K = 5
#: Most rows of the items' windows that are sent to all tasks for the joins (about 40 bytes each); beyond, rows are sorted.
BROADCAST_WINDOWS = 400_000
#: Word separators below 0x80, after A-Z are lower-cased.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TAB = byte_table(SEPARATORS)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x100000001B3)
        out += h[i : i + n]
    return mix64(out)


def least(g: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w values."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for i in range(1, w):
        np.minimum(out, g[i : i + n], out=out)
    return out


def window_hashes(h: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the n words from each start."""
    key, check = np.full(len(starts), n, np.uint64), np.full(len(starts), n, np.uint64)
    for i in range(n):
        key = key * np.uint64(0x100000001B3) + h[starts + i]
        check = check * np.uint64(0x9E3779B97F4A7C15) + h[starts + i]
    return mix64(key), mix64(check)


def windows_of(items: DataFrame, window: int, k: int) -> DataFrame:
    """item, n, key, check, print: the distinct windows of each item (id as text, text)."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, data, offsets in runs(batch.column(1)):
                h, first = hash_words(data, offsets, _TAB)
                for d in range(len(first) - 1):
                    words = h[first[d] : first[d + 1]]
                    n = min(window, len(words))
                    if not n:
                        continue
                    starts = np.arange(len(words) - n + 1)
                    key, check = window_hashes(words, starts, n)
                    prints = least(grams(words, k), n - k + 1) if n == window else key
                    at = np.unique(np.stack((key, check)), axis=1, return_index=True)[1]
                    columns = [pa.array([ids[i + d] or ""] * len(at)), pa.array(np.full(len(at), n, np.int32)), *[pa.array(x[at].view(np.int64)) for x in (key, check, prints)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "key", "check", "print"])

    return items.mapInArrow(tidied(scan), "item string, n int, key long, check long, print long")


def _top(column: str):
    """The place of a 64-bit hash among 2 ** bits: its first bits."""
    return lambda bits: F.shiftrightunsigned(F.col(column), 64 - bits)


def found_windows(docs: DataFrame, prints: Marks, keys: Marks, lengths: list[int], window: int, k: int) -> DataFrame:
    """rid, n_words, hits: for each document (rid, text) its windows (at, n, key, check) that may be an item's."""
    print_bits, key_bits, prints, keys = prints.bits, keys.bits, prints.marks, keys.marks

    def may(values: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
        return marked(marks, (values >> np.uint64(64 - bits)).astype(np.int64))

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for i, data, offsets in runs(batch.column(1)):
                h, first = hash_words(data, offsets, _TAB)
                parts = []
                for n in lengths:
                    if n == window:
                        mins = least(grams(h, k), n - k + 1)
                        starts = np.flatnonzero(may(mins, prints.value, print_bits))
                    else:
                        starts = np.arange(max(0, len(h) - n + 1))
                    doc = np.searchsorted(first, starts, "right") - 1
                    inside = starts + n <= first[doc + 1]
                    starts, doc = starts[inside], doc[inside]
                    key, check = window_hashes(h, starts, n)
                    ok = may(key, keys.value, key_bits)
                    parts.append((doc[ok], starts[ok] - first[doc[ok]], np.full(int(ok.sum()), n), key[ok], check[ok]))
                doc, at, n, key, check = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 5))
                order = np.argsort(doc, kind="stable")
                ends = np.searchsorted(doc[order], np.arange(len(first)))
                hits = pa.StructArray.from_arrays([pa.array(at[order].astype(np.int64)), pa.array(n[order].astype(np.int32)), pa.array(key[order].view(np.int64)), pa.array(check[order].view(np.int64))], names=["at", "n", "key", "check"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(first) - 1), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)], names=["rid", "n_words", "hits"])

    return docs.select("rid", "text").mapInArrow(tidied(scan), "rid long, n_words long, hits array<struct<at: long, n: int, key: long, check: long>>")


def united(rows: DataFrame) -> DataFrame:
    """rid, spans: the windows (at, n) of rows (rid, at, n) as spans of words that don't touch, in order."""
    per = rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("xs"))

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            flat, sizes = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            s, e = flat.field("at").to_numpy(), flat.field("at").to_numpy() + flat.field("n").to_numpy()
            shift = doc * (int(e.max(initial=0)) + 2)  # documents one behind the other, so that no span crosses
            high = np.maximum.accumulate(e + shift)
            head = np.r_[True, (s + shift)[1:] > high[:-1]] if len(s) else np.zeros(0, bool)
            at = np.flatnonzero(head)
            last = np.r_[at[1:] - 1, len(s) - 1] if len(at) else at
            spans = pa.StructArray.from_arrays([pa.array(s[at]), pa.array(high[last] - shift[at])], names=["start", "end"])
            ends = np.searchsorted(doc[at], np.arange(len(sizes) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans)], names=["rid", "spans"])

    return per.mapInArrow(tidied(scan), "rid long, spans array<struct<start: long, end: long>>")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    scratch: Scratch,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    k: int = K,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """For each row of docs, which has a unique rid: rid, n_words, spans (start, end: the words that are hit), items (ids as
    text, sorted)."""
    base = docs.select("rid", F.col(text).alias("text"))
    rows = scratch.put(windows_of(narrow(items, item_id, item_text).select(F.col(item_id).cast("string"), F.col(item_text)), window, k).distinct())
    lengths = sorted(r[0] for r in rows.select("n").distinct().collect())  # at most `window` of them
    prints = Marks(rows.select("print").distinct(), _top("print"))
    keys = Marks(rows.select("key").distinct(), _top("key"))
    found = scratch.put(found_windows(base, prints, keys, lengths, window, k))
    on = ["n", "key", "check"]
    small = rows.limit(broadcast_windows + 1).count() <= broadcast_windows
    sent = F.broadcast if small else (lambda df: df.hint("merge"))
    hits = found.filter(F.size("hits") > 0).select("rid", F.explode("hits").alias("x")).select("rid", "x.at", "x.n", "x.key", "x.check")
    hits = scratch.put(hits.join(sent(rows.select(*on).distinct()), on))
    names = hits.select("rid", *on).distinct().join(sent(rows.select(*on, "item")), on).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = found.select("rid", "n_words").join(united(hits), "rid", "left").join(names, "rid", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})")).alias(c)
    return each.select("rid", "n_words", none("spans", "array<struct<start: bigint, end: bigint>>"), none("items", "array<string>"))


def digest(found: DataFrame) -> list[Column]:
    """n_hit, n_items and items_sha256 of decontaminate()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return [n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")]


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    docs = with_row_ids(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", scratch, "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), scratch)
    out = out.select("rid", "n_words", *digest(out))
    return out.join(docs.select("rid", "doc_id"), "rid").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: Windows as rows of joined words. Items below ten words would need a window length each; the benchmark has none.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     il AS (SELECT item_id, w, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n FROM iw WHERE len(w) > 0),
     ig AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM il, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
     ns AS (SELECT DISTINCT n FROM il),
     dg AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM dw, ns, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
     hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
