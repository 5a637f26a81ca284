"""Importance resampling towards a target distribution.

Features are runs of 1 to `longest` consecutive words, hashed to buckets. Buckets of all documents and of the target's texts
are counted; a bucket's gain is the scaled logarithm of its smoothed share in the target over that in the documents. The gains
are an array, by which a scan scores each document: its weight is the sum of its features' gains, its score the weight and a
Gumbel noise that depends on the seed and the document's id alone. The highest scores are a draw without replacement in
proportion to the weights.

The draw is an external merge sort that stops at the draw's size:

1. Each partition of scored documents sorts those that are eligible to a run, cut into blocks at the bounds of key ranges.
   Bounds come from a bounded sample; they only decide how even the ranges are, not the result.
2. Blocks' sizes tell how many documents lie before each range. Ranges behind the draw's size are never read.
3. A task merges the runs of a range by a tournament tree. Its blocks come in the order of their first keys, so a block is
   opened when the merge gets to it and the tree holds the blocks that overlap only. Places in the merge and the documents
   before the range are the ranks; in the range where the draw ends the merge stops there.

Keys are (score descending, id ascending, row id), so a group of any size with equal scores is cut as well.

Cases: a null text has no words: no features, weight 0, not eligible unless no words are asked for. A null id makes noise as an
empty one and comes last of equal scores. Repeated rows are rows of their own. No documents give no rows; an empty target gives
gains of the documents' shares alone. Other columns aren't read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_table, narrow, runs, table, tidied, with_row_ids, word_spans
from .winnowing import SEPARATORS

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Longer words are hashed one by one, shorter ones together, a byte of each at a time.
LONG_WORD = 48
#: Rows of a range that are aimed at, ranges at most, sampled keys for a range's bound.
RANGE_ROWS = 50_000
MOST_RANGES = 4_096
SAMPLED = 32

_IS_WORD, _ = byte_table(SEPARATORS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The register's steps by byte, taken from the checksums of single bytes.
_STEP = np.array([zlib.crc32(bytes([i ^ 255])) for i in range(256)], np.uint32) ^ np.uint32(0xFF000000)
#: A row of a run.
ROW = np.dtype([("neg", "<i8"), ("lost", "<i8"), ("id", "<i8"), ("rid", "<i8"), ("features", "<i8"), ("weight", "<i8")])


def fed(register: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Checksum registers after the bytes s..e of each word."""
    size = e - s + 1
    out = register.copy()
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[s[i] : e[i] + 1].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    short = np.flatnonzero(size <= LONG_WORD)
    order = short[np.argsort((LONG_WORD - size[short]).astype(np.uint8), kind="stable")]  # the longest come first
    ends, at, r = -size[order], s[order], out[order]
    for k in range(int(-ends[0]) if len(ends) else 0):
        live = int(np.searchsorted(ends, -k))
        r[:live] = _STEP[(r[:live] ^ data[at[:live] + k]) & 255] ^ (r[:live] >> np.uint32(8))
    out[order] = r
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length of features the document and bucket of each; and each document's words."""
    data = _LOWER[data]
    s, e, first = word_spans(data, offsets, _IS_WORD)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    register, out = np.full(len(s), 0xFFFFFFFF, np.uint32), []
    at = np.arange(len(s))
    for k in range(longest):
        if k:
            at = at[(at + k < len(s)) & (doc[np.minimum(at + k, len(s) - 1)] == doc[at])] if len(at) else at
            register = _STEP[(register[: len(s)][at] ^ 32) & 255] ^ (register[at] >> np.uint32(8))
        grown = fed(register, data, s[at + k], e[at + k])
        out.append((doc[at], ((grown ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)))
        register = np.zeros(len(s), np.uint32)
        register[at] = grown
    return out, np.diff(first)


def bucket_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends a row for each bucket at most."""

    def scan(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in runs(batch.column(0)):
                for _, bucket in features(data, offsets, longest, buckets)[0]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = docs.select(text).mapInArrow(tidied(scan), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Each bucket's gain from its counts in the documents and in the target."""
    n = len(s)
    a, b = float(int(s.sum()) + n), float(int(t.sum()) + n)
    return np.array([math.floor(1000 * math.log(float(y + 1) * a / (float(x + 1) * b))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def scored(spark: SparkSession, text: Column, gain: np.ndarray, longest: int) -> Column:
    """struct(words, n_features, weight) of a text column."""
    shared = spark.sparkContext.broadcast(gain)

    @F.arrow_udf("struct<words: long, n_features: long, weight: long>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def scan(batches):
            gain = shared.value
            for texts in batches:
                words, count, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
                for i, data, offsets in runs(texts):
                    found, n = features(data, offsets, longest, len(gain))
                    words[i : i + len(n)] = n
                    for doc, bucket in found:
                        ahead = np.concatenate(([0], np.cumsum(gain[bucket])))
                        edges = np.searchsorted(doc, np.arange(len(n) + 1))
                        count[i : i + len(n)] += np.diff(edges)
                        weight[i : i + len(n)] += np.diff(ahead[edges])
                yield pa.StructArray.from_arrays([pa.array(x) for x in (words, count, weight)], names=["words", "n_features", "weight"])

        yield from tidied(scan)(batches)

    return judged(text)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, from the seed and the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


class Tournament:
    """A winner tree over the open blocks: each leaf is a block's next key, each inner node the better one of its two."""

    def __init__(self) -> None:
        self.size = 1
        self.keys: list[tuple | None] = [None]
        self.win = [0, 0]
        self.free = [0]

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return b if x is None or (y is not None and y < x) else a

    def put(self, slot: int, key: tuple | None) -> None:
        """Sets a leaf (None: its block is done) and replays its matches."""
        self.keys[slot] = key
        at = (slot + self.size) >> 1
        while at:
            left, right = ((2 * at, 2 * at + 1) if 2 * at < self.size else (None, None))
            a, b = (self.win[left], self.win[right]) if left else (2 * at - self.size, 2 * at + 1 - self.size)
            self.win[at] = self._better(a, b)
            at >>= 1
        if key is None:
            self.free.append(slot)

    def add(self, key: tuple) -> int:
        if not self.free:
            old = self.size
            self.size *= 2
            self.keys += [None] * old
            self.win = [0] * self.size
            for at in range(self.size - 1, 0, -1):
                a, b = (self.win[2 * at], self.win[2 * at + 1]) if 2 * at < self.size else (2 * at - self.size, 2 * at + 1 - self.size)
                self.win[at] = self._better(a, b)
            self.free = list(range(self.size - 1, old - 1, -1))
        slot = self.free.pop()
        self.put(slot, key)
        return slot

    def best(self) -> int:
        return self.win[1] if self.size > 1 else 0


def merged(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """All rows of sorted blocks in order, in pieces; the blocks come in the order of their first keys. Only blocks that
    overlap are open at the same time."""
    tree, open_, out = Tournament(), {}, []
    key = lambda row: (int(row["neg"]), int(row["lost"]), int(row["id"]), int(row["rid"]))
    ahead = next(blocks, None)
    while ahead is not None or open_:
        slot = tree.best()
        if ahead is not None and (not open_ or key(ahead[0]) <= tree.keys[slot]):
            keys = list(zip(*(ahead[c].tolist() for c in ("neg", "lost", "id", "rid")), strict=True))
            open_[tree.add(keys[0])] = [ahead, keys, 0]
            ahead = next(blocks, None)
            continue
        block = open_[slot]
        rows, keys, at = block
        out.append(rows[at : at + 1])
        block[2] = at + 1
        if at + 1 < len(keys):
            tree.put(slot, keys[at + 1])
        else:
            tree.put(slot, None)
            del open_[slot]
        if len(out) == 4096:
            yield np.concatenate(out)
            out = []
    if out:
        yield np.concatenate(out)


def drawn(rows: DataFrame, scratch: Scratch, percent: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, tuple | None]:
    """The drawn rows of a scored table (doc_id, rid, n_features, weight, score, eligible) with their rank, and the last one's
    key (None: nothing is drawn)."""
    spark = rows.sparkSession
    keyed = rows.filter("eligible").select((-F.col("score")).alias("neg"), F.col("doc_id").isNull().cast("long").alias("lost"), F.coalesce("doc_id", F.lit(0)).alias("id"), "rid", "n_features", "weight")
    n = keyed.count()
    draw = percent * n // 100
    if not draw:
        return spark.createDataFrame([], "doc_id long, n_features long, weight long, score long, rank long"), None
    ranges = max(1, min(MOST_RANGES, n // range_rows))
    share = min(1.0, SAMPLED * ranges / n)
    sample = keyed.filter(F.pmod(F.xxhash64("rid", F.lit("bounds")), F.lit(1 << 30)) < share * (1 << 30)).select("neg", "lost", "id", "rid").collect() if ranges > 1 else []
    sample = sorted(map(tuple, sample))
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else []

    def cut(batches):
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            packed = np.empty(k, ROW)
            for name, column in zip(ROW.names, batch.columns, strict=True):
                packed[name] = column.to_numpy(zero_copy_only=False)
            key = lambda i: tuple(packed[i].item()[:4])  # noqa: B023, E731
            low, high = bisect.bisect_right(bounds, key(0)), bisect.bisect_right(bounds, key(k - 1))
            edges = [0, *[bisect.bisect_left(range(k), b, key=key) for b in bounds[low:high]], k]
            kept = [(low + j, a, b) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            first = packed[[a for _, a, _ in kept]]
            columns = [pa.array([r for r, _, _ in kept], pa.int64()), pa.array([b - a for _, a, b in kept], pa.int64()), *[pa.array(first[c]) for c in ROW.names[:4]]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed[a:b].tobytes() for _, a, b in kept], pa.binary())], names=["range", "n", *ROW.names[:4], "rows"])

    keys = list(ROW.names[:4])
    blocks = scratch.put(keyed.sortWithinPartitions(*keys).mapInArrow(tidied(cut), "range long, n long, neg long, lost long, id long, rid long, rows binary"))
    sizes = {r["range"]: r["n"] for r in blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # MOST_RANGES at most
    ahead, total = {}, 0
    for r in sorted(sizes):
        if total < draw:
            ahead[r] = total
        total += sizes[r]

    def merge(batches):
        def stream(first, rest):
            """The blocks of first's range; what comes next is left in rest."""
            at, row = first
            while row is not None:
                yield np.frombuffer(row, ROW)
                nxt = next(rest["rows"], None)
                if nxt is None or nxt[0] != at:
                    rest["next"] = nxt
                    return
                row = nxt[1]

        rest = {"rows": ((r, x) for batch in batches for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), "next": None}
        rest["next"] = next(rest["rows"], None)
        while rest["next"] is not None:
            first = rest["next"]
            place = ahead[first[0]]
            blocks = stream(first, rest)
            for part in merged(blocks):
                part = part[: draw - place]
                if not len(part):
                    break
                place += len(part)
                ids = pa.array(part["id"], mask=part["lost"] == 1)
                columns = [ids, *[pa.array(x) for x in (part["features"], part["weight"], -part["neg"], place - len(part) + 1 + np.arange(len(part)), part["rid"])]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight", "score", "rank", "rid"])
            for _ in blocks:  # what lies behind the draw's end
                pass

    top = blocks.filter(F.col("range") <= max(ahead)).repartition("range").sortWithinPartitions("range", *keys).select("range", "rows")
    out = scratch.put(top.mapInArrow(tidied(merge), "doc_id long, n_features long, weight long, score long, rank long, rid long"))
    last = out.filter(F.col("rank") == draw).select(-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), "rid").first()
    return out.drop("rid"), tuple(last)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    scratch: Scratch,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (rid, doc_id, text); target has text."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, "text", longest, buckets), bucket_counts(target, "text", longest, buckets))
    found = scored(spark, F.col("text"), gain, longest)
    rows = docs.select("doc_id", "rid", found.alias("f")).select("doc_id", "rid", "f.words", "f.n_features", "f.weight")
    rows = rows.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("eligible", F.col("words") >= least_words)
    rows = scratch.put(rows)
    top, last = drawn(rows, scratch, percent, range_rows)
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = rows
    if last is not None:
        neg, lost, known, rid = last
        key = F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().cast("long").alias("b"), F.coalesce("doc_id", F.lit(0)).alias("c"), F.col("rid").alias("d"))
        edge = F.struct(*[F.lit(x).cast("long").alias(c) for x, c in ((neg, "a"), (lost, "b"), (known, "c"), (rid, "d"))])
        rest = rows.filter(~F.col("eligible") | (key > edge))
    return top.select(*columns).unionByName(rest.select(*columns[:-1], F.lit(None).cast("long").alias("rank")))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    docs = with_row_ids(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", scratch, "text")
    return resampled(docs, narrow(table(spark, sf_dir, "benchmark"), "text"), scratch)


#: Checksums of distinct words, by the bytewise table of the polynomial.
SQL = r"""
WITH step AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT)) AS v FROM range(256) r(n))),
     dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     iw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     dc AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM dw) GROUP BY ALL),
     ic AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM iw) GROUP BY ALL),
     words AS (SELECT DISTINCT x, hex(x) AS h FROM (SELECT x FROM dc UNION ALL SELECT x FROM ic)),
     place AS (SELECT x, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM words, step),
     s AS (SELECT bucket, sum(n) AS n FROM dc JOIN place USING (x) GROUP BY bucket),
     g AS (SELECT bucket, sum(n) AS n FROM ic JOIN place USING (x) GROUP BY bucket),
     total AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) + 10000 AS a, CAST(coalesce((SELECT sum(n) FROM g), 0) AS DOUBLE) + 10000 AS b),
     gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(g.n, 0) AS DOUBLE) + 1) * a / ((CAST(s.n AS DOUBLE) + 1) * b))) AS BIGINT) AS v FROM s LEFT JOIN g USING (bucket), total),
     weighed AS (SELECT doc_id, CAST(sum(dc.n * v) AS BIGINT) AS weight FROM dc JOIN place USING (x) JOIN gain USING (bucket) GROUP BY doc_id),
     scored AS (SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                       coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || dw.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
                FROM dw LEFT JOIN weighed USING (doc_id)),
     ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
