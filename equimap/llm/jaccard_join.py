"""N-gram Jaccard join: documents whose sets of word shingles reach a similarity, and their connected components.

A document's shingles are 64-bit hashes, sorted. Sizes are cut into bands, each EDGE times the one before; a tile holds
the sizes of a band and those above it that can still reach the similarity with one of them. Within a tile two linked
sets differ in at most k shingles, so when the hash space is cut into k + 1 + z parts, at least z + 1 parts hold the
same shingles in both. A key for each part that isn't empty therefore brings every linked pair together (a set with
more than z empty parts has keys for these too, so nothing is lost). Only documents that share a key meet:

1. Keys are made next to the scan. Each task keeps one document per key and sets the others beside it, so a key of any
   number of documents reaches the shuffle with one row a task. The scan is made twice, for the few documents beside
   and for the keys, so keys are never written to a table; docs has to be a stored table, which splits alike each time.
   (Sets of equal size and equal 128-bit sums count as equal within a task.)
2. Each document is first held against the least document of its keys. Linked pairs are joined to components.
3. Only keys whose documents are still in different components go on. A key's documents are dealt by hash to sides of
   about TILE documents, and each two sides make a tile, so no task holds a key of many documents. In a tile, bitmaps of hashed parities are compared: the bits in which two differ bound the overlap from above. Pairs
   of different components that pass are counted exactly on the sorted arrays. A first turn takes each document's few
   closest ones in a part of the keys, which connects most; a second turn takes all pairs that pass, so none is left out.

Hashes of 64 bits stand for the shingles. Candidates thus come from shared parts (steps 1 and 2 see no bitmap); bitmaps
bound the overlap in step 3 only. Sets that a task finds of equal size and equal 128-bit sums are united without the exact
intersection.

Cases: a null or empty text has an empty set, is linked with nothing and is its own component. Null or repeated ids get
row numbers inside; a component's id is the least id in it that isn't null (null where all are). Repeated rows are
documents of their own with similarity 1. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LEAST_BATCHES, Marks, Scratch, byte_table, hash_words, marked, mix64, narrow, runs, table, tidied, with_row_ids

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_TAB = byte_table(SEPARATORS)
#: Ratio of a size band's end to its start.
EDGE = 1.5
#: Most bits of a bitmap.
MOST_BITS = 1 << 15
#: Documents on a side of a tile, and the closest ones that a document proposes in the first turn.
TILE, CLOSEST = 1024, 4
#: The first turn looks into one key of so many; it only has to connect most.
EVERY = 4
#: Rows that a task gathers before it sends them on; bounds its memory.
FLUSH = 500_000
#: Rows of a batch that a scan sends on.
SENT = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked when den * intersection >= num * union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def differ(self, total: int) -> int:
        """Most shingles in which two linked sets of `total` shingles together differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def bands(self, top: int) -> list[int]:
        out = [1]
        while out[-1] <= top:
            out.append(max(out[-1] + 1, int(out[-1] * EDGE)))
        return out

    def parts(self, band_end: int) -> tuple[int, int]:
        """(parts, spare parts) of the tile whose band ends before band_end."""
        low = band_end - 1
        k = self.differ(low + low * self.den // self.num)
        spare = max(1, k // 10)
        return k + 1 + spare, spare


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes; fewer words make one shingle."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0x100000001B3)
        out += h[i : i + len(out)]
    out = mix64(out + np.uint64(n))
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def tile_keys(s: np.ndarray, rule: Rule, bands: list[int]) -> np.ndarray:
    """Keys of a set in the tiles that it belongs to."""
    n, out = len(s), []
    own = int(np.searchsorted(bands, n, "right")) - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    top = s >> np.uint64(32)
    for band in (own, own - 1):
        if band < 0 or band < own and n * rule.num > (bands[own] - 1) * rule.den:
            continue
        m, spare = rule.parts(bands[band + 1])
        edges = (np.arange(m + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(m)
        cut = np.searchsorted(top, edges)
        empty = cut[1:] == cut[:-1]
        part = sums[cut[1:]] - sums[cut[:-1]]
        key = mix64(part + mix64(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32)))
        out.append(key if empty.sum() > spare else key[~empty])
    return np.concatenate(out)


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the count of shingles in each of `bits` buckets: two sets differ in at least as many shingles as their
    bitmaps differ in bits. The halves of a bitmap, added without carry, are the bitmap of half the bits."""
    bucket = (mix64(s + np.uint64(0x1234567)) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(bucket, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def bits_for(n: int, rule: Rule) -> int:
    """Bits of a set's bitmap: sixteen for each shingle in which it may differ from a linked one."""
    return min(MOST_BITS, max(64, 1 << (16 * rule.differ(2 * n)).bit_length()))


def passing(n: np.ndarray, comp: np.ndarray, maps: list[bytes], rule: Rule, closest: int | None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile in different components whose bitmaps allow a link; at most `closest` for each
    document of a smaller component where that is given. A tile of two sides has only pairs of one from each: those inside
    a side are in a tile of their own."""
    across = side is not None and bool((side != side[0]).any())
    width = min(len(m) for m in maps)
    rows = np.empty((len(maps), width // 8), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while len(x) > rows.shape[1]:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows[i] = x
    names, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    big = int(np.argmax(count))
    a, b = [], []
    for i in np.flatnonzero(at != big).tolist():
        # a pair of two smaller components is seen from both sides; the lower place proposes it in the full turn
        other = (at != at[i]) if closest else (at != at[i]) & ((at == big) | (np.arange(len(at)) > i))
        if across:
            other &= side != side[i]
        j = np.flatnonzero(other)
        differ = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64)
        total = n[j] + n[i]
        over = np.minimum((total - differ) // 2, np.minimum(n[j], n[i]))
        ok = (rule.num + rule.den) * over >= rule.num * total
        j, differ = j[ok], differ[ok]
        if closest and len(j) > closest:
            j = j[np.argsort(differ, kind="stable")[:closest]]
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _scan(docs: DataFrame, rule: Rule, heads: bool) -> DataFrame:
    """heads: key and one document of this task for each key, as kind 1. Else kind 0: a document and its set size;
    kind 2: key, document, that document of the key; kind 3: document and an earlier one of this task with the same set."""
    bands = rule.bands(1 << 31)

    def scan(batches):
        import pyarrow as pa

        sets: dict[tuple, int] = {}
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def rows(kind, a, b, c):
            for at in range(0, len(a), SENT):
                x, y, z = (np.asarray(v[at : at + SENT]) for v in (a, b, c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y, pa.int64()), pa.array(z, pa.int64())], names=["kind", "a", "b", "c"])

        def flush():
            k, r = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((r, k))
            k, r = k[order], r[order]
            head = np.r_[True, k[1:] != k[:-1]]
            start = np.flatnonzero(head)
            count = np.diff(np.r_[start, len(k)])
            if heads:
                yield from rows(1, k[start], r[start], r[start])
            many = np.repeat(count > 1, count)
            if many.any() and not heads:
                yield from rows(2, k[many], r[many], np.repeat(r[start], count)[many])

        for batch in batches:
            rid = batch.column(0).to_numpy()
            n_set = np.zeros(len(rid), np.int64)
            same_a, same_b = [], []
            for i, data, offsets in runs(batch.column(1)):
                h, first = hash_words(data, offsets, _TAB)
                for d in range(len(first) - 1):
                    s = shingles(h[first[d] : first[d + 1]], rule.words)
                    n_set[i + d] = len(s)
                    if not len(s):
                        continue
                    me = int(rid[i + d])
                    name = (len(s), int(s.sum(dtype=np.uint64)), int(mix64(s).sum(dtype=np.uint64)))
                    if (other := sets.setdefault(name, me)) != me:
                        same_a.append(me)
                        same_b.append(other)
                        continue
                    k = tile_keys(s, rule, bands)
                    keys.append(k)
                    ids.append(np.full(len(k), me, np.int64))
                    size += len(k)
            if not heads:
                yield from rows(0, rid, n_set, n_set)
            if same_a and not heads:
                yield from rows(3, np.array(same_a, np.int64), same_b, same_b)
            if size > FLUSH:
                yield from flush()
                keys, ids, size = [], [], 0
                sets.clear()
        if size:
            yield from flush()

    return docs.select("rid", "text").mapInArrow(tidied(scan), "kind int, a long, b long, c long")


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("rid"), F.lit(1 << bits))


def _sets(docs: DataFrame, marks: Marks, rule: Rule, arrays: bool) -> DataFrame:
    """For all marked documents: rid, n, and s: the sorted set, or else its bitmap."""
    bits = marks.marks

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.array(marked(bits.value, batch.column(2).to_numpy())))
            for i, data, offsets in runs(batch.column(1)):
                h, first = hash_words(data, offsets, _TAB)
                got = [shingles(h[first[d] : first[d + 1]], rule.words) for d in range(len(first) - 1)]
                lengths = np.array([len(s) for s in got], np.int64)
                if arrays:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.concatenate(got).view(np.int64)))
                else:
                    out = pa.array([bitmap(s, bits_for(len(s), rule)).tobytes() for s in got], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(got)), pa.array(lengths), out], names=["rid", "n", "s"])

    return docs.select("rid", "text", _place(marks.bits).alias("at")).mapInArrow(tidied(scan), f"rid long, n long, s {'array<long>' if arrays else 'binary'}")


def _tiles(rows: DataFrame, rule: Rule, closest: int | None) -> DataFrame:
    """Pairs that pass in the tiles of rows (key, tile, own, rid, comp, n, s), which are sorted by key and tile."""

    def scan(batches):
        import pyarrow as pa

        def done(key, tile, own, rid, comp, n, s):
            edge = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            a, b = [], []
            for x, y in zip(np.r_[0, edge].tolist(), np.r_[edge, len(key)].tolist(), strict=True):
                if y - x > 1:
                    i, j = passing(n[x:y], comp[x:y], s[x:y], rule, closest, own[x:y])
                    a.append(rid[x:y][i])
                    b.append(rid[x:y][j])
            if not a:
                return None
            a, b = np.concatenate(a), np.concatenate(b)
            both = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(6)] + [batch.column(6).to_pylist()]
            if rest is not None:
                now = [np.concatenate((x, y)) for x, y in zip(rest[:6], now[:6], strict=True)] + [rest[6] + now[6]]
            # the last tile may go on in the next batch; no tile is larger than 2 * TILE rows
            cut = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0]) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if cut and (out := done(*[x[:cut] for x in now])) is not None:
                yield out
        if rest is not None and len(rest[0]) and (out := done(*rest)) is not None:
            yield out

    return rows.select("key", "tile", "own", "rid", "comp", "n", "s").mapInArrow(tidied(scan), "a long, b long").distinct()


def _exact(pairs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b, sa, sb) that are linked, by exact intersection of the sorted arrays."""
    num, den = rule.num, rule.den

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            sets = []
            for c in (2, 3):
                col = batch.column(c)
                sets.append((col.flatten().to_numpy(), np.r_[0, np.cumsum(col.value_lengths().to_numpy())]))
            (va, oa), (vb, ob) = sets
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = den * common >= num * (len(both) - common) > 0
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(tidied(scan), "a long, b long")


class _Join:
    def __init__(self, docs: DataFrame, scratch: Scratch, rule: Rule) -> None:
        self.docs, self.scratch, self.rule = docs, scratch, rule
        scratch.batches = LEAST_BATCHES

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b)."""
        sc, rule = self.scratch, self.rule
        pairs = sc.put(pairs)
        if pairs.isEmpty():
            return pairs
        sc.release()  # what the pairs were made from goes before their sets are moved
        wanted = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
        stored = sc.put(_sets(self.docs, Marks(wanted, _place), rule, True))
        sets = stored.select("rid", "s")
        full = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
        linked = sc.put(_exact(full.select("a", "b", "sa", "sb"), rule))
        sc.drop(stored, pairs)
        sc.release()
        return linked

    def components(self, edges: DataFrame) -> DataFrame:
        """rid, comp for all documents in an edge, by alternating large-star and small-star. The least neighbours are a table of
        a row for each document before they are joined, so that Spark can split the rows of a document that very many are
        linked with, such as the least one of a large group."""
        sc = self.scratch
        e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
        e, mark = sc.put(e, few=True), None
        while True:
            now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))).alias("s")).first()
            if now == mark or not now["n"]:
                return e.select(F.col("u").alias("rid"), F.col("v").alias("comp"))
            mark = now
            both = e.union(e.select("v", "u"))
            least = sc.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), few=True)
            big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            big = sc.put(big, few=True)
            sc.drop(least)
            least = sc.put(big.groupBy("u").agg(F.min("v").alias("m")), few=True)
            small = big.join(least, "u")
            small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).filter("u <> v").distinct()
            old, e = e, sc.put(small, few=True)
            sc.drop(old, big, least)

    def run(self) -> DataFrame:
        sc, rule = self.scratch, self.rule
        found = sc.put(_scan(self.docs, rule, False))
        sizes = found.filter("kind = 0").select(F.col("a").alias("rid"), F.col("b").alias("n"))
        local = found.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("rid"), F.col("c").alias("head"))
        # at most a row for each task and key, so the rows of a key are few
        w = Window.partitionBy("key")
        keyed = _scan(self.docs, rule, True).select(F.col("a").alias("key"), F.col("b").alias("rid"))
        heads = keyed.withColumn("head", F.min("rid").over(w)).withColumn("last", F.max("rid").over(w))
        heads = sc.put(heads.filter("head < last").select("key", "rid", "head"))
        sc.release()
        met = local.union(heads)
        first = met.filter("rid <> head").groupBy("rid").agg(F.min("head").alias("head"))
        same = found.filter("kind = 3").select("a", "b")
        edges = sc.put(self.verified(first.select(F.col("rid").alias("a"), F.col("head").alias("b"))).union(same))
        comps = sc.put(self.components(edges))
        members = sc.put(met.select("key", "rid").distinct())
        sc.drop(heads)
        for closest in (CLOSEST, None):
            labelled = members.select("key", "rid").join(comps, "rid", "left").select("key", "rid", F.coalesce("comp", "rid").alias("comp"))
            keys = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            keys = sc.put(keys.filter("lo < hi").select("key", "size"))
            old, members = members, sc.put(labelled.join(keys, "key").select("key", "rid", "comp", "size"))
            sc.drop(old, keys)
            if members.isEmpty():
                break
            sc.release()
            looked = members.filter(F.pmod("key", F.lit(EVERY)) == 0) if closest else members
            maps = sc.put(_sets(self.docs, Marks(looked.select("rid").distinct(), _place), rule, False))
            sides = F.ceil(F.col("size") / TILE).cast("long")
            own = F.pmod(F.xxhash64("rid"), F.col("sides"))
            tile = F.transform(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1), lambda x: F.least(F.col("own"), x) * F.col("sides") + F.greatest(F.col("own"), x))
            rows = looked.withColumn("sides", sides).withColumn("own", own).withColumn("tile", F.explode(tile))
            rows = rows.join(maps, "rid").repartition("key", "tile").sortWithinPartitions("key", "tile", "rid")
            more = self.verified(_tiles(rows, rule, closest))
            if not more.isEmpty():
                comps = sc.put(self.components(sc.put(comps.select(F.col("rid").alias("a"), F.col("comp").alias("b")).union(more))))
            sc.drop(maps)
            sc.release()
        return sizes.join(comps, "rid", "left").select("rid", "n", F.coalesce("comp", "rid").alias("comp"))


def jaccard_components(docs: DataFrame, scratch: Scratch, rule: Rule | None = None, text: str = "text") -> DataFrame:
    """For each row of docs, which has a unique rid: rid, n (set size), comp (least rid of its component)."""
    return _Join(docs.select("rid", F.col(text).alias("text")), scratch, rule or Rule()).run()


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    docs = with_row_ids(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", scratch, "text")
    return with_component_ids(docs, jaccard_components(docs, scratch), "doc_id", scratch)


def with_component_ids(docs: DataFrame, comps: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    rows = scratch.put(comps.join(docs.select("rid", id_col), "rid"))
    least = scratch.put(rows.groupBy("comp").agg(F.min(id_col).alias("component_id")))
    return rows.join(least, "comp").select(id_col, F.col("n").alias("n_shingles"), "component_id")
