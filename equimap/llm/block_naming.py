"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks of UTF-8 bytes. All distinct blocks are sorted, by a hash and then by their bytes, and
their places give them integer names. Then adjacent names of a document are paired, the distinct pairs sorted and named in
turn, and so on until each document is down to one name. Names don't depend on the number of partitions. (level, name) is then the identity of the whole text: equal for equal texts only.

Blocks travel once. A 64-bit hash only routes a block's occurrences to its name; blocks are compared by their bytes, and
if two different blocks share a hash their occurrences are resolved by the bytes, so a collision can't merge texts.

Cases: a null text counts as empty (an empty text is one empty block). Null ids are allowed: a row with a null id is kept
only if every equal text has a null id. Repeated rows get one output row each; of rows that share a text and its largest
id one is kept. An empty table gives an empty result. Other
columns of the input aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, table, with_row_ids

BLOCK_BYTES = 2048
#: Stands for the missing second name of a pair.
NONE = -(1 << 63)
#: Leading bits of a hash that cut the order of all values into ranges.
RANGE_BITS = 16


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """A name for each row of a stored table of distinct values: its place in the order over all rows, counted from 0, the
    same on every cluster. The first column of the order is a hash, whose leading bits cut the order into ranges of like
    size; places inside a range are shifted by the rows of the ranges before, of which there are 2 ** RANGE_BITS at most."""
    keyed = distinct.withColumn("_range", F.shiftrightunsigned(F.col(order[0]), 64 - RANGE_BITS))
    sizes = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    out = keyed.withColumn("_place", place).join(F.broadcast(shifts), "_range")
    return out.withColumn("name", F.col("_before") + F.col("_place")).select(*distinct.columns, "name")


def identities(
    docs: DataFrame,
    scratch: Scratch,
    rid: str = "rid",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row for each row of docs: rid, level, name; (level, name) is equal if and only if the texts are equal."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes).cast("int"))
    # pos counts from the start; substring of binary is a byte copy
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(i.alias("pos"), F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)).alias("block")),
    )
    blocks = (
        docs.select(F.col(rid).alias("rid"), raw.alias("raw"))
        .select("rid", (n - 1).alias("top"), F.explode(pieces).alias("p"))
        .select("rid", "top", "p.pos", "p.block")
        .withColumn("h", route(F.col("block")))
    )
    distinct = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"))
    hashes = scratch.put(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("k")))
    names = scratch.put(_named(hashes.filter("k = 1").select("h"), ["h"]))
    shared = hashes.filter("k > 1").select("h")
    where = blocks.select("rid", "top", "pos", "h")
    if shared.isEmpty():
        found = where.join(names, "h").drop("h")
    else:  # the blocks of these hashes are told apart by their bytes; their names are below zero, the others not
        shared = scratch.put(shared)
        hard = blocks.join(shared, "h", "left_semi")
        apart = scratch.put(hard.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n")).select("h", "block"))
        exact = scratch.put(_named(apart, ["h", "block"]).select("h", "block", (-1 - F.col("name")).alias("name")))
        found = where.join(shared, "h", "left_anti").join(names, "h").drop("h")
        found = found.unionByName(hard.join(exact, ["h", "block"]).drop("h", "block"))
    rows, level, out = scratch.put(found), 0, None
    scratch.drop(hashes, names)
    while True:
        done = rows.filter("top = 0").select("rid", F.lit(level).alias("level"), "name")
        out = done if out is None else out.unionByName(done)
        pairs = (
            rows.filter("top > 0")
            .groupBy("rid", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.shiftright(F.max("top"), 1).alias("top"),
                F.min(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.min(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"),
            )
        )
        pairs = scratch.put(pairs)
        if pairs.isEmpty():
            return out
        level += 1
        two = scratch.put(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("a", "b").alias("h"), "a", "b"))
        names = scratch.put(_named(two, ["h", "a", "b"]).drop("h"))
        rows = scratch.put(pairs.join(names, ["a", "b"]).drop("a", "b"))
        scratch.drop(pairs, two, names)


def dedup_groups(
    base: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """For each row of base, which has a unique rid: rid, keep_id (largest id of equal texts), group_size, kept."""
    ids = identities(base, scratch, text=text, block_bytes=block_bytes, route=route)
    rows = scratch.put(ids.join(base.select("rid", F.col(id_col).alias("id")), "rid"))
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(scratch.put(groups), ["level", "name"])
    return out.select("rid", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"))


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with keep_id, group_size, kept and the hash of each whole text."""
    base = with_row_ids(narrow(docs, id_col, text), id_col, scratch, text)
    hashes = base.select("rid", id_col, F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return dedup_groups(base, scratch, id_col, text, **options).join(hashes, "rid").select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
