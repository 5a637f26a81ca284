"""Shared helpers: scratch tables on the cluster's shared folder, table reading, byte tokenising."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may leave it unset (tests) and gets a local folder; a
    cluster's executors would not see that one, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="equimap-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch while a table is written: they bound what a Python worker holds at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: The same for rows that hold large arrays: the JVM's Arrow buffers grow by doubling, outside its heap.
LEAST_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
FEW_TASKS = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


@contextlib.contextmanager
def small_batches(spark: SparkSession, batches: dict[str, str] = BATCHES):
    """Within it, queries that run send Python workers such batches; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in batches}
    try:
        for k, v in batches.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidied(scan: Callable) -> Callable:
    """scan, which gives the memory that it freed back to the system when it ends: workers are used again, and what one
    stage's needed would else stay theirs beside the next one's."""

    @functools.wraps(scan)
    def run(batches):
        import pyarrow as pa

        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


class Scratch:
    """Parquet tables that cut lineage: they live in the shared folder, so a lost executor loses none.

    They are removed by drop() and close(), or else when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.batches = BATCHES
        atexit.register(self.close)

    def put(self, df: DataFrame, *parts: str, few: bool = False) -> DataFrame:
        """df as a table. few: small partitions are joined up to Spark's advisory size although cores stay idle, for tables of
        small rows in loops: each file costs more than its rows do."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        writer = df.write
        if parts:
            writer = writer.partitionBy(*parts)
        with small_batches(self.spark, self.batches | (FEW_TASKS if few else {})):
            writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that are over; else they stay until the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., and their places by name: names that clash do no harm."""
    names: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        names.setdefault(c, f"c{i}")
    for i, c in enumerate(df.columns):
        names.setdefault(c.lower(), f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), names


def narrow(df: DataFrame, *wanted: str) -> DataFrame:
    """Only these columns; others whose names differ in case alone, or repeat, do no harm."""
    base, names = numbered(df)
    return base.select(*[F.col(names[c]).alias(c) for c in wanted])


def with_row_ids(docs: DataFrame, id_col: str, scratch: Scratch, *keep: str) -> DataFrame:
    """docs with a unique non-null long `rid`: the id column itself where it is that, else a number given to
    each row and written down, so that later reads see the same numbers."""
    kind = docs.schema[id_col].dataType.typeName()
    cols = [F.col(id_col), *[F.col(c) for c in keep]]
    if kind in ("long", "integer", "short", "byte"):
        odd = docs.groupBy(F.col(id_col).alias("i")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or i is null")
        if odd.isEmpty():
            return docs.select(F.col(id_col).cast("long").alias("rid"), *cols)
    return scratch.put(docs.select(F.monotonically_increasing_id().alias("rid"), *cols))


class Marks:
    """Bits at hashed places, at most 2 ** MOST of them and so of a bounded size: tells which keys may be in a set. Keys that
    aren't may pass too."""

    MOST = 27

    def __init__(self, keys: DataFrame, at: Callable[[int], Column]) -> None:
        """at: the place of a row of keys among 2 ** (its argument) bits."""
        self.bits = min(self.MOST, max(15, (16 * keys.count()).bit_length()))
        place = at(self.bits).cast("bigint")
        cells = keys.select(F.shiftright(place, 15).alias("k"), place.bitwiseAND(F.lit(32767)).alias("p"))
        rows = cells.groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
        whole = np.zeros(1 << (self.bits - 3), np.uint8)
        for k, m in rows.collect():  # at most 2 ** MOST bits
            whole[k << 12 : (k + 1) << 12] = np.frombuffer(m, np.uint8)
        self.marks = keys.sparkSession.sparkContext.broadcast(whole)


def marked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at these places are set."""
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# --- bytes to words, vectorised over a run of documents ---------------------------------------------------------

_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, 1 << 20)
        for key, r in (("p", _R), ("q", _RINV)):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def byte_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, hash of the lower-cased byte) for each byte value."""
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    to = np.arange(256)
    if lower:
        to[65:91] += 32
    return is_word, _BYTE[to]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of all words of a run of documents, and the word index at which each document begins.

    data: the documents' UTF-8 bytes on end; offsets: len(documents) + 1 byte positions, starting at 0.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = w[inner]  # a document's edge also ends a word
    end = w.copy()
    end[:-1] &= ~w[1:]
    end[inner - 1] = w[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end), np.searchsorted(s, offsets)


def hash_words(data: np.ndarray, offsets: np.ndarray, tab: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of documents, and the word index at which each document begins (see word_spans)."""
    is_word, value = tab
    s, e, first = word_spans(data, offsets, is_word)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), first
    p, q = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * p[:n], out=total[1:])
    return mix64((total[e + 1] - total[s]) * q[s]), first


def runs(column, run_bytes: int = 1 << 20):
    """Cuts an Arrow string column into runs of whole documents of about run_bytes: (first row, bytes, offsets).

    A null counts as empty. A document is never cut, so a run holds one document at least.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + run_bytes, "right")) - 1)
        j = min(j, n)
        yield i, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64)
        i = j
