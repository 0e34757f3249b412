"""Shared helpers: scratch tables, whole-text byte arrays, and 64-bit word hashes.

Words are runs of bytes other than space and tab to carriage return. All
separators and A-Z are ASCII, so working on UTF-8 bytes gives the same words
as working on characters. Words are compared by a 64-bit hash of all their
bytes; nothing is cut.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.functions.scratch import scratch_dir

#: Bytes of text that one vectorised step works on.
CHUNK = 1 << 20
#: Bytes of an Arrow batch handed to Python, about.
BATCH_BYTES = 8 << 20
#: Bits of the fixed-size filter of document ids (1 MB, whatever the input's size).
FILTER_BITS = 1 << 23
_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) with batches bounded by bytes as well as rows, as texts may be very long.

    Python workers serve many tasks; what a task has freed goes back to the machine at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that Python has freed back to the machine."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost no recomputation.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind; the session's setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark = df.sparkSession
    for part in {os.path.dirname(f) for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(part)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (a public finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    sep = np.zeros(256, bool)
    sep[[32, 9, 10, 11, 12, 13]] = True
    return plain, lower, sep


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("p", _P), ("i", _PI)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def sums(h: np.ndarray) -> np.ndarray:
    """Like prefix_hash, over 64-bit values."""
    p, _ = _powers(len(h) + 1)
    s = np.empty(len(h) + 1, np.uint64)
    s[0] = 0
    np.cumsum(mix64(h.copy()) * p[:-1], out=s[1:])
    return s


def prefix_hash(data: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """S with S[j] - S[i] determined by data[i:j] and i; see span_hash."""
    plain, lower, _ = _tables()
    p, _ = _powers(len(data) + 1)
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum((lower if fold_case else plain)[data] * p[:-1], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike for equal bytes wherever they stand."""
    _, inv = _powers(len(s))
    n = (end - start).astype(np.uint64)
    return mix64((s[end] - s[start]) * inv[start] + n * np.uint64(0xD6E8FEB86659FD93))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about limit bytes; a null text is empty; a longer text stands alone."""
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all case-folded words, in order, and for each text the place of its first one (one more at the end).

    sep: which bytes part words, if not white space.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    start, end = word_places(data, offs, _tables()[2] if sep is None else sep)
    return span_hash(prefix_hash(data, True), start, end), np.searchsorted(start, offs)


def word_places(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word."""
    inside = ~sep[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end


def white_space() -> np.ndarray:
    return _tables()[2]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, keep) -> DataFrame:
    """(id, y, text) of about so many labelled documents (a hash of the id picks them, alike at every size), one row each.

    keep: which ids may be learned from. Equal texts count once, so copies can't outweigh others.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep).select(F.col("doc_id").cast("long").alias("id"), F.col(column).alias("y")).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    n = max(y.count(), 1)
    grain = 1 << 20
    y = y.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(grain)) < int(grain * min(1.0, rows / n)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    both = passing(base, "doc", y, "id").join(y, F.col("doc") == F.col("id"))
    return both.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "y"]).select("id", "y", "text")


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """(_fw, _fb): a bitmap of hashed ids, broadcast, of FILTER_BITS bits at any size of input.

    It only saves work: ids that share a bit with a wanted one pass too, and an exact join follows.
    """
    rows = ids.select(F.expr(f"shiftright({_bit(column)}, 6)").alias("_fw"), F.expr(f"shiftleft(1L, cast({_bit(column)} & 63 as int))").alias("_fb"))
    return F.broadcast(rows.groupBy("_fw").agg(F.bit_or("_fb").alias("_fb")))


def flagged(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """df and a column _hit: whether the filter of ids lets the row pass."""
    bits = id_filter(ids, id_column)
    hit = F.coalesce(F.expr(f"shiftright(_fb, cast({_bit(column)} & 63 as int)) & 1 = 1"), F.lit(False))
    return df.join(bits, F.expr(f"shiftright({_bit(column)}, 6)") == F.col("_fw"), "left").withColumn("_hit", hit).drop("_fw", "_fb")


def passing(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows of df whose id is in ids, or shares a bit of the filter with one that is."""
    return flagged(df, column, ids, id_column).where("_hit").drop("_hit")


def _bit(column: str) -> str:
    """A place in the filter; null for a null id."""
    return f"if(`{column}` is null, null, pmod(xxhash64(cast(`{column}` as bigint)), {FILTER_BITS}L))"


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable."""
    low = stars(edges, name=name)
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct())


def stars(edges: DataFrame, known: DataFrame | None = None, name: str = "links") -> DataFrame:
    """(node, component) for the nodes of edges (a, b) that are not the smallest of their component, as a table; known: such a table, whose links count too.

    Alternating large-star and small-star steps on the link table; each step is
    written, so that a lost executor costs one step at most. Nothing of the
    links reaches the driver but a count. The end is seen from the links
    themselves, so no step is made to find that it changes nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    e = written(e if known is None else e.unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v"))), name)
    while True:
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("of")).select("of.x", "of.y")
        low = ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        far = e.join(low, F.col("v") == F.col("x")).select("u", F.col("m").alias("v"))
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        # Done if a node that has a smaller one has no other link.
        sides = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("of"))
        if not sides.groupBy("of.x").agg(F.max("of.up").alias("up"), F.count("*").alias("n")).where("up = 1 and n > 1").count():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
