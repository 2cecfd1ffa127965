"""Shared folders and vectorised word hashing for the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/barloom"
#: Whether a query's shuffle files go when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a filter for each of its keys, and bits in one of its rows.
FILTER_BITS, FILTER_ROW = 16, 1 << 15


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder; it goes when the session's file systems close.

    Without ``spark.checkpoint.dir`` only a local master has a folder that all tasks see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_CHECKPOINTS
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives lost executors. What was shuffled for it goes
    at once, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = workspace(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def perhaps(rows: DataFrame, keys: DataFrame, on: list[str], many: int) -> DataFrame:
    """``rows`` with ``__perhaps``: false only where no row of ``keys``, which has ``many``, is equal in ``on``.

    A filter of FILTER_BITS bits a key is broadcast instead of the keys; one row in FILTER_BITS that has no key passes it.
    """
    size = -(-FILTER_BITS * many // FILTER_ROW) * FILTER_ROW
    place = F.pmod(F.xxhash64(*on), F.lit(size))
    block, bit = F.floor(place / FILTER_ROW).alias("__block"), (place % FILTER_ROW).alias("__bit")
    bits = keys.select(block, bit).groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    is_set = F.expr("getbit(cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(__bit % 8 as int)) = 1")
    found = rows.withColumns({"__block": block, "__bit": bit}).join(F.broadcast(bits), "__block", "left")
    return found.withColumn("__perhaps", F.coalesce(is_set, F.lit(False))).drop("__block", "__bit", "__bits")


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``used`` under names that meet no others, and what gives a result its columns back."""
    own = [c if c in used else f"__aside{k}" for k, c in enumerate(docs.columns)]
    names = docs.columns
    return docs.toDF(*own), lambda df: df.select(*own).toDF(*names)


def partitions(df: DataFrame) -> int:
    """Partitions for an explicit repartitioning: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's decimal text leaves 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vectorised words -------------------------------------------------------

_SLICE_BYTES = 1 << 20
#: malloc_trim of the C library, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_kept: dict[str, dict] = {}


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte; A-Z share those of a-z."""
    v = mix(np.arange(1, 257, dtype=np.uint64))
    v[ord("A") : ord("Z") + 1] = v[ord("a") : ord("z") + 1]
    return v


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTES = _byte_values()


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    powers = kept("texts")
    if not powers or len(powers["up"]) < n:
        up, down = np.full(n, _P, np.uint64), np.full(n, _P_INV, np.uint64)
        up[0] = down[0] = 1
        powers |= {"up": np.cumprod(up, dtype=np.uint64), "down": np.cumprod(down, dtype=np.uint64)}
    return powers["up"][:n], powers["down"][:n]


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def kept(work: str) -> dict:
    """What this worker keeps from task to task for one kind of work. What it kept for another kind goes, as an executor
    has more workers than tasks and each would come to hold the aids of all the work there was."""
    if work not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[work] = {}
    return _kept[work]


def text_slices(col: pa.Array, size: int = _SLICE_BYTES):
    """Yields (first row, byte buffer, offsets of rows within it) in runs of whole rows of about ``size`` bytes; null is
    empty. What is freed on the way goes back to the system at the end, as the worker may long be idle after it."""
    kept("texts")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    give_back()


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of bytes for which ``inside`` is true, within one row.

    Returns their starts and ends in ``buf``, their 64-bit hashes (A-Z as a-z) and, for each row, the index of its
    first word, with the number of words last. Different words share a hash with probability about 2**-64 a pair.
    """
    m = inside[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = m[:-1]
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = m[1:]
    start = np.flatnonzero(m & (~before | edge[:-1]))
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    up, down = _power_table(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[buf] * up[:-1], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start]), np.searchsorted(start, off)


def inside_table(outside: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes out of the given inclusive ranges."""
    t = np.ones(256, bool)
    for a, b in outside:
        t[a : b + 1] = False
    return t


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters and all beyond ASCII.
ALNUM = inside_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: [^\x20\x09-\x0D]: all but ASCII white space.
DARK = inside_table([(0x20, 0x20), (0x09, 0x0D)])
