"""Pieces that several operators share: table access, scratch tables, word hashing."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources.scratch import scratch

# Words are runs of bytes other than these six (space, \t, \n, \v, \f, \r).
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20
PAUSE = 3.0
_collected = 0.0  # when this driver last did

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return scratch(spark)


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The files outlive executors.  Shuffle files of the finished plan are then
    unreachable; collections, ``PAUSE`` seconds apart at least, let Spark's cleaner free them.
    """
    global _collected
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    schema = df.schema
    del df
    if time.monotonic() - _collected > PAUSE:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()
    return spark.read.schema(schema).parquet(path)


def small(run, rows: int = 1000):
    """``run``, a function for mapInArrow, over batches of at most ``rows`` rows; afterwards unused memory is given back.

    Python workers live on between tasks, and two or more share an executor's memory.
    Spark's own batches hold up to 10,000 texts, in buffers outside of the heap;
    the session's limits are lowered to BATCH_ROWS and BATCH_BYTES where they are higher.
    """
    spark = SparkSession.getActiveSession()
    if spark:
        for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
            key = f"spark.sql.execution.arrow.{key}"
            now = spark.conf.get(key).lower().rstrip("b")
            if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
                spark.conf.set(key, str(most))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        give_back()

    return over


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.malloc_trim(0)


_held: dict[str, object] = {}


def held(name: str, make):
    """What ``make`` gives, kept by this worker under a name until another is asked for."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def wrap(docs: DataFrame, *also: str) -> DataFrame:
    """``docs`` as a struct ``__row`` of all columns but text, the text, and columns given by name.

    Operators that carry whole rows add columns of their own beside these, so
    names in ``docs`` can't clash with them.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__row"), "text", *also)


def unwrap(rows: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """Undo ``wrap``: the columns in their order, the text from the named column."""
    return rows.select(*(F.col(text).alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in columns))


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on a uint64 array."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        for k, base in ((0, _BASE), (1, _BASE_INV)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and the start and end of each word in it."""
    a = np.frombuffer(raw, np.uint8)
    flag = np.ones(len(a) + 2, dtype=np.int8)
    flag[1:-1] = IS_SPACE[a]
    edge = np.flatnonzero(np.diff(flag))
    return a, edge[0::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: polynomial prefix sums over the bytes, then mixed."""
    a, start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=sums[1:])
    return fmix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive words; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    k = 1
    for i in range(n):
        k = k * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
        out += words[i : i + m] * _U64(k)
    return fmix(out)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes.  A text of 1 to n-1 words is one shingle; one without words has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    grams = gram_hashes(words, min(n, len(words)))
    return np.unique(grams if len(words) >= n else grams ^ _U64(len(words)))
