"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct hashes of a text's five-word
shingles (a text of fewer words is one shingle, one without words none).
Sketches merge by taking the smallest of both, so a sketch of parts is that of
the whole; two of them estimate resemblance, containment and the number of
distinct shingles.

Defined cases: a null text is empty; two empty sketches resemble each other
fully, and an empty one resembles no other; equal texts have equal
fingerprints; a very long text is hashed as a whole; a null doc_id comes last in
descending order; rows with equal doc_ids follow each other by a hash of their
texts, so many of them are dealt over many ranges (rows that repeat a doc_id
and text share one); an empty table gives no rows; other columns than doc_id
and text play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import shingle_set, small, word_hashes

K = 128
SHINGLE = 5
_LOWEST = -(2**63)


def sketch(text: str, k: int = K, n: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes, sorted."""
    return shingle_set(word_hashes(text.encode()), n)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    first = np.concatenate([[True], ~same])
    union = int(min(k, first.sum()))
    bound = both[first][union - 1]
    return float((both[1:][same] <= bound).sum()) / union


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k=k), k)
    return min(1.0, shared / distinct(a, k))


def to_string(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([to_string(sketch(x.as_py() or "")) for x in b.column("text")], pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(small(run), f"doc_id {kind}, fingerprint string")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint for each value of ``key`` over rows with a ``fingerprint``.

    Sketches merge within partitions first, so a key gets no more than a few
    rows from each, however many documents it has.
    """
    kind = prints.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), type=key_type), pa.array(list(map(to_string, held.values())), pa.string())], [key, "fingerprint"])
        key_type = None
        for b in batches:
            key_type = b.schema.field(key).type
            for x, s in zip(b.column(key).to_pylist(), b.column("fingerprint").to_pylist(), strict=True):
                new = from_string(s)
                held[x] = merge(held[x], new, k=k) if x in held else new
            if len(held) > 20_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    schema = f"`{key}` {kind}, fingerprint string"
    once = prints.select(key, "fingerprint").mapInArrow(small(run), schema)
    spread = once.withColumn("__salt", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
    again = spread.repartition(key, "__salt").select(key, "fingerprint").mapInArrow(small(run), schema)
    return again.repartition(key).mapInArrow(small(run), schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in descending order of doc_id within ranges: doc_id, text, bucket, guest.

    Each range ends with a guest, the row that follows it in the whole order
    (after the last row of all comes the first), so every row's successor is
    the next one of its partition.  Only the ranges' ends, a few numbers for
    each partition, pass through the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.xxhash64(text).alias("told"))
    cuts = sorted(map(int, keyed.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    # A key at which several ranges would end is split among them by the hash of the text.
    limits = [(k, _LOWEST + (j + 1) * (1 << 64) // n - 1) for k, n in sorted(Counter(cuts).items()) for j in range(n)]
    dealt = keyed.withColumn("bucket", _before(limits, F.col("key"), F.col("told")))
    ends = dealt.groupBy("bucket").agg(F.max(F.struct("key", "told")).alias("top")).orderBy("bucket").collect()
    above = [(r.top.key, r.top.told, ends[(i + 1) % len(ends)].bucket) for i, r in enumerate(ends)]
    guests = spark.createDataFrame(above, "key long, told long, at int")  # one row for each range
    both = dealt.join(F.broadcast(guests), ["key", "told"], "left").withColumn("to", F.explode(F.array_compact(F.array(
        F.struct("bucket", F.lit(0).alias("guest")), F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("bucket"), F.lit(1).alias("guest")))))))
    return both.select("doc_id", "text", "key", "told", "to.bucket", "to.guest").repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc("told"))


def _before(limits: list[tuple[int, int]], key: Column, told: Column) -> Column:
    """How many of the sorted pairs are less than (key, told): a binary search, as an expression."""
    steps = [1 << k for k in range(len(limits).bit_length())][::-1]
    if not steps:
        return F.lit(0)
    full = limits + [(2**63 - 1, 2**63 - 1)] * (2 * steps[0] - 1 - len(limits))
    keys, hashes = (F.array(*(F.lit(x[k]) for x in full)) for k in (0, 1))

    def further(at: Column, step: Column) -> Column:
        k, t = F.element_at(keys, at + step), F.element_at(hashes, at + step)
        return F.when((k < key) | ((k == key) & (t < told)), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles and edited_contained.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "edited_contained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None
        for b in batches:
            ids = b.column("doc_id")
            types = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            for doc_id, text, bucket, guest in zip(ids.to_pylist(), b.column("text").to_pylist(), b.column("bucket").to_pylist(), b.column("guest").to_pylist(), strict=True):
                own = sketch(text)
                if last and last[2] == bucket:
                    before, its_text, _, its = last
                    n = len(its_text)
                    new = its_text[: n - n // 3] + text[: n // 3]
                    other = sketch(new)
                    rows.append((before, n, hashlib.sha256(new.encode()).hexdigest(), to_string(its), to_string(other), resemblance(its, other), resemblance(its, own), distinct(its), containment(its, other)))
                # Rows after the first guest are others with its key.
                last = None if guest else (doc_id, text, bucket, own)
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs).select("doc_id", "text", "bucket", "guest").mapInArrow(small(run), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, edited_contained double")
