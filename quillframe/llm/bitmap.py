"""A bounded one-hash filter: a bitmap that Spark fills and every task reads.

A value that was put in is always found; others are found by chance, at about
the share of bits set.  Its size follows the number of values up to a fixed
bound, beyond which only more chance hits pass, so what is broadcast stays
bounded at any scale and no result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import small

SEGMENT_BITS = 16
LEAST_BITS, MOST_BITS = 17, 28  # 16 KB to 32 MB
SPARSE = 6  # 2 ** SPARSE bits for each value, within these bounds


class Bitmap:
    def __init__(self, bits: int, segments: dict[int, bytes]) -> None:
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), np.uint8)
        size = 1 << (SEGMENT_BITS - 3)
        for k, b in segments.items():
            self.data[k * size : (k + 1) * size] = np.frombuffer(b, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each uint64 hash may have been put in."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap(values: DataFrame, column: str) -> Bitmap:
    """The bitmap of a long column of evenly spread hashes; ``values`` is read twice."""
    n = max(1, values.count())
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + SPARSE))
    width = 1 << SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            segment = at >> SEGMENT_BITS
            for k in np.unique(segment):
                flags = held.setdefault(int(k), np.zeros(width, bool))
                flags[at[segment == k] & (width - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(f, bitorder="little").tobytes() for f in held.values()], pa.binary())], ["segment", "flags"])

    dealt = values.select(F.col(column).alias("h")).repartition(F.shiftrightunsigned("h", 64 - bits + SEGMENT_BITS))
    rows = dealt.mapInArrow(small(run), "segment int, flags binary").collect()  # the whole bitmap: MOST_BITS bits at most
    return Bitmap(bits, {r.segment: bytes(r.flags) for r in rows})


def maybe_in(spark, found: Bitmap, hashes: Column) -> Column:
    """A boolean column: whether each long hash may be in the bitmap."""
    shared = spark.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        return pa.array(shared.value.has(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return probe(hashes)
