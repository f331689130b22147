"""Sharding through fixed virtual slots.

Every record hashes into one of thousands of slots.  Bytes and rows are summed
per slot (a result of ``slots`` rows at most, whatever the input), and a
slot-to-shard map with versions says where each slot lives.  Rebalancing edits
the map, so only the slots named by an edit move.  A record's place within its
shard is the start of its slot there plus its rank within the slot, so no task
sees more than one slot's rows of four small numbers.

Defined cases: a null text has 0 bytes and the checksum of no bytes; a null
doc_id is hashed like any other value, together with the text's size and
checksum, so many rows without one (or with the same) go to many slots; rows
that repeat a doc_id and text are records of their own, in the same slot; a very
long text weighs what it has bytes, and its shard gets less of others; records
that tie within a slot take its places in either order; an empty table gives no
rows; other columns than doc_id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, scratch_dir

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, start long"


@dataclass(frozen=True)
class SlotMap:
    """Shard of each slot, under a version that grows with each edit."""

    shard: np.ndarray
    shards: int
    version: int = 1

    @classmethod
    def uniform(cls, slots: int, shards: int) -> SlotMap:
        return cls(np.arange(slots) % shards, shards)

    def rebalanced(self, weight: np.ndarray) -> SlotMap:
        """Move slots from the heaviest shard to the lightest while that narrows the gap.

        Where no single move helps, a swap of two slots is tried.  Each step
        lowers the sum of squared loads, so it ends.
        """
        shard, load = self.shard.copy(), np.bincount(self.shard, weight, self.shards)
        for _ in range(64 * len(shard)):
            hi, lo = int(load.argmax()), int(load.argmin())
            gap = load[hi] - load[lo]
            mine = np.flatnonzero((shard == hi) & (weight > 0))
            mine = mine[np.argsort(weight[mine], kind="stable")]
            w = weight[mine]
            fits = w < gap
            if fits.any():
                k = int(np.abs(np.where(fits, w, np.inf) - gap / 2).argmin())
                shard[mine[k]] = lo
                load[hi] -= w[k]
                load[lo] += w[k]
                continue
            theirs = np.flatnonzero((shard == lo) & (weight > 0))
            theirs = theirs[np.argsort(weight[theirs], kind="stable")]
            best = None
            for t in theirs:
                k = int(np.searchsorted(w, weight[t] + gap / 2))
                for j in (k - 1, k):
                    if 0 <= j < len(w) and 0 < (d := w[j] - weight[t]) < gap and (best is None or abs(d - gap / 2) < best[0]):
                        best = (abs(d - gap / 2), mine[j], t, d)
            if best is None:
                break
            shard[best[1]], shard[best[2]] = lo, hi
            load[hi] -= best[3]
            load[lo] += best[3]
        return self if (shard == self.shard).all() else replace(self, shard=shard, version=self.version + 1)

    def grown(self, weight: np.ndarray) -> SlotMap:
        """One more shard; it takes slots from the others, and no other slot moves."""
        shard, load = self.shard.copy(), np.bincount(self.shard, weight, self.shards + 1)
        goal = weight.sum() / (self.shards + 1)
        for s in np.argsort(-weight, kind="stable"):
            old = shard[s]
            if old != self.shards and load[old] - weight[s] / 2 >= goal and load[self.shards] + weight[s] / 2 <= goal and weight[s] > 0:
                load[old] -= weight[s]
                load[self.shards] += weight[s]
                shard[s] = self.shards
        return SlotMap(shard, self.shards + 1, self.version + 1)

    def save(self, spark: SparkSession, path: str, rows: np.ndarray) -> None:
        """Add this version to the table at ``path``; earlier versions stay readable."""
        order = np.lexsort((np.arange(len(self.shard)), self.shard))
        before = np.cumsum(rows[order]) - rows[order]
        first = {int(s): int(b) for s, b in reversed(list(zip(self.shard[order], before, strict=True)))}
        data = [(self.version, int(k), int(self.shard[k]), int(b) - first[int(self.shard[k])]) for k, b in zip(order, before, strict=True)]
        spark.createDataFrame(data, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == version)


def virtual_slot(slots: int = SLOTS) -> Column:
    """The slot of a record: a hash of its doc_id, size and checksum, which no other record has a part in."""
    return F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Place every document: doc_id, size, text_crc32, virtual_slot, map_version, shard, slot.

    The first version of the map deals slots round-robin; where bytes are
    uneven the next one moves slots until the shards weigh the same.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    sized = materialise(sized.withColumn("virtual_slot", virtual_slot(slots)))
    per_slot = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    weight, rows = np.zeros(slots), np.zeros(slots, np.int64)
    for r in per_slot:
        weight[r.virtual_slot], rows[r.virtual_slot] = r.bytes, r.rows
    path = map_path or scratch_dir(spark)
    first = SlotMap.uniform(slots, shards)
    first.save(spark, path, rows)
    used = first.rebalanced(weight)
    if used.version > first.version:
        used.save(spark, path, rows)
    placed = sized.withColumn("rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1)
    # The map has `slots` rows, whatever the input.
    return placed.join(F.broadcast(load_map(spark, path, used.version)), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "virtual_slot", F.col("version").alias("map_version"))
