"""Best-fit packing into sequences of a fixed number of tokens, by exact-complement hashing.

Packing sees lengths only, and there are at most ``capacity`` of them, so the
plan is made on a histogram (``capacity`` rows on the driver, whatever the
input).  From the longest length down, the gap it leaves is looked up in
indexes of single lengths, sums of pairs and sums of triples that are still
available; a combination that fills the gap exactly is consumed as often as
its scarcest length allows.  What no combination completes goes, longest
first, into the fullest open sequence that still takes it.  A plan is a list
of runs: pieces ``rank`` to ``rank + count - 1`` of a length go to consecutive
sequences, at one offset.

Every piece gets a number when it is stored.  Pieces are ranked within their
length through buckets of these numbers, as many as the length needs for
``BUCKET`` pieces in each, and prefix sums over them.  So a length that most
pieces share is dealt over many tasks, whatever their texts.

Defined cases: a null text is the end token alone; repeated rows are packed as
rows of their own; a very long text is cut into as many pieces as it needs;
pieces of equal length may change places; an empty table gives no rows; other
columns than doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.bpe import encoder_of, merges_by_rank, read_spec
from quillframe.llm.common import materialise, small

CAPACITY = 2048
BUCKET = 100_000


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of every document's ids and end token: doc_id, piece, start, length, ids_crc32, and a number of their own.

    The numbers are fixed once the pieces are stored.  Only a document longer than ``capacity`` is cut; its first piece takes the remainder.
    """
    text = read_spec(tokenizer_path)
    spec = docs.sparkSession.sparkContext.broadcast((text, merges_by_rank(text)))
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(*spec.value)
        next_ = TaskContext.get().partitionId() << 40
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, x in enumerate(b.column("text")):
                ids = encode(x.as_py() or "") + tail
                n = len(ids) // 4
                at, number = 0, 0
                while at < n:
                    size = min(n, (n % capacity or capacity) if not at else capacity)
                    row.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                    at, number = at + size, number + 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(np.arange(next_, next_ + len(row)))], ["doc_id", "piece", "start", "length", "ids_crc32", "number"])
            next_ += len(row)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(small(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long")


class Plan:
    """Runs of (length, rank, count, first sequence, offset), and the number of sequences."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used = np.zeros(capacity + 1, np.int64)

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), count, first, offset))
        self.used[length] += count

    def fill(self, parts: list[int], count: int) -> None:
        """``count`` sequences that each hold ``parts``."""
        first, offset = self.open(count), 0
        for x in parts:
            self.put(x, count, first, offset)
            offset += x


def _complement(have: np.ndarray, gap: int) -> list[int] | None:
    """Available lengths that add up to ``gap``: one, two or three, larger parts first."""
    if have[gap] > 0:
        return [gap]
    if pair := _pair(have, gap):
        return pair
    for c in np.flatnonzero(have[: gap - 1] > 0)[::-1]:
        c = int(c)
        if 3 * c < gap:
            break
        have[c] -= 1
        pair = _pair(have, gap - c)
        have[c] += 1
        if pair and pair[0] <= c:
            return [c, *pair]
    return None


def _pair(have: np.ndarray, total: int) -> list[int] | None:
    """The most uneven pair of available lengths with this sum."""
    if total < 2:
        return None
    half = total // 2
    small = np.arange(1, half + 1)
    good = (have[small] > 0) & (have[total - small] > 0)
    if total % 2 == 0 and have[half] < 2:
        good[-1] = False
    k = int(good.argmax())
    return [total - k - 1, k + 1] if good[k] else None


def plan(counts: np.ndarray) -> Plan:
    """Pack ``counts[length]`` pieces of each length; ``len(counts) - 1`` is the capacity."""
    capacity = len(counts) - 1
    out, have = Plan(capacity), np.array(counts, dtype=np.int64)
    have[0] = 0
    for length in range(capacity, 0, -1):
        while have[length] > 0:
            if length == capacity:
                out.fill([length], int(have[length]))
                have[length] = 0
                break
            have[length] -= 1
            parts = _complement(have, capacity - length)
            have[length] += 1
            if parts is None:
                break
            parts = [length, *parts]
            count = min(int(have[x]) // parts.count(x) for x in set(parts))
            out.fill(parts, count)
            for x in parts:
                have[x] -= count
    # Best fit, longest first.  Open sequences are held as groups of equal room: room -> [(first sequence, count)].
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def opened(room: int, first: int, count: int) -> None:
        if room:
            if not groups.get(room):
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for length in range(capacity, 0, -1):
        while (left := int(have[length])) > 0:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(k)
                take = min(left, count)
                out.put(length, take, first, capacity - room)
                if take < count:
                    opened(room, first + take, count - take)
                opened(room - length, first, take)
                have[length] -= take
            else:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        first = out.open(n)
                        for j in range(k):
                            out.put(length, n, first, j * length)
                        opened(capacity - k * length, first, n)
                have[length] = 0
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset.  ``pieces`` is read twice; give a stored table."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    made = plan(histogram)
    salts = spark.createDataFrame([(int(k), int(-(-histogram[k] // BUCKET))) for k in np.flatnonzero(histogram)], "length long, salts int")  # at most `capacity` rows
    keyed = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("number"), F.col("salts")).cast("int"))
    per = keyed.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, rank, count, first, offset in made.runs:
        runs.setdefault(length, []).append((rank, count, first, offset))
    shared = spark.sparkContext.broadcast({k: np.array(sorted(v), np.int64) for k, v in runs.items()})  # bounded by the lengths there can be
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("number")) - 1
    ranked = keyed.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "within", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                of = table[int(x)]
                k = np.searchsorted(of[:, 0], rank[mine], "right") - 1
                sequence[mine], offset[mine] = of[k, 2] + rank[mine] - of[k, 0], of[k, 3]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(small(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    return pack(materialise(cut(docs, tokenizer_path, capacity, end)), capacity)
