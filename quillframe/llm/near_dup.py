"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification.

A text is its five-word shingles (a text of fewer words is one shingle, one
without words none), each weighted by how often the text has it.  Two texts are
near-duplicates if their weighted Jaccard similarity, the sum of the lesser
weights over that of the greater, is 0.8 or more; classes are the connected
components.  As weights are whole numbers, this is the similarity of the sets
of numbered shingles: the first, the second, ... occurrence of each.

Signatures.  An element of weight w owns the region [0, w) x [0, inf) of a
plane of weight and rank, which holds darts at one per unit of area, placed by
hashes of the element alone.  A set throws the darts below a rank threshold
that leaves it about k (ln k + 2) of them, however large it is; each dart
hashes to one of k coordinates, and a coordinate keeps its earliest dart.  Two
sets agree in a coordinate with the probability of their weighted Jaccard
similarity.  Where a coordinate stays empty the threshold doubles.

Joining.  Equal weighted sets are one node, which gets a number.  Nodes that share a band of four
coordinates are compared, exactly, with the smallest and the largest node of
that bucket, never all with all; with 32 bands a pair at 0.8 meets in none
with a probability of 5e-8.  First every node is verified against the one hub
it shares most bands with; then only pairs that are still in different
components are.  Buckets are aggregated and joined, so one that a third of all
documents share is split like any skewed join.

Completion.  A bucket's hubs may be below 0.8 to two members that are at 0.8
to each other, as where many texts share a passage.  So all nodes that met any
other are joined once more, exactly: with shingles in one order, the rarest
first, two sets at 0.8 share one among the first fifth of each, at places that
leave enough behind it.  Every such pair of different components is verified;
what a text alone holds stands first, so a passage that many share in part
brings few of them together.  Each set also has ``8 * PARITY`` bytes, in which every
element turns one bit; two sets differ in no fewer elements than their bits, so
a pair whose bits differ too much is left out before it is verified.

Defined cases: a null text is empty; texts without words are one class;
repeated rows share a class; a row without doc_id is compared like any other;
a very long text is read as a whole, and its signature takes no longer to
compare; columns of ``docs`` may have any name; class_id is the smallest doc_id of the class (null
only if it has no other); of rows that share this doc_id, or have none, the one
with the smallest digest of its text is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.bitmap import bitmap, maybe_in
from quillframe.llm.common import fmix, gram_hashes, materialise, small, unwrap, word_hashes, wrap
from quillframe.llm.components import components, joined

COORDINATES, BANDS = 128, 32
SIMILARITY = 0.8
SHINGLE = 5
NARROW, WIDE = 2.0**-4, 16.0
PARITY = 8  # numbers of 64 bits that tell sets apart before they are compared
RANKED = 200_000  # shingles at most whose counts order all sets
_U64 = np.uint64
_EMPTY = _U64(0xFFFFFFFFFFFFFFFF)


def _told() -> Column:
    """A digest that tells apart texts, null among them, where doc_ids do not."""
    return F.coalesce(F.md5("text"), F.lit("")).alias("told")


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(11)).astype(np.float64) * 2.0**-53


def _rank_bands(upto: float) -> Iterator[tuple[int, float, float]]:
    """Number, start and width of the rank bands below ``upto``: doubling, then of equal width."""
    start, width, j = 0.0, NARROW, 0
    while start < upto:
        yield j, start, width
        start, j = start + width, j + 1
        width = min(start, WIDE)


def _poisson(mean: float) -> np.ndarray:
    n = np.arange(int(mean + 12 * np.sqrt(mean) + 30))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


_POISSON: dict[float, np.ndarray] = {}


def dart_signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, sets: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures, [set, coordinate], of sets given as (element hash, weight, owner) rows.

    A value names the earliest dart of its coordinate; a set of no weight has
    all values empty.
    """
    total = np.bincount(owner, weight, sets)
    upper = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    lower = np.zeros(sets)
    out = np.full(sets * k, _EMPTY)
    open_ = total > 0
    while open_.any():
        chosen = np.flatnonzero(open_[owner])
        e, w, o = element[chosen], weight[chosen], owner[chosen]
        hi, lo = upper[o], lower[o]
        weight_start, weight_width, nu = 0.0, 1.0, 0
        while len(some := np.flatnonzero(w > weight_start)):
            e, w, o, hi, lo = e[some], w[some], o[some], hi[some], lo[some]
            for j, start, width in _rank_bands(float(hi.max())):
                cell = np.flatnonzero((hi > start) & (lo < start + width))
                if not len(cell):
                    continue
                area = width * weight_width
                if area not in _POISSON:
                    _POISSON[area] = _poisson(area)
                seed = fmix(e[cell] + _U64((nu * 4096 + j) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
                count = np.searchsorted(_POISSON[area], _uniform(seed), "right")
                some = np.flatnonzero(count)
                count = count[some]
                which = np.repeat(cell[some], count)
                number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                h = fmix(np.repeat(seed[some], count) ^ (number.astype(np.uint64) + _U64(1)) * _U64(0xD6E8FEB86659FD93))
                rank = start + width * _uniform(h)
                h2 = fmix(h + _U64(0xA0761D6478BD642F))
                fits = (rank < hi[which]) & (rank >= lo[which]) & (weight_start + weight_width * _uniform(fmix(h2)) < w[which])
                at = o[which[fits]] * k + (h2[fits] % _U64(k)).astype(np.int64)
                np.minimum.at(out, at, rank[fits].view(np.uint64))
            weight_start, nu = weight_start + weight_width, nu + 1
            weight_width = max(1.0, weight_start)
        open_ &= (out.reshape(sets, k) == _EMPTY).any(1)
        lower = np.where(open_, upper, lower)
        upper = np.where(open_, 2 * upper, upper)
    return out.reshape(sets, k)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature."""
    rows = signatures.reshape(len(signatures), bands, -1)
    key = np.zeros(rows.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[2]):
        key = fmix(key ^ rows[:, :, i])
    return key


def weighted_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, sorted, and how often it has each."""
    words = word_hashes(text.encode())
    if len(words) < SHINGLE:
        return gram_hashes(words, len(words)) ^ _U64(len(words)) if len(words) else words, np.ones(min(1, len(words)), np.int64)
    return np.unique(gram_hashes(words, SHINGLE), return_counts=True)


def numbered(element: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The set of numbered shingles, sorted: a shingle's first occurrence has its hash, each further one another."""
    if (times == 1).all():
        return element
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    each = np.repeat(element, times)
    return np.unique(np.where(number > 0, fmix(each + number.astype(np.uint64) * _U64(0xC2B2AE3D27D4EB4F)), each))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, told, a digest of its numbered shingles in two numbers, and the band keys; no bands where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                known: dict[str, int] = {}
                index = [known.setdefault(x or "", len(known)) for x in part.column("text").to_pylist()]
                sets, times = zip(*map(weighted_shingles, known), strict=True)
                owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                keys = band_keys(dart_signatures(np.concatenate(sets), np.concatenate(times).astype(np.float64), owner, len(sets))).view(np.int64)
                digests = np.frombuffer(b"".join(map(_digest, map(numbered, sets, times))), "<i8").reshape(-1, 2)[index]
                bands = [k if len(x) else k[:0] for k, x in zip(keys, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("told"), *map(pa.array, digests.T.copy()), pa.array([bands[i] for i in index], pa.list_(pa.int64()))], ["doc_id", "told", "n1", "n2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _told(), "text").mapInArrow(small(run), f"doc_id {kind}, told string, n1 long, n2 long, bands array<bigint>")


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """a (node), b (hub), shared (number of bands in which they meet)."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter(F.col("least") != F.col("most"))
    met = rows.join(hubs, "band").select("node", F.explode(F.array("least", "most")).alias("hub")).filter(F.col("node") != F.col("hub"))
    return met.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and numbered shingles (binary, sorted unsigned 64-bit) of the documents in ``wanted`` (node, doc_id, told)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [numbered(*weighted_shingles(x.as_py() or "")).tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    ids = wanted.select("node", F.col("doc_id").alias("id"), F.col("told").alias("as_told"))
    rows = docs.select("doc_id", _told(), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("told") == F.col("as_told"))).select("node", "text")
    made = rows.mapInArrow(small(run), "node long, shingles binary")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(common >= similarity * (len(both) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    of_a, of_b = (shingles.select(F.col("node").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    return pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b").mapInArrow(small(run), "a long, b long")


def _counted(shingles: DataFrame) -> DataFrame:
    """h and n of the shingles of at least two nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("shingles")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return shingles.select("shingles").mapInArrow(small(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _ranked(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent shingles: RANKED at most, found by a histogram of bounded size."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    least, held = None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("shingles")).orderBy(F.desc("step")).collect():
        if held + r.shingles > RANKED:
            break
        least, held = r.step, held + r.shingles
    rows = [] if least is None else counted.filter(step >= least).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _parity(s: np.ndarray) -> np.ndarray:
    """PARITY numbers whose bits each element turns."""
    bits = np.bincount((s >> _U64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def _leading(sets: DataFrame, counted: DataFrame, similarity: float) -> DataFrame:
    """h, node, label, size, parity bits and place of the shingles that two sets at ``similarity`` can't all differ in.

    Any order serves that is the same for all sets; shingles without a rank
    count as the rarest.  Those of one node alone keep their place, but meet none.
    """
    shared = sets.sparkSession.sparkContext.broadcast((bitmap(counted, "h"), *_ranked(counted)))
    parity = [f"bits{k}" for k in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known, count = shared.value
        for b in batches:
            h, size, place, bits = [], [], [], []
            for x in b.column("shingles"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                n = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    n = np.where(known[at] == s, count[at], 0)
                lead = np.lexsort((s, n))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]
                some = np.flatnonzero(seen.has(s[lead]))
                h.append(s[lead[some]])
                size.append(len(s))
                bits.append(_parity(s))
                place.append(some)
            of = np.repeat(np.arange(b.num_rows), [len(p) for p in place])
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(h).view(np.int64)), b.column("node").take(row), b.column("label").take(row),
                pa.array(np.array(size, np.int32)[of]), pa.array(np.concatenate(place).astype(np.int32)),
                *map(pa.array, np.array(bits)[of].T.copy()),
            ], ["h", "node", "label", "size", "place", *parity])

    return sets.select("node", "label", "shingles").mapInArrow(small(run), "h long, node long, label long, size int, place int, " + ", ".join(f"{k} long" for k in parity))


def missed_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a and b: a superset of the pairs of ``sets`` (node, label, shingles) at ``similarity`` whose labels differ."""
    rows = materialise(_leading(sets, materialise(_counted(sets)), similarity))
    # Pairs within the largest label of a shingle are never looked at, so a large class costs no square of its size.
    each = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = materialise(each.groupBy("h").agg(F.max_by("label", "n").alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("h", "main"))
    met = materialise(rows.join(mixed, "h").withColumn("main", F.col("label") == F.col("main")))
    x, y = (met.select("h", *(F.col(c).alias(f"{c}_{k}") for c in met.columns if c != "h")) for k in "xy")
    both = F.col("size_x") + F.col("size_y")
    differ = F.lit(0)
    for k in range(PARITY):
        differ += F.bit_count(F.col(f"bits{k}_x").bitwiseXOR(F.col(f"bits{k}_y")))
    fits = (
        (F.col("label_x") != F.col("label_y")) & (F.col("main_y") | (F.col("node_x") < F.col("node_y")))
        & (F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y") - 1e-6)
        & (F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) >= similarity / (1 + similarity) * both - 1e-6)
        & (differ <= (1 - similarity) / (1 + similarity) * both + 1e-6)
    )
    pairs = x.filter(~F.col("main_x")).withColumnRenamed("h", "h_x").join(y, (F.col("h_x") == F.col("h")) & fits)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, told, class_id and stays (whether it is the one of its class) of every document."""
    marks = materialise(signed(docs))
    told = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "told")).alias("best")
    # The number is fixed once the table is written; all that follows joins and groups by it alone.
    nodes = materialise(marks.groupBy("n1", "n2").agg(told, F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    pairs = materialise(candidate_pairs(nodes))
    in_pairs = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shingles = materialise(shingles_of(docs, nodes.join(in_pairs, "node").select("node", "best.doc_id", "best.told")))
    # The hub that a node shares most bands with; of several the largest number, so that nodes agree. Numbers stay below 2 ** 56.
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("hub"), "shared").union(pairs.select("b", "a", "shared"))
    near = both.groupBy("node").agg(F.max(F.shiftleft("shared", 56).bitwiseOR(F.col("hub"))).alias("hub")).withColumn("hub", F.col("hub").bitwiseAND((1 << 56) - 1))
    best = materialise(near.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    first = materialise(verified(best, shingles))
    labels = components(first)
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    second = materialise(verified(apart.join(best, ["a", "b"], "left_anti"), shingles))
    if not second.isEmpty():
        labels = joined(labels, second)
    sets = materialise(shingles.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "shingles"))
    third = materialise(verified(materialise(missed_pairs(sets)), shingles))
    if not third.isEmpty():
        labels = joined(labels, third)
    labelled = materialise(nodes.select("n1", "n2", "node", "best").join(labels, "node", "left").select("n1", "n2", "best", F.coalesce("label", "node").alias("label")))
    # Stored, so that the join below reads plain exchanges and a class of any size can be split.
    least = materialise(labelled.groupBy("label").agg(F.min("best").alias("best")))
    of_node = materialise(labelled.select("n1", "n2", "label").join(least, "label").select("n1", "n2", "best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("told") == F.col("best.told"))
    return marks.select("doc_id", "told", "n1", "n2").join(of_node, ["n1", "n2"]).select("doc_id", "told", F.col("best.doc_id").alias("class_id"), stays.alias("stays"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept; one document of each class is kept."""
    return classes(docs).select("doc_id", "class_id", F.col("stays").alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose class has another document that stays.

    What goes is found by doc_id and digest of the text.  A bounded bitmap tells which rows may be
    meant; only these move to be joined, all others stay where they are.
    """
    found = classes(docs).groupBy("doc_id", "told").agg(F.min("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    named = materialise(found.filter(~F.col("stays") | (F.col("rows") > 1)).withColumn("h", F.xxhash64("doc_id", "told")))
    probed = wrap(docs, "doc_id").withColumn("told", _told()).withColumn("named", maybe_in(docs.sparkSession, bitmap(named, "h"), F.xxhash64("doc_id", "told")))
    gone = named.filter(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("told").alias("gone_told"))
    # Rows that repeat a doc_id and text are one document.
    moved = probed.filter("named").join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("told") == F.col("gone_told")), "left_anti").dropDuplicates(["doc_id", "text"])
    return unwrap(probed.filter(~F.col("named")).unionByName(moved), docs.columns)
