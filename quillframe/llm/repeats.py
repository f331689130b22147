"""Substring dedup: remove every word that a window of 20 words covers which occurred before.

Words are runs of non-space bytes, unchanged.  A window's occurrence is removed
if the same words also start earlier: in a smaller doc_id, or earlier in the
same document.

1. Documents with one and the same text (by two hashes and its length) are one
   text in several places.  All its windows start earlier than in any place but
   the least, so the steps below read it there alone.
2. Every window has an anchor, the smallest hash among its ten-word runs, so
   equal windows have equal anchors.  Anchors are counted; those that occur
   again go into a bounded bitmap.
3. Windows whose anchor may recur, or that recur within their document, are
   counted by two hashes.  Those found twice recur; the least (document, start)
   of each is its first occurrence.
4. Texts are read again.  Neighbouring first occurrences are merged into
   passages, whose words are told; neighbouring windows that may recur but are
   not first ones are merged into stretches.  Both are dealt to shards by a
   leading gram, the smallest hash among a window's pairs of words, so a
   stretch meets only the shard that may know it.
5. Each shard compiles the windows of all its passages into one Aho-Corasick
   automaton and streams its stretches through it.  Words are symbols of the
   automaton, so what it finds is equal as text; hashes only choose what it
   reads.  Every occurrence of a passage's windows is located here, and only
   these are removed.
6. The spans found are brought to their documents.

No passage is left out, however rare.  A shard of many passages is split into
automata of ``SHARD`` windows at most; one with many stretches is salted, with
its automaton compiled once for each salt.  So a passage that a third of all
documents hold is streamed by many tasks.

Defined cases: a null text has no words and counts as empty; a text of fewer
than 20 words is kept; a null doc_id is larger than any other (below 2 ** 62),
and rows without one go by hashes of their texts, as rows that share a doc_id
do; rows that repeat a doc_id and text are one document, and each gets its
result; a very long text is read as a whole, its stretches go one by one; a
word of any length is one symbol; an empty table gives no rows; columns of
``docs`` may have any name, as they travel within one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillframe.llm.bitmap import bitmap, maybe_in
from quillframe.llm.common import fmix, gram_hashes, materialise, small, word_bounds, word_hashes

WINDOW, RUN, LEAD = 20, 10, 2
#: Windows of one automaton at most (some 20 nodes each), windows of a passage at most, bytes of stretches for each salt.
SHARD, PASSAGE, SALT_BYTES = 6000, 256, 16 << 20
_NULLS = 1 << 62


def identity() -> list[Column]:
    """``key`` and ``told``: what tells documents apart, in their order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    other = F.lit(_NULLS).bitwiseOR(F.xxhash64(F.lit(1), text).bitwiseAND(_NULLS - 1))
    return [F.coalesce(F.col("doc_id").cast("long"), other).alias("key"), F.xxhash64(text).alias("told")]


def anchors(words: np.ndarray, window: int = WINDOW, run: int = RUN) -> np.ndarray:
    """The smallest hash among the runs of ``run`` words of the window that starts at each word."""
    if len(words) < window:
        return words[:0]
    g = gram_hashes(words, min(run, window))
    width, have = window - min(run, window) + 1, 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[: len(g) - step], g[step:])
        have += step
    return fmix(g)  # minima crowd together; a filter by leading bits needs them spread


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(flag: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of flagged places with one value of ``by``."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (by[at[1:]] != by[at[:-1]]))
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1


def _cut(begin: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``most`` places at most."""
    times = -(-(end - begin) // most)
    if (times <= 1).all():
        return begin, end
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    begin, end = np.repeat(begin, times) + number * most, np.repeat(end, times)
    return begin, np.minimum(end, begin + most)


class _Texts:
    """Every text once: ``rows`` (key, told, text) but for ``copies``, told apart by a bitmap, and few that it takes for copies by chance."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, spark = rows, rows.sparkSession
        named = materialise(rows.select("key", "told", F.xxhash64(F.lit(1), "text").alias("other"), F.length("text").alias("n")))
        # Stored, so that the join with it reads plain exchanges and a group of any size can be split.
        groups = materialise(named.groupBy("told", "other", "n").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least != most").drop("most"))
        self.copies = materialise(named.join(groups, ["told", "other", "n"]).filter("key != least").select("key", "told").distinct().withColumn("h", F.xxhash64("key", "told")))
        found = bitmap(self.copies, "h")
        self.gone = spark.sparkContext.broadcast(found)
        self.rest = materialise(rows.filter(maybe_in(spark, found, F.xxhash64("key", "told"))).join(self.copies.drop("h"), ["key", "told"], "left_anti"))

    def read(self, run, schema: str) -> DataFrame:
        """``run`` over all texts."""
        return self.rows.select("*", _hash()).mapInArrow(small(_without(self.gone, run)), schema).unionByName(self.rest.mapInArrow(small(run), schema))

    def read_with(self, given: DataFrame, column: str, run, schema: str) -> DataFrame:
        """``run`` over all texts, each with its ``column`` of ``given``."""
        few = self.rest.join(given, ["key", "told"], "left").mapInArrow(small(run), schema)
        return _with(self.rows, given, column, ["key", "told", "text"], _without(self.gone, run), schema).unionByName(few)


def _hash() -> Column:
    return F.xxhash64("key", "told").alias("__h")


def _without(shared, run):
    """``run`` over the rows whose hash ``__h`` is not in a bitmap."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.filter(pa.array(~shared.value.has(b.column("__h").to_numpy().view(np.uint64)))) for b in batches)

    return over


def _count_anchors(texts: _Texts, window: int) -> DataFrame:
    """Anchors that at least two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                found = [np.unique(anchors(word_hashes(x.as_py().encode()), window)) for x in b.column("text").slice(at, 500)]
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(values), pa.array(n.astype(np.int64))], ["h", "n"])

    return texts.read(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def _windows(texts: _Texts, shared, window: int) -> DataFrame:
    """h and a (two hashes of a window), n, and its first occurrence among a few hundred documents.

    Of windows whose anchor may recur, and of those that recur within a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys, told = part.column("key").to_numpy(), part.column("told").to_numpy()
                order = np.lexsort((told, keys))
                h, a, n, start, size, who = [], [], [], [], [], []
                for i in order.tolist():
                    words = word_hashes(part.column("text")[i].as_py().encode())
                    if len(words) < window:
                        continue
                    value, first, times = np.unique(gram_hashes(words, window), return_index=True, return_counts=True)
                    anchor = anchors(words, window)[first]
                    some = np.flatnonzero(seen.has(anchor) | (times > 1))
                    if len(some):
                        h.append(value[some])
                        a.append(anchor[some])
                        n.append(times[some])
                        start.append(first[some])
                        size.append(len(some))
                        who.append(i)
                if not h:
                    continue
                h, a, n, start, who = *map(np.concatenate, (h, a, n, start)), np.repeat(who, size)
                # Documents come in order, so the first place of a window is that of its first document.
                # Windows that share the first hash alone may come more than once; Spark's sum puts them together.
                by = np.argsort(h, kind="stable")
                new = np.ones(len(h), bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (a[by][1:] != a[by][:-1])
                one = by[new]
                yield pa.RecordBatch.from_arrays(
                    [_long(h[one]), _long(a[one]), pa.array(np.add.reduceat(n[by], np.flatnonzero(new))), pa.array(keys[who[one]]), pa.array(told[who[one]]), pa.array(start[one])],
                    ["h", "a", "n", "key", "told", "start"])

    return texts.read(run, "h long, a long, n long, key long, told long, start long")


def _pieces(texts: _Texts, firsts: DataFrame, shared, shards: int, window: int) -> DataFrame:
    """Passages (kind 0) and stretches (kind 1) of documents, and their shards; ``firsts`` has the starts of their first occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                keys, told = part.column("key").to_numpy(), part.column("told").to_numpy()
                whose, kinds, shard, begin, end, words = [], [], [], [], [], []
                for i, (x, given) in enumerate(zip(part.column("text"), part.column("starts"), strict=True)):
                    raw = x.as_py().encode()
                    hashes = word_hashes(raw)
                    if len(hashes) < window:
                        continue
                    later = recurring.has(gram_hashes(hashes, window))
                    first = np.zeros(len(later), bool)
                    if given.is_valid:
                        first[given.values.to_numpy()] = True
                        later &= ~first
                    if not (given.is_valid or later.any()):
                        continue
                    lead, (_, left, right) = anchors(hashes, window, LEAD), word_bounds(raw)
                    for kind, (s, e) in ((0, _cut(*_runs(first, lead), PASSAGE)), (1, _runs(later, lead))):
                        whose.append(np.full(len(s), i))
                        kinds.append(np.full(len(s), kind, np.int32))
                        shard.append((lead[s] % np.uint64(shards)).astype(np.int64))
                        begin.append(s)
                        end.append(e)
                        words += [raw[p:q] for p, q in zip(left[s].tolist(), right[e + window - 2].tolist(), strict=True)]
                if words:
                    whose, kinds, shard, begin, end = map(np.concatenate, (whose, kinds, shard, begin, end))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (shard, kinds, keys[whose], told[whose], begin, end - begin)), pa.array([len(w) for w in words], pa.int64()), pa.array(words, pa.binary())],
                        ["shard", "kind", "key", "told", "start", "windows", "bytes", "words"])

    return texts.read_with(firsts, "starts", run, "shard long, kind int, key long, told long, start long, windows long, bytes long, words binary")


def _symbol(i: int) -> str:
    return chr(i + 1 if i < 0xD7FF else i + 0x801)  # no surrogates; \0 is left for words that no passage has


class Passages:
    """An Aho-Corasick automaton over windows of words, each word one symbol."""

    def __init__(self, passages: list[bytes], window: int = WINDOW) -> None:
        self.symbols: dict[bytes, str] = {}
        self.window = window
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        add = self.automaton.add_word
        for p in passages:
            told = "".join([self.symbols.get(w) or self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in p.split()])
            for s in range(len(told) - window + 1):
                add(told[s : s + window])
        self.automaton.make_automaton()

    def starts(self, words: bytes) -> list[int]:
        """Where windows of the passages start."""
        if not len(self.automaton):
            return []
        known, back = self.symbols.get, self.window - 1
        return [end - back for end, _ in self.automaton.iter("".join([known(w, "\0") for w in words.split()]))]


def _locate(dealt: DataFrame, window: int) -> DataFrame:
    """key, told, begin and end (of words) of what the automata find; rows come by shard, salt and part, passages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, passages, automaton = None, [], None
        for b in batches:
            now = np.stack([b.column(c).to_numpy() for c in ("shard", "salt", "part")])
            new = np.concatenate([[True], (now[:, 1:] != now[:, :-1]).any(0)]).tolist() if b.num_rows else []
            whose, begin, end = [], [], []
            for i, (fresh, kind, words) in enumerate(zip(new, b.column("kind").to_pylist(), b.column("words").to_pylist(), strict=True)):
                if fresh and (told := now[:, i].tolist()) != group:
                    group, passages, automaton = told, [], None
                if kind == 0:
                    passages.append(words)
                    continue
                automaton = automaton or Passages(passages, window)
                last = -1
                for s in automaton.starts(words):
                    if s > last:
                        whose.append(i)
                        begin.append(s)
                        end.append(s + window)
                    else:
                        end[-1] = s + window
                    last = s + window
            whose = np.array(whose, np.int64)
            key, told, start = (b.column(c).to_numpy()[whose] for c in ("key", "told", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(told), pa.array(start + np.array(begin, np.int64)), pa.array(start + np.array(end, np.int64))], ["key", "told", "begin", "end"])

    return dealt.select("shard", "salt", "part", "kind", "key", "told", "start", "words").mapInArrow(small(run), "key long, told long, begin long, end long")


def _with_identity(docs: DataFrame) -> DataFrame:
    carried = [c for c in docs.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("__row")
    return docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("text"), *identity())


def _with(rows: DataFrame, given: DataFrame, column: str, columns: list[str], run, schema) -> DataFrame:
    """``run`` over the columns of ``rows``, and a column of ``given`` (key, told, column), null where that has none.

    A bounded bitmap tells which rows may be meant; only these move to be joined.
    Those that stay are chosen by the Python worker that runs over them.
    """
    given = materialise(given.withColumn("h", F.xxhash64("key", "told")))
    found = bitmap(given, "h")
    shared = rows.sparkSession.sparkContext.broadcast(found)

    none = F.lit(None).cast(given.schema[column].dataType).alias(column)
    still = rows.select(*columns, none, _hash()).mapInArrow(small(_without(shared, run)), schema)
    moved = rows.filter(maybe_in(rows.sparkSession, found, F.xxhash64("key", "told"))).join(given.drop("h"), ["key", "told"], "left").select(*columns, column, _hash()).mapInArrow(small(run), schema)
    return still.unionByName(moved)


def located(texts: _Texts, window: int = WINDOW) -> DataFrame:
    """key, told, begin, end: spans of words, in texts read once, that windows cover which started earlier."""
    spark = texts.rows.sparkSession
    anchor = spark.sparkContext.broadcast(bitmap(materialise(_count_anchors(texts, window)), "h"))
    counted = _windows(texts, anchor, window).groupBy("h", "a").agg(F.sum("n").alias("n"), F.min(F.struct("key", "told", "start")).alias("first"))
    repeated = materialise(counted.filter("n > 1").select("h", "first.*"))
    windows = repeated.count()
    recurring = spark.sparkContext.broadcast(bitmap(repeated, "h"))
    # Half full on average, so that most shards need one automaton.
    shards = max(1, 2 * windows // SHARD)
    firsts = repeated.groupBy("key", "told").agg(F.collect_list("start").alias("starts"))  # of one document each
    pieces = materialise(_pieces(texts, firsts, recurring, shards, window))
    known = F.col("kind") == 0
    load = materialise(pieces.groupBy("shard").agg(
        F.ceil(F.sum(F.when(known, F.col("windows"))) / SHARD).cast("int").alias("parts"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(~known, F.col("bytes")).otherwise(0)) / SALT_BYTES)).cast("int").alias("salts"),
        F.max("kind").alias("any")).filter("parts > 0 AND any = 1").drop("any"))
    each = pieces.join(load, "shard")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    passages = each.filter(known).withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int")).withColumn("salt", numbers("salts"))
    stretches = each.filter(~known).withColumn("salt", F.pmod(F.xxhash64("key", "told", "start"), F.col("salts")).cast("int")).withColumn("part", numbers("parts"))
    dealt = passages.unionByName(stretches).repartition("shard", "salt", "part").sortWithinPartitions("shard", "salt", "part", "kind")
    return _locate(dealt, window)


def _finish(rows: DataFrame, spans: DataFrame, window: int, layout: bool) -> DataFrame:
    """Kept text and counts of rows; ``spans`` (key, told, spans) tells what goes: up to an end, or (null) all of ``window`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for x, spans in zip(b.column("text"), b.column("spans"), strict=True):
                words = x.as_py().encode().split()
                removed = 0
                if spans.is_valid and len(words) >= window:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spans.values.field("begin").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("end").fill_null(len(words)).to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(len(words) + removed)
                n_removed.append(removed)
                kept.append(x.as_py() if layout and not removed else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["__row", "n_words", "n_removed", "kept_text"])

    fields = [rows.schema["__row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]
    return _with(rows, spans, "spans", ["__row", "text"], run, StructType(fields))


def remove_repeats(docs: DataFrame, window: int = WINDOW, layout: bool = False) -> DataFrame:
    """``__row`` (a struct of all columns of ``docs`` but text), n_words, n_removed and kept_text.

    kept_text is the kept words with one space between; with ``layout`` a text
    that loses no word is given as it was.
    """
    rows = _with_identity(docs)
    texts = _Texts(rows.select("key", "told", "text"))
    copies = texts.copies.select("key", "told", F.lit(0).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"))
    # A document's spans: rows that repeat it tell them again, so they are counted once.
    spans = located(texts, window).unionByName(copies).distinct().groupBy("key", "told").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return _finish(rows, spans, window, layout)
