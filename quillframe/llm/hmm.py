"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Words are lower-cased (A-Z only) runs of non-space bytes; every text ends with
an end token.  The ``SYMBOLS`` most frequent words of the training texts, if
seen ``LEAST_SEEN`` times, have emission probabilities of their own.  Every other word is emitted as one of a
few classes by its form, and within its class by its add-one count, with one
share for all words never seen, so the model is a distribution over all texts.

Training.  Each pass reads all training texts: every partition runs scaled
forward and backward recursions and gives its expected counts, which Spark
sums; the driver gets one row per symbol.  Passes end when the likelihood of
the training texts rises by less than ``LEAST_GAIN`` a token, or after
``PASSES``; the model keeps the likelihood of each pass.

Texts are sequences from their start to their end.  One that is longer than
``STRETCH`` tokens is read in stretches that run side by side: the transfer
matrix of each stretch (forward recursions from every state) carries the scaled
alpha and beta across its borders, so counts and likelihoods are those of the
unbroken recursion and memory stays bounded.

Counts of all words stay in Spark.  Only the ``FREQUENT`` most frequent, by
count and then by word, are sent to executors; the other words of each text are
joined with the counts table, so no vocabulary needs to fit in memory, and
scores do not depend on ``FREQUENT`` as long as it is no less than ``SYMBOLS``.

Defined cases: a null text is the end token alone, as an empty one is; a null
doc_id counts as the empty text where rows are held out; repeated rows count as
often as they occur; a very long text is read in stretches; an empty table
gives no rows; without training texts N and V are 0 and every symbol is equally
likely; words of equal count go by their bytes; other columns than doc_id and
text play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise, small

FREQUENT, SYMBOLS = 150_000, 30_000
STATES, PASSES, LEAST_GAIN = 8, 3, 0.02
#: Words seen less often have no symbol of their own, so that classes tell how likely words are that were never seen;
#: tokens that are added to each symbol, dealt over states as all tokens are.
LEAST_SEEN, SMOOTH = 3, 0.5
STRETCH = 1 << 15
END = b"\n"  # no word holds a line feed
#: Classes of words without a symbol of their own, by form.
CLASSES = 8


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def form(word: bytes) -> int:
    """The class of a word: letters or not, ASCII or not, its length, and a stop at its end."""
    if word.isalpha():
        return 0 if len(word) <= 6 else 1 if len(word) <= 10 else 2
    if not word.isascii():
        return 3 if word[-1:] not in (b".", b",") else 4
    if word[-1:] in b".,!?;:" and word[:-1].isalpha():
        return 5
    return 6 if any(48 <= c <= 57 for c in word) else 7


@dataclass
class Vocabulary:
    """Frequent words and what is known of all others."""

    number: dict[bytes, int]  # of each frequent word, by descending count
    count: np.ndarray  # its count
    symbol: np.ndarray  # its symbol; the classes come first
    tokens: int  # N
    distinct: int  # V
    class_tokens: np.ndarray  # tokens and distinct words of each class, over words without a symbol
    class_words: np.ndarray
    share: np.ndarray = field(init=False)  # log10 of a frequent word's share of its class; 0 if it has a symbol

    def __post_init__(self) -> None:
        k = np.minimum(self.symbol, CLASSES - 1)
        self.share = np.where(self.symbol < CLASSES, np.log10(self.count + 1) - np.log10(self.class_tokens[k] + self.class_words[k] + 1), 0.0)

    @property
    def symbols(self) -> int:
        return CLASSES + int((self.symbol >= CLASSES).sum())


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary) and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array(list(map(form, seen)), pa.int32())], ["word", "n", "form"])
        for b in batches:
            for x in b.column("text"):
                seen.update(tokens(x.as_py()))
            if len(seen) > 200_000:
                yield told()
                seen.clear()
        yield told()

    return docs.select("text").mapInArrow(small(run), "word binary, n long, form int").groupBy("word", "form").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """``counts`` is a stored table.  The driver gets FREQUENT rows at most, one for each class, and a histogram of bounded size."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    least, held, next_ = None, 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():  # 16 steps for each doubling of counts
        if held + r.words > FREQUENT:
            next_ = r.step
            break
        least, held = r.step, held + r.words
    top = [] if least is None else counts.filter(step >= least).collect()
    if next_ is not None and held < FREQUENT:  # the rest from the step that is too large, by count and word
        top += counts.filter(step == next_).orderBy(F.desc("n"), "word").limit(FREQUENT - held).collect()
    top.sort(key=lambda r: (-r.n, bytes(r.word)))
    own = [r for r in top[:SYMBOLS] if r.n >= LEAST_SEEN]
    sums = counts.groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    n, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        n[r.form], words[r.form] = r.n, r.words
    total, distinct = int(n.sum()), int(words.sum())
    for r in own:
        n[r.form] -= r.n
        words[r.form] -= 1
    symbol = np.array([CLASSES + i if i < len(own) else r.form for i, r in enumerate(top)], np.int64)
    return Vocabulary({bytes(r.word): i for i, r in enumerate(top)}, np.array([r.n for r in top], np.float64), symbol, total, distinct, n, words)


@dataclass
class Model:
    """start[state], move[state, next] and emit[symbol, state]; log10 likelihood of the training texts before each pass."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: list[float] = field(default_factory=list)

    @classmethod
    def first(cls, prior: np.ndarray, states: int, seed: int = 11) -> Model:
        """Emissions near the symbols' frequencies, states that mostly stay."""
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * rng.gamma(4.0, 0.25, (len(prior), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))


def _stack(sequences: list[np.ndarray], none: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length as [time, row], with ``none`` behind their ends; how many rows each time has; their order."""
    size = np.array([len(s) for s in sequences])
    order = np.argsort(-size, kind="stable")
    x = np.full((int(size.max(initial=0)), len(sequences)), none, np.uint16)
    for row, i in enumerate(order):
        x[: size[i], row] = sequences[i]
    return x, len(sequences) - np.searchsorted(np.sort(size), np.arange(len(x)), "right"), order


def _groups(sequences: list[np.ndarray], most: int = 1 << 17) -> Iterator[list[int]]:
    """Sequences of like length, by their places; a group's table holds ``most`` tokens, or one sequence."""
    by_size = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(by_size):
        width = max(1, most // max(1, len(sequences[by_size[at]])))
        yield by_size[at : at + width]
        at += width


def _transfers(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each sequence, [state at its first token, state at its last], scaled to a sum of one, and log10 of the scale.

    The first token's emission is not in it, the last one's is.
    """
    s = len(model.start)
    out, log = np.zeros((len(sequences), s, s)), np.zeros(len(sequences))
    for group in _groups(sequences, (1 << 17) // s):
        x, rows, order = _stack([sequences[i] for i in group])
        now, scale = np.broadcast_to(np.eye(s), (len(group), s, s)).copy(), np.zeros(len(group))
        for t in range(1, len(x)):
            n = rows[t]
            now[:n] = (now[:n].reshape(-1, s) @ model.move).reshape(n, s, s) * model.emit[x[t, :n]][:, None, :]
            if t % 8 == 0 or t == len(x) - 1:  # the ends of shorter ones are scaled by the next step that is
                total = now.sum((1, 2))
                now /= total[:, None, None]
                scale += np.log10(total)
        for row, i in enumerate(order):
            out[group[i]], log[group[i]] = now[row], scale[row]
    return out, log


@dataclass
class _Stretches:
    """Texts in stretches that share their border tokens, with what comes in from the left and from the right of each.

    ``alpha`` is the scaled alpha of a stretch's first token, ``beta`` the beta
    of its last, ``ends`` tells whether it ends its text.
    """

    parts: list[np.ndarray]
    alpha: np.ndarray
    beta: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # the number of each text's first stretch
    log10: np.ndarray  # the likelihood of each text of several stretches; of others, of the first token
    whole: np.ndarray  # whether a stretch is all of its text

    @classmethod
    def of(cls, model: Model, sequences: list[np.ndarray], stretch: int = 0) -> _Stretches:
        stretch = stretch or STRETCH
        parts, first, ends = [], [], []
        for q in sequences:
            first.append(len(parts))
            cuts = range(0, max(1, len(q) - 1), stretch)
            parts += [q[c : c + stretch + 1] for c in cuts]
            ends += [False] * (len(cuts) - 1) + [True]
        ends, first, s = np.array(ends, bool), np.array(first, np.int64), len(model.start)
        alpha, beta, log = np.zeros((len(parts), s)), np.ones((len(parts), s)), np.zeros(len(sequences))
        begin = model.start * model.emit[[q[0] for q in sequences]]
        alpha[first] = begin / begin.sum(1, keepdims=True)
        log += np.log10(begin.sum(1))
        # Only texts of several stretches need the matrices.
        several = [(k, int(f), int(e)) for k, (f, e) in enumerate(zip(first, [*first[1:], len(parts)], strict=True)) if e - f > 1]
        where = [i for _, f, e in several for i in range(f, e)]
        through, scale = _transfers(model, [parts[i] for i in where])
        at = {i: j for j, i in enumerate(where)}
        for k, f, e in several:
            for i in range(f, e):
                on = alpha[i] @ through[at[i]]
                log[k] += np.log10(on.sum()) + scale[at[i]]
                if i + 1 < e:
                    alpha[i + 1] = on / on.sum()
            for i in range(e - 1, f, -1):
                back = through[at[i]] @ beta[i]
                beta[i - 1] = back / (alpha[i] @ back)
        whole = ends.copy()
        whole[where] = False
        return cls(parts, alpha, beta, ends, first, log, whole)


def forward(model: Model, sequences: list[np.ndarray], stretch: int = 0) -> np.ndarray:
    """log10 likelihood of each sequence, by the scaled forward recursion."""
    if not sequences:
        return np.zeros(0)
    cut = _Stretches.of(model, sequences, stretch)
    out = cut.log10.copy()
    ones = np.ones(len(model.start))
    # Texts of several stretches are done; all others run side by side.
    alone = np.flatnonzero(cut.whole[cut.first])
    parts = [cut.parts[cut.first[k]] for k in alone]
    for group in _groups(parts):
        x, rows, order = _stack([parts[i] for i in group])
        alpha = cut.alpha[cut.first[alone[[group[i] for i in order]]]]
        scales = np.ones(x.shape)
        for t in range(1, len(x)):
            n = rows[t]
            alpha = (alpha[:n] @ model.move) * model.emit[x[t, :n]]
            scales[t, :n] = scale = alpha @ ones
            alpha = alpha / scale[:, None]
        log = np.log10(scales).sum(0)
        for row, i in enumerate(order):
            out[alone[group[i]]] += log[row]
    return out


def expected(model: Model, sequences: list[np.ndarray], stretch: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions of whole sequences, and the log10 likelihood.

    Only the two recursions go step by step, in single precision; what needs
    both is computed for all steps at once.
    """
    s, single = len(model.start), np.float32
    move_, ones = model.move.astype(single), np.ones(s, single)
    back = np.ascontiguousarray(move_.T)
    none = len(model.emit)  # what stands behind a sequence's end; no state emits it
    emit_ = np.concatenate([model.emit, np.zeros((1, s))]).astype(single)
    cut = _Stretches.of(model, sequences, stretch)
    move, emit, likelihood = np.zeros((s, s)), np.zeros((s, none + 1)), 0.0
    starts = np.zeros(len(cut.parts), bool)
    starts[cut.first] = True
    start = np.zeros(s)
    for group in _groups(cut.parts):
        x, rows, order = _stack([cut.parts[i] for i in group], none)
        of = np.array(group)[order]
        steps, width = x.shape
        size = np.array([len(cut.parts[i]) for i in of])
        given = emit_[x]
        alpha, beta = np.zeros((steps, width, s), single), np.zeros((steps, width, s), single)
        scale = np.ones((steps, width), single)
        now = alpha[0] = cut.alpha[of]
        for t in range(1, steps):
            n = rows[t]
            now = (now[:n] @ move_) * given[t, :n]
            scale[t, :n] = c = now @ ones
            now = np.divide(now, c[:, None], out=alpha[t, :n])
        # ``given`` becomes what a step passes back: emission, times what follows, over its scale.
        given /= scale[:, :, None]
        beta[size - 1, np.arange(width)] = cut.beta[of]
        for t in range(steps - 2, -1, -1):
            m = rows[t + 1]
            given[t + 1, :m] *= beta[t + 1, :m]
            np.matmul(given[t + 1, :m], back, out=beta[t, :m])
        if steps > 1:
            move += (alpha[:-1].reshape(-1, s).T @ given[1:].reshape(-1, s)).astype(np.float64) * model.move
        alpha *= beta
        start += alpha[0][starts[of]].sum(0, dtype=np.float64)
        # A border token counts in the stretch that it begins.
        alpha[size - 1, np.arange(width)] *= cut.ends[of][:, None]
        symbol = x.ravel().astype(np.int64)
        for k, gamma in enumerate(np.ascontiguousarray(alpha.reshape(-1, s).T)):
            emit[k] += np.bincount(symbol, gamma, none + 1)
        likelihood += float(np.log10(scale).sum(dtype=np.float64))
    likelihood += float(np.log10((model.start * model.emit[[q[0] for q in sequences]]).sum(1)).sum())
    return start, move, emit[:, :none].T.copy(), likelihood


class _Numbers(dict):
    """A frequent word's number; -1 - class for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1 - form(word)


def _symbols(vocab: Vocabulary, numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers >= 0, vocab.symbol[np.maximum(numbers, 0)] if len(vocab.symbol) else 0, -1 - numbers)


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = PASSES, least_gain: float = LEAST_GAIN) -> Model:
    """Baum-Welch: up to ``passes`` readings of ``symbols`` (binary, unsigned 16-bit) of the training texts."""
    prior = np.ones(vocab.symbols) * 0.1
    prior[:CLASSES] += vocab.class_tokens
    prior[CLASSES:] += vocab.count[: vocab.symbols - CLASSES]
    prior /= prior.sum()
    model = Model.first(prior, states)
    if not vocab.tokens:
        return model
    for _ in range(passes):
        now = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            m = now.value
            total = [np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit), 0.0]
            waiting: list[np.ndarray] = []
            have = 0
            for b in batches:
                for x in b.column("symbols"):
                    waiting.append(np.frombuffer(x.as_py(), "<u2"))
                    have += len(waiting[-1])
                    if have >= 1 << 19:
                        total = [p + q for p, q in zip(total, expected(m, waiting), strict=True)]
                        waiting, have = [], 0
            if waiting:
                total = [p + q for p, q in zip(total, expected(m, waiting), strict=True)]
            table = np.concatenate([total[0][None], total[1], total[2], np.full((1, states), total[3] / states)])
            some = np.flatnonzero(table.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, k]) for k in range(states))], ["row", *(f"s{k}" for k in range(states))])

        counts = rows.select("symbols").mapInArrow(small(run), "row int, " + ", ".join(f"s{k} double" for k in range(states)))
        total = np.zeros((2 + states + len(model.emit), states))
        for r in counts.groupBy("row").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states))).collect():  # one row for each symbol
            total[r["row"]] = r[1:]
        start, move, emit = total[0] + 0.1, total[1 : 1 + states] + 0.1, total[1 + states : -1]
        emit = emit + prior[:, None] + SMOOTH * (emit.sum(1) > 0)[:, None] * emit.sum(0) / max(emit.sum(), 1e-9)
        told = [*model.likelihood, float(total[-1].sum())]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), told)
        now.unpersist()
        if len(told) > 1 and told[-1] - told[-2] < least_gain * vocab.tokens:
            break
    return model


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each text as symbols, with what frequent words add to its scores; and a row for each place of another word."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)  # FREQUENT words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        get = _Numbers(v.number).__getitem__
        floor = np.log10(v.tokens + v.distinct + 1)
        log_count, share = np.log10(v.count + 1), v.share
        row = TaskContext.get().partitionId() << 33  # tells rows apart where doc_ids repeat
        for b in batches:
            symbols, base, known, n, extra = [], [], [], [], []
            of, word, kind_ = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for i, x in enumerate(b.column("text")):
                told = tokens(x.as_py())
                number = np.fromiter(map(get, told), np.int64, len(told))
                often = number[number >= 0]
                symbols.append(_symbols(v, number).astype("<u2").tobytes())
                n.append(len(told))
                known.append(len(often))
                base.append(float(log_count[often].sum() - len(told) * floor))
                extra.append(float(share[often].sum()))
                if len(often) < len(told):
                    others = np.flatnonzero(number < 0)
                    word += [told[j] for j in others.tolist()]
                    kind_.append(-1 - number[others])
                    of.append(np.full(len(others), i))
            rows, at = np.arange(row, row + b.num_rows), np.concatenate(of)
            row += b.num_rows
            doc_id = b.column("doc_id")
            with_none = lambda c, t: pa.concat_arrays([pa.array(c, t), pa.nulls(len(word), t)])
            after_none = lambda c, t: pa.concat_arrays([pa.nulls(b.num_rows, t), pa.array(c, t)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows, rows[at]])), with_none(symbols, pa.binary()), pa.concat_arrays([doc_id, pa.nulls(len(word), doc_id.type)]),
                *(with_none(c, t) for c, t in ((n, pa.int64()), (known, pa.int64()), (base, pa.float64()), (extra, pa.float64()))),
                after_none(word, pa.binary()), after_none(np.concatenate(kind_).astype(np.int32), pa.int32()),
            ], ["row", "symbols", "doc_id", "n_tokens", "n_known", "base", "extra", "word", "form"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(small(run), f"row long, symbols binary, doc_id {kind}, n_tokens long, n_known long, base double, extra double, word binary, form int")


def score(docs: DataFrame) -> DataFrame:
    """Train on what is not held out; score every document with the model and with the unigram base."""
    counts = materialise(count_words(docs.select("doc_id", "text").filter(~held_out())))
    vocab = vocabulary(counts)
    parts = materialise(encoded(docs, vocab))
    texts = parts.filter(F.col("symbols").isNotNull()).withColumn("held_out", held_out())
    model = train(texts.filter("NOT held_out"), vocab)
    made = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = forward(made.value, [np.frombuffer(x.as_py(), "<u2") for x in b.column("symbols")])
            keep = b.select(["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "extra"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(value)], [*keep.schema.names, "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    valued = texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "extra", "symbols").mapInArrow(small(run), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, extra double, value double")
    rare = parts.filter(F.col("word").isNotNull()).select("row", "word", "form").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    whole = F.lit(0.0)
    for k in range(CLASSES):
        whole = F.when(F.col("form") == k, F.lit(float(np.log10(vocab.class_tokens[k] + vocab.class_words[k] + 1)))).otherwise(whole)
    c = F.coalesce("c", F.lit(0))
    adds = rare.groupBy("row").agg(
        F.sum((c > 0).cast("long")).alias("more"), F.sum(F.log10(c + 1)).alias("add_base"), F.sum(F.log10(c + 1) - whole).alias("add_value"))
    zero = F.lit(0.0)
    return valued.join(adds, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add_base", zero)).alias("base_score"), (F.col("value") + F.col("extra") + F.coalesce("add_value", zero)).alias("score"))
