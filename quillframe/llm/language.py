"""Language identification with a bidirectional gated recurrent network over bytes.

A text's bytes are read in windows that span words: ``CORE`` bytes that count,
and ``CONTEXT`` bytes of what stands before and after them (borders where the
text ends).  The network reads a window in both directions; at every position
the two states together give a distribution over languages.  A document's
probabilities are pooled from those of all its positions, each counted once.

Training is backpropagation through time in numpy, on a bounded sample of
labelled documents (``PER_LANGUAGE`` of each language, those with the smallest
hash), whose whole texts are read, every window at least once.  Prediction
reads every byte of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
null doc_id counts as the empty text where rows are held out; repeated rows are
predicted alike, and each may be in the sample; a very long text is read in as
many windows as it needs, a thousand at a time; ties between languages go to
the first by name; an empty table gives no rows; without any labelled document
every prediction is ``und``; columns of ``docs`` may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillframe.llm.common import small, unwrap, wrap

UNKNOWN = "und"
PER_LANGUAGE = 250  # labelled documents of each language that training reads at most, as a whole
CORE, CONTEXT = 112, 8  # bytes of a window that count, and those before and after them
HIDDEN, EMBED, STEPS, BATCH, AT_ONCE = 16, 12, 320, 128, 1024
BEFORE, AFTER = 256, 257  # borders of a text
_letter = regex.compile(r"\p{L}").search


def training_row(modulus: int = 4, held_out: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Network:
    """Weights by name; languages in the order of the outputs."""

    languages: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"embed": draw(258, EMBED)}
        for d in "fb":
            w |= {f"{d}_in": draw(EMBED, 3 * HIDDEN), f"{d}_rec": draw(HIDDEN, 3 * HIDDEN), f"{d}_bias": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"out": draw(2 * HIDDEN, len(languages)), "out_bias": np.zeros(len(languages), np.float32)}
        return cls(languages, w)

    def _read(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction, [time, window, hidden].  Gates: update, reset, candidate."""
        w, h = self.w, HIDDEN
        by_byte = w["embed"] @ w[f"{d}_in"] + w[f"{d}_bias"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        state = np.zeros((x.shape[1], h), by_byte.dtype)
        out = np.empty((*x.shape, h), by_byte.dtype)
        rec, cand = np.ascontiguousarray(w[f"{d}_rec"][:, : 2 * h]), np.ascontiguousarray(w[f"{d}_rec"][:, 2 * h :])
        for t in steps:
            given = by_byte[x[t]]
            gates = _sigmoid(given[:, : 2 * h] + state @ rec)
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(given[:, 2 * h :] + (r * state) @ cand)
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = out[t] = state + z * (c - state)
        return out

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """What ``_read`` gives, for prediction: gates in place, half of their weights folded in, only positions that count."""
        w, h, steps = self.w, HIDDEN, len(x)
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        by_byte, rec = (w["embed"] @ w[f"{d}_in"] + w[f"{d}_bias"]) * half, w[f"{d}_rec"] * half
        rec, cand = np.ascontiguousarray(rec[:, : 2 * h]), np.ascontiguousarray(rec[:, 2 * h :])
        out = np.empty((steps - 2 * CONTEXT, x.shape[1], h), np.float32)
        given, gates, c = (np.empty((x.shape[1], k * h), np.float32) for k in (3, 2, 1))
        state = np.zeros((x.shape[1], h), np.float32)
        for t in range(steps - CONTEXT) if d == "f" else range(steps - 1, CONTEXT - 1, -1):
            np.take(by_byte, x[t], axis=0, out=given, mode="clip")
            np.matmul(state, rec, out=gates)
            gates += given[:, : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.matmul(gates[:, h:] * state, cand, out=c)
            c += given[:, 2 * h :]
            np.tanh(c, out=c)
            c -= state
            c *= gates[:, :h]
            state = np.add(c, state, out=out[t - CONTEXT] if CONTEXT <= t < steps - CONTEXT else None)
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """[language, time, window], of the positions that count; equal to what ``forward`` gives."""
        both = [self._states(x, d).reshape(-1, HIDDEN) for d in "fb"]
        score = sum(self.w["out"][k * HIDDEN : (k + 1) * HIDDEN].T @ both[k].T for k in (0, 1)) + self.w["out_bias"][:, None]
        score -= score.max(0)
        score -= np.log(np.exp(score).sum(0))
        return score.reshape(len(score), -1, x.shape[1])

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log probabilities, [time, window, language]."""
        saved = {d: [] if keep is not None else None for d in "fb"}
        both = np.concatenate([self._read(x, d, saved[d]) for d in "fb"], axis=2)
        score = both @ self.w["out"] + self.w["out_bias"]
        score -= score.max(2, keepdims=True)
        score -= np.log(np.exp(score).sum(2, keepdims=True))
        if keep is not None:
            keep |= {"saved": saved, "both": both}
        return score

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, weighted by ``mask``, and its gradients, backwards through time."""
        w, h, keep = self.w, HIDDEN, {}
        logp = self.forward(x, keep)
        total = mask.sum()
        pick = np.take_along_axis(logp, label[None, :, None], 2)[:, :, 0]
        loss = float(-(pick * mask).sum() / total)
        delta = np.exp(logp)
        delta[:, np.arange(len(label)), label] -= 1
        delta *= (mask / total)[:, :, None]
        flat, both = delta.reshape(-1, delta.shape[2]), keep["both"].reshape(-1, 2 * h)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"], g["out_bias"] = both.T @ flat, flat.sum(0)
        up = (flat @ w["out"].T).reshape(*x.shape, 2 * h)
        order = np.argsort(x, axis=None, kind="stable")
        bytes_, begin = np.unique(x.ravel()[order], return_index=True)
        for k, d in enumerate("fb"):
            rec = w[f"{d}_rec"]
            step_rec, step_cand = np.ascontiguousarray(rec[:, : 2 * h].T), np.ascontiguousarray(rec[:, 2 * h :].T)
            given = np.empty((*x.shape, 3 * h), up.dtype)
            back = np.zeros((x.shape[1], h), up.dtype)
            for t, state, z, r, c in reversed(keep["saved"][d]):
                back = back + up[t, :, k * h : (k + 1) * h]
                dc = back * z * (1 - c * c)
                through = dc @ step_cand
                given[t, :, :h] = back * (c - state) * z * (1 - z)
                given[t, :, h : 2 * h] = through * state * r * (1 - r)
                given[t, :, 2 * h :] = dc
                gates = given[t, :, : 2 * h]
                g[f"{d}_rec"][:, : 2 * h] += state.T @ gates
                g[f"{d}_rec"][:, 2 * h :] += (r * state).T @ dc
                back = back - back * z + through * r + gates @ step_rec
            by_byte = np.zeros((258, 3 * h), up.dtype)
            by_byte[bytes_] = np.add.reduceat(given.reshape(-1, 3 * h)[order], begin)
            g[f"{d}_bias"] = by_byte.sum(0)
            g[f"{d}_in"] = w["embed"].T @ by_byte
            g["embed"] += by_byte @ w[f"{d}_in"].T
        return loss, g


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers of a text's windows, [window, time], and how many bytes of each count; none of an empty text."""
    n = -(-len(text) // CORE)
    padded = np.full(n * CORE + 2 * CONTEXT, AFTER, np.uint16)
    padded[:CONTEXT] = BEFORE
    padded[CONTEXT : CONTEXT + len(text)] = np.frombuffer(text, np.uint8)
    if not n:
        return np.zeros((0, CORE + 2 * CONTEXT), np.uint16), np.zeros(0, np.int64)
    read = np.lib.stride_tricks.sliding_window_view(padded, CORE + 2 * CONTEXT)[::CORE]
    return read, np.minimum(CORE, len(text) - CORE * np.arange(n))


def counted(size: np.ndarray) -> np.ndarray:
    """1 at the positions of windows that count, [time, window]."""
    at = np.arange(-CONTEXT, CORE + CONTEXT)[:, None]
    return ((at >= 0) & (at < size)).astype(np.float32)


def train(texts: list[bytes], label: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Adam on batches of windows; each is read once before any is read again, and languages weigh the same."""
    read = [windows(t) for t in texts]
    of = np.repeat(label, [len(s) for _, s in read])
    if not len(of):
        return None
    x, size = np.concatenate([r for r, _ in read]), np.concatenate([s for _, s in read])
    del read
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    there = np.bincount(of, size, len(languages))
    weight = (there.sum() / np.maximum(there, 1) / (there > 0).sum()).astype(np.float32)
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    steps, left = max(steps, -(-len(x) // BATCH)), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(left) < BATCH:
            left = np.concatenate([left, rng.permutation(len(x))])
        pick, left = left[:BATCH], left[BATCH:]
        _, g = net.gradients(x[pick].T.astype(np.intp), counted(size[pick]) * weight[of[pick]], of[pick])
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, d in g.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame) -> Network | None:
    """Train on the bounded sample of ``docs`` (doc_id, text, lang): PER_LANGUAGE rows of each language are brought to the driver."""
    known = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # xxhash64 is even over all longs, so this share of its range holds about 3 * PER_LANGUAGE rows of a language.
    share = {k: min(1.0, 3 * PER_LANGUAGE / n + 30 / n) for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, int(-(2**63) + s * (2**64 - 1)) if s < 1 else 2**63 - 1)])
    # Where one doc_id has many rows, or texts none, what passes may be more; each task gives on PER_LANGUAGE rows of a language at most.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    rows = known.filter(F.col("h") <= limit[F.col("lang")]).withColumn("rank", rank).filter(F.col("rank") <= PER_LANGUAGE).collect()
    languages = sorted(sizes)
    rows.sort(key=lambda r: (r.lang, r["rank"]))
    return train([r.text.encode() for r in rows], np.array([languages.index(r.lang) for r in rows], np.int64), languages)


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """Sum of log probabilities over all positions of each text, and in a last column the number of positions."""
    total = np.zeros((len(texts), len(net.languages) + 1))
    waiting, have = [], 0

    def add() -> None:
        x, size, row = (np.concatenate(c) for c in zip(*waiting, strict=True))
        for at in range(0, len(x), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            logp = net.log_probabilities(x[part].T.astype(np.intp))
            logp *= counted(size[part])[CONTEXT:-CONTEXT]
            np.add.at(total, row[part], np.concatenate([logp.sum(1).T, size[part, None]], axis=1))
        waiting.clear()

    for i, t in enumerate(texts):
        x, size = windows(t.encode())
        waiting.append((x, size, np.full(len(size), i)))
        have += len(size)
        if have >= AT_ONCE:
            add()
            have = 0
    if have:
        add()
    return total


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``docs``, then lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 10,000 weights
    names = [*docs.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            can = [i for i, x in enumerate(texts) if model and _letter(x)]
            if can:
                distinct = {t: k for k, t in enumerate(dict.fromkeys(texts[i] for i in can))}
                found = pooled(model, list(distinct))[[distinct[texts[i]] for i in can]]
                # The geometric mean over positions, sharpened by the evidence there is.
                mean = found[:, :-1] / np.sqrt(np.maximum(found[:, -1:], 1))
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, q in zip(can, p, strict=True):
                    lang[i], score[i] = model.languages[int(q.argmax())], float(q.max())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names)

    return docs.mapInArrow(small(run, 1024), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score: train on the rows that are not held out, predict all."""
    net = fit(docs.filter(training_row()))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", (~training_row()).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found with a score of ``least``."""
    net = fit(docs.filter(training_row()))
    rows = predict(wrap(docs), net)
    return unwrap(rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns)
