"""Quality rules as weak supervision.

Each rule votes good, bad, or abstains on a document.  Votes are aggregated to
the number of documents of each vote pattern (at most 3 ** rules rows, whatever
the input), on which expectation-maximisation estimates, for good and for bad
documents, how often each rule casts each vote, and how common good documents
are.  The posterior of a pattern is then the probability that its documents are
good, and decides in place of an all-must-pass chain of filters.

Defined cases: a null text has no words; an empty or wordless text fails the
base rule; a very long text is measured as a whole; equal vote patterns have one
posterior, and one of just the threshold is kept; repeated rows are judged alike
and count as often as they occur; a null doc_id plays no part in the verdict; an
empty table gives no rows; columns of ``docs`` may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillframe.llm.common import SPACES, materialise, small, unwrap, wrap

SYMBOLS = "#*$%&|<>"
_ASCII_LETTERS_AND_SPACES = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha() or b in SPACES)
_SPACE_CHARS = SPACES.decode()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stops", "n_odd_bytes"]
GOOD, ABSTAIN, BAD = 1, 0, -1


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words in an n-word window that the text has twice or more, the first included."""
    if len(words) < n:
        return 0
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + n - max(i, until)
            until = i + n
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of ``COUNTS``, of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), len(text) - sum(map(text.count, _SPACE_CHARS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(set(words)), sum(map(text.count, ".!?")), len(raw.translate(None, _ASCII_LETTERS_AND_SPACES)))


def counts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, and in a struct ``counted`` the counts of its text."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(x.as_py()) for x in b.column("text")], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([pa.array(c) for c in rows.T], COUNTS)], [*names, "counted"])

    counted = StructType([StructField(c, LongType()) for c in COUNTS])
    return docs.mapInArrow(small(run), StructType([*docs.schema.fields, StructField("counted", counted)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of ``counts``."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    per_word, per_char, per_line = (lambda c: F.col(c) / F.greatest(words, F.lit(1))), (lambda c: F.col(c) / F.greatest(chars, F.lit(1))), (lambda c: F.col(c) / F.greatest(lines, F.lit(1)))
    never = F.lit(False)
    # A rule whose breach condemns, but whose keeping says little, abstains instead of voting good.
    return {
        "symbols": _vote(per_word("n_symbols") <= 0.03, per_word("n_symbols") > 0.12),
        "odd_bytes": _vote(per_char("n_odd_bytes") <= 0.05, per_char("n_odd_bytes") > 0.075),
        "sentences": _vote(per_word("n_stops").between(0.02, 0.3), (words >= 60) & (per_word("n_stops") < 0.008)),
        "repeats": _vote(never, per_word("n_repeat_words") > 0.3),
        "dup_lines": _vote(never, per_line("n_dup_lines") > 0.3),
        "word_length": _vote(never, ~(chars / F.greatest(words, F.lit(1))).between(2.2, 12)),
        "variety": _vote(never, F.col("n_distinct") < 0.2 * F.least(words, F.lit(400))),
        "short_lines": _vote(per_line("n_words") >= 8, (lines >= 5) & (per_line("n_words") < 3)),
    }


def fit(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, prior: float = 0.7, accuracy: float = 0.8) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of -1, 0, 1) with counts ``n``.

    Starts from rules that are right ``accuracy`` of the time.  Returns each
    pattern's posterior of being good, the vote probabilities
    [good or bad, rule, vote + 1], and the share of good documents.  A prior
    of 0.5 % of all documents per cell (three at least), in the sense of the
    start, keeps estimates defined and the two classes from changing places.
    """
    k = patterns.shape[1]
    start = np.empty((2, k, 3))
    start[0] = np.array([1 - accuracy, 0.5, accuracy]) / 1.5
    start[1] = np.array([accuracy, 0.5, 1 - accuracy]) / 1.5
    theta, share = start.copy(), prior
    one_hot = patterns[:, :, None] == np.array([BAD, ABSTAIN, GOOD])
    post = np.full(len(n), prior)
    total = float(n.sum())
    strength = max(3.0, 0.005 * total)
    for _ in range(rounds):
        like = np.einsum("pkv,ckv->pc", one_hot, np.log(theta)) + np.log([share, 1 - share])
        new = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        for c, w in ((0, n * post), (1, n * (1 - post))):
            cell = np.einsum("p,pkv->kv", w, one_hot) + strength * start[c]
            theta[c] = cell / cell.sum(1, keepdims=True)
        share = float(np.clip(((n * post).sum() + 20 * prior) / (total + 20), 0.02, 0.98))
        if done:
            break
    return post, theta, share


def _votes() -> list[Column]:
    return [v.cast("int").alias(f"vote_{k}") for k, v in rules().items()]


def verdicts(counted: DataFrame) -> DataFrame:
    """Each vote pattern among documents that pass the base rule, and its posterior; ``counted`` has the counts as columns."""
    names = [f"vote_{k}" for k in rules()]
    seen = counted.filter(~base_failed()).select(*_votes()).groupBy(*names).count().orderBy(*names).collect()  # at most 3 ** rules rows
    patterns = np.array([r[:-1] for r in seen], dtype=np.int64).reshape(-1, len(names))
    post, _, _ = fit(patterns, np.array([r[-1] for r in seen], dtype=np.float64))
    rows = [(*map(int, p), float(q)) for p, q in zip(patterns, post, strict=True)]
    return counted.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in names) + ", quality double")


def _decide(counted: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    names = [f"vote_{k}" for k in rules()]
    out = counted.select("*", *_votes()).join(F.broadcast(found), names, "left")
    return out.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & (F.coalesce("quality", F.lit(0.0)) >= threshold), "quality": F.when(~base_failed(), F.col("quality"))})


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, kept, quality (the posterior) and votes of every document."""
    measured = materialise(counts(docs.select("doc_id", "text")).select("doc_id", "counted.*"))
    out = _decide(measured, verdicts(measured), threshold)
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "quality", *(f"vote_{k}" for k in rules()))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept.  Texts are measured twice and not moved."""
    found = verdicts(counts(docs.select("text")).select("counted.*"))
    rows = counts(wrap(docs)).select("__row", "text", "counted.*")
    return unwrap(_decide(rows, found, threshold).filter("kept"), docs.columns)
