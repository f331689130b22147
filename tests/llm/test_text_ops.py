import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import catalog, fingerprint, hmm, language, near_dup, quality, repeats

from conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


# -- quality --------------------------------------------------------------------------------------


def base_counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality(spark, sf, table, docs, no_docs):
    rows = {r.doc_id: r for r in catalog.op2_quality_rules(spark, sf).collect()}
    for i, text, _ in table:
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[i], rows[i].kept) for i in labels if not rows[i].base_failed]
    assert sum(bool(a) == b for a, b in judged) >= 0.97 * len(judged)
    check_posteriors(list(rows.values()))
    odd = quality.judge(docs).collect()
    assert len(odd) == len(ROWS) and all(r.base_failed and not r.kept for r in odd if r.doc_id in (3, 4, 5, 9))
    assert quality.judge(no_docs).collect() == []
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 7, 8, None}


def check_posteriors(rows):
    """quality and kept, by expectation-maximisation over documents one at a time, from their votes."""
    votes = [c for c in rows[0].asDict() if c.startswith("vote_")]
    judged = [r for r in rows if not r.base_failed]
    table = {c: {v: {1: (0.8, 0.5, 0.2)[1 - v] / 1.5, 0: (0.2, 0.5, 0.8)[1 - v] / 1.5} for v in (1, 0, -1)} for c in votes}
    share, strength, before = 0.7, max(3.0, 0.005 * len(judged)), None
    start = {c: {v: dict(table[c][v]) for v in table[c]} for c in votes}
    for _ in range(200):
        post = []
        for r in judged:
            good, bad = share * math.prod(table[c][r[c]][1] for c in votes), (1 - share) * math.prod(table[c][r[c]][0] for c in votes)
            post.append(good / (good + bad))
        done = before is not None and max(abs(a - b) for a, b in zip(post, before, strict=True)) < 1e-9
        before = post
        for k in (1, 0):
            weight = [p if k else 1 - p for p in post]
            for c in votes:
                cell = {v: strength * start[c][v][k] + sum(w for w, r in zip(weight, judged, strict=True) if r[c] == v) for v in (1, 0, -1)}
                for v in cell:
                    table[c][v][k] = cell[v] / sum(cell.values())
        share = min(0.98, max(0.02, (sum(post) + 14) / (len(judged) + 20)))
        if done:
            break
    for r, p in zip(judged, post, strict=True):
        assert r.quality == pytest.approx(p, abs=1e-6) and r.kept == (p >= 0.5)
    assert all(r.quality is None and not r.kept for r in rows if r.base_failed)


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    votes = np.where(good[:, None], rng.choice([1, 0, -1], (20_000, 5), p=[0.7, 0.2, 0.1]), rng.choice([1, 0, -1], (20_000, 5), p=[0.15, 0.25, 0.6]))
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, theta, share = quality.fit(patterns, n.astype(float))
    assert abs(share - 0.7) < 0.03 and abs(theta[0, 0, 2] - 0.7) < 0.03
    assert ((post[which.ravel()] > 0.5) == good).mean() > 0.93


# -- substring dedup ------------------------------------------------------------------------------


def without_repeats(rows):
    seen, out = set(), []
    for i, text in rows:  # in the order that decides
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("shard", [repeats.SHARD, 50])
def test_substring_dedup(spark, sf, table, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)  # 50: many shards, and shards of several automata
    monkeypatch.setattr(repeats, "SALT_BYTES", 100 * shard)
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op3_substring_dedup(spark, sf).collect())
    assert found == [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in without_repeats([r[:2] for r in table])]
    assert sum(r[2] for r in found) > 0


def test_automata_locate_every_occurrence(spark):
    """All windows that occur before, counted by brute force over the texts of sf0.01; each is a hit of an automaton."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen, later = set(), collections.Counter()
    for r in docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").collect():
        w = WORD.findall(r.text or "")
        for s in range(len(w) - 19):
            told = tuple(w[s : s + 20])
            later[r.doc_id] += told in seen
            seen.add(told)
    spans = repeats.located(repeats._Texts(docs.select("text", *repeats.identity()))).distinct().collect()
    by_doc = {}
    for r in spans:
        by_doc.setdefault(r.key, set()).update(range(r.begin, r.end - 19))
    assert {i: len(x) for i, x in by_doc.items()} == {i: n for i, n in later.items() if n}
    assert sum(later.values()) > 5_000


def test_passages_are_found_whatever_stands_between_words():
    words = [f"w{i}".encode() for i in range(30)]
    made = repeats.Passages([b" ".join(words), b"\n".join([b"the"] * 25)])
    assert made.starts(b"\t".join([b"x", *words, b"y"])) == list(range(1, 12))
    assert made.starts(b" ".join([b"the"] * 22)) == [0, 1, 2] and made.starts(b" ".join(words[:19])) == []
    assert repeats._symbol(0xD7FE) < "\ud800" and "\udfff" < repeats._symbol(0xD7FF) == "\ue000"


def in_order(spark, docs):
    """doc_id and text of distinct rows, in the order that decides where ids are null or equal."""
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text", *repeats.identity()).distinct().orderBy("key", "told").collect()]


def test_substring_edges(spark, docs, no_docs):
    rows = repeats.remove_repeats(docs)
    found = sorted((r["__row"]["doc_id"] or 99, r.n_words, r.n_removed, r.kept_text) for r in rows.collect())
    expected = without_repeats(in_order(spark, docs))
    expected.append(next(r for r in expected if r[0] == 7))  # a repeated row is one document, and each has its result
    assert found == sorted((i or 99, *x) for i, *x in expected)
    assert set(rows.schema["__row"].dataType.names) == set(docs.columns) - {"text"}
    assert repeats.remove_repeats(no_docs).collect() == []


def test_substring_dedup_where_ids_are_null_or_equal(spark):
    p, q = ([f"{c}{i}" for i in range(40)] for c in "pq")
    rows = [(None, " ".join(["one", *p])), (None, " ".join([*p, "two"])), (5, " ".join([*q, "a"])), (5, " ".join(["b", *q, *q])), (4, " ".join(q[5:30])), (5, " ".join([*q, "a"])), (None, None), (5, None), (6, "the " * 500), (7, "long" * 100_000 + " " + " ".join(p))]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((r["__row"]["doc_id"] or 99, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(given).collect())
    expected = without_repeats(in_order(spark, given))
    expected.append(next(r for r in expected if r[0] == 5 and r[3].endswith("a")))
    assert found == sorted((i or 99, *x) for i, *x in expected) and sum(r[2] for r in found) > 200


# -- language model -------------------------------------------------------------------------------


def test_language_model(spark, sf, table):
    rows = {r.doc_id: r for r in catalog.op4_lm_scoring(spark, sf).collect()}
    told = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + ["\n"]
    count = collections.Counter(w for i, t, _ in table if zlib.crc32(str(i).encode()) % 7 != 2 for w in told(t))
    n, v = sum(count.values()), len(count)
    gain = 0
    for i, t, _ in table:
        r, w = rows[i], told(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(5)
    draw = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    emit = rng.random((4, 2))
    m = hmm.Model(draw(2), draw(2, 2), emit / emit.sum(0))
    texts = [np.array(x, np.uint16) for x in ([0], [1, 3, 2], [2, 2, 0, 1, 3])]

    def total(x):
        return sum(math.prod([m.start[p[0]], *(m.move[a, b] for a, b in zip(p, p[1:], strict=False)), *(m.emit[o, s] for o, s in zip(x, p, strict=True))]) for p in np.ndindex(*[2] * len(x)))

    assert hmm.forward(m, texts) == pytest.approx([math.log10(total(x)) for x in texts])
    start, move, emissions, log = hmm.expected(m, texts)
    assert log == pytest.approx(sum(math.log10(total(x)) for x in texts), rel=1e-5)
    assert start.sum() == pytest.approx(3, rel=1e-5) and move.sum() == pytest.approx(6, rel=1e-5) and emissions.sum() == pytest.approx(9, rel=1e-5)
    better = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emissions / emissions.sum(0))
    assert hmm.forward(better, texts).sum() > log


def test_stretches_do_not_matter():
    """Counts and likelihoods of whole texts, whatever they are cut into."""
    rng = np.random.default_rng(9)
    draw = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    emit = rng.random((7, 3)) ** 3 + 1e-3
    m = hmm.Model(draw(3), draw(3, 3), emit / emit.sum(0))
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 2, 3, 4, 5, 8, 9, 50, 333, 17)]
    whole = hmm.expected(m, texts, 10_000)
    for stretch in (1, 2, 3, 8, 100):
        for a, b in zip(hmm.expected(m, texts, stretch), whole, strict=True):
            assert a == pytest.approx(b, rel=1e-4, abs=1e-4)
        assert hmm.forward(m, texts, stretch) == pytest.approx(hmm.forward(m, texts, 10_000), rel=1e-9)
    assert whole[0].sum() == pytest.approx(len(texts), rel=1e-5) and whole[2].sum() == pytest.approx(sum(map(len, texts)), rel=1e-5)


def test_likelihood_rises_by_pass(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocab = hmm.vocabulary(hmm.materialise(hmm.count_words(docs)))
    rows = hmm.materialise(hmm.encoded(docs, vocab).filter("symbols IS NOT NULL").select("symbols"))
    told = hmm.train(rows, vocab, passes=5, least_gain=0).likelihood
    assert len(told) == 5 and all(a < b for a, b in zip(told, told[1:], strict=False))
    assert len(hmm.train(rows, vocab, passes=5, least_gain=10.0).likelihood) == 2


def test_score_by_brute_force(spark, sf, table, monkeypatch):
    """A whole text's score, by an unscaled recursion over its words with the trained model."""
    made = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda rows, vocab: made.append((train(rows, vocab, passes=2), vocab)) or made[-1][0])
    rows = {r.doc_id: r for r in catalog.op4_lm_scoring(spark, sf).collect()}
    (m, vocab), = made
    for i, text, _ in table[:40]:
        log, alpha = 0.0, m.start
        for t, w in enumerate(hmm.tokens(text)):
            k = vocab.number.get(w)
            symbol = hmm.form(w) if k is None else vocab.symbol[k]
            alpha = (alpha if t == 0 else alpha @ m.move) * m.emit[symbol]
            if symbol < hmm.CLASSES:
                alpha = alpha * ((0 if k is None else vocab.count[k]) + 1) / (vocab.class_tokens[symbol] + vocab.class_words[symbol] + 1)
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert rows[i].score == pytest.approx(log, rel=1e-9), i


def test_language_model_edges(spark, docs, no_docs):
    rows = hmm.score(docs).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1} and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert hmm.score(no_docs).collect() == []
    untold = spark.createDataFrame([(i, "a b c") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known) for r in hmm.score(untold).collect()} == {(0, 0)}


def test_scores_do_not_depend_on_what_is_broadcast(docs, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    whole = sorted((r.doc_id or 0, r.n_known, r.base_score, r.score) for r in hmm.score(docs).collect())
    for frequent in (50, 20):
        monkeypatch.setattr(hmm, "FREQUENT", frequent)
        few = sorted((r.doc_id or 0, r.n_known, r.base_score, r.score) for r in hmm.score(docs).collect())
        assert [x[:2] for x in few] == [x[:2] for x in whole] and [y for x in few for y in x[2:]] == pytest.approx([y for x in whole for y in x[2:]])


def test_vocabulary_is_filled_to_its_bound(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 100)
    for words in (81, 121):
        counts = hmm.count_words(spark.createDataFrame([(" ".join(f"w{i:03}" for i in range(words)) + " twice twice",)], "text string"))
        number = hmm.vocabulary(hmm.materialise(counts)).number
        assert len(number) == min(100, words + 2) and number[b"twice"] == 0
        assert sorted(number, key=number.get)[1:] == sorted([hmm.END, *(f"w{i:03}".encode() for i in range(words))])[: len(number) - 1]


# -- fingerprints ---------------------------------------------------------------------------------


def test_fingerprints(spark, sf, table):
    rows = {r.doc_id: r for r in catalog.op5_document_fingerprints(spark, sf).collect()}
    down = sorted(table, reverse=True, key=lambda r: r[0])
    off = []
    for (i, t, _), (_, nxt, _) in zip(down, down[1:] + down[:1], strict=True):
        n = len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        off += [r.near_edited - jaccard(shingles(t), shingles(edited)), r.near_next - jaccard(shingles(t), shingles(nxt))]
    assert np.sqrt(np.mean(np.square(off))) < 0.04
    by_text = {}
    for i, t, _ in table:
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_fingerprints_where_ids_are_null_or_equal(spark):
    """Every row's next one, in descending order of doc_id and then of a hash of the text."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, None if i == 5 else " ".join(f"t{i}-{k}" for k in range(i))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for parts in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in fingerprint.edited(docs).collect())
        dealt = fingerprint.with_next(docs).filter("guest = 0").groupBy("bucket").count().collect()
        assert len(dealt) == int(parts) and max(r["count"] for r in dealt) <= 2.5 * len(rows) / len(dealt)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    down = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).collect()
    expected = []
    for a, b in zip(down, [*down[1:], down[0]], strict=True):
        n = len(a.text)
        expected.append((a.doc_id or 0, n, hashlib.sha256((a.text[: n - n // 3] + b.text[: n // 3]).encode()).hexdigest()))
    assert found == sorted(expected)


def test_binary_search_counts_lesser_pairs(spark):
    for n in (0, 1, 2, 3, 5, 8, 33):
        limits = sorted((i // 3, i * 7 % 5) for i in range(n))
        rows = spark.range(400).select((F.col("id") % 20 - 3).alias("k"), (F.col("id") % 9 - 2).alias("t")).distinct()
        for r in rows.withColumn("b", fingerprint._before(limits, F.col("k"), F.col("t"))).collect():
            assert r.b == sum(x < (r.k, r.t) for x in limits)


def test_sketches(spark, docs, no_docs):
    a, b = (" ".join(f"w{i}" for i in range(s, s + 3000)) for s in (0, 1000))
    x, y, both = fingerprint.sketch(a), fingerprint.sketch(b), fingerprint.sketch(a + " " + b)
    assert fingerprint.distinct(x) == pytest.approx(2996, rel=0.3) and fingerprint.containment(x, y) == pytest.approx(0.667, abs=0.15)
    assert fingerprint.resemblance(fingerprint.merge(x, y), both) > 0.95
    assert (fingerprint.from_string(fingerprint.to_string(x)) == x).all()
    empty = fingerprint.sketch("")
    assert fingerprint.resemblance(empty, empty) == 1 and fingerprint.resemblance(empty, x) == 0
    rows = fingerprint.edited(docs).collect()
    assert len(rows) == len(ROWS)
    assert fingerprint.edited(no_docs).collect() == []
    merged = {r.source: r.fingerprint for r in fingerprint.merged(fingerprint.fingerprints(docs).join(docs.select("doc_id", "source"), "doc_id"), "source").collect()}
    c = [r.text for r in docs.filter("source = 'c'").collect()]
    assert merged["c"] == fingerprint.to_string(fingerprint.merge(*map(fingerprint.sketch, c)))


# -- near duplicates ------------------------------------------------------------------------------


def weighted(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_links(rows):
    """Places of all pairs at a weighted similarity of 0.8, found through shared shingles."""
    sets = [weighted(t) for _, t in rows]
    size = [sum(s.values()) for s in sets]
    having, links = collections.defaultdict(list), []
    for i, s in enumerate(sets):
        both = collections.Counter()
        for x, c in s.items():
            for j, d in having[x]:
                both[j] += min(c, d)
            having[x].append((i, c))
        links += [(j, i) for j, n in both.items() if n >= 0.8 * (size[i] + size[j] - n)]
    without = [i for i, n in enumerate(size) if not n]
    return links + list(zip(without, without[1:], strict=False))


def brute_classes(rows):
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in brute_links(rows):
        a, b = find(i), find(j)
        of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def recall(spark, rows):
    """Share of the links between different texts whose ends are in one class; and that no class is too large."""
    found = {r.doc_id: r.class_id for r in near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    links = [(rows[i], rows[j]) for i, j in brute_links(rows) if rows[i][1] != rows[j][1]]
    of = dict(zip([r[0] for r in rows], brute_classes(rows), strict=True))
    assert all(of[i] == of[c] for i, c in found.items())
    return sum(found[a[0]] == found[b[0]] for a, b in links) / len(links), len(links)


def test_recall_on_a_large_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    share, links = recall(spark, rows)
    print(f"sf0.1: recall {share:.4f} of {links} links")
    assert share >= 0.9 and links > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_on_dense_sets(spark, seed):
    """Random edits of a few texts, most pairs close to the threshold on either side."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(400):
        words = [f"d{k % 4}-{i}" for i in range(200)]
        for at in rng.choice(200, rng.integers(1, 4), replace=False):
            words[at] = f"e{k}-{at}"
        rows.append((k, " ".join(words)))
    share, links = recall(spark, rows)
    print(f"dense {seed}: recall {share:.4f} of {links} links")
    assert share >= 0.9 and links > 1000


def test_weights_tell_texts_apart(spark):
    """The same set of shingles, but one of them five times as often: no near-duplicates, unless weights are left out."""
    once, often = (" ".join([f"w{i}" for i in range(60)] + ["x y z x y z"] * n) for n in (2, 40))
    close = once + " x y z"
    assert jaccard(shingles(once), shingles(often)) == 1
    found = {r.doc_id: r.class_id for r in near_dup.deduplicate(spark.createDataFrame([(1, once), (2, often), (3, close)], "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    e, n = near_dup.weighted_shingles(often)
    both = np.intersect1d(near_dup.numbered(e, n), near_dup.numbered(*near_dup.weighted_shingles(once)))
    assert len(both) == sum((weighted(once) & weighted(often)).values()) and len(near_dup.numbered(e, n)) == n.sum()


def test_near_duplicates(spark, sf, table):
    found = {r.doc_id: r.class_id for r in catalog.op6_minhash_near_dedup(spark, sf).collect()}
    expected = brute_classes([r[:2] for r in table])
    assert found == {r[0]: table[k][0] for r, k in zip(table, expected, strict=True)}


def test_near_duplicate_chains(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(base[: 120 - 2 * k] + [f"u{k}-{i}" for i in range(2 * k)])) for k in range(12)]
    found = {r.doc_id: r.class_id for r in near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute_classes(rows)
    assert found == {r[0]: rows[k][0] for r, k in zip(rows, expected, strict=True)}


def test_near_duplicates_among_hubs_that_are_none(spark):
    """A passage that hundreds of longer texts share: these are hubs, but near to nothing."""
    rows = []
    for p in range(3):
        passage = [f"p{p}-{i}" for i in range(300)]
        rows += [(1000 * p + k, " ".join(passage + [f"o{p}-{k}-{i}" for i in range(30 if k < 2 else 90)])) for k in range(400)]
    found = {r.doc_id: r.class_id for r in near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert jaccard(shingles(rows[0][1]), shingles(rows[1][1])) >= 0.8 > jaccard(shingles(rows[0][1]), shingles(rows[2][1])) > 0.7
    assert found == {i: i - 1 if i % 1000 == 1 else i for i, _ in rows}


def test_near_duplicate_edges(docs, no_docs):
    rows = near_dup.deduplicate(docs).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r.class_id for r in rows}
    assert of[3] == of[4] == of[5] == 3 and of[7] == 1
    assert sorted(r.kept for r in rows if r.doc_id in (6, None)) == [True] * 4
    assert near_dup.deduplicate(no_docs).collect() == []
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 99 for r in kept.collect()) == [1, 2, 3, 6, 6, 8, 9, 10, 11, 99, 99]


def test_one_of_each_class_stays_where_ids_are_null_or_equal(spark):
    near = lambda w, end: " ".join([f"{w}{i}" for i in range(100)] + [end])
    rows = [(3, near("a", "x")), (None, near("a", "y")), (None, near("b", "x")), (None, near("c", "x")), (None, near("c", "y")), (4, near("d", "x")), (4, near("d", "y")), (4, near("e", "x")), (2, near("e", "y")), (None, None), (None, "")]
    kept = [(r.doc_id, (r.text or "-")[0]) for r in near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=lambda r: r[1]) == [(None, "-"), (3, "a"), (None, "b"), (None, "c"), (4, "d"), (2, "e")]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    e, w = rng.integers(0, 2**63, 60, dtype=np.uint64), rng.uniform(0.1, 9, 60)
    v = w * rng.uniform(0.5, 1.5, 60)
    s = near_dup.dart_signatures(np.concatenate([e, e]), np.concatenate([w, v]), np.repeat([0, 1], 60), 2, k=4096)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.03)
    one = near_dup.dart_signatures(e[:1], np.ones(1), np.zeros(1, np.int64), 2)
    assert (one[0] != near_dup._EMPTY).all() and (one[1] == near_dup._EMPTY).all()


# -- language -------------------------------------------------------------------------------------


def test_language(spark, sf, table, docs, no_docs):
    rows = {r.doc_id: r for r in catalog.op9_language_id(spark, sf).collect()}
    held = [(rows[i].lang_pred, lang) for i, t, lang in table if zlib.crc32(str(i).encode()) % 4 == 2 and len(t) > 200]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    odd = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert odd[3] == odd[4] == odd[5] == odd[11] == "und" and odd[1] in ("en", "de")
    assert language.identify(no_docs).collect() == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.source.substr(9, 1).cast("string"))).collect()} <= {"und", ""}
    assert language.keep_known(docs).columns == docs.columns


def test_training_reads_whole_texts(spark):
    """Only words after the first thousand bytes, and only parts of long words, tell the language."""
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 9)))
    rows = []
    for i in range(160):
        lang = "xy"[i % 2]
        own = [word("abcde" if lang == "x" else "fghij") for _ in range(60)]
        end = " ".join(own) if i % 4 < 2 else "z" * 30 + "".join(own)
        rows.append((i, " ".join(word("uvwz") for _ in range(300)) + " " + end, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in found if r.held_out) >= 0.95 * sum(r.held_out for r in found)


def test_predictions_by_one_step_at_a_time(spark, sf):
    """lang_pred and score of whole texts, with the recurrence written out for one window and one byte at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = language.fit(docs.filter(language.training_row()))
    w, h = {k: v.astype(np.float64) for k, v in net.w.items()}, language.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(window, d):
        state, out = np.zeros(h), []
        for b in window if d == "f" else window[::-1]:
            given = w["embed"][b] @ w[f"{d}_in"] + w[f"{d}_bias"]
            z, r = np.split(sigmoid(given[: 2 * h] + state @ w[f"{d}_rec"][:, : 2 * h]), 2)
            state = state + z * (np.tanh(given[2 * h :] + (r * state) @ w[f"{d}_rec"][:, 2 * h :]) - state)
            out.append(state)
        return out if d == "f" else out[::-1]

    few = docs.filter("length(text) < 900").limit(12)
    found = {(r.doc_id, r.text): r for r in language.predict(few, net).collect()}
    assert len(found) > 5
    for (_, text), r in found.items():
        raw, total = [256] * 8 + list(text.encode()) + [257] * 200, np.zeros(len(net.languages))
        n = len(text.encode())
        for at in range(0, n, 112):
            window = raw[at : at + 128]
            both = np.concatenate([states(window, "f"), states(window, "b")], axis=1)[8 : 8 + min(112, n - at)]
            logit = both @ w["out"] + w["out_bias"]
            total += (logit - np.log(np.exp(logit).sum(1, keepdims=True))).sum(0)
        p = np.exp((total - total.max()) / np.sqrt(n))
        p /= p.sum()
        assert r.lang_pred == net.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-3)


def test_windows_cover_a_text_once_with_context():
    for n in (0, 1, 111, 112, 113, 500):
        text = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        x, size = language.windows(text)
        assert b"".join(bytes(w[language.CONTEXT : language.CONTEXT + s].tolist()) for w, s in zip(x, size, strict=True)) == text
        whole = [256] * 8 + list(text) + [257] * 200
        assert all(w.tolist() == whole[k * 112 : k * 112 + 128] for k, w in enumerate(x))


def test_pooling_reads_every_byte():
    net = language.Network.fresh(["x", "y"])
    texts = ["one  two\nthrée one" * 40, "", "日本語" * 5000]
    found = language.pooled(net, texts)
    assert found[:, 2].tolist() == [len(t.encode()) for t in texts]
    x, size = language.windows(texts[0].encode())
    logp = net.forward(x.T.astype(int))
    assert found[0, :2] == pytest.approx(sum(logp[8 : 8 + s, k].sum(0) for k, s in enumerate(size)), rel=1e-4)


def test_gradients():
    net = language.Network.fresh(["a", "b", "c"])
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    x = np.array([[256, 256], *np.random.default_rng(1).integers(0, 256, (6, 2)), [257, 257]])
    mask, label = np.array([[0, 0], *[[1.0, 2.0]] * 5, [1, 0], [0, 0]]), np.array([0, 2])
    _, g = net.gradients(x, mask, label)
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = w[at]
        w[at] = was + 1e-3
        up = net.gradients(x, mask, label)[0]
        w[at] = was - 1e-3
        down = net.gradients(x, mask, label)[0]
        w[at] = was
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=1e-3)
