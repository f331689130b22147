import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillframe.llm import bpe, catalog, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


SPEC = bpe.read_spec(PATH)
CODEC = bpe.codec_of(SPEC)


def test_ranks_give_the_same_ids():
    assert bpe.merges_by_rank(SPEC)
    vocab = {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4, "abc": 5}
    odd = {"model": {"vocab": vocab, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}, "added_tokens": []}
    assert not bpe.merges_by_rank(json.dumps(odd))  # abc is a, bc: no encoding gives its token


@given(st.text(max_size=60) | st.text("ab cdeé'.,\n\t  19<|>tTsS", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encodes_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    library = Tokenizer.from_file(PATH) if not hasattr(test_encodes_as_the_library, "t") else test_encodes_as_the_library.t
    test_encodes_as_the_library.t = library
    ids = CODEC.encode(text)
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert bpe.encoder_of(SPEC, True)(text) == ids
    assert CODEC.decode(ids) == library.decode(expected, skip_special_tokens=False)


def naive(merges, word):
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def explicit(letters, merges):
    """The gadget construction with every arc copied, on a small vocabulary."""
    arcs = {(a, b) for a in letters for b in letters}
    for a, b in merges:
        if (a, b) not in arcs:
            continue
        c = a + b
        into = {(q, c) for q, t in arcs if t == a and not (a == b and q == a)}
        out = {(c, u) for s, u in arcs if s == b}
        loop = {(c, c)} if (b, a) in arcs else set()
        arcs = (arcs | into | out | loop) - {(a, b)}
    return arcs


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=7), st.text("abc", min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton_is_that_of_the_gadgets(picks, word):
    tokens, merges = [b"a", b"b", b"c"], []
    for i, j in picks:
        a, b = tokens[i % len(tokens)], tokens[j % len(tokens)]
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    spec = {"model": {"vocab": {t.decode(): i for i, t in enumerate(tokens)}, "merges": [[a.decode(), b.decode()] for a, b in merges]}, "added_tokens": []}
    made = bpe.MergeAutomaton(spec)
    arcs = explicit(tokens[:3], merges)
    for i, s in enumerate(tokens):
        for j, t in enumerate(tokens):
            if naive(merges, s) == [s] and naive(merges, t) == [t]:
                assert made.arc(i, j) == ((s, t) in arcs), (s, t, merges)
    assert [made.labels[i] for i in made.encode_word(word.encode())] == naive(merges, word.encode())


def test_one_step_of_the_table_for_each_byte(monkeypatch):
    """Once its states are made, a word of n bytes takes n steps of the table and no other work on its bytes."""
    made = bpe.MergeAutomaton(json.loads(SPEC))
    words = [w.encode() for w in CODEC.split("Straight ahead, nevertheless unconstitutionally 1234567 aaaaaaaaaa \u65e5\u672c\u8a9e\u30c6\u30b9\u30c8 " + "xyzzy" * 300)]
    first = [made.encode_word(w) for w in words]

    class Counted(dict):
        steps = 0

        def get(self, key):
            Counted.steps += 1
            return self[key]

    made.next = Counted(made.next)
    monkeypatch.setattr(made, "_extend", None)
    for name in ("ids", "begins", "cut", "born", "first", "last", "told", "states"):
        monkeypatch.setattr(made, name, None)
    assert [made.encode_word(w) for w in words] == first and Counted.steps == sum(map(len, words))


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    made = bpe.MergeAutomaton(json.loads(SPEC))
    for w in ("unconstitutionally", "nevertheless" * 30, "\u65e5\u672c\u8a9e", "unconstitutionally"):
        assert made.encode_word(w.encode()) == CODEC.automaton.encode_word(w.encode()) and len(made.token) <= 51


def test_query_and_edges(spark, sf, table, docs, no_docs, library):
    rows = {r.doc_id: r for r in catalog.op1_bpe(spark, sf).collect()}
    for i, text, _ in table:
        ids = library.encode(text, add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.encode_documents(docs, PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(r.text or "" for r in docs.collect())
    assert bpe.encode_documents(no_docs, PATH).collect() == []


def sequences(rows):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append(r)
    for of in held.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return held


def test_packing(spark, sf, table, library):
    rows = catalog.op8_best_fit_packing(spark, sf).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text, _ in table:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 2048) and all(p.length == 2048 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    held = sequences(rows)
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) + 1


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(sizes):
    counts = np.zeros(41, np.int64)
    for k, n in sizes.items():
        counts[k] = n
    made = packing.plan(counts)
    load, placed = np.zeros(made.sequences, np.int64), {k: [] for k in sizes}
    spans = {}
    for length, rank, count, first, offset in made.runs:
        placed[length] += range(rank, rank + count)
        load[first : first + count] += length
        for s in range(first, first + count):
            spans.setdefault(s, []).append((offset, length))
    assert all(sorted(v) == list(range(sizes[k])) for k, v in placed.items())
    assert (load <= 40).all() and (load > 0).all()
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_exact_fits_are_found():
    counts = np.zeros(101, np.int64)
    counts[[70, 30, 60, 25, 15, 40, 35]] = [1, 1, 1, 2, 1, 1, 1]
    assert packing.plan(counts).sequences == 3


def test_packing_edges(docs, no_docs):
    rows = packing.pack_documents(docs, PATH).collect()
    assert sum(r.length == 1 for r in rows) == 2  # null and empty: the end token alone
    assert sum(r.doc_id == 7 for r in rows) == 2
    sequences(rows)
    assert packing.pack_documents(no_docs, PATH).collect() == []
    assert json.loads(bpe.read_spec(PATH))["model"]["type"] == "BPE"


def test_a_length_that_most_pieces_share_is_dealt_over_buckets(spark, monkeypatch):
    """Equal rows, all of one length: ranks within small buckets still give every piece a place of its own."""
    monkeypatch.setattr(packing, "BUCKET", 10)
    rows = [(1, "the same words in every row")] * 300 + [(i, "more " * (i % 5)) for i in range(100)]
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), PATH).collect()
    held = sequences(packed)
    assert len(packed) == 400 and len(held) <= -(-sum(r.length for r in packed) // 2048) + 1
