"""Byte-pair encoding through a deterministic automaton over bytes, compiled from merges.

Gadgets.  An automaton over tokens has the last token written as its state; an
arc is labelled with the next token.  At first only single bytes exist and
every arc does.  Merges are then compiled in order.  The gadget of merge k,
``a b -> c``, adds the token c: arcs into c are those that lead into a at that
moment, arcs out of c are those that leave b at that moment, and the arc from a
on b is deleted (a run ``a a a`` merges from its left, so where a = b there is
no arc from a on c).  A token sequence is the encoding of a word exactly if the
final automaton accepts it, and each word has one such sequence.  Copying arcs
for 50,000 gadgets would need a square table of 2.5 billion bits, so each
gadget keeps a reference instead, its parts and its number; looking an arc up
walks gadgets from the youngest down.

Table.  Encoding runs a deterministic automaton over bytes.  All tokens that
may still be going on after some bytes begin within the longest suffix of these
bytes that begins a token; so a state is this suffix and the last token of the
encoding of every prefix that ends within it.  On a byte, one token alone ends
there and has an arc from the token that ends where it begins: it is the last
token of the longer prefix, and the state's label.  States and their rows, which
hold only bytes that were met, are made when a byte first leads to them, and
kept in a bounded table.  A word takes one transition for each byte, never
back; its encoding is then read off the labels from its end.  Decoding emits
the arcs' labels.

Defined cases: a null text is empty and has no ids; a very long text or word
takes one step for each byte, and only short pieces are kept in tables;
repeated rows are encoded as rows of their own; an empty table gives no rows;
other columns than doc_id and text play no part.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from quillframe.llm.common import held, small

#: The byte-level pre-split of this family of vocabularies.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the word table of one Python worker; it is emptied when full.
WORD_TABLE = 300_000
STOPS = ".,;:!?"  # each is a pre-split word of its own after letters
#: States of the byte automaton that a worker keeps; it starts anew when they are more.
STATES = 150_000
START = -1  # stands for the last token where there is none yet
LONGEST_KEPT = 48
#: Text without any of these can be cut at every space.
ROUGH = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """Compiled from a tokenizer's JSON: its vocabulary, merges and added tokens."""

    def __init__(self, spec: dict) -> None:
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.labels: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.labels[i] = raw(s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            self.labels[i] = s.encode()
        n = len(self.labels)
        # Gadget of each token: its number (-1: a single byte), the token whose in-arcs and the one whose out-arcs it copied.
        self.born, self.first, self.last = [-1] * n, [-1] * n, [-1] * n
        self.cut: dict[int, int] = {}  # deleted arcs, and the gadget that deleted them
        self.width = n
        self.ids = {raw(s): i for s, i in vocab.items() if len(s) == 1}  # of tokens that some text has
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.begins = {x[:k] for x in self.ids for k in range(len(x))}  # what begins a token and is not all of it
        self.size = [len(x) for x in self.labels]
        # The byte automaton: its arcs by state and byte, and of each state the label and what tells it apart.
        self.next: dict[int, int] = {}
        self.token = [START]
        self.told: list[tuple[bytes, tuple[int, ...]]] = [(b"", (START,))]
        self.states = {self.told[0]: 0}

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        """Add the token c, unless no sequence has a and b side by side by now."""
        if self.born[c] >= 0:
            raise ValueError(f"two merges make the token {c}")
        if self.labels[a] in self.ids and self.labels[b] in self.ids and self._walk(a, b):
            self.cut[a * self.width + b] = k
            self.born[c], self.first[c], self.last[c] = k, a, b
            self.ids[self.labels[c]] = c

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state`` in the automaton over tokens."""
        return state == START or self._walk(state, token)

    def _walk(self, s: int, t: int) -> bool:
        born, when = self.born, 1 << 60
        while True:
            if self.cut.get(s * self.width + t, when) < when:
                return False
            young = max(born[s], born[t])
            if young < 0:
                return True
            when = young
            if s == t:  # the gadget's own loop: out of its last part, into its first
                s, t = self.last[s], self.first[t]
            elif born[s] > born[t]:
                s = self.last[s]
            else:
                if self.first[t] == self.last[t] == s:
                    return False  # a, then a a: the left pair merges first
                t = self.first[t]

    def _extend(self, state: int, byte: int) -> int:
        """The state after ``byte``, from now on in the table."""
        suffix, last = self.told[state]
        suffix += bytes((byte,))
        label = next(t for k in range(len(suffix)) if (t := self.ids.get(suffix[k:])) is not None and self.arc(last[k], t))
        last += (label,)
        k = next(k for k in range(len(suffix) + 1) if suffix[k:] in self.begins)
        told = (suffix[k:], last[k:])
        if len(self.token) >= STATES:
            self.next.clear()
            del self.token[1:], self.told[1:]
            self.states = {self.told[0]: 0}
            state = None
        to = self.states.get(told)
        if to is None:
            to = self.states[told] = len(self.token)
            self.token.append(label)
            self.told.append(told)
        if state is not None:
            self.next[state << 8 | byte] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word: one transition for each byte, then the labels from the end."""
        step, token, state, last = self.next.get, self.token, 0, []
        for byte in word:
            to = step(state << 8 | byte)
            state = self._extend(state, byte) if to is None else to
            last.append(token[state])
        path, at, size = [], len(word), self.size
        while at:
            path.append(last[at - 1])
            at -= size[path[-1]]
        path.reverse()
        return path


class Codec:
    """Whole texts to ids (little-endian unsigned 32-bit) and back.

    Texts are cut at single spaces between two non-space characters, where no
    pre-split word reaches across; the pieces' ids are kept in a bounded table.
    """

    def __init__(self, spec: dict) -> None:
        self.automaton = MergeAutomaton(spec)
        self.split = regex.compile(PRE_SPLIT).findall
        self.added = self.automaton.added
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.smooth = re.compile(r"(?<=\S) (?=\S)").split
        self.words = _Table(lambda w: _pack(self.automaton.encode_word(w.encode())), WORD_TABLE // 5)
        self.table = _Table(self._spaced, WORD_TABLE)

    def _fresh(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def _spaced(self, piece: str) -> bytes:
        if piece.isalpha():
            return _pack(self.automaton.encode_word((" " + piece).encode()))
        if piece[-1] in STOPS and piece[:-1].isalpha():
            return self.table[piece[:-1]] + self.words[piece[-1]]
        return self._fresh(" " + piece)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        rough = text[0] == " " or text[-1] == " " or any(map(text.__contains__, ROUGH))
        pieces = self.smooth(text) if rough else text.split(" ")
        return self._fresh(pieces[0]) + b"".join(map(self.table.__getitem__, pieces[1:]))

    def encode(self, text: str) -> bytes:
        if self.special and any(s in text for s in self.added):
            return b"".join(_pack([self.added[x]]) if x in self.added else self._plain(x) for x in self.special.split(text))
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Table(dict):
    """Ids by piece of text.  Fills itself, keeps short pieces only, and when full keeps what is used again."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > LONGEST_KEPT:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def codec_of(spec_json: str) -> Codec:
    """The worker's codec for a tokenizer; compiled once per process."""
    return held("codec " + spec_json, lambda: Codec(json.loads(spec_json)))


def merges_by_rank(spec_json: str) -> bool:
    """Whether merging the adjacent pair that makes the smallest id gives the same ids.

    It does if ids rise with merges and every token is the encoding of its own
    bytes.  When a pair that makes a token is next, all smaller merges are done
    within its bytes, as they would be for the bytes alone; so the pair is the
    one that the token's merge names.
    """
    spec = json.loads(spec_json)
    made = MergeAutomaton(spec)
    by_merge = sorted((i for i in made.ids.values() if made.born[i] >= 0), key=made.born.__getitem__)
    return by_merge == sorted(by_merge) and len(by_merge) == len(spec["model"]["merges"]) and len(made.ids) == len(spec["model"]["vocab"])


def encoder_of(spec_json: str, by_rank: bool):
    """Text to ids (little-endian unsigned 32-bit) where nothing else is needed: by rank in a compiled library, if that gives the same ids."""
    if not by_rank:
        return codec_of(spec_json).encode

    def make():
        spec = json.loads(spec_json)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        return tiktoken.Encoding("by_rank", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    made = held("by rank " + spec_json, make)
    return lambda text: made.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def read_spec(path: str) -> str:
    """A tokenizer file on the driver, as text; vocabulary files are a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of every document; a null text is empty."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for b in batches:
            ids = [codec.encode(x or "") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(small(run), f"doc_id {kind}, ids binary, decoded string")
