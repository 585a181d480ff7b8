"""Byte-pair encoding as an automaton over tokens, and decoding by the labels of its arcs.

Construction. The automaton starts with one state that every byte leads back to: all byte sequences are accepted. Merges
are compiled in order, and each adds one gadget for its pair (left, right):
- the state that ``left`` leads to loses its arc ``right``, for that pair is from now on written as one token;
- wherever ``left`` and then ``right`` could be read, an arc for the new token leads to a state that copies the state
  ``right`` leads to as it is at this moment.
What is then accepted are exactly the token sequences that merging in order leaves. A copy is not written out: a state
keeps the arcs it lost itself and the state it was copied from with the moment of the copy, and an arc for a token made
of (left, right) exists if the arc for ``left`` existed when the token was made. ``Automaton.follows`` looks that up; arcs
that have been asked for are kept in a table.

Encoding. A word has one accepted reading, and so has every prefix of it. Read by bytes, the automaton is made deterministic:
a state of the table holds, for each place that a token may still be open from, the token read last there and the node of
a byte trie, and a byte leads to the next state and to the token that ends the reading of the prefix. Transitions are
compiled when they are first met (there are far too many to write out) and kept; after that a byte is one look-up. Going
back from the end over the lengths of those tokens gives the reading, so the work grows with the length of the word.

Texts are first cut as byte-level BPE files ask: special tokens, then the pattern of the pre-tokenizer.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

#: Fixed value: the pre-tokenizer's pattern of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text whose encoding a worker remembers, and rows of the table: some 150 MB in all.
REMEMBERED, ROWS = 200_000, 150_000
#: Marks that are a piece of their own behind a word, and the end of the Latin letters.
MARKS = tuple(".,;:!?")
PLAIN = "\u0250"
#: Longer pieces, in characters, are encoded each time.
LONGEST = 48


#: White space but the space, in the widest sense.
_OTHER_SPACE = re.compile(r"[^\S ]+").finditer


def _tight(text: str) -> bool:
    """True if no white space stands beside a space or at an end of the text."""
    if not text or "  " in text or text[0].isspace() or text[-1].isspace():
        return False
    return all(text[m.start() - 1] != " " and text[m.end()] != " " for m in _OTHER_SPACE(text))


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Row(dict):
    """A row of the table: (next row, token that ends there) by byte.

    ``open``: the token last read (one more, so that the start is 0) and, in the lower 32 bits, the trie node since.
    """

    __slots__ = ("machine", "open")

    def __init__(self, machine: Automaton, open_: tuple[int, ...]):
        self.machine, self.open = machine, open_

    def __missing__(self, byte: int) -> tuple[_Row, int]:
        return self.machine._step(self, byte)


class Automaton:
    """States are tokens: the state of a token is where its arcs lead. State -1 is the start."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        #: labels[t] is what the arc of token t writes; merges are (left, right, made) in order.
        self.labels = labels
        n = len(labels)
        self.made = [-1] * n
        self.copied = [-1] * n
        self.head = [-1] * n
        self.lost: dict[int, int] = {}
        for moment, (left, right, made) in enumerate(merges):
            self.lost.setdefault(left << 32 | right, moment)
            if self.made[made] < 0:
                self.made[made], self.copied[made], self.head[made] = moment, right, left
        # a token whose own pair could no longer be read when its turn came is never written, nor is one made from it
        dead: set[int] = set()
        for moment, (left, right, made) in enumerate(merges):
            if left in dead or right in dead or not self._has_arc(left, right, moment):
                dead.add(made)
        self._arcs: dict[int, bool] = {}
        #: The byte trie: what each node leads to, and the token that ends there or -1.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, label in enumerate(labels):
            if label and t not in dead and (self.made[t] >= 0 or len(label) == 1):
                node = 0
                for b in label:
                    at = self.next[node].get(b)
                    if at is None:
                        at = self.next[node][b] = len(self.next)
                        self.next.append({})
                        self.token.append(-1)
                    node = at
                self.token[node] = t
        self.size = [len(x) for x in labels]
        #: The table: its start, and rows by what is open in them.
        self._start = _Row(self, (0,))
        self._rows: dict[tuple[int, ...], _Row] = {}

    def _has_arc(self, state: int, token: int, now: int = 1 << 60) -> bool:
        """Whether the arc is there at the moment ``now``: it, or one it was made from, wasn't lost by then."""
        at, until = state, now
        while at >= 0:
            t, before = token, now - 1
            while t >= 0:
                moment = self.lost.get(at << 32 | t)
                if moment is not None and moment < until and moment <= before:
                    return False
                before, t = self.made[t], self.head[t]
            until, at = min(until, self.made[at]), self.copied[at]
        return True

    def follows(self, state: int, token: int) -> bool:
        """Whether the state of ``state`` has an arc for ``token``."""
        if state < 0:
            return True
        key = state << 32 | token
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) > 2 * REMEMBERED:
                self._arcs.clear()
            found = self._arcs[key] = self._has_arc(state, token)
        return found

    def _step(self, row: _Row, byte: int) -> tuple[_Row, int]:
        """Adds the transition of a row of the table for a byte: the row it leads to and the token that ends there."""
        made, open_ = -1, []
        for place in row.open:
            on = self.next[place & 0xFFFFFFFF].get(byte)
            if on is not None:
                t = self.token[on]
                if made < 0 <= t and self.follows((place >> 32) - 1, t):
                    made = t
                if self.next[on]:
                    open_.append(place >> 32 << 32 | on)
        open_.append(made + 1 << 32)
        key = tuple(open_)
        to = self._rows.get(key)
        if to is None:
            to = _Row(self, key)
            if len(self._rows) >= ROWS:
                return to, made  # the table is full of what came first, and so of what comes most; this row isn't kept
            self._rows[key] = to
        row[byte] = to, made
        return to, made

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word: a transition for each byte, then back from the end over the tokens' lengths."""
        row, ends = self._start, []
        add = ends.append
        for byte in word:
            row, t = row[byte]
            add(t)
        out, size, i = [], self.size, len(word)
        while i:
            t = ends[i - 1]
            out.append(t)
            i -= size[t]
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the arcs' labels spell; bytes that are no UTF-8 come out as U+FFFD."""
        return b"".join([self.labels[t] for t in ids]).decode("utf-8", "replace")


class Encoder:
    """A byte-level BPE file: special tokens, pre-split, automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        symbols, vocab = byte_symbols(), file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        labels = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for word, t in vocab.items():
            labels[t] = bytes(symbols[c] for c in word) if word not in special else word.encode()
        for word, t in special.items():
            labels[t] = word.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(labels, merges)
        self.special = special
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._pieces = regex.compile(PATTERN).findall
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _word(self, piece: str) -> bytes:
        found = self._words.get(piece)
        if found is None:
            if len(self._words) > REMEMBERED:
                self._words.clear()
            found = array("I", self.automaton.encode(piece.encode())).tobytes()
            if len(piece) <= LONGEST:
                self._words[piece] = found
        return found

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._word, self._pieces(text)))

    def _run(self, chunk: str) -> bytes:
        if len(self._known) > REMEMBERED:
            self._known.clear()
        if chunk.isalpha() and max(chunk) < PLAIN:
            # letters alone are one piece with the space before them
            found = array("I", self.automaton.encode(b" " + chunk.encode())).tobytes()
        elif chunk[-1:] in MARKS and (word := chunk[:-1]).isalpha() and max(word) < PLAIN:
            found = (self._known.get(word) or self._run(word)) + self._word(chunk[-1])
        else:
            found = self._parted(chunk)
        if len(chunk) <= LONGEST:
            self._known[chunk] = found
        return found

    def _parted(self, chunk: str) -> bytes:
        """A chunk of which parts are joined by single line ends; one between other characters is a piece of its own."""
        first, *rest = chunk.split("\n")
        if not rest or not all(map(str.isalnum, (x[:1] for x in rest))) or first[-1:].isspace() or not first or any(x[-1:].isspace() for x in rest[:-1]):
            return self._cut(" " + chunk)
        out, end = [self._known.get(first) or self._run(first)], self._word("\n")
        for x in rest:
            out += end, (self._word(x) if x.isalpha() and max(x) < PLAIN else self._cut(x))
        return b"".join(out)

    def _ordinary(self, text: str) -> bytes:
        """Ids of text without special tokens.

        A single space followed by something that neither begins nor ends with white space is cut alike wherever it
        stands, so such chunks are looked up whole; the rest of the text is cut as it is.
        """
        known, run, out = self._known.get, self._run, []
        parts = text.split(" ")
        if not _tight(text):
            held = [parts[0]]
            for c in parts[1:]:
                before = held[-1]
                if c and before and not c[0].isspace() and not before[-1].isspace():
                    held.append(c)
                else:
                    held[-1] = f"{before} {c}"
            parts = held
        return self._cut(parts[0]) + b"".join([known(c) or run(c) for c in parts[1:]])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not any(map(text.__contains__, self.special)):
            return self._ordinary(text)
        out = []
        for k, part in enumerate(self._special.split(text)):
            out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2 else self._ordinary(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """The encoder of a file, built once in each Python worker."""
    made = Encoder(path)
    gc.freeze()  # the trie stays, so the collector needn't walk it again and again
    return made


def _digests(path: str):
    import hashlib

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_sha, text_sha = [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _tokens(path: str):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "ids"])

    return run


def encode(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per row of ``docs``: id and its token ids.

    A null text is an empty one and has no ids; texts are encoded whole, whatever their length, and repeated rows each
    give a row; other columns play no part.
    """
    from pyspark.sql import functions as F

    out = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_tokens(path), "_id long, ids array<int>")
    return out.withColumnRenamed("_id", id_col)


def decode(rows, path: str, ids_col: str = "ids", out_col: str = "text"):
    """``rows`` and the text that each row's ids spell; null ids give a null text."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def spelled(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return ids.map(lambda x: None if x is None else bpe.automaton.decode(np.asarray(x).tolist()))

    return rows.withColumn(out_col, spelled(F.col(ids_col)))


def round_trip(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """One row per row of ``docs``: id, n_tokens, and SHA-256 of its ids and of the text they decode to."""
    from pyspark.sql import functions as F

    out = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_digests(path), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("_id", id_col)
