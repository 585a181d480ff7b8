"""Words, word hashes and word shingles of Arrow string arrays, computed on whole byte buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value of the contract: the bytes that part words.
SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text handled at once, unless one text is longer.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        top = _POWERS[-1:] * _BASE
        _POWERS = np.concatenate([_POWERS, _POWERS * top])
    return _POWERS


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls empty, and the len + 1 places where texts start."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about ``size`` bytes."""
    _, off = utf8(texts)
    at = 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield at, end
        at = end


class Words:
    """The words of a block of texts: ``start`` and ``end`` in ``raw``, ``doc`` and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        raw, off = utf8(texts)
        self.raw = _LOWER[raw] if lower else raw
        self.n_docs = len(off) - 1
        inside = ~_IS_SPACE[self.raw]
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        prev = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
        begins = inside & (first[:-1] | ~prev)
        after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.flatnonzero(self.inside)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        k = np.arange(len(at)) - np.repeat(begin, size)
        terms = _BYTE[self.raw[at]] * _powers(int(size.max()))[k]
        return mix(np.add.reduceat(terms, begin) + size.astype(np.uint64))

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def shingles(words: Words, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word runs; of all its words if they are fewer."""
    h, scale = words.hashes(), stream(2, width + 1)
    n = len(h)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        whole += h[j : n - width + 1 + j] * scale[j] if n >= width else whole
    whole = mix(whole)
    out = []
    for d in range(words.n_docs):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            some = np.sum(h[a:b] * scale[: b - a], keepdims=True) + scale[width:] * np.uint64(b - a)
            out.append(mix(some))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
