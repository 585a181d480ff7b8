"""Byte-level BPE files encoded by the rank of pairs, as a library does it.

If a file's merges are in the order of the ids they make, an id is the rank of its bytes and the fast encoder for ranks gives the
same ids; else the tokenizers library encodes.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

from tesserae.llm.bpe import PATTERN, byte_symbols


class Ranks:
    """A byte-level BPE file: ``label`` has the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, symbols = file["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        spelled = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.label = [b""] * self.size
        for t, i in spelled.items():
            self.label[i] = t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        self._ranked = all(x < y for x, y in zip(made, made[1:], strict=False))
        if self._ranked:
            self._ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=spelled, special_tokens=self.special)
        else:
            self._plain, self._whole = _library(path, True), _library(path, False)

    def ordinary(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts in which the strings of special tokens are ordinary text."""
        if self._ranked:
            return list(map(self._ranks.encode_ordinary, texts))
        return [x.ids for x in self._plain.encode_batch(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        """Ids of a text, special tokens where their strings are, as little-endian unsigned 32-bit numbers."""
        if not self._ranked:
            ids = self._whole.encode(text, add_special_tokens=False).ids
        elif any(t in text for t in self.special):
            ids = self._ranks.encode(text, allowed_special="all")
        else:
            ids = self._ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


def _library(path: str, plain: bool):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    """The encoder of a file, built once in each Python worker."""
    return Ranks(path)
