"""Two tokenizers over the same texts: which tokens overlap, where both cut, and how often a pair of tokens meets.

The owner of a byte is the token it belongs to. np.repeat of token numbers over their bytes gives an array of owners for
each tokenizer; each run of one pair of owners is a link between two tokens, and where both owners change at once both
tokenizers cut, which parts the text into groups.

A space between two characters that are no white space parts a text for both tokenizers: byte-level patterns start a piece
there, and no piece of the other vocabulary has its word mark behind another character (checked when it is loaded; without
that, texts are taken whole). So texts are encoded by their distinct chunks, a worker keeps what the first ``KEPT`` of
those came to, and a document is the sum of its chunks.

How many documents hold a pair is counted in one aggregate of each document's distinct pairs. The commonest pairs (at most
HOT rows) then go to every task as sorted arrays; what remains of the documents' pairs is joined with the other counts.
Both ways use the same counts, so the bound moves work and never results.

Defined results for odd input: a null or empty text, or one whose tokens don't spell a space and the text (as when it holds
the word mark itself), has no tokens, zero counts and an empty digest; texts are taken whole, whatever their length; rows
that repeat an id or have none are rows like others, and each counts as a document of its own; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bpe
from tesserae.llm._words import blocks
from tesserae.llm.ranks import Ranks
from tesserae.runtime import discard, written

#: Chunks that a worker remembers and the longest of them; pairs that are sent to every task; bytes of text at once.
KEPT, LONGEST, HOT, BLOCK = 1 << 18, 48, 1 << 18, 1 << 22
#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
_cut = re.compile(r"(?<=\S) (?=\S)").split


class Pieces:
    """A piece model: ids and bytes of tokens; ``parted`` if the word mark only ever leads a piece."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, m = self._model.get_piece_size(), self._model
        spelled = [m.id_to_piece(i) for i in range(self.size)]
        self.label = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(spelled)]
        self.parted = not any(MARK in p.lstrip(MARK) for p in spelled)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Chunks:
    """What chunks of text come to: an entry each in arrays that grow with them."""

    def __init__(self, pair: Pair):
        self.pair, self.at = pair, {}
        self.numbers = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.good = np.zeros(0, bool)
        self.links = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # of each chunk's links
        self.spelled: list[bytes] = []

    def add(self, chunks: list[str]) -> None:
        numbers, good, links, spelled = self.pair.compared(chunks)
        self.at.update(zip(chunks, range(len(self.good), len(self.good) + len(chunks)), strict=True))
        self.numbers = np.concatenate([self.numbers, numbers], axis=1)
        self.good, self.links = np.concatenate([self.good, good]), np.concatenate([self.links, links])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(numbers[3])])
        self.spelled += spelled

    def keep(self, n: int) -> None:
        """Forget all but the first ``n`` chunks."""
        if n < len(self.good):
            for chunk in list(self.at)[n:]:
                del self.at[chunk]
            self.numbers, self.good, self.first = self.numbers[:, :n], self.good[:n], self.first[: n + 1]
            self.links = self.links[: self.first[-1]]
            del self.spelled[n:]

    def indexes(self, chunks: list[str]) -> np.ndarray:
        """Entry numbers; chunks met for the first time are added, short ones first, for those may be kept."""
        got = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        missed = np.flatnonzero(got < 0)
        if len(missed):
            missing = [chunks[i] for i in missed.tolist()]
            new = list(dict.fromkeys(missing))
            short = [c for c in new if len(c) <= LONGEST]
            if len(short) < len(new):
                short += [c for c in new if len(c) > LONGEST]
            self.add(short)
            got[missed] = np.fromiter(map(self.at.__getitem__, missing), np.int64, len(missing))
        return got


class Pair:
    """Both tokenizers and what is kept about chunks."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Ranks(a_path), Pieces(b_path)
        self.bytes_a, self.bytes_b = (np.array([len(x) for x in side.label], np.int64) for side in (self.a, self.b))
        # each id in decimal with each mark that may follow it, so that groups are spelled by look-ups
        most = max(self.a.size, self.b.size)
        self.digits = np.array([f"{i}{mark}".encode() for mark in (",", "|", ";") for i in range(most)])
        self.most = most
        self.known = Chunks(self)

    def cut(self, text: str) -> list[str]:
        """The chunks of a text; a space lies between any two."""
        if not self.b.parted:
            return [text]
        return text.split(" ") if bpe._tight(text) else _cut(text)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B one after the other, how many each text has, and which texts both spell; others have none."""
        ids, labels = [self.a.ordinary([" " + t for t in texts]), self.b.encode(texts)], (self.a.label, self.b.label)
        want = [b" " + t.encode() for t in texts]
        good = np.ones(len(texts), bool)
        # all at once: equal bytes, and as many for each text
        whole = b"".join(want)
        same = all(b"".join(map(label.__getitem__, chain.from_iterable(x))) == whole for x, label in zip(ids, labels, strict=True))
        if not same or any(bounds.any() for bounds in self._bounds(ids, want)):
            for i, text in enumerate(want):
                if any(b"".join(map(label.__getitem__, x[i])) != text for x, label in zip(ids, labels, strict=True)):
                    good[i], ids[0][i], ids[1][i] = False, [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in ids)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip(ids, (n_a, n_b), strict=True))
        return a, b, n_a, n_b, good

    def _bounds(self, ids: list[list[list[int]]], want: list[bytes]) -> Iterator[np.ndarray]:
        """For each tokenizer, whether a text's tokens have another number of bytes than the text."""
        size = np.fromiter(map(len, want), np.int64, len(want))
        for side, lengths in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
            n = np.fromiter(map(len, side), np.int64, len(side))
            found = lengths[np.fromiter(chain.from_iterable(side), np.int64, int(n.sum()))]
            upto = np.concatenate([[0], np.cumsum(found)])
            yield upto[np.cumsum(n)] - upto[np.cumsum(n) - n] != size

    def owners(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links as token numbers of A and of B, and the group of each token of A and of B.

        The tokens of both spell the same bytes. A text's end is the end of a token in both, so texts in a row are parted.
        """
        own_a, own_b = np.repeat(np.arange(len(a)), self.bytes_a[a]), np.repeat(np.arange(len(b)), self.bytes_b[b])
        new_a, new_b = np.diff(own_a, prepend=-1) != 0, np.diff(own_b, prepend=-1) != 0
        group = np.cumsum(new_a & new_b) - 1
        starts = np.flatnonzero(new_a | new_b)
        return own_a[starts], own_b[starts], group[np.flatnonzero(new_a)], group[np.flatnonzero(new_b)]

    def compared(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For each text its numbers of tokens, groups and links, whether both spell it, its links and its groups spelled."""
        a, b, n_a, n_b, good = self.tokens(texts)
        left, right, group_a, group_b = self.owners(a, b)
        of_a, of_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        n_groups, n_links = np.bincount(of_a[last_a], minlength=len(texts)), np.bincount(of_a[left], minlength=len(texts))
        # a group's tokens of A, then those of B
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        out = np.empty(len(a) + len(b), self.digits.dtype)
        out[place_a], out[place_b] = self.digits[a + self.most * last_a], self.digits[b + 2 * self.most * last_b]
        ends = np.cumsum(np.char.str_len(out))[np.cumsum(n_a + n_b) - 1] if len(out) else np.zeros(len(texts), np.int64)
        raw, begin, spelled = out.tobytes().translate(None, b"\0"), 0, []
        for end, fine in zip(ends.tolist(), good.tolist(), strict=True):
            spelled.append(raw[begin : end - 1] if fine else b"")
            begin = end if fine else begin
        return np.stack([n_a, n_b, n_groups, n_links]), good, a[left] * self.b.size + b[right], spelled


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Pair:
    """Both tokenizers, built once in each Python worker."""
    return Pair(a_path, b_path)


_MEASURES = "_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_FIELDS = pa.schema(
    [("_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)


def _weighed(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their sums of weights."""
    if not len(code):
        return code, weight
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    return code[first], np.add.reduceat(weight[order], first)


class _Block:
    """The rows of a block of texts: counts and digest of each, and each one's distinct pairs with how often."""

    def __init__(self, n: int):
        self.numbers, self.digest = np.zeros((4, n), np.int64), [""] * n
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fill(self, chunks: Chunks, rows: list[int], parts: list[list[str]]) -> list[int]:
        """Measure texts by their chunks; the rows that have a chunk which isn't spelled right are left and returned."""
        at = chunks.indexes([c for p in parts for c in p])
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(n) - n
        good = np.logical_and.reduceat(chunks.good[at], begin)
        here = np.array(rows, np.int64)
        self.numbers[:, here[good]] = np.add.reduceat(chunks.numbers[:, at], begin, axis=1)[:, good]
        listed, spelled = at.tolist(), chunks.spelled
        for row, a, k, fine in zip(rows, begin.tolist(), n.tolist(), good.tolist(), strict=True):
            if fine:
                self.digest[row] = hashlib.sha256(b";".join([spelled[i] for i in listed[a : a + k]])).hexdigest()
        kept = np.repeat(good, n)
        entries = len(chunks.good)
        code, count = _weighed((np.repeat(here, n) * entries + at)[kept], np.ones(int(kept.sum()), np.int64))
        row, chunk = np.divmod(code, entries)
        links = chunks.numbers[3, chunk]
        ends = np.cumsum(links)
        where = np.arange(int(links.sum())) + np.repeat(chunks.first[chunk] - (ends - links), links)
        self.pairs.append((np.repeat(row, links), chunks.links[where], np.repeat(count, links)))
        return here[~good].tolist()

    def record(self, ids: pa.Array, span: int) -> pa.RecordBatch:
        row, pair, count = (np.concatenate(x) for x in zip(*self.pairs, strict=True)) if self.pairs else [np.zeros(0, np.int64)] * 3
        code, times = _weighed(row * span + pair, count)
        row, pair = np.divmod(code, span)
        offsets = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pair, times)]
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, self.numbers), pa.array(self.digest, pa.string()), *lists], schema=_FIELDS)


def _measured(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(a_path, b_path)
        for batch in batches:
            for start, end in blocks(batch.column(1), BLOCK):
                part = batch.slice(start, end - start)
                texts, block = part.column(1).to_pylist(), _Block(part.num_rows)
                rows = [i for i, t in enumerate(texts) if t]
                old = len(pair.known.good)
                odd = block.fill(pair.known, rows, [pair.cut(texts[i]) for i in rows]) if rows else []
                if odd:  # whole texts decide
                    block.fill(Chunks(pair), odd, [[texts[i]] for i in odd])
                pair.known.keep(min(KEPT, old + sum(len(c) <= LONGEST for c in islice(pair.known.at, old, None))))
                yield block.record(part.column(0), pair.a.size * pair.b.size)

    return run


def measured(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_id``, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs of its
    links (id in A times the size of B, and id in B) with how often each is linked."""
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(_measured(a_path, b_path), _MEASURES)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment itself: per row of ``docs`` its ids in A and in B, the group of each token, and the links as token
    numbers in A and in B."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(a_path, b_path)
        for batch in batches:
            for start, end in blocks(batch.column(1), BLOCK):
                part, found = batch.slice(start, end - start), []
                for text in part.column(1).to_pylist():
                    a, b, _, _, _ = pair.tokens([text] if text else [])
                    left, right, group_a, group_b = pair.owners(a, b)
                    found.append((a, b, group_a, group_b, left, right))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.list_(pa.int32())) for c in zip(*found, strict=True))], names=["_id", *names])

    names = ["a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b"]
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, "_id long, " + ", ".join(f"{n} array<int>" for n in names)).withColumnRenamed("_id", id_col)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many rows hold a pair, and whether that is the most of all pairs of its token of A."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    token = F.floor(F.col("pair") / size_b)
    tops = counts.groupBy(token.alias("_a")).agg(F.max("n").alias("_top"))
    return counts.join(tops, token == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def _least_hot(counts: DataFrame, hot: int) -> int:
    """The least count such that at most ``hot`` pairs reach it, from a histogram of at most 1,024 rows."""
    level = F.ceil(F.log2("n") * 16)
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()
    least, so_far = 1 << 62, 0
    for step in sorted(steps, key=lambda r: -r["level"]):
        so_far += step["k"]
        if so_far > hot:
            break
        least = step["least"]
    return least


def _looked_up(pair: np.ndarray, n: np.ndarray, best: np.ndarray):
    """Sums over the pairs of a row that are found in the arrays; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            lengths = np.diff(pairs.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            keys, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
            hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[hit], weight[hit] * n[at[hit]])
            np.add.at(sums[1], row[hit], weight[hit] * best[at[hit]])
            offsets = pa.array(np.searchsorted(row[~hit], np.arange(batch.num_rows + 1)), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], pa.int64())) for x in (keys, weight)]
            small = [batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")]
            names = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*small, *map(pa.array, sums), *rest], names=[*names, "_sum", "_best", "pairs", "times"])

    return run


def scored(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A token's commonest in
    the corpus), count_sum (documents that hold a link's pair, summed over links) and groups_sha256."""
    rows = written(measured(docs, a_path, b_path, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "alignment")
    counts = written(pair_counts(rows, load(a_path, b_path).b.size), "counts")
    least = _least_hot(counts, hot)
    common = counts.filter(F.col("n") >= least).toPandas().sort_values("pair")  # at most ``hot`` rows
    look_up = _looked_up(common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), common["best"].to_numpy(np.int64))
    small = "_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    part = written(rows.mapInArrow(look_up, f"{small}, _row long, _sum long, _best long, pairs array<long>, times array<long>"), "looked-up")
    discard(rows)
    left = part.filter(F.size("pairs") > 0).select(F.col("_row").alias("_r"), F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("_r", "_l.*")
    rare = counts.filter(F.col("n") < least).select(F.col("pair").alias("pairs"), "n", F.col("best").cast("long").alias("best"))
    sums = left.join(rare, "pairs").groupBy("_r").agg(F.sum(F.col("times") * F.col("n")).alias("_more"), F.sum(F.col("times") * F.col("best")).alias("_better"))
    out = part.join(sums, F.col("_row") == F.col("_r"), "left")
    return out.select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("_best") + F.coalesce("_better", F.lit(0))).alias("n_best"),
        (F.col("_sum") + F.coalesce("_more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
