"""Packing documents into sequences of bounded length: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity`` counts whatever the
number of documents. The plan is made on that histogram on the driver: the reduction fixes small sets of lengths that
provably dominate every alternative for their largest member, as often as the counts allow; best fit in falling order of
length packs the rest, whole groups of equal sequences at a time. The plan's slots are handed to documents by their rank
among pieces of equal length, which salted windows count, so that a length that a third of all pieces have is split.

Defined results for odd input: a null or empty text has no ids but the closing one and packs as one piece of length 1;
texts are encoded whole and cut only beyond the capacity; repeated rows and repeated or null ids are packed row by row;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import ranks
from tesserae.runtime import written

CAPACITY, CLOSING = 1024, 2
#: Least and most parts that the pieces of one length are ranked in, and pieces that a part should have.
SALTS, PART = (64, 1024), 1 << 16

Group = tuple[tuple[int, ...], int]


def dominated(counts: np.ndarray) -> list[Group]:
    """Sets of lengths that some best packing holds, with how often; ``counts`` is left with the rest.

    For the largest length j and room r beside it (all other sets with j being dominated):
    - nothing fits: {j}; a length of exactly r: {j, r};
    - no two fit: {j, k}, k the largest that fits;
    - no three fit: {j, k} if no two that fit sum to more than k, else {j, k, b} with b the largest that fits beside
      both, if in no two that fit the smaller exceeds b.
    """
    capacity, fixed = len(counts) - 1, []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                r = capacity - j
                counts[j] -= 1
                sizes = np.flatnonzero(counts[: r + 1])
                chosen = _dominating(counts, sizes, r)
                counts[j] += 1
                if chosen is None:
                    break
                group = (j, *chosen)
                need = {s: group.count(s) for s in group}
                times = int(min(counts[s] // k for s, k in need.items()))
                if not chosen and j <= r:
                    times = 1  # the last of its length: two would fit together
                for s, k in need.items():
                    counts[s] -= k * times
                fixed.append((group, times))
                changed = True
    return fixed


def _dominating(counts: np.ndarray, sizes: np.ndarray, r: int) -> tuple[int, ...] | None:
    if not len(sizes):
        return ()
    k = int(sizes[-1])
    if k == r:
        return (k,)
    least = [int(s) for s in sizes[:3] for _ in range(min(3, int(counts[s])))][:3]
    if len(least) < 2 or least[0] + least[1] > r:
        return (k,)
    if len(least) > 2 and sum(least) <= r:
        return None
    # pairs that fit: for each smaller member its largest partner
    best, smaller = 0, 0
    listed = sizes.tolist()
    for a in listed:
        at = bisect_left(listed, r - a + 1) - 1
        b = listed[at] if at >= 0 else 0
        if b == a and counts[a] < 2:
            b = listed[at - 1] if at else 0
        if b >= a:
            best, smaller = max(best, a + b), max(smaller, a)
    if best <= k:
        return (k,)
    counts[k] -= 1
    beside = np.flatnonzero(counts[: r - k + 1])
    counts[k] += 1
    if len(beside) and smaller <= int(beside[-1]):
        return (k, int(beside[-1]))
    return None


def best_fit(counts: np.ndarray) -> list[Group]:
    """Best fit in falling order of length; equal sequences are filled together."""
    capacity = len(counts) - 1
    at: dict[int, list[Group]] = {}
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            room = next((r for r in range(s, capacity) if at.get(r)), capacity)
            held, times = at[room].pop() if room < capacity else ((), left)
            each = room // s
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            rest = min(rest, each - 1) if full == left // each else 0
            if full:
                at.setdefault(room - each * s, []).append((held + (s,) * each, full))
            if rest:
                at.setdefault(room - rest * s, []).append((held + (s,) * rest, 1))
            unused = times - full - bool(rest)
            if room < capacity and unused:
                at.setdefault(room, []).append((held, unused))
            left -= full * each + rest
    return [g for groups in at.values() for g in groups]


def plan(counts: np.ndarray) -> list[Group]:
    """Sequences as (lengths, how often), for counts[length] pieces of each length."""
    rest = counts.copy()
    return dominated(rest) + best_fit(rest)


class Slots:
    """Where the plan puts the n-th piece of each length."""

    def __init__(self, groups: list[Group], capacity: int):
        ranks, sequence, found = [0] * (capacity + 1), 0, []
        for lengths, times in groups:
            offset = 0
            for s in lengths:
                found.append((s << 44 | ranks[s], sequence, offset))
                ranks[s] += times
                offset += s
            sequence += times
        found.sort()
        table = np.array(found, np.int64).reshape(-1, 3)
        self.key, self.sequence, self.offset = table.T
        self.n = sequence

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        return self.sequence[at] + (rank - (self.key[at] & ((1 << 44) - 1))), self.offset[at]


_PIECE = pa.schema([("_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str, capacity: int, closing: int):
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ranks.load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        row = (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECE, strict=True)], schema=_PIECE)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: ``_id``, piece, start, length and ids_crc32."""
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(_pieces(path, capacity, closing), "_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    found = written(pieces(docs, path, capacity, closing, id_col, text_col), "pieces")
    parts = max(SALTS[0], min(SALTS[1], found.count() // PART))
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    # at most capacity * parts rows
    tally = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).toPandas()
    counts = np.zeros((capacity + 1, parts), np.int64)
    counts[tally["length"].to_numpy(np.int64), tally["_salt"].to_numpy(np.int64)] = tally["_n"].to_numpy(np.int64)
    before = np.cumsum(counts, axis=1) - counts
    slots = Slots(plan(counts.sum(axis=1)), capacity)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = before[length, batch.column("_salt").to_numpy()] + batch.column("_rank").to_numpy() - 1
            sequence, offset = slots.place(length, rank)
            kept = [batch.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "_salt").orderBy("_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order).cast("long"))
    out = ranked.mapInArrow(placed, "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
