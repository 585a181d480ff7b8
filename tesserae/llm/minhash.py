"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

Each document becomes its set of distinct five-word shingles, hashed to 64 bits. One permutation fills BINS bins with the
least hash that falls in each; an empty bin copies the value of a bin that optimal densification picks by hashing
(bin, attempt) until it meets a full one. ROWS bins make a band, each band a bucket. Documents with equal sets are one
candidate; candidates that share a bucket are linked through the bucket's centres (links.star_components), and a link
stands only if the full sets confirm it. Sizes and a 1024-bit map of each set bound what two sets can share, so most pairs
that aren't links end inside the bucket join and their sets never move; the bound is exact and loses none.

With 36 bands of 7 bins a pair of similarity 0.85 is missed about once in a million times, a pair of 0.8 once in five
thousand.

Defined results for odd input:
- a text that is null or has no word has no shingle and is linked with nothing;
- a text of one to four words has its whole word sequence as its one shingle;
- a null id is a document like any other but can't be the target of a link: its row comes back unlinked;
- rows that repeat an id and a text are marked alike, and ``drop_near_copies`` leaves one; an empty table gives an empty
  result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bloom, links
from tesserae.llm._words import Words, blocks, mix, shingles, stream
from tesserae.runtime import written

WIDTH = 5
BANDS, ROWS = 36, 7
BINS = BANDS * ROWS
#: Words of the bitmap that bounds what two sets can share.
MAP = 16
#: Least hash of each bin, and one past the last.
_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], dtype=np.uint64)
_SCALE = stream(3, ROWS)
_BAND = stream(4, BANDS)


def _donor(empty: np.ndarray, attempt: int) -> np.ndarray:
    """The bin that an empty one asks at this attempt: the same for every document."""
    salt = stream(5 + attempt, 1)
    return (mix(empty.astype(np.uint64) * np.uint64(0x100000001B3) + salt) % np.uint64(BINS)).astype(np.int64)


def signature(found: np.ndarray) -> np.ndarray:
    """The densified one-permutation MinHash of a sorted, non-empty set of hashes."""
    at = np.searchsorted(found, _EDGES)
    full = at < np.append(at[1:], len(found))
    values = np.where(full, found[np.minimum(at, len(found) - 1)], np.uint64(0))
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        donor = _donor(empty, attempt)
        good = full[donor]
        values[empty[good]] = values[donor[good]]
        empty, attempt = empty[~good], attempt + 1
    return values


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket ids of (documents, BINS) signatures."""
    return mix((signatures.reshape(-1, BANDS, ROWS) * _SCALE).sum(axis=2, dtype=np.uint64) + _BAND)


def bitmap(found: np.ndarray) -> np.ndarray:
    """A bit for each hash, in MAP 64-bit words: a bit that only one of two sets has is an element the other lacks."""
    bits = np.zeros(64 * MAP, np.uint8)
    bits[found % np.uint64(64 * MAP)] = 1
    return np.packbits(bits).view(np.int64)


def worth(percent: int) -> str:
    """SQL condition without which two sets can't reach the similarity: by their sizes, then by their bitmaps.

    Each set has at least as many elements of its own as its bitmap has bits of its own, so the rest bounds what they share.
    """
    own = lambda x, y: " + ".join(f"bit_count({x}_m[{i}] & ~{y}_m[{i}])" for i in range(MAP))
    most = f"least(a_n - ({own('a', 'b')}), b_n - ({own('b', 'a')}))"
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) AND (100 + {percent}) * {most} >= {percent} * (a_n + b_n)"


_SKETCH = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_set", pa.binary()), ("_bands", pa.list_(pa.int64())), ("_map", pa.list_(pa.int64()))])
_SETS = pa.schema([("rid", pa.int64()), ("_set", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in blocks(batch.column(1)):
            part = batch.slice(a, b - a)
            sets = shingles(Words(part.column(1)), WIDTH)
            some = [x for x in sets if len(x)]
            buckets = iter(band_hashes(np.stack([signature(x) for x in some])).view(np.int64)) if some else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([next(buckets) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    pa.array([bitmap(x) if len(x) else None for x in sets], pa.list_(pa.int64())),
                ],
                schema=_SKETCH,
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in blocks(batch.column(1)):
            part = batch.slice(a, b - a)
            sets = [x.view(np.int64) for x in shingles(Words(part.column(1)), WIDTH)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=_SETS)


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _n, _set) of every row, and (_gset, _comp) of the sets whose component isn't their own least id."""
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketch = written(narrow.mapInArrow(_sketch, "_id long, _n long, _set binary, _bands array<long>, _map array<long>"), "sketch")
    some = sketch.filter("_n > 0 AND _id IS NOT NULL")
    sets = written(some.groupBy("_set").agg(F.min("_id").alias("rid")).withColumnRenamed("_set", "_gset"), "sets")
    reps = some.join(sets, (F.col("_set") == F.col("_gset")) & (F.col("_id") == F.col("rid")))
    members = written(reps.select("rid", F.explode("_bands").alias("bucket")).distinct(), "bands")

    # the full sets of those documents that share a bucket with another, and of few more: a bounded Bloom filter of their
    # ids lets the others' texts stay where they are
    shared = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1"), "bucket", "left_semi")
    shared = written(shared, "shared")
    ids = written(shared.select("rid").distinct(), "ids")
    known = reps.select("rid", F.col("_n").alias("n"), F.col("_map").alias("m")).dropDuplicates(["rid"])
    shared = shared.join(known, "rid")
    bits = bloom.bits_for(ids.count())
    asked = bloom.flagged(narrow.filter("_id IS NOT NULL"), F.col("_id"), bloom.of_members(ids, "rid", bits), bits, "_asked").filter("_asked")
    full = written(asked.select("_id", "_text").mapInArrow(_sets, "rid long, _set array<long>").join(ids, "rid", "left_semi").dropDuplicates(["rid"]), "full")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("_sa", "_sb"))
        either = F.size("_sa") + F.size("_sb") - both
        return links.beside(pairs, full, "rid", "_set", ("_sa", "_sb")).filter(100 * both >= percent * either)

    comps = links.star_components(shared, confirmed, worth(percent))
    moved = sets.join(comps, F.col("rid") == F.col("node"), "left").select("_gset", F.coalesce("comp", "rid").alias("_comp"))
    return sketch.select("_id", "_n", "_set"), written(moved, "moved")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable over links) and kept."""
    rows, moved = _linked(docs, id_col, text_col, percent)
    out = rows.join(moved, F.col("_set") == F.col("_gset"), "left").withColumn("_comp", F.when(F.col("_id").isNull(), F.col("_id")).otherwise(F.coalesce("_comp", "_id")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_comp").alias("component_id"), F.col("_id").eqNullSafe(F.col("_comp")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with all its columns, one document of each component."""
    rows, moved = _linked(docs, id_col, text_col, percent)
    gone = written(rows.join(moved, F.col("_set") == F.col("_gset")).filter("_id <> _comp").select(F.col("_id").alias("_gone")).distinct(), "gone")
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    left = inner.join(gone, F.col(at[id_col]).cast("long") == F.col("_gone"), "left_anti")
    return left.toDF(*docs.columns)
