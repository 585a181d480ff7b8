"""Bloom filters as tables of 64-bit words, built and read with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import written

#: Positions that each key sets.
PROBES = 2
#: The widest filter: 2**27 bits are 2**21 words, the most rows that a filter ever broadcasts.
MOST_BITS = 1 << 27


def bits_for(rows: int, per_row: int = 16) -> int:
    """A power of two with ``per_row`` bits a row, between 2**16 and MOST_BITS.

    Past MOST_BITS / per_row rows the filter fills up and lets more keys through; it never withholds one,
    so results stay exact and only the saving shrinks.
    """
    return min(MOST_BITS, max(1 << 16, 1 << (per_row * max(rows, 1) - 1).bit_length()))


def _position(key: Column, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(probe)), F.lit(bits))


def _words(positions: DataFrame) -> DataFrame:
    """(word, mask) rows of the positions in column ``_p``."""
    bit = F.expr("shiftleft(1L, cast(_p & 63 AS int))")
    return positions.groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(bit).alias("_mask"))


def of_repeated(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The filter of positions that two or more rows of ``keys`` set: one that a unique key rarely passes."""
    positions = keys.select(F.explode(F.array(*(_position(F.col(key), k, bits) for k in range(PROBES)))).alias("_p"))
    twice = positions.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return written(_words(twice), "repeated")


def of_members(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The ordinary filter: the positions that any row of ``keys`` sets."""
    positions = keys.select(F.explode(F.array(*(_position(F.col(key), k, bits) for k in range(PROBES)))).alias("_p"))
    return written(_words(positions.distinct()), "members")


def flagged(rows: DataFrame, key: Column, words: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with a boolean column: every position of the key is set in the filter.

    The filter is broadcast; MOST_BITS bounds it at 2**21 rows of two longs whatever the input's size.
    """
    out, hit = rows, F.lit(True)
    names = rows.columns
    for k in range(PROBES):
        word, mask, at = f"_word{k}", f"_mask{k}", f"_at{k}"
        side = words.select(F.col("_word").alias(word), F.col("_mask").alias(mask))
        out = out.withColumn(at, _position(key, k, bits))
        out = out.join(F.broadcast(side), F.shiftright(at, 6) == F.col(word), "left")
        hit = hit & (F.col(mask).isNotNull() & (F.expr(f"shiftright({mask}, cast({at} & 63 AS int)) & 1") == 1))
    return out.select(*(F.col(f"`{n}`") for n in names), hit.alias(flag))
