"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions alone.

Pass one hashes every normalised text and finds the filter positions that two or more rows set. Pass two tests each row
against them: a row that fails is certainly unique and passes straight through; only the others shuffle, keyed by hash.

Defined results for odd input:
- a null text is an empty text; empty texts are copies of each other;
- a null id never wins against another; a group of null ids alone keeps the null id;
- rows that repeat an id and a text count in ``group_size``; all are marked kept if that id wins, and ``drop_copies``
  leaves one of them;
- an empty table gives an empty result; other columns, whatever their names, play no part and ``drop_copies`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import bloom
from tesserae.runtime import written

#: Fixed value of the contract: the white space that counts as one space.
SPACE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with runs of ASCII white space made one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256))


def _passes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Pass one: the narrow table of ids and digests, the filter of repeated positions and its width."""
    digests = written(docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_sha")), "digests")
    bits = bloom.bits_for(digests.count())
    return digests, bloom.of_repeated(digests, "_sha", bits), bits


def _groups(maybe: DataFrame) -> DataFrame:
    """Of the possibly repeated digests, those that are: a row each, pre-aggregated before they shuffle."""
    found = maybe.groupBy("_sha").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    return written(found.withColumnRenamed("_sha", "_gsha"), "groups")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256."""
    digests, words, bits = _passes(docs, id_col, text_col)
    tested = bloom.flagged(digests, F.col("_sha"), words, bits, "_maybe")
    maybe = tested.filter("_maybe").select("_id", "_sha")
    # both sides are plain shuffles of narrow rows, so that AQE can split a digest that holds much of the table
    joined = maybe.join(_groups(maybe), F.col("_sha") == F.col("_gsha"), "left")
    repeated = joined.select("_id", "_sha", F.when(F.col("_gsha").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1)).alias("_size"))
    unique = tested.filter("NOT _maybe").select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    return unique.unionByName(repeated).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, less every row whose text an earlier id already has."""
    digests, words, bits = _passes(docs, id_col, text_col)
    maybe = bloom.flagged(digests, F.col("_sha"), words, bits, "_maybe").filter("_maybe")
    groups = _groups(maybe)
    # only rows of an id that a group has are digested again and shuffle with their text
    ids = maybe.join(groups, F.col("_sha") == F.col("_gsha"), "left_semi").select(F.xxhash64("_id").alias("_at")).distinct()
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    tested = bloom.flagged(inner, F.xxhash64(at[id_col]), bloom.of_members(ids, "_at", bits), bits, "_maybe")
    asked = tested.filter("_maybe").withColumn("_sha", digest(F.col(at[text_col])))
    joined = asked.join(groups, F.col("_sha") == F.col("_gsha"), "left")
    single = joined.filter(F.col("_gsha").isNull()).select(*inner.columns)
    first = joined.filter(F.col("_gsha").isNotNull() & F.col(at[id_col]).eqNullSafe(F.col("_keep"))).dropDuplicates([at[id_col], "_sha"]).select(*inner.columns)
    return tested.filter("NOT _maybe").select(*inner.columns).unionByName(single).unionByName(first).toDF(*docs.columns)
