"""Similarity search and joins on set-bit fingerprints and descriptor vectors, and the activity analytics built on them.

The threshold join is exact and has no pair-of-everything step: bits are ordered from rare to common, and two sets can
only reach a Tanimoto of t if they share one of their first n - ceil(t n) + 1 bits; those are joined by bit, sizes bound
the rest, and what is left is verified on the full sets. Where the sets have few different bits and all are frequent (as the
places of positive values of a vector), prefixes rule nothing out; such sets are compared in blocks, as products of 0/1 matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import sali, tanimoto_bits
from tesserae.operators import blocks
from tesserae.operators.neighbours import BLOCK, nearest
from tesserae.operators.quantiles import quantiles
from tesserae.runtime import written

#: Different bits that sets may have to be compared as matrices.
WIDE = 4096


def similar_pairs(df: DataFrame, key: str, bits: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of rows with Tanimoto >= ``threshold``; empty sets are similar to nothing."""
    return _joined(df, df, key, bits, threshold, within=True)


def similar_to(queries: DataFrame, df: DataFrame, key: str, bits: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of rows a of ``queries`` and b of ``df`` with Tanimoto >= ``threshold``."""
    return _joined(queries, df, key, bits, threshold, within=False)


def _joined(left: DataFrame, right: DataFrame, key: str, bits: str, t: float, within: bool) -> DataFrame:
    a, b = (x.select(F.col(key).alias("k"), F.array_compact(F.array_distinct(F.col(bits))).alias("s")).filter(F.size("s") > 0) for x in (left, right))
    seen = a if within else a.unionByName(b)
    rare = written(seen.select(F.explode("s").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("f")), "bit-counts")
    n_a = a.count()
    n_b = n_a if within else b.count()

    def prefixed(x: DataFrame) -> DataFrame:
        ranked = x.select("k", F.explode("s").alias("bit")).join(rare, "bit").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "bit"))).alias("o"))
        n = F.size("o")
        keep = n - F.ceil(F.lit(t) * n - 1e-9).cast("int") + 1
        return ranked.select("k", F.transform("o", lambda y: y["bit"]).alias("s"), F.slice("o", 1, keep).alias("o")).select("k", "s", F.size("s").alias("n"), F.explode("o").alias("o")).select("k", "s", "n", "o.bit")

    known = [r["bit"] for r in rare.select("bit").limit(WIDE + 1).collect()]
    if t > 0 and len(known) <= WIDE:
        # what the prefixes would let through, at a thousand times the price of a pair in a matrix product
        first = F.ceil(F.size("s") * (1 - t)) + 1
        share = seen.agg(F.avg(F.least(first, F.size("s")) / F.lit(max(len(known), 1)))).first()[0] or 0.0
        if share * share * len(known) * 1000 * 64 > max(64, len(known)):
            return _multiplied(a, n_a, b, n_b, known, t, within)
    left_bits = written(prefixed(a), "prefix")
    right_bits = left_bits if within else written(prefixed(b), "prefix")
    one, two = left_bits.select(F.col("k").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), "bit"), right_bits.select(F.col("k").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), "bit")
    met = one.join(two, "bit").filter((F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b") if within else F.lit(True)))
    scored = met.select("a", "b", tanimoto_bits(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= t)
    return scored.distinct()


def _multiplied(a: DataFrame, n_a: int, b: DataFrame, n_b: int, known: list, t: float, within: bool) -> DataFrame:
    """The join of sets of few different bits, all of them frequent: blocks of sets as 0/1 matrices, common bits as their product."""
    kind = a.schema["k"].dataType.simpleString()
    place = {bit: i for i, bit in enumerate(known)}
    width = -(-len(known) // 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sets = part.column(1)
                if isinstance(sets, pa.LargeListArray):
                    sets = sets.cast(pa.list_(sets.type.value_type))
                flat, row = sets.flatten().to_pylist(), np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy(zero_copy_only=False))
                marks = np.zeros((len(sets), width * 8), np.uint8)
                marks[row, [place[x] for x in flat]] = 1
                packed = np.packbits(marks, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tobytes() for p in packed], pa.binary())], names=["k", "p"])

    def matrix(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
        data = np.frombuffer(b"".join(rows.field("p").to_pylist()), np.uint8).reshape(len(rows), width)
        return rows.field("k"), data

    bound = t / (1 + t)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ka, xa), (kb, xb) = matrix(batch.column("_a")[i].values), matrix(batch.column("_b")[i].values)
                same = batch.column("_same")[i].as_py()
                for low in range(0, len(xb), 4096):
                    y = np.unpackbits(xb[low : low + 4096], axis=1).astype(np.float32)
                    n_y = y.sum(1)
                    # common bits less what a pair of these sizes needs, as one product
                    right = np.column_stack([y, np.ones_like(n_y), -bound * n_y]).T
                    for at in range(0, len(xa), 1024):
                        x = np.unpackbits(xa[at : at + 1024], axis=1).astype(np.float32)
                        n_x = x.sum(1)
                        spare = np.column_stack([x, -bound * n_x, np.ones_like(n_x)]) @ right
                        r, c = np.nonzero(spare >= -0.02)
                        if same:
                            ahead = r + at < c + low
                            r, c = r[ahead], c[ahead]
                        size = n_x[r].astype(np.float64) + n_y[c]
                        common = np.rint(spare[r, c] + bound * size)
                        score = common / (size - common)
                        r, c, score = (v[score >= t] for v in (r, c, score))
                        yield pa.RecordBatch.from_arrays([ka.take(pa.array(r + at)), kb.take(pa.array(c + low)), pa.array(score)], names=["a", "b", "similarity"])

    def blocked(x: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
        parts = blocks.count(n, width + 16)
        return written(blocks.dealt(x.mapInArrow(pack, f"k {kind}, p binary"), "k", parts, name), "bit-blocks"), parts

    one, parts_a = blocked(a, n_a, "_a")
    two, parts_b = (one.withColumnRenamed("_a", "_b"), parts_a) if within else blocked(b, n_b, "_b")
    found = blocks.paired(one, parts_a, two, parts_b, within).mapInArrow(compare, f"a {kind}, b {kind}, similarity double")
    if within:
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").filter("a < b")
    return written(found, "multiplied").distinct()


def activity_cliffs(df: DataFrame, key: str, bits: str, activity: str, similarity: float = 0.7, change: float = 1.0) -> DataFrame:
    """Similar pairs whose activities differ by ``change`` or more, with their landscape index."""
    pairs = similar_pairs(df, key, bits, similarity)
    acts = df.select(F.col(key).alias("_k"), F.col(activity).alias("_y"))
    out = pairs.join(acts.select(F.col("_k").alias("a"), F.col("_y").alias("activity_a")), "a").join(acts.select(F.col("_k").alias("b"), F.col("_y").alias("activity_b")), "b")
    out = out.withColumn("difference", F.abs(F.col("activity_a") - F.col("activity_b"))).filter(F.col("difference") >= change)
    return out.select("a", "b", "similarity", "activity_a", "activity_b", "difference", sali(F.col("similarity"), F.col("difference")).alias("sali"))


def cliff_summary(cliffs: DataFrame) -> DataFrame:
    """Cliffs, molecules in them, mean and greatest landscape index."""
    both = cliffs.select(F.explode(F.array("a", "b")).alias("m"))
    return cliffs.agg(F.count(F.lit(1)).alias("n_cliffs"), F.avg("sali").alias("mean_sali"), F.max("sali").alias("max_sali")).join(F.broadcast(both.agg(F.count_distinct("m").alias("n_molecules"))), how="inner")


def knn_domain(train: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, sigmas: float = 3.0, include_self: bool = True, block: int = BLOCK) -> DataFrame:
    """Applicability domain by mean distance to the k nearest training rows.

    The threshold is mean plus ``sigmas`` population deviations of that distance over the training rows themselves (each
    its own neighbour at 0 unless ``include_self`` is off); reliability falls linearly to 0 there. Both sets are queries
    against the training rows (``neighbours.nearest``); keys are distinct.
    """
    mean = lambda q, own: nearest(q, train, key, vector, k, include_self=own, block=block).groupBy("query").agg(F.avg("distance").alias("distance"))
    limit = mean(train, include_self).agg((F.avg("distance") + sigmas * F.stddev_pop("distance")).alias("threshold"))
    out = mean(rows, True).join(F.broadcast(limit), how="inner")
    return out.select(F.col("query").alias(key), "distance", "threshold", (F.col("distance") <= F.col("threshold")).alias("in_domain"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("distance", "threshold"))).alias("reliability"))


def box_domain(train: DataFrame, rows: DataFrame, key: str, vector: str, margin: float = 0.0) -> DataFrame:
    """Applicability domain by ranges: share of dimensions inside the training minimum and maximum, widened by a margin."""
    each = train.select(F.posexplode(vector).alias("_i", "_x")).groupBy("_i").agg(F.min("_x").cast("double").alias("_lo"), F.max("_x").cast("double").alias("_hi"))
    bounds = each.agg(F.array_sort(F.collect_list(F.struct("_i", "_lo", "_hi"))).alias("_b"))
    inside = F.zip_with(vector, "_b", lambda x, b: ((x >= b["_lo"] - margin * (b["_hi"] - b["_lo"])) & (x <= b["_hi"] + margin * (b["_hi"] - b["_lo"]))).cast("double"))
    share = F.aggregate(inside, F.lit(0.0), lambda t, x: t + x) / F.size(vector)
    return rows.join(F.broadcast(bounds), how="inner").select(key, share.alias("reliability"), (share == 1.0).alias("in_domain"))


def conformal(df: DataFrame, y: str, p: str, level: float = 0.9) -> DataFrame:
    """Half-width of split-conformal intervals: the quantile of absolute residuals at min(1, ceil((n + 1) level) / n)."""
    residuals = df.select(F.abs(F.col(y) - F.col(p)).alias("_r"))
    at = lambda n: F.least(F.lit(1.0), F.try_divide(F.ceil((n + 1) * level), n))
    found = quantiles(residuals, "_r", [], {"half_width": at}).select("half_width")
    counted = residuals.agg(F.count("_r").alias("n"))
    return counted.join(F.broadcast(found), F.lit(True), "left")
