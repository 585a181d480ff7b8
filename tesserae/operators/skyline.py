"""Pareto fronts in any number of objectives: cells of a grid, blocks of points, and dominance between blocks.

Equal points are one. Each objective is cut at quantile marks, which makes at most CELLS cells. A point goes if a cell that is ahead
in every objective holds a point, or if one of a few strong points dominates it; then each block of a cell keeps its own
front; what is left is compared with the blocks of cells that are nowhere behind. Both sides of a comparison are blocks of
at most about BLOCK points, so a front that is most of the table is many small tasks (as many as its square over BLOCK's, which
is the work that such a front has).

Rows with a null or NaN objective are on no front. A point dominates another if it is nowhere worse and somewhere better.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import written

#: Most cells of the grid, points of a block, and strong points that every point is held against first.
CELLS, BLOCK, STRONG = 4096, 2048, 256


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which of ``points`` a row of ``by`` dominates (more is better), some rows at a time."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(by), 64):
        some = by[at : at + 64, None, :]
        out |= ((some >= points[None]).all(2) & (some > points[None]).any(2)).any(0)
    return out


def _points(df: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """Distinct points (``_o``, more is better in each)."""
    each = [F.col(c).cast("double") * (-1.0 if goal == "minimize" else 1.0) + 0.0 for c, goal in objectives.items()]
    ok = [x.isNotNull() & ~F.isnan(x) for x in each]
    keep = ok[0]
    for x in ok[1:]:
        keep = keep & x
    return df.filter(keep).select(F.array(*each).alias("_o")).distinct()


def _front(points: DataFrame, d: int, block: int) -> DataFrame:
    """The points that no other dominates."""
    spark = points.sparkSession
    # strong points have the greatest sum of objectives, each as a share of its range
    spans = points.agg(*(f(F.element_at("_o", i + 1)).alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    share = sum(((F.element_at("_o", i + 1) / 2 - spans[f"lo{i}"] / 2) / ((spans[f"hi{i}"] / 2 - spans[f"lo{i}"] / 2) or 1.0) for i in range(d)), F.lit(0.0)) if spans["lo0"] is not None else F.lit(0.0)
    strong = np.array([r["_o"] for r in points.orderBy(F.desc(share)).limit(STRONG).collect()]).reshape(-1, d)  # at most STRONG rows

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~dominated(_matrix(batch.column(0), d), strong)))

    left = written(points.mapInArrow(held, "_o array<double>"), "skyline")
    marks = max(1, int(CELLS ** (1 / d)) - 1)
    shares = F.array(*(F.lit((i + 1) / (marks + 1)) for i in range(marks)))
    cuts = left.agg(*(F.percentile_approx(F.element_at("_o", i + 1), shares, 1000).alias(f"_c{i}") for i in range(d)))
    at = lambda i: F.size(F.filter(f"_c{i}", lambda c: c < F.element_at("_o", i + 1)))
    placed = written(left.join(F.broadcast(cuts), how="inner").select("_o", F.array(*map(at, range(d))).alias("_cell"), F.monotonically_increasing_id().alias("_row")), "cells")
    sizes = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most CELLS rows
    cells = np.array([r["_cell"] for r in sizes]).reshape(-1, d)
    parts = [-(-r["n"] // block) for r in sizes]
    kept = [i for i in range(len(cells)) if not (cells > cells[i]).all(1).any()]
    number = spark.createDataFrame([(cells[i].tolist(), i, parts[i]) for i in kept], "_cell array<int>, _at int, _parts int")
    dealt = placed.join(F.broadcast(number), "_cell").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    blocks = dealt.groupBy("_at", "_part").agg(F.collect_list("_o").alias("_points"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch.column("_points")[i].values, d)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([x[~dominated(x, x)].tolist()], pa.list_(pa.list_(pa.float64())))], names=["_at", "_part", "_points"])

    fronts = written(blocks.mapInArrow(own, "_at int, _part int, _points array<array<double>>"), "block-fronts")
    pairs = [(a, p, b, q) for a in kept for b in kept if (cells[b] >= cells[a]).all() for p in range(parts[a]) for q in range(parts[b]) if (a, p) != (b, q)]
    met = spark.createDataFrame(pairs, "_at int, _part int, _bat int, _bpart int")
    others = fronts.select(F.col("_at").alias("_bat"), F.col("_part").alias("_bpart"), F.col("_points").alias("_by"))

    def beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (_matrix(batch.column(c)[i].values, d) for c in ("_points", "_by"))
                yield pa.RecordBatch.from_arrays([pa.array(x[dominated(x, y)].tolist(), pa.list_(pa.float64()))], names=["_o"])

    lost = met.join(others, ["_bat", "_bpart"]).join(fronts, ["_at", "_part"]).select("_points", "_by").mapInArrow(beaten, "_o array<double>")
    return fronts.select(F.explode("_points").alias("_o")).join(lost.distinct(), "_o", "left_anti")


def _matrix(points: pa.Array, d: int) -> np.ndarray:
    return points.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def pareto_front(df: DataFrame, objectives: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Rows that no other dominates; ``objectives`` say 'maximize' or 'minimize' for each column."""
    return pareto_ranks(df, objectives, 1, block).drop("front")


def pareto_ranks(df: DataFrame, objectives: dict[str, str], fronts: int, block: int = BLOCK) -> DataFrame:
    """Rows of the first ``fronts`` fronts, with ``front``: 1 for rows that none dominates, 2 for those that only such rows
    dominate, and so on."""
    rest, found = written(_points(df, objectives), "points"), []
    for k in range(1, fronts + 1):
        if rest.isEmpty():
            break
        front = written(_front(rest, len(objectives), block), "front")
        found.append(front.withColumn("front", F.lit(k)))
        if k < fronts:
            rest = written(rest.join(front, "_o", "left_anti"), "points")
    if not found:
        return df.withColumn("front", F.lit(1)).limit(0)
    ranks = found[0]
    for more in found[1:]:
        ranks = ranks.unionByName(more)
    each = F.array(*(F.col(c).cast("double") * (-1.0 if goal == "minimize" else 1.0) + 0.0 for c, goal in objectives.items()))
    return df.withColumn("_point", each).join(ranks, F.col("_point") == F.col("_o")).drop("_point", "_o")
