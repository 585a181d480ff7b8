"""Kendall's tau-b of any two columns without meeting pairs: inversions are counted by ranges of both.

Equal (y, p) rows are counted first. Both columns are cut into ranges at quantile marks; a value on a mark is a range of its own,
so a value that many rows have never shares one. A discordant pair then lies
- in different ranges of both columns: found from the table of counts by range (at most (2 CUTS + 1)^2 rows);
- in one range of y: counted in that range's task;
- in different ranges of y but one of p: counted in the task of that range of p, over ranges of y.
Ranges hold about 1 / CUTS of the rows; a range of one value has no discordant pair and isn't sent anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import ratio
from tesserae.runtime import written

#: Most marks in each column, and rows that a range should have.
CUTS, RANGE = 512, 20_000


def inversions(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> float:
    """Weighted pairs with first_i < first_j and second_i > second_j: rows in order of ``first`` are dealt by the bits of their
    rank in ``second``, highest first; two rows part at the highest bit in which their ranks differ, and there the weight of the
    rows with a 1 ahead of each row with a 0 is added. A bit costs a few passes over the rows and no sort."""
    order = np.lexsort((second, first))
    rank, weight = np.unique(second, return_inverse=True)[1].ravel()[order], weight[order].astype(np.float64)
    total, at = 0.0, np.arange(len(order))
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        high = rank >> bit & 1 == 1
        group = rank >> bit + 1
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[start, len(rank)])
        ahead = np.cumsum(np.where(high, weight, 0.0))
        base = np.repeat(np.where(start > 0, ahead[start - 1], 0.0), sizes)
        total += float((weight * (ahead - base))[~high].sum())
        # a stable partition of each group, zeros first
        zeros = np.cumsum(~high)
        before = np.repeat(np.where(start > 0, zeros[start - 1], 0), sizes)
        n_zeros = np.repeat(np.add.reduceat((~high).astype(np.int64), start), sizes)
        head = np.repeat(start, sizes)
        place = np.where(high, head + n_zeros + (at - head) - (zeros - before), head + (zeros - before) - 1)
        moved, carried = np.empty_like(rank), np.empty_like(weight)
        moved[place], carried[place] = rank, weight
        rank, weight = moved, carried
    return total


def _ranges(y_marks: np.ndarray, p_marks: np.ndarray):
    """Columns _i and _j beside the rows: 2 i for a value between marks i - 1 and i, 2 i + 1 for mark i itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for c, marks in enumerate((y_marks, p_marks)):
                value = batch.column(c).to_numpy(zero_copy_only=False)
                below = np.searchsorted(marks, value, "left")
                found.append(pa.array((2 * below + (np.searchsorted(marks, value, "right") > below)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["_y", "_p", "_n", "_i", "_j"])

    return run


def _inside(first: str, second: str):
    def run(rows: pa.Table) -> pa.Table:
        x, y, n = (rows.column(c).to_numpy() for c in (first, second, "_n"))
        return pa.table({"d": [inversions(x, y, n)]})

    return run


def kendall(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row with ``kendall``; null with fewer than two rows or where a column has one value. Rows with a null are left out."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    cells = written(df.filter(a.isNotNull() & b.isNotNull()).groupBy(a.alias("_y"), b.alias("_p")).agg(F.count(F.lit(1)).alias("_n")), "cells")
    marks = max(1, min(CUTS, cells.count() // RANGE))
    shares = F.array(*(F.lit(i / (marks + 1)) for i in range(1, marks + 1)))
    cuts = cells.agg(*(F.percentile_approx(c, shares, 10 * (marks + 1)).alias(c) for c in ("_y", "_p"))).first()  # at most CUTS marks each
    places = _ranges(*(np.unique(np.array(cuts[c] or [], float)) for c in ("_y", "_p")))
    ranged = written(cells.mapInArrow(places, "_y double, _p double, _n long, _i int, _j int"), "ranges")
    grid = np.zeros((2 * CUTS + 1, 2 * CUTS + 1))
    for r in ranged.groupBy("_i", "_j").agg(F.sum("_n").alias("n")).collect():
        grid[r["_i"], r["_j"]] = r["n"]
    later = np.cumsum(grid[::-1], axis=0)[::-1]  # in this range of y and those behind
    lower = np.cumsum(later, axis=1)
    across = float((grid[:-1, 1:] * lower[1:, :-1]).sum())
    # odd ranges are single values
    own = ranged.filter(F.col("_i") % 2 == 0).groupBy("_i").applyInArrow(_inside("_y", "_p"), "d double")
    coarse = ranged.filter(F.col("_j") % 2 == 0).groupBy("_j", "_i", "_p").agg(F.sum("_n").alias("_n"))
    same = coarse.groupBy("_j").applyInArrow(_inside("_i", "_p"), "d double")
    discordant = own.unionByName(same).agg((F.coalesce(F.sum("d"), F.lit(0.0)) + across).alias("_d"))
    n = F.col("_n").cast("double")
    ties = lambda by, name: cells.groupBy(*by).agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias(name))
    out = discordant
    for table in (ties(["_y"], "_ty"), ties(["_p"], "_tp"), ties(["_y", "_p"], "_typ"), cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("_n"))):
        out = out.join(F.broadcast(table), how="inner")  # a row each
    pairs = n * (n - 1) / 2
    score = pairs - F.col("_ty") - F.col("_tp") + F.col("_typ") - 2 * F.col("_d")
    return out.select(ratio(score, F.sqrt((pairs - F.col("_ty")) * (pairs - F.col("_tp")))).alias("kendall"))
