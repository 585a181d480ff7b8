"""Calibration of probabilities and uncertainties: binned curves, errors, isotonic, Platt and temperature scaling, coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import ratio
from tesserae.operators.ordered import PARTS
from tesserae.operators.quantiles import with_quantiles
from tesserae.runtime import written


def curve(df: DataFrame, y: str, p: str, bins: int = 10, by_quantile: bool = False) -> DataFrame:
    """(bin, n, accuracy, confidence) of bins of equal width, or equally filled; bins are right-open, 1 in the last."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    if by_quantile:
        cuts = {f"_cut{i}": i / bins for i in range(1, bins)}
        rows = with_quantiles(rows, p, [], **cuts).withColumn("bin", sum((F.when(F.col(c) <= F.col(p), 1).otherwise(0) for c in cuts), F.lit(0)).cast("long"))
    else:
        rows = rows.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("accuracy"), F.avg(p).alias("confidence"))


def errors(df: DataFrame, y: str, p: str, bins: int = 10, by_quantile: bool = False) -> DataFrame:
    """Expected and maximum calibration error of the curve, and the Brier score of the rows."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    made = curve(df, y, p, bins, by_quantile).agg(ratio(F.sum(F.col("n") * gap), F.sum("n").cast("double")).alias("ece"), F.max(gap).alias("mce"))
    brier = df.agg(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias("brier"))
    return made.join(F.broadcast(brier), how="inner")


def coverage(df: DataFrame, y: str, mean: str, std: str, z: dict[float, float] | None = None) -> DataFrame:
    """Share of rows within z deviations, its gap to the level and the mean width, a row per level."""
    parts = []
    for level, width in (z or {0.5: 0.6744897501960817, 0.68: 0.9944578832097532, 0.9: 1.6448536269514722, 0.95: 1.959963984540054}).items():
        inside = (F.abs(F.col(y) - F.col(mean)) <= width * F.col(std)).cast("double")
        parts.append(F.struct(F.lit(level).alias("level"), F.avg(inside).alias("coverage"), F.avg(2 * width * F.col(std)).alias("mean_width")))
    rows = df.agg(F.array(*parts).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    gap = F.abs(F.col("coverage") - F.col("level"))
    return rows.withColumns({"gap": gap, "calibrated": gap < 0.05})


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of y on sorted distinct x: knots and fitted values."""
    level: list[list[float]] = []
    for a, b in zip(y, w, strict=True):
        level.append([float(a), float(b), 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            v, m, k = level.pop()
            u, n, j = level.pop()
            level.append([(u * n + v * m) / (n + m), n + m, j + k])
    return x, np.repeat([v for v, _, _ in level], [int(k) for _, _, k in level])


def _pooled(rows: pa.Table) -> pa.Table:
    """The blocks of one range, pooled until their means rise."""
    order = np.argsort(rows.column("_lo").to_numpy())
    lo, hi, s, w = (rows.column(c).to_numpy()[order] for c in ("_lo", "_hi", "_s", "_w"))
    kept: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), s.tolist(), w.tolist(), strict=True):
        kept.append(list(block))
        while len(kept) > 1 and kept[-2][2] * kept[-1][3] > kept[-1][2] * kept[-2][3]:
            last = kept.pop()
            kept[-1] = [kept[-1][0], last[1], kept[-1][2] + last[2], kept[-1][3] + last[3]]
    return pa.table(dict(zip(("_lo", "_hi", "_s", "_w"), map(list, zip(*kept, strict=True)), strict=True)))


def _ranges(df: DataFrame, value: str, parts: int, shift: float) -> DataFrame:
    """``df`` with _part, a range of a column that holds about 1 / ``parts`` of the rows."""
    marks = [min(1.0, (i + shift) / parts) for i in range(1, parts)]
    if not marks:
        return df.withColumn("_part", F.lit(0))
    cuts = df.agg(F.percentile_approx(value, F.array(*map(F.lit, marks)), 10 * parts).alias("_cuts"))
    return df.join(F.broadcast(cuts), how="inner").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def _fitted_on(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")) & ~F.isnan(F.col(y).cast("double")))


def isotonic_blocks(df: DataFrame, y: str, p: str, rows: int = 50_000) -> DataFrame:
    """(_lo, _hi, _s, _w): the blocks of equal fitted value of the isotonic regression of y on p: least and greatest score, sum
    of y, number of rows.

    Scores are cut into ranges of about ``rows`` blocks and each range is pooled in its own task; what is pooled in a range is
    pooled in the whole. Ranges are then cut anew, half a range on, until no block is above the next range's first.
    """
    score = F.col(p).cast("double")
    blocks = written(_fitted_on(df, y, p).groupBy(score.alias("_lo")).agg(F.first(score).alias("_hi"), F.sum(F.col(y).cast("double")).alias("_s"), F.count(F.lit(1)).cast("double").alias("_w")), "scores")
    shift = 0.0
    while True:
        parts = max(1, min(PARTS, blocks.count() // rows))
        ranged = _ranges(blocks, "_lo", parts, shift)
        blocks = written(ranged.groupBy("_part").applyInArrow(_pooled, "_lo double, _hi double, _s double, _w double"), "blocks")
        mean = F.col("_s") / F.col("_w")
        # a row for each range, at most PARTS
        ends = _ends(blocks, ranged) if parts > 1 else []
        if all(a <= b for (_, a), (b, _) in zip(ends, ends[1:], strict=False)):
            return blocks.withColumn("fitted", mean)
        shift = 0.5 - shift


def _ends(blocks: DataFrame, ranged: DataFrame) -> list[tuple[float, float]]:
    """Fitted value of the first and the last block of each range, in order."""
    first = ranged.groupBy("_part").agg(F.min("_lo").alias("_from")).collect()
    starts = sorted(r["_from"] for r in first)
    at = F.size(F.filter(F.array(*map(F.lit, starts)), lambda c: c <= F.col("_lo")))
    mean = F.col("_s") / F.col("_w")
    found = blocks.groupBy(at.alias("_at")).agg(F.min_by(mean, "_lo").alias("a"), F.max_by(mean, "_lo").alias("b")).collect()
    return [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["_at"])]


def isotonic(df: DataFrame, y: str, p: str, rows: int = 50_000) -> DataFrame:
    """(p, fitted): isotonic regression of y on a score, a row per distinct score."""
    scores = _fitted_on(df, y, p).select(F.col(p).cast("double").alias("p")).distinct()
    return calibrated(scores, "p", isotonic_blocks(df, y, p, rows))


def calibrated(df: DataFrame, p: str, blocks: DataFrame) -> DataFrame:
    """``df`` with ``fitted``: the value of the block that the score is in; between blocks that of the one below, below all
    the first one's. Scores and the starts of blocks are put in order together, in ranges."""
    knots = blocks.select(F.col("_lo").alias("_at"), F.col("fitted").alias("_f"))
    each = df.filter(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("_at")).distinct().withColumn("_f", F.lit(None).cast("double"))
    ranged = written(_ranges(written(each.unionByName(knots), "knots"), "_at", PARTS, 0.0), "knots")
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
    last = ranged.groupBy("_part").agg(F.max_by("_f", F.when(F.col("_f").isNotNull(), F.col("_at"))).alias("_last"))
    carried = last.select(F.col("_part").alias("_p"), F.last("_last", ignorenulls=True).over(over).alias("_before"))
    inner = Window.partitionBy("_part").orderBy("_at", F.desc_nulls_last("_f")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = blocks.agg(F.min_by("fitted", "_lo").alias("_least"))
    found = ranged.withColumn("_in", F.last("_f", ignorenulls=True).over(inner)).filter(F.col("_f").isNull()).join(F.broadcast(carried), F.col("_part") == F.col("_p")).join(F.broadcast(least), how="inner")
    values = found.select("_at", F.coalesce("_in", "_before", "_least").alias("fitted"))
    return df.join(values, F.col(p).cast("double") == F.col("_at"), "left").drop("_at")


def _newton(df: DataFrame, y: Column, x: Column, rounds: int) -> tuple[float, float]:
    """Slope and offset of a one-feature logistic unit with unit L2 penalty on the slope; two-by-two sums each round."""
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * x + b)))
        s = df.agg(F.sum((p - y) * x), F.sum(p - y), F.sum(p * (1 - p) * x * x), F.sum(p * (1 - p) * x), F.sum(p * (1 - p))).first()
        g = np.array([s[0] + a, s[1]])
        h = np.array([[s[2] + 1, s[3]], [s[3], s[4] + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def platt(df: DataFrame, y: str, score: str, rounds: int = 12) -> tuple[float, float]:
    """Slope and offset that turn a score into a probability."""
    rows = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    return _newton(rows, F.col(y).cast("double"), F.col(score).cast("double"), rounds)


def temperature(df: DataFrame, y: str, logit: str, rounds: int = 30) -> float:
    """The temperature (at least 0.01) that minimises the log loss of a logit: golden section over its logarithm, one aggregate a round."""
    rows = df.filter(F.col(y).isNotNull() & F.col(logit).isNotNull())

    def loss(t: float) -> float:
        z = F.col(logit) / float(np.exp(t))
        return rows.agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col(y) * z)).first()[0]

    low, high, g = np.log(0.01), np.log(100.0), (np.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))


def uncertainty(df: DataFrame, y: str, p: str, u: str, by: list[str]) -> DataFrame:
    """Coverage at 1 and 1.96 deviations, sharpness and spread of uncertainties, by task."""
    inside = lambda k: F.avg((F.abs(F.col(y) - F.col(p)) <= k * F.col(u)).cast("double"))
    return df.groupBy(*by).agg(inside(1.0).alias("coverage_1"), inside(1.96).alias("coverage_196"), F.avg(u).alias("sharpness"), F.stddev_pop(u).alias("spread"))
