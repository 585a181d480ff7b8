"""Applicability domains fitted on all training rows: leverage, local outlier factor, isolation forest, and several at once.

Each returns (key, distance or score, threshold, in_domain, reliability); rows whose vector is null are left out, training
rows likewise; with no training rows nothing is in the domain of an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.neighbours import nearest
from tesserae.operators.split import draw
from tesserae.runtime import written


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample covariance of a vector column: sums are taken in each batch, and only those are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = np.stack(rows[vector].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))
            if len(x):
                sums = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                yield pd.DataFrame({"i": np.arange(len(sums)), "s": sums})

    parts = df.select(vector).filter(F.col(vector).isNotNull()).mapInPandas(run, "i int, s double")
    sums = np.array([r["s"] for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])
    if not len(sums):
        return 0, np.zeros(0), np.zeros((0, 0))
    n = int(sums[0])
    p = int((np.sqrt(4 * len(sums) - 3) - 1) / 2)
    mean = sums[1 : p + 1] / n
    return n, mean, (sums[p + 1 :].reshape(p, p) - n * np.outer(mean, mean)) / max(n - 1, 1)


def _quadratic(vector: Column, mean: np.ndarray, inverse: np.ndarray) -> Column:
    """(x - mean)' inverse (x - mean), row by row of the inverse."""
    centre = F.array(*(F.lit(float(m)) for m in mean))
    off = F.zip_with(vector, centre, lambda x, m: x.cast("double") - m)
    inner = [F.aggregate(F.zip_with(off, F.array(*(F.lit(float(v)) for v in row)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) for row in inverse]
    return F.aggregate(F.zip_with(off, F.array(*inner), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)


def leverage(train: DataFrame, rows: DataFrame, key: str, vector: str, threshold: float | None = None) -> DataFrame:
    """Leverage as the quadratic form of the inverse covariance (1e-6 on its diagonal); 3 p / n unless a threshold is given."""
    n, mean, covariance = moments(train, vector)
    p = len(mean)
    limit = threshold if threshold is not None else (3 * p / n if n else 0.0)
    score = _quadratic(F.col(vector), mean, np.linalg.inv(covariance + 1e-6 * np.eye(p))) if p else F.lit(None).cast("double")
    out = rows.filter(F.col(vector).isNotNull()).select(key, score.alias("distance"))
    return out.select(key, "distance", F.lit(float(limit)).alias("threshold"), (F.col("distance") <= limit).alias("in_domain"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("distance", F.lit(float(limit))))).alias("reliability"))


def local_outlier(train: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 20, threshold: float = 1.5) -> DataFrame:
    """Local outlier factor of rows against all training rows, by their k nearest there (ties to the least key)."""
    known = train.filter(F.col(vector).isNotNull())
    within = written(nearest(known, known, key, vector, k), "within")
    reach = written(within.groupBy(F.col("query").alias("_k")).agg(F.max("distance").alias("_reach")), "reach")

    def density(found: DataFrame) -> DataFrame:
        far = found.join(reach, F.col("neighbour") == F.col("_k"))
        return far.groupBy("query").agg((1 / (F.avg(F.greatest("distance", "_reach")) + 1e-10)).alias("_density"))

    dense = written(density(within).withColumnRenamed("query", "_d").withColumnRenamed("_density", "_near"), "density")
    found = written(nearest(rows.filter(F.col(vector).isNotNull()), known, key, vector, k, include_self=True), "found")
    mean = found.join(dense, F.col("neighbour") == F.col("_d")).groupBy("query").agg(F.avg("_near").alias("_near"))
    out = density(found).join(mean, "query").select(F.col("query").alias(key), (F.col("_near") / F.col("_density")).alias("distance"))
    return out.select(key, "distance", F.lit(threshold).alias("threshold"), (F.col("distance") <= threshold).alias("in_domain"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / 10)).alias("reliability"))


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    """Nested (axis, cut, left, right), or the path length that a leaf's size stands for."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else ()
    if depth == 0 or len(spread) == 0:
        return (_path(len(x)),)
    axis = int(rng.choice(spread))
    cut = rng.uniform(x[:, axis].min(), x[:, axis].max())
    left = x[:, axis] < cut
    return axis, cut, _tree(x[left], depth - 1, rng), _tree(x[~left], depth - 1, rng)


def _path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = 1 + _depths(tree[2], x[left]), 1 + _depths(tree[3], x[~left])
    return out


def isolation(train: DataFrame, rows: DataFrame, key: str, vector: str, trees: int = 100, size: int = 256, sample: int = 4096, contamination: float = 0.1, seed: int = 0) -> DataFrame:
    """Isolation forest: trees on ``size`` rows each of a bounded sample (``sample`` training rows, drawn by a hash of their key).

    The score is 2^(-mean depth / expected depth); the threshold is its quantile at 1 - contamination over the sample.
    """
    drawn = train.filter(F.col(vector).isNotNull()).orderBy(draw(F.col(key), seed), key).limit(sample).select(vector).toPandas()
    if drawn.empty:
        return rows.limit(0).select(key, F.lit(0.0).alias("distance"), F.lit(0.0).alias("threshold"), F.lit(False).alias("in_domain"), F.lit(0.0).alias("reliability"))
    x, rng = np.stack(drawn[vector].to_numpy()).astype(np.float64), np.random.default_rng(seed)
    size = min(size, len(x))
    forest = [_tree(x[rng.choice(len(x), size, replace=False)], int(np.ceil(np.log2(max(size, 2)))), rng) for _ in range(trees)]
    scored = lambda v: 2 ** (-np.mean([_depths(t, v) for t in forest], axis=0) / max(_path(size), 1e-9))
    limit = float(np.quantile(scored(x), 1 - contamination))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({key: part[key], "distance": scored(np.stack(part[vector].to_numpy()).astype(np.float64))})

    out = rows.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, distance double")
    return out.select(key, "distance", F.lit(limit).alias("threshold"), (F.col("distance") <= limit).alias("in_domain"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.col("distance") - 0.5)).alias("reliability"))


def together(methods: dict[str, Callable[[], DataFrame]], key: str) -> DataFrame:
    """Several domains as one table with a ``method`` column; ``votes`` sums it up."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (f().select(key, "in_domain", "reliability").withColumn("method", F.lit(n)) for n, f in methods.items()))


def votes(domains: DataFrame, key: str) -> DataFrame:
    """Of each row, how many methods took it in and their mean reliability."""
    return domains.groupBy(key).agg(F.count(F.lit(1)).alias("n_methods"), F.count_if("in_domain").alias("n_in_domain"), F.avg("reliability").alias("reliability"))
