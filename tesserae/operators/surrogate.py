"""Gaussian-process surrogates: fitted to observations, scored over candidates where those lie.

Observations are what an active-learning campaign has measured. Up to MOST of them make the exact process; since a fit takes the
cube of their number, more make that of all of them through inducing points (``inducing.fit``). Candidates may be any number
of rows, whose vectors go through numpy in Arrow batches.

Rows whose vector or value is null are no observations; a candidate without vector has null mean and std; ties go to the
least key; an empty table of candidates gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserae.operators import select

if TYPE_CHECKING:
    from tesserae.operators.inducing import Inducing

#: Observations of which the exact process is taken.
MOST = 5000


def _shape(kind: str, r: np.ndarray) -> np.ndarray:
    """Correlation at a distance of r length scales."""
    if kind == "rbf":
        return np.exp(-0.5 * r * r)
    s = np.sqrt(3.0 if kind == "matern32" else 5.0) * r
    return (1 + s) * np.exp(-s) if kind == "matern32" else (1 + s + s * s / 3) * np.exp(-s)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))


@dataclass
class Surrogate:
    """A fitted process: scaled observations, hyperparameters and the factor of their covariance."""

    kernel: str
    x: np.ndarray
    y: np.ndarray
    hyper: dict[str, float]
    scale: tuple[np.ndarray, np.ndarray, float, float]
    factor: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at rows of x, in the units of the observations."""
        mx, sx, my, sy = self.scale
        k = self.hyper["constant"] * _shape(self.kernel, _distances((x - mx) / sx, self.x) / self.hyper["length"])
        v = np.linalg.solve(self.factor, k.T)
        var = self.hyper["constant"] + self.hyper["noise"] - (v * v).sum(0)
        return my + sy * (k @ self.weight), sy * np.sqrt(np.maximum(var, 0.0))


def _factored(kernel: str, r: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log marginal likelihood, factor and weights for log (constant, length, noise)."""
    c, length, noise = np.exp(theta)
    k = c * _shape(kernel, r / length)
    k[np.diag_indices_from(k)] += noise + 1e-8
    try:
        low = np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return -np.inf, r, y
    w = np.linalg.solve(low.T, np.linalg.solve(low, y))
    return float(-0.5 * y @ w - np.log(np.diag(low)).sum() - 0.5 * len(y) * np.log(2 * np.pi)), low, w


#: Bounds of log (constant, length, noise).
BOUNDS = np.log(np.array([[1e-3, 1e3], [1e-2, 1e2], [1e-6, 1.0]]))


def _tuned(kernel: str, r: np.ndarray, y: np.ndarray, restarts: int, seed: int) -> np.ndarray:
    """The most likely hyperparameters of several pattern searches: a step along each axis, halved when none is better."""
    rng = np.random.default_rng(seed)
    starts = [np.log([1.0, max(float(np.median(r)), 0.1), 0.1]), *(rng.uniform(BOUNDS[:, 0], BOUNDS[:, 1]) for _ in range(restarts))]
    found = []
    for theta in starts:
        best, step = _factored(kernel, r, y, theta)[0], 1.0
        while step > 0.05:
            moves = [np.clip(theta + s * step * np.eye(3)[i], BOUNDS[:, 0], BOUNDS[:, 1]) for i in range(3) for s in (1, -1)]
            likely = [_factored(kernel, r, y, m)[0] for m in moves]
            if max(likely) > best + 1e-9:
                best, theta = max(likely), moves[int(np.argmax(likely))]
            else:
                step /= 2
        found.append((best, theta))
    return max(found, key=lambda f: f[0])[1]


def fitted(x: np.ndarray, y: np.ndarray, kernel: str = "matern52", restarts: int = 2, seed: int = 0, hyper: dict[str, float] | None = None) -> Surrogate:
    """The process of observations x, y, both scaled to mean 0 and deviation 1; ``hyper`` skips the search."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    sx, sy = x.std(axis=0), float(y.std()) or 1.0
    sx[sx == 0] = 1.0
    scale = (x.mean(axis=0), sx, float(y.mean()), sy)
    xs, ys = (x - scale[0]) / sx, (y - scale[2]) / sy
    r = _distances(xs, xs)
    theta = np.log([hyper[k] for k in ("constant", "length", "noise")]) if hyper else _tuned(kernel, r, ys, restarts, seed)
    likelihood, low, w = _factored(kernel, r, ys, theta)
    found = dict(zip(("constant", "length", "noise"), map(float, np.exp(theta)), strict=True)) | {"log_likelihood": likelihood}
    return Surrogate(kernel, xs, ys, found, scale, low, w)


def fit(observed: DataFrame, vector: str, value: str, **how) -> Surrogate | Inducing:
    """The process of a table of observations; of more than MOST the one through inducing points, drawn by a hash of the vector."""
    seen = observed.select(vector, F.col(value).cast("double").alias("_y")).filter(F.col(vector).isNotNull() & F.col("_y").isNotNull())
    rows = seen.limit(MOST + 1).toPandas()
    if rows.empty:
        raise ValueError("no observations")
    if len(rows) > MOST:
        from tesserae.operators import inducing

        named = {name: how[name] for name in ("kernel", "hyper", "seed") if name in how}
        return inducing.fit(seen.withColumn("_key", F.xxhash64(vector)), "_key", vector, "_y", **named)
    return fitted(np.stack(rows[vector].to_numpy()), rows["_y"].to_numpy(), **how)


def predict(model: Surrogate | Inducing, candidates: DataFrame, vector: str, mean: str = "mean", std: str = "std") -> DataFrame:
    """``candidates`` and the process's mean and std."""
    schema = StructType([*candidates.schema.fields, StructField(mean, DoubleType()), StructField(std, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 1024):
                part = rows.iloc[at : at + 1024].copy()
                there = part[vector].notna().to_numpy()
                m, s = np.full(len(part), np.nan), np.full(len(part), np.nan)
                if there.any():
                    m[there], s[there] = model.predict(np.stack(part.loc[there, vector].to_numpy()).astype(np.float64))
                part[mean], part[std] = m, s
                yield part

    out = candidates.mapInPandas(run, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in (mean, std)})


def best_observation(observed: DataFrame, key: str, value: str, minimize: bool = False) -> DataFrame:
    """The key and value of the best observation."""
    order = F.struct(F.col(value) if not minimize else -F.col(value), -F.col(key))
    return observed.filter(F.col(value).isNotNull()).agg(F.max_by(F.struct(key, value), order).alias("x")).select("x.*")


class BayesianOptimizer:
    """Observations and the process fitted to them; each step returns tables, and nothing but observations is held."""

    def __init__(self, key: str, vector: str, value: str, acquisition: str = "expected_improvement", kernel: str = "matern52", minimize: bool = False, seed: int = 0):
        self.key, self.vector, self.value, self.acquisition, self.kernel, self.minimize, self.seed = key, vector, value, acquisition, kernel, minimize, seed
        self.observed: DataFrame | None = None
        self.model: Surrogate | Inducing | None = None

    def fit(self, observed: DataFrame) -> BayesianOptimizer:
        self.observed = observed.select(self.key, self.vector, self.value)
        self.model = fit(self.observed, self.vector, self.value, kernel=self.kernel, seed=self.seed)
        return self

    def update(self, new: DataFrame) -> BayesianOptimizer:
        """Further observations; the hyperparameters stay."""
        self.observed = self.observed.unionByName(new.select(self.key, self.vector, self.value))
        self.model = fit(self.observed, self.vector, self.value, kernel=self.kernel, hyper=self.model.hyper)
        return self

    def best(self) -> float:
        return float(best_observation(self.observed, self.key, self.value, self.minimize).first()[1])

    def scored(self, candidates: DataFrame) -> DataFrame:
        """Unobserved candidates with mean, std and acquisition."""
        rest = candidates.select(self.key, self.vector).join(self.observed.select(self.key), self.key, "left_anti")
        made = select.ACQUISITIONS[self.acquisition](F.col("mean"), F.col("std"), F.lit(self.best()), **({"minimize": True} if self.minimize else {}))
        return predict(self.model, rest, self.vector).withColumn("acquisition", made)

    def select_next(self, candidates: DataFrame, size: int = 1) -> DataFrame:
        """The next batch: (key, mean, std, acquisition), best first."""
        return self.scored(candidates).drop(self.vector).orderBy(F.desc_nulls_last("acquisition"), self.key).limit(size)

    def hyperparameters(self) -> dict[str, float]:
        return dict(self.model.hyper)


def select_multi(models: dict[str, Surrogate], candidates: DataFrame, key: str, vector: str, best: dict[str, float], weights: dict[str, float], size: int, scalarization: str = "weighted_sum") -> DataFrame:
    """The batch with the highest scalarised expected improvement over several objectives, a process for each."""
    out = candidates.select(key, vector)
    for name, model in models.items():
        out = predict(model, out, vector, f"{name}_mean", f"{name}_std")
        out = out.withColumn(name, select.expected_improvement(F.col(f"{name}_mean"), F.col(f"{name}_std"), F.lit(best[name])))
    out = out.drop(vector)
    if scalarization == "weighted_sum":
        out = select.min_max_scaled(out, {n: "maximize" for n in models})
        score = select.weighted({f"{n}_scaled": weights[n] for n in models})
    else:
        score = select.tchebycheff({n: weights[n] for n in models})
    return out.withColumn("acquisition", score).orderBy(F.desc("acquisition"), key).limit(size)


def rounds(optimizer: BayesianOptimizer, candidates: DataFrame, oracle: DataFrame, size: int, n_rounds: int) -> DataFrame:
    """An active-learning campaign against known values: (round, key, mean, std, value) of each pick.

    ``oracle`` has the key, vector and value of every candidate; a round's picks are measured, added and refitted.
    """
    spark, picked = candidates.sparkSession, []
    for n in range(1, n_rounds + 1):
        batch = optimizer.select_next(candidates, size).select(optimizer.key, "mean", "std").toPandas()
        if batch.empty:
            break
        keys = batch[optimizer.key].tolist()
        new = oracle.filter(F.col(optimizer.key).isin(keys)).select(optimizer.key, optimizer.vector, optimizer.value)
        seen = {r[0]: float(r[1]) for r in new.select(optimizer.key, optimizer.value).collect()}
        picked += [(n, int(k), float(m), float(s), seen.get(k)) for k, m, s in batch.itertuples(index=False)]
        optimizer.update(new)
    return spark.createDataFrame(picked, "round int, id long, mean double, std double, value double")
