"""Gaussian-process surrogates for any number of observations, by inducing points.

A process through m chosen points needs of its observations the m by m sums of k k' and k y, where k are an observation's
covariances with those points. The sums are taken where the rows lie, added up in one small shuffle, and the driver solves a system of
m unknowns; no observation travels but the chosen points and the rows that hyperparameters are tuned on, both bounded
parameters. With all observations as points it is the exact process of ``surrogate``.

Rows whose vector or value is null are no observations; with none, fitting is an error. Points are drawn by a hash of the key, equal
vectors once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import select, surrogate
from tesserae.operators.domains import moments

#: Points, and observations that the hyperparameters are tuned on.
POINTS, TUNED = 256, 500


@dataclass
class Inducing:
    """A fitted process; ``predict`` is that of ``surrogate.Surrogate``."""

    kernel: str
    points: np.ndarray
    hyper: dict[str, float]
    scale: tuple[np.ndarray, np.ndarray, float, float]
    weight: np.ndarray = field(repr=False)
    spread: np.ndarray = field(repr=False)

    def covariance(self, x: np.ndarray) -> np.ndarray:
        """Of scaled rows with the points."""
        return self.hyper["constant"] * surrogate._shape(self.kernel, surrogate._distances(x, self.points) / self.hyper["length"])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mx, sx, my, sy = self.scale
        k = self.covariance((x - mx) / sx)
        var = self.hyper["constant"] + self.hyper["noise"] - np.einsum("ij,jk,ik->i", k, self.spread, k)
        return my + sy * (k @ self.weight), sy * np.sqrt(np.maximum(var, 0.0))


def _sums(rows: DataFrame, model: Inducing) -> tuple[np.ndarray, np.ndarray]:
    """The sums of k k' and of k y over all rows."""
    m = len(model.points)
    mx, sx, my, sy = model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                y = part.column(1).to_numpy(zero_copy_only=False)
                k = model.covariance((x - mx) / sx)
                total += k.T @ np.column_stack([k, (y - my) / sy])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "s"])

    found = np.zeros(m * (m + 1))
    for r in rows.select("_v", "_y").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # m (m + 1) rows
        found[r["i"]] = r["s"]
    found = found.reshape(m, m + 1)
    return found[:, :m], found[:, m]


def fit(observed: DataFrame, key: str, vector: str, value: str, points: int = POINTS, tuned: int = TUNED, kernel: str = "matern52", hyper: dict[str, float] | None = None, seed: int = 0) -> Inducing:
    """The process of all observations through ``points`` of them."""
    rows = observed.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), F.col(value).cast("double").alias("_y")).filter("_k IS NOT NULL AND _v IS NOT NULL AND _y IS NOT NULL")
    n, mean, covariance = moments(rows, "_v")
    if not n:
        raise ValueError("no observations")
    my, sy = rows.agg(F.avg("_y"), F.stddev_pop("_y")).first()
    sx = np.sqrt(np.diag(covariance) * max(n - 1, 1) / n)
    sx[sx < 1e-12] = 1.0
    scale = (mean, sx, float(my), float(sy) or 1.0)
    drawn = rows.orderBy(F.xxhash64("_k", F.lit(seed)), "_k").limit(max(points, 0 if hyper else tuned)).toPandas()  # bounded by both parameters
    x, y = np.stack(drawn["_v"].to_numpy()), drawn["_y"].to_numpy()
    if hyper is None:
        sample = surrogate.fitted((x[:tuned] - mean) / sx, (y[:tuned] - scale[2]) / scale[3], kernel, restarts=0, seed=seed)
        hyper = {name: sample.hyper[name] for name in ("constant", "length", "noise")}
    chosen = np.unique((x[:points] - mean) / sx, axis=0)
    model = Inducing(kernel, chosen, {name: hyper[name] for name in ("constant", "length", "noise")}, scale, np.zeros(0), np.zeros((0, 0)))
    gram, right = _sums(rows, model)
    # in the directions of the points' own covariance, so that nearly equal points do no harm
    noise = model.hyper["noise"] + 1e-8
    size, axes = np.linalg.eigh(model.covariance(chosen))
    white = axes[:, size > 1e-10 * size.max()] / np.sqrt(size[size > 1e-10 * size.max()])
    inverse = np.linalg.inv(noise * np.eye(white.shape[1]) + white.T @ gram @ white)
    model.weight = white @ (inverse @ (white.T @ right))
    model.spread = white @ (np.eye(len(inverse)) - noise * inverse) @ white.T
    return model


class MultiObjective:
    """Observations of several values, a process for each, and batches by a scalarised expected improvement.

    Observations stay a table; ``update`` adds to it and fits anew with the hyperparameters of the first fit.
    """

    def __init__(self, key: str, vector: str, goals: dict[str, str], weights: dict[str, float] | None = None, points: int = POINTS, seed: int = 0):
        self.key, self.vector, self.goals, self.points, self.seed = key, vector, goals, points, seed
        self.weights = weights or dict.fromkeys(goals, 1.0 / len(goals))
        self.observed: DataFrame | None = None
        self.models: dict[str, Inducing] = {}

    def _signed(self, name: str):
        return F.col(name).cast("double") * (-1.0 if self.goals[name] == "minimize" else 1.0)

    def fit(self, observed: DataFrame) -> MultiObjective:
        known = {name: model.hyper for name, model in self.models.items()}
        self.observed = observed.select(self.key, self.vector, *self.goals)
        for name in self.goals:
            rows = self.observed.withColumn("_signed", self._signed(name))
            self.models[name] = fit(rows, self.key, self.vector, "_signed", self.points, hyper=known.get(name), seed=self.seed)
        return self

    def update(self, new: DataFrame) -> MultiObjective:
        return self.fit(self.observed.unionByName(new.select(self.key, self.vector, *self.goals)))

    def select_next(self, candidates: DataFrame, size: int = 1, scalarization: str = "weighted_sum") -> DataFrame:
        """The next batch of candidates that aren't observed: key, mean and std of each value (signed: more is better), acquisition."""
        rest = candidates.join(self.observed.select(self.key), self.key, "left_anti")
        best = self.observed.agg(*(F.max(self._signed(name)).alias(name) for name in self.goals)).first()
        return surrogate.select_multi(self.models, rest, self.key, self.vector, {name: best[name] for name in self.goals}, self.weights, size, scalarization)

    def front(self) -> DataFrame:
        """The observations that no other beats."""
        from tesserae.operators.skyline import pareto_front

        return pareto_front(self.observed, self.goals)


def acquisition(model: Inducing, candidates: DataFrame, vector: str, best: float, name: str = "expected_improvement") -> DataFrame:
    """``candidates`` with mean, std and an acquisition."""
    return surrogate.predict(model, candidates, vector).withColumn("acquisition", select.ACQUISITIONS[name](F.col("mean"), F.col("std"), F.lit(best)))
