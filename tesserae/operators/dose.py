"""Dose-response curves: a bounded four-parameter fit for each compound, in Arrow batches by compound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of bottom, top, IC50 (from the doses) and slope.
LOW, HIGH, SLOPES = 0.0, 100.0, (-10.0, 10.0)


def curve(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The four-parameter logistic: bottom, top, IC50, slope."""
    with np.errstate(over="ignore", divide="ignore"):
        return p[0] + (p[1] - p[0]) / (1 + (x / p[2]) ** p[3])


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 400) -> dict[str, float]:
    """``fitted_sums`` of single points."""
    return fitted_sums(x, y, np.ones(len(x)), np.zeros(len(x)), *((y.min(), y.max()) if len(y) else (np.nan, np.nan)), steps)


def fitted_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, inner: np.ndarray, least: float, most: float, steps: int = 400) -> dict[str, float]:
    """Levenberg-Marquardt within bounds; all values are null where fewer than four points or no two doses are left.

    Doses x in order, each with the mean y of w points and their squares about it (inner), and the least and greatest response
    of all: what a dose's points add to the squared error is w (y - curve)^2 + inner, so the fit is that of all points.
    """
    names = ("bottom", "top", "ic50", "hill")
    n = int(w.sum())
    none = dict.fromkeys((*names, *(f"{n}_se" for n in names), "r2"), np.nan) | {"n": n}
    if n < 4 or len(np.unique(x)) < 2:
        return none
    low, high = np.array([LOW, LOW, x.min(), SLOPES[0]]), np.array([HIGH, HIGH, x.max(), SLOPES[1]])
    upto, order = np.cumsum(w[np.argsort(x, kind="stable")]), np.sort(x)
    middle = sum(order[np.searchsorted(upto, at, "right")] for at in ((n - 1) // 2, n // 2)) / 2
    p = np.clip(np.array([least, most, middle, -1.0]), low, high)
    within = float(inner.sum())

    def slopes(p):
        out = np.empty((len(x), 4))
        for i in range(4):
            h = 1e-6 * max(abs(p[i]), 1e-3)
            up, down = p.copy(), p.copy()
            up[i], down[i] = p[i] + h, p[i] - h
            out[:, i] = (curve(x, up) - curve(x, down)) / (2 * h)
        return np.nan_to_num(out)

    damp, error = 1e-2, float((w * (y - curve(x, p)) ** 2).sum()) + within
    for _ in range(steps):
        j = slopes(p)
        gram, right = (j.T * w) @ j, j.T @ (w * (y - curve(x, p)))
        # a parameter at its bound that would leave it stays there
        free = ~(((p <= low) & (right < 0)) | ((p >= high) & (right > 0)))
        if not free.any():
            break
        move = np.zeros(4)
        part = gram[np.ix_(free, free)]
        move[free] = np.linalg.lstsq(part + damp * np.diag(np.diag(part) + 1e-12), right[free], rcond=None)[0]
        new = np.clip(p + move, low, high)
        found = float((w * (y - curve(x, new)) ** 2).sum()) + within
        if found < error:
            done = error - found < 1e-12 * (error + 1e-12)
            p, error, damp = new, found, max(damp / 3, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    j = slopes(p)
    spread = np.linalg.pinv((j.T * w) @ j) * error / max(n - 4, 1)
    total = float((w * (y - (w @ y) / n) ** 2).sum()) + within
    out = dict(zip(names, map(float, p), strict=True)) | {f"{n}_se": float(np.sqrt(max(spread[i, i], 0.0))) for i, n in enumerate(names)}
    return out | {"r2": 1 - error / total if total else np.nan, "n": n}


def fit(df: DataFrame, compound: str, dose: str, response: str) -> DataFrame:
    """A row per compound: bottom, top, ic50, hill, their standard errors, r2 and n (points with a dose above 0 and a response).

    Every point counts, repeated ones too. Points are summed up by dose first, so a compound's task holds its distinct doses.
    """
    kind = dict(df.dtypes)[compound]
    rows = df.select(F.col(compound).alias("compound"), F.col(dose).cast("double").alias("x"), F.col(response).cast("double").alias("y")).filter("x > 0 AND y IS NOT NULL")
    n = F.count(F.lit(1)).cast("double")
    doses = rows.groupBy("compound", "x").agg(F.avg("y").alias("y"), n.alias("w"), (F.var_pop("y") * n).alias("inner"), F.min("y").alias("least"), F.max("y").alias("most"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        sums = (part[c].to_numpy() for c in ("x", "y", "w", "inner"))
        return pd.DataFrame([{"compound": part["compound"].iloc[0], **fitted_sums(*sums, part["least"].min(), part["most"].max())}])

    names = "bottom, top, ic50, hill, bottom_se, top_se, ic50_se, hill_se, r2".split(", ")
    out = doses.groupBy("compound").applyInPandas(run, f"compound {kind}, " + ", ".join(f"{n} double" for n in names) + ", n long")
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names}).withColumnRenamed("compound", compound)
