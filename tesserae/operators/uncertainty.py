"""Uncertainty of predictions that are columns: evidential parameters, ensembles, repeated passes and undone scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.metrics import spearman


def nig(gamma: Column, lam: Column, alpha: Column, beta: Column) -> dict[str, Column]:
    """Mean, aleatoric and epistemic deviation of a normal-inverse-gamma output; null unless alpha > 1 and lambda > 0."""
    spread = F.when((alpha > 1) & (lam > 0), beta / (alpha - 1))
    return {"mean": gamma, "aleatoric": F.sqrt(spread), "epistemic": F.sqrt(spread / lam)}


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function by Stirling's series eight steps up, to some 1e-13; null unless x > 0."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    below = F.log(x) + sum((F.log(x + i) for i in range(2, 8)), F.log(x + 1))
    return F.when((x > 0) & ~F.isnan(x), series - below)


def evidential_loss(df: DataFrame, gamma: str, lam: str, alpha: str, beta: str, target: str, weight: float = 1.0) -> DataFrame:
    """Mean negative log likelihood of the Student distribution, plus ``weight`` times error times evidence."""
    g, v, a, b, y = (F.col(c).cast("double") for c in (gamma, lam, alpha, beta, target))
    omega = 2 * b * (1 + v)
    nll = 0.5 * F.log(F.lit(math.pi) / v) - a * F.log(omega) + (a + 0.5) * F.log(v * (y - g) ** 2 + omega) + log_gamma(a) - log_gamma(a + 0.5)
    return df.agg(F.avg(nll + weight * F.abs(y - g) * (2 * a + v)).alias("evidential_loss"))


def ensemble(members: list[Column]) -> dict[str, Column]:
    """Mean and sample deviation over the members' predictions of a row; nulls are left out."""
    seen = F.filter(F.array(*(m.cast("double") for m in members)), lambda x: x.isNotNull())
    n = F.size(seen)
    mean = F.aggregate(seen, F.lit(0.0), lambda t, x: t + x, lambda t: F.when(n > 0, t / n))
    square = F.aggregate(seen, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))
    return {"mean": mean, "std": F.when(n > 1, F.sqrt(square / (n - 1)))}


def passes(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and sample deviation of repeated stochastic passes, a row for each pass."""
    return df.groupBy(key).agg(F.count(value).alias("n_passes"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def unscaled(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scaled predictions in their units again; ``stats`` is one row of mean_<c> and std_<c>."""
    out = df.join(F.broadcast(stats), how="inner")
    return out.withColumns({c: F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}") for c in columns}).select(*df.columns)


def error_correlation(df: DataFrame, y: str, p: str, std: str) -> DataFrame:
    """Spearman correlation of absolute errors with predicted deviations."""
    rows = df.select(F.abs(F.col(y).cast("double") - F.col(p).cast("double")).alias("_e"), F.col(std).cast("double").alias("_s"))
    return spearman(rows, "_e", "_s").withColumnRenamed("spearman", "uncertainty_correlation")
