"""A regression on numeric columns: feature selection, cross-validation and scoring from sums that all rows add to.

The fit is ridge regression by normal equations: sums of p x p products where the rows lie, one small system on the driver.
Rows with a null among the columns used are left out; a constant feature has weight 0.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.split import draw


@dataclass
class Linear:
    features: list[str]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        return sum((F.col(c).cast("double") * w for c, w in zip(self.features, self.weights, strict=True)), F.lit(self.intercept))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.column())

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Linear:
        return Linear(**json.loads(spark.read.json(path).first()["model"]))


def selected(df: DataFrame, features: list[str], y: str, k: int) -> list[str]:
    """The k features of highest F statistic of a line on y; ties in the order given."""
    made = df.agg(*(F.corr(c, y).alias(c) for c in features)).first()
    strength = {c: (made[c] or 0.0) ** 2 for c in features}
    strength = {c: 0.0 if v != v else v for c, v in strength.items()}
    return sorted(features, key=lambda c: -strength[c])[:k]


def _sums(df: DataFrame, features: list[str], y: str, by: list[Column], weight: Column | None = None) -> dict:
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features), F.col(y).cast("double")]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    rows = df.dropna(subset=[*features, y]).groupBy(*by).agg(*(F.sum(x[i] * x[j] if weight is None else weight * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(x), len(x)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r[0] if by else None] = m
    return out


def _solved(m: np.ndarray, features: list[str], ridge: float) -> Linear:
    n = max(m[0, 0], 1.0)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    gram = cov[:-1, :-1]
    scale = np.sqrt(np.where(np.diag(gram) > 1e-12 * n, np.diag(gram) / n, 1.0))
    w = np.linalg.lstsq(gram / np.outer(scale, scale) + ridge * np.eye(len(features)), cov[:-1, -1] / scale, rcond=None)[0] / scale
    return Linear(list(features), [float(v) for v in w], float(mean[-1] - w @ mean[:-1]))


def fit(df: DataFrame, features: list[str], y: str, ridge: float = 1e-6) -> Linear:
    """The line of all rows; features are scaled, so that ``ridge`` weighs them alike."""
    sums = _sums(df, features, y, [])
    return _solved(sums.get(None, np.zeros((len(features) + 2,) * 2)), features, ridge)


@dataclass
class Ensemble:
    """Lines fitted to bootstrap draws of the same rows."""

    members: list[Linear]

    def predict(self, df: DataFrame, mean: str = "mean", std: str = "std") -> DataFrame:
        """``df`` with the mean and the population deviation of the members' predictions."""
        each = F.array(*(m.column() for m in self.members))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
        out = df.withColumn("_each", each).withColumn(mean, total(F.col("_each")) / len(self.members))
        off = F.transform("_each", lambda x: (x - F.col(mean)) * (x - F.col(mean)))
        return out.withColumn(std, F.sqrt(total(off) / len(self.members))).drop("_each")

    def save(self, spark: SparkSession, path: str) -> None:
        """A row for each member."""
        spark.createDataFrame([(i, json.dumps(asdict(m))) for i, m in enumerate(self.members)], "member int, model string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        return Ensemble([Linear(**json.loads(r["model"])) for r in spark.read.json(path).orderBy("member").collect()])


def ensemble(df: DataFrame, features: list[str], y: str, key: str, members: int = 10, ridge: float = 1e-6, seed: int = 0) -> Ensemble:
    """``members`` lines in one pass: a row's weight in each is a Poisson draw by a hash of member and key, and the sums of all
    members are taken where the rows lie."""
    from tesserae.operators.significance import _drawn

    drawn = _drawn(df.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(members)))), key, seed).filter("_w > 0")
    sums = _sums(drawn, features, y, [F.col("_rep")], F.col("_w"))
    none = np.zeros((len(features) + 2,) * 2)
    return Ensemble([_solved(sums.get(k, none), features, ridge) for k in range(1, members + 1)])


def cross_validated(df: DataFrame, features: list[str], y: str, key: str, folds: int = 5, ridge: float = 1e-6, seed: int = 42) -> DataFrame:
    """(fold, n, r2, mae, rmse): rows are dealt to folds by a hash; one pass sums all folds, and a fold's line is of the others."""
    from tesserae.operators.metrics import regression_aggregates

    fold = F.least(F.floor(draw(F.col(key), seed) * folds), F.lit(folds - 1)).cast("int")
    sums = _sums(df.withColumn("_fold", fold), features, y, [F.col("_fold")])
    total = sum(sums.values(), np.zeros((len(features) + 2,) * 2))
    made = F.lit(None).cast("double")
    for k, m in sums.items():
        made = F.when(F.col("fold") == k, _solved(total - m, features, ridge).column()).otherwise(made)
    rows = df.dropna(subset=[*features, y]).withColumn("fold", fold).withColumn("_p", made)
    scores = regression_aggregates(F.col(y).cast("double"), F.col("_p"))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(scores[c].alias(c) for c in ("r2", "mae", "rmse")))


def permuted(df: DataFrame, model: Linear, y: str, key: str, seed: int = 0) -> DataFrame:
    """(feature, increase): how much the mean squared error grows when a feature's values are dealt anew, in expectation.

    For a line it is twice the squared weight times the variance plus twice the weight times the covariance with the
    residual: no row has to move.
    """
    rows = model.predict(df.dropna(subset=[*model.features, y]), "_p").withColumn("_e", F.col(y).cast("double") - F.col("_p"))
    made = rows.agg(*(F.struct(F.var_pop(c).alias("v"), F.covar_pop(c, "_e").alias("c")).alias(c) for c in model.features)).first()
    table = [(c, 2 * w * w * (made[c]["v"] or 0.0) + 2 * w * (made[c]["c"] or 0.0)) for c, w in zip(model.features, model.weights, strict=True)]
    return df.sparkSession.createDataFrame(table, "feature string, increase double")
