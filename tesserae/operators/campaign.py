"""Campaigns: rounds of experiments, prospective validations and portfolios summed up as tables.

Null values are left out of means; a campaign without rows has no row; ties go to the least key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import DISTANCES
from tesserae.operators.routes import upsert
from tesserae.operators.select import latin_hypercube, local_penalty
from tesserae.runtime import written


def created(campaigns: DataFrame, new: DataFrame) -> DataFrame:
    """The table of campaigns (name, model_version, start, metadata) with new ones; of a name the row with the last start stays."""
    return upsert(campaigns, new, ["name"], "start")


def with_results(results: DataFrame, new: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Results and those new ones whose campaign is there."""
    return results.unionByName(new.join(campaigns.select(F.col("name").alias("campaign")), "campaign", "left_semi"))


def summary(results: DataFrame) -> DataFrame:
    """Of each campaign: results, predictions, experiments, mean of the hit rates that are there."""
    return results.groupBy("campaign").agg(
        F.count(F.lit(1)).alias("n_results"), F.sum("n_predictions").alias("total_predictions"), F.sum("n_experimental").alias("total_experimental"), F.avg("hit_rate").alias("mean_hit_rate"),
    )


def save(campaigns: DataFrame, results: DataFrame, folder: str) -> None:
    """Both tables as Parquet; results lie by campaign, so that one campaign is read alone."""
    campaigns.write.mode("overwrite").parquet(f"{folder}/campaigns")
    results.write.mode("overwrite").partitionBy("campaign").parquet(f"{folder}/results")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(campaigns, results) as they were saved."""
    return spark.read.parquet(f"{folder}/campaigns"), spark.read.parquet(f"{folder}/results")


def exploration_weight(round_number: int, max_rounds: int, start: float = 0.5, decay: bool = True) -> float:
    """The weight of exploration, falling to 0 over the rounds."""
    return start * max(0.0, 1 - round_number / max(max_rounds, 1)) if decay else start


def adaptive(df: DataFrame, key: str, mean: str, std: str, size: int, weight: float) -> DataFrame:
    """The rows with the highest mean plus ``weight`` deviations."""
    return df.orderBy(F.desc(F.col(mean) + weight * F.col(std)), key).limit(size)


def hybrid(df: DataFrame, key: str, mean: str, std: str, columns: list[str], size: int, weight: float, seed: int = 0) -> DataFrame:
    """Half a batch by mean, the rest spread over the columns by a hypercube; rows that both take count once."""
    exploit = adaptive(df, key, mean, std, size - int(size * weight), 0.0).select(key)
    explore = latin_hypercube(df, key, columns, max(int(size * weight), 1), seed).select(key)
    return exploit.unionByName(explore).distinct().orderBy(key).limit(size)


def round_metrics(df: DataFrame, by: str, observed: str, predicted: str, std: str) -> DataFrame:
    """Of each round: mean, range and deviation observed, errors, and mean and greatest uncertainty."""
    e = F.col(observed) - F.col(predicted)
    return df.groupBy(by).agg(
        F.count(observed).alias("n"), F.avg(observed).alias("mean_observed"), F.max(observed).alias("max_observed"), F.min(observed).alias("min_observed"), F.stddev_pop(observed).alias("std_observed"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(std).alias("mean_uncertainty"), F.max(std).alias("max_uncertainty"),
    )


def round_trend(metrics: DataFrame, by: str) -> DataFrame:
    """Rounds, samples, the best observed, and the first and last round's uncertainty; the table has a row a round."""
    return metrics.agg(
        F.count(F.lit(1)).alias("n_rounds"), F.sum("n").alias("n_samples"), F.max("max_observed").alias("best_observed"),
        F.min_by("mean_uncertainty", by).alias("first_uncertainty"), F.max_by("mean_uncertainty", by).alias("last_uncertainty"),
    ).withColumn("reduced", F.col("last_uncertainty") < F.col("first_uncertainty"))


def portfolio_metrics(df: DataFrame, objectives: list[str], cost: str | None = None) -> DataFrame:
    """Mean and greatest of each objective, total and mean cost of a chosen set."""
    made = [f(c).alias(f"{n}_{c}") for c in objectives for n, f in (("mean", F.avg), ("max", F.max))]
    made += [F.sum(cost).alias("total_cost"), F.avg(cost).alias("mean_cost")] if cost else []
    return df.agg(F.count(F.lit(1)).alias("n"), *made)


def portfolio_spread(df: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """Mean, least and greatest distance of the pairs of a chosen set, which is as small as a batch."""
    a, b = (df.select(F.col(key).alias(f"_{x}"), F.col(vector).alias(f"_v{x}")) for x in "ab")
    d = a.join(b, F.col("_a") < F.col("_b")).select(DISTANCES[metric](F.col("_va"), F.col("_vb")).alias("d"))
    return d.agg(F.avg("d").alias("mean_distance"), F.min("d").alias("min_distance"), F.max("d").alias("max_distance"))


def by_utility(df: DataFrame, key: str, utility: Callable[..., Column], objectives: list[str], size: int) -> DataFrame:
    """The rows of highest utility, a function of the objectives' columns."""
    return df.withColumn("utility", utility(*(F.col(c) for c in objectives))).orderBy(F.desc("utility"), key).limit(size)


def batch_penalised(df: DataFrame, key: str, mean: str, std: str, score: Column, size: int, slope: float = 10.0) -> DataFrame:
    """A greedy batch: each pick lowers the scores of candidates with a mean close to its own. (id, pick, score)."""
    rows, picked = written(df.select(key, mean, std, score.alias("_score")), "candidates"), []
    now = F.col("_score")
    for n in range(size):
        rest = rows.filter(~F.col(key).isin([p[0] for p in picked])) if picked else rows
        row = rest.agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(mean).cast("double").alias("m"), F.col(std).cast("double").alias("s"), now.cast("double").alias("v")), F.struct(now, -F.col(key))).alias("x")).first()["x"]
        if row is None:
            break
        picked.append((row["k"], n + 1, row["v"]))
        now = now * local_penalty(F.col(mean), F.lit(row["m"]), F.lit(row["s"]), slope)
    return df.sparkSession.createDataFrame(picked, "id long, pick int, score double")
