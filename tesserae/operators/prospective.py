"""Prospective validation: time-cut and rolling evaluation, latest-wins stores, drift over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import ratio
from tesserae.operators.metrics import HIGHER_IS_BETTER, regression_aggregates


def rolling(df: DataFrame, time: str, y: str, x: str, train_days: int, step_days: int) -> DataFrame:
    """For each step of ``step_days``: a line fitted on the ``train_days`` before, tested on the step.

    A row belongs to one step as test and to the steps it trains; both are derived from its time by arithmetic, so
    windows aren't a join. The line comes from sums, and so does its test error.
    """
    t = F.col(time)
    start = df.agg(F.min(t).alias("_t0"))
    rows = df.filter(t.isNotNull() & F.col(y).isNotNull() & F.col(x).isNotNull()).join(F.broadcast(start), how="inner")
    day = F.datediff(t, F.col("_t0"))
    rows = rows.select(day.alias("_d"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    # step k tests days [train + k step, train + (k + 1) step) and trains on the train days before
    own = F.floor((F.col("_d") - train_days) / step_days)
    last = df.join(F.broadcast(start), how="inner").agg(F.max(own_step(F.datediff(t, F.col("_t0")), train_days, step_days)).alias("_last"))
    low, high = F.greatest(F.lit(0), F.floor((F.col("_d") - train_days) / step_days) + 1), F.floor(F.col("_d") / step_days)
    trains = rows.join(F.broadcast(last), how="inner").withColumn("_hi", F.least(high, F.col("_last"))).filter(F.col("_hi") >= low).withColumn("step", F.explode(F.sequence(low, F.col("_hi"))))
    fit = trains.groupBy("step").agg(F.count(F.lit(1)).alias("n_train"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))
    tests = rows.filter(own >= 0).withColumn("step", own)
    scored = tests.join(F.broadcast(fit), "step").withColumn("_p", F.col("intercept") + F.col("slope") * F.col("_x"))
    made = regression_aggregates(F.col("_y"), F.col("_p"))
    return scored.groupBy("step", "n_train").agg(F.count(F.lit(1)).alias("n_test"), made["rmse"].alias("rmse"), made["r2"].alias("r2")).withColumn("step", F.col("step").cast("long"))


def own_step(day, train_days: int, step_days: int):
    return F.floor((day - train_days) / step_days)


def compared(predictions: DataFrame, experiments: DataFrame, key: str, threshold: float) -> DataFrame:
    """Joined by key: counts, errors, hit rate above a threshold and correlation of confidence with error."""
    rows = predictions.join(experiments, key)
    e = F.abs(F.col("predicted_value") - F.col("experimental_value"))
    made = regression_aggregates(F.col("experimental_value"), F.col("predicted_value"))
    return rows.agg(F.count(F.lit(1)).alias("n_matched"), made["rmse"].alias("rmse"), made["mae"].alias("mae"), made["r2"].alias("r2"), F.avg((F.col("experimental_value") >= threshold).cast("double")).alias("hit_rate"), F.corr(F.coalesce("confidence", F.lit(1.0)), e).alias("confidence_error_corr"))


def drift(df: DataFrame, order: str, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Slope over the index, mean, deviation, range, values beyond two deviations and the direction; a row per metric value
    (one a period), so a window over them is bounded."""
    i = F.row_number().over(Window.orderBy(order)).cast("double") - 1
    rows = df.filter(F.col(metric).isNotNull()).select(i.alias("_i"), F.col(metric).alias("_v"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_v", "_i").alias("slope"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    odd = rows.join(F.broadcast(stats.select("mean", "std")), how="inner").agg(F.count_if(F.abs(F.col("_v") - F.col("mean")) > 2 * F.col("std")).alias("n_outliers"))
    better = F.col("slope") > 0 if higher_is_better else F.col("slope") < 0
    return stats.join(F.broadcast(odd), how="inner").withColumn("direction", F.when(F.coalesce(F.col("slope") == 0, F.lit(True)), "stable").when(better, "improving").otherwise("declining"))


def performance_drop(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, retrospective, prospective, drop) of metrics both tables have; the sign turns for errors."""
    m = a.select("metric", F.col("value").alias("retrospective")).join(b.select("metric", F.col("value").alias("prospective")), "metric")
    gap = F.col("retrospective") - F.col("prospective")
    return m.withColumn("drop", F.when(F.col("metric").isin(*HIGHER_IS_BETTER), gap).otherwise(-gap))


def hit_summary(df: DataFrame, by: list[str], hit: str) -> DataFrame:
    """Predictions, hits and hit rate of groups."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), F.count_if(hit).alias("n_hits"), ratio(F.count_if(hit).cast("double"), n).alias("hit_rate"))
