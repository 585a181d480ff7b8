"""Data set splits: random, stratified, temporal, by group, by cliff component, and k folds; leakage and split statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.quantiles import with_quantiles
from tesserae.runtime import written


def draw(key: Column, seed: int = 42) -> Column:
    """A reproducible number in [0, 1) from a key: the first 12 hex digits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_split(df: DataFrame, key: str, train: float = 0.7, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` by the hash of the key: no sort, no shuffle, shares right in expectation."""
    u = draw(F.col(key), seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def exact_split(df: DataFrame, key: str, train: float = 0.7, valid: float = 0.15, seed: int = 42, by: str | None = None) -> DataFrame:
    """Shares met to the row: rows ranked by the hash of the key, within strata if ``by`` names them.

    The cut is a quantile of the hash, so only two numbers per stratum travel; rows stay where they are.
    """
    df = df.withColumn("_u", draw(F.col(key), seed))
    out = with_quantiles(df, "_u", [by] if by else [], _a=train, _b=min(1.0, train + valid))
    return out.withColumn("split", F.when(F.col("_u") <= F.col("_a"), "train").when(F.col("_u") <= F.col("_b"), "valid").otherwise("test")).drop("_u", "_a", "_b")


def temporal_split(df: DataFrame, time: str, train_end: str, valid_end: str) -> DataFrame:
    """Train up to and with the first date, valid up to and with the second, test after; null times are in none."""
    t = F.col(time)
    a, b = F.lit(train_end).cast("timestamp_ntz"), F.lit(valid_end).cast("timestamp_ntz")
    return df.withColumn("split", F.when(t <= a, "train").when(t <= b, "valid").when(t > b, "test"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def group_split(df: DataFrame, group: str, train: float = 0.7, valid: float = 0.15, fill_first: str = "train") -> DataFrame:
    """Whole groups, largest first, go to the first split that isn't full yet: a group is placed by the rows before it.

    ``fill_first='test'`` fills the test set with the largest groups instead. Only the table of group sizes is ordered.
    """
    sizes = group_sizes(df, group)
    order = Window.orderBy(F.desc("size"), group).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumns({"_before": F.coalesce(F.sum("size").over(order), F.lit(0)), "_all": F.sum("size").over(Window.partitionBy())})
    names, shares = (("train", "valid", "test"), (train, train + valid)) if fill_first == "train" else (("test", "valid", "train"), (1 - train - valid, 1 - train))
    at = F.col("_before").cast("double") / F.col("_all")
    placed = placed.select(F.col(group).alias("_g"), F.when(at < shares[0], names[0]).when(at < shares[1], names[1]).otherwise(names[2]).alias("split"))
    return df.join(placed, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``df`` with ``fold``: groups dealt by falling size, there and back, so that folds are near equal and no group is cut."""
    rank = F.row_number().over(Window.orderBy(F.desc("size"), group)) - 1
    at = F.pmod(rank, F.lit(2 * folds))
    fold = F.when(at < folds, at).otherwise(2 * folds - 1 - at)
    placed = group_sizes(df, group).select(F.col(group).alias("_g"), fold.cast("long").alias("fold"))
    return df.join(placed, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratum(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """``df`` with ``stratum``: which of equally filled ranges the value lies in."""
    marks = {f"_cut{i}": i / bins for i in range(1, bins)}
    at = sum((F.when(F.col(c) < F.col(value), 1).otherwise(0) for c in marks), F.lit(0))
    return with_quantiles(df, value, [], **marks).withColumn("stratum", F.when(F.col(value).isNotNull(), at.cast("long"))).drop(*marks)


def split_statistics(df: DataFrame, split: str, group: str, value: str) -> DataFrame:
    """Rows, distinct groups, mean and population deviation of each split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def overlap(df: DataFrame, split: str, group: str) -> DataFrame:
    """Groups that train and test share."""
    each = df.filter(F.col(split).isin("train", "test")).groupBy(group).agg(F.count_distinct(split).alias("_n"))
    return each.agg(F.count_if(F.col("_n") == 2).alias("n_shared_groups"), F.count(F.lit(1)).alias("n_groups"))


def component_split(df: DataFrame, key: str, edges: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Connected components of ``edges`` (a, b) stay together: each is drawn whole, by the hash of its least member."""
    from tesserae.operators.graph import components

    comps = components(edges)
    out = df.join(comps, F.col(key) == F.col("node"), "left").withColumn("component", F.coalesce("comp", F.col(key))).drop("node", "comp")
    return out.withColumn("split", F.when(draw(F.col("component"), seed) < test, "test").otherwise("train"))


def leakage(pairs: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Share of test rows with a similar train row; ``pairs`` has (test_id, train_id, similarity) above the threshold."""
    leaked = written(pairs.groupBy("test_id").agg(F.max_by("train_id", F.struct("similarity", -F.col("train_id"))).alias("train_id"), F.max("similarity").alias("similarity")), "leaks")
    return leaked.agg(F.count(F.lit(1)).alias("n_leaked"), F.avg("similarity").alias("mean_similarity")).join(F.broadcast(test_rows.agg(F.count(F.lit(1)).alias("n_test"))), how="inner").withColumn("score", F.try_divide(F.col("n_leaked").cast("double"), F.col("n_test")))
