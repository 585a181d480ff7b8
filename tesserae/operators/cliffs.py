"""What activity cliffs are made of, and folds that respect them.

``cliffs`` are pairs (a, b, activity_a, activity_b) as ``similarity.activity_cliffs`` makes them; ``df`` has the key and the set bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import components
from tesserae.operators.split import draw, group_folds
from tesserae.runtime import written


def differences(cliffs: DataFrame, df: DataFrame, key: str, bits: str) -> DataFrame:
    """``cliffs`` with the bits that only a or only b has, and the numbers of those and of common bits."""
    side = lambda n: df.select(F.col(key).alias(n), F.array_distinct(bits).alias(f"_s{n}"))
    met = cliffs.join(side("a"), "a").join(side("b"), "b")
    only_a, only_b = F.array_except("_sa", "_sb"), F.array_except("_sb", "_sa")
    out = met.withColumns({"only_a": F.array_sort(only_a), "only_b": F.array_sort(only_b), "n_only_a": F.size(only_a), "n_only_b": F.size(only_b), "n_common": F.size(F.array_intersect("_sa", "_sb"))})
    return out.drop("_sa", "_sb")


def feature_effects(cliffs: DataFrame, df: DataFrame, key: str, bits: str) -> DataFrame:
    """(feature, n_cliffs, n_up, mean_change, std_change, effect_size): over the cliffs in which one side alone has a feature, how much
    higher that side's activity is, in how many it is higher, and the mean change over its deviation (null with one cliff)."""
    change = F.col("activity_a") - F.col("activity_b")
    found = differences(cliffs, df, key, bits)
    each = found.select(F.explode("only_a").alias("feature"), change.alias("_c")).unionByName(found.select(F.explode("only_b").alias("feature"), (-change).alias("_c")))
    made = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cliffs"), F.count_if(F.col("_c") > 0).alias("n_up"), F.avg("_c").alias("mean_change"), F.stddev_samp("_c").alias("std_change"))
    return made.withColumn("effect_size", F.try_divide("mean_change", "std_change"))


def cliff_folds(df: DataFrame, key: str, cliffs: DataFrame, folds: int = 5) -> DataFrame:
    """``df`` with ``component`` and ``fold``: all that cliffs link is in one fold, and folds are near equal in rows."""
    comps = components(cliffs.select("a", "b"))
    whole = df.join(comps, F.col(key) == F.col("node"), "left").withColumn("component", F.coalesce("comp", F.col(key))).drop("node", "comp")
    return group_folds(written(whole, "components"), "component", folds)


def opposite_split(df: DataFrame, key: str, cliffs: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: a set for testing on cliffs themselves. Of the rows on cliffs a test row is one whose draw is below those of
    all its partners, so every cliff of a test row leads to a training row; other rows are drawn so that the test set has its
    share of all rows, if the cliffs don't fill it (then the least draws are kept)."""
    both = cliffs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cliffs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    order = lambda c: F.struct(draw(F.col(c), seed), F.col(c))
    least = both.groupBy("u").agg(F.min(order("v")).alias("_near"))
    marked = written(df.join(least, F.col(key) == F.col("u"), "left").withColumn("_u", draw(F.col(key), seed)).withColumn("_kind", _kind(key)).drop("u", "_near"), "sides")
    n = marked.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["_kind"]: r["n"] for r in n}
    wanted = test * sum(size.values())
    first = min(1.0, wanted / size["first"]) if size.get("first") else 0.0
    free = max(0.0, wanted - size.get("first", 0)) / size["free"] if size.get("free") else 0.0
    # a fresh draw, so that the share of the first sides is taken evenly
    again = draw(F.concat(F.col(key).cast("string"), F.lit("/")), seed)
    picked = F.when(F.col("_kind") == "first", again < first).when(F.col("_kind") == "free", again < free).otherwise(F.lit(False))
    return marked.withColumn("split", F.when(picked, "test").otherwise("train")).drop("_u", "_kind")


def _kind(key: str) -> Column:
    near = F.col("_near")
    return F.when(near.isNull(), "free").when(F.struct(F.col("_u"), F.col(key)) < near, "first").otherwise("partner")


def fold_shares(df: DataFrame, key: str, fold: str, cliffs: DataFrame) -> DataFrame:
    """(fold, n_rows, n_cliffs, n_cut): rows of a fold, cliffs with an end in it, and those whose other end is in another fold."""
    at = df.select(F.col(key).alias("_k"), F.col(fold).alias("_f"))
    met = cliffs.select("a", "b").join(at.select(F.col("_k").alias("a"), F.col("_f").alias("_fa")), "a").join(at.select(F.col("_k").alias("b"), F.col("_f").alias("_fb")), "b")
    cut = F.col("_fa") != F.col("_fb")
    ends = met.select(F.explode(F.array_distinct(F.array("_fa", "_fb"))).alias("_of"), cut.alias("_cut")).groupBy("_of").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_cut").alias("_m"))
    rows = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(ends, F.col(fold) == F.col("_of"), "left").select(fold, "n_rows", F.coalesce("_n", F.lit(0)).alias("n_cliffs"), F.coalesce("_m", F.lit(0)).alias("n_cut"))
