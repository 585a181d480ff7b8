"""Assay statistics over long plates: normalisation, quality, outliers, replicates, hit calling.

Group statistics come from one aggregate that is joined back by its (small) key, so a plate that holds a large share of
the wells is pre-aggregated where it lies and never gathered by a window. Medians and quartiles are exact and found by counting
(``operators.quantiles``), for plates of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import ratio
from tesserae.operators.quantiles import joined_quantiles, quantiles, with_quantiles


def _with_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """``df`` with aggregates of its groups; null keys are a group like any other."""
    if not by:
        return df.join(F.broadcast(df.agg(*(c.alias(n) for n, c in stats.items()))), how="inner")
    found = df.groupBy(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by))).agg(*(c.alias(n) for n, c in stats.items()))
    on = [F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)]
    return df.join(found, on, "inner").drop(*(f"_k{i}" for i in range(len(by))))


def percent_inhibition(df: DataFrame, value: str, positive: Column, negative: Column, by: list[str], out: str = "percent_inhibition") -> DataFrame:
    """100 * (v - mean negative) / (mean positive - mean negative); null where the controls agree."""
    v = F.col(value)
    df = _with_stats(df, by, _pos=F.avg(F.when(positive, v)), _neg=F.avg(F.when(negative, v)))
    return df.withColumn(out, ratio(100 * (v - F.col("_neg")), F.col("_pos") - F.col("_neg"))).drop("_pos", "_neg")


def z_score(df: DataFrame, value: str, by: list[str], out: str = "z_score") -> DataFrame:
    """(v - mean) / population deviation; null where all values agree."""
    df = _with_stats(df, by, _m=F.avg(value), _s=F.stddev_pop(value))
    return df.withColumn(out, ratio(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def with_mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with _med and _mad: the median and the median absolute deviation of its group."""
    df = with_quantiles(df, value, by, _med=0.5)
    df = df.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return with_quantiles(df, "_dev", by, _mad=0.5).drop("_dev")


def robust_z_score(df: DataFrame, value: str, by: list[str], out: str = "robust_z") -> DataFrame:
    """0.6745 * (v - median) / MAD; null where the MAD is 0."""
    df = with_mad(df, value, by)
    return df.withColumn(out, ratio(0.6745 * (F.col(value) - F.col("_med")), F.col("_mad"))).drop("_med", "_mad")


def b_score(df: DataFrame, value: str, row: str, column: str, by: list[str], out: str = "b_score") -> DataFrame:
    """One pass of median correction: v - (row median - plate median) - (column median - plate median)."""
    out_of = df
    for name, keys in (("_all", by), ("_row", [*by, row]), ("_col", [*by, column])):
        out_of = joined_quantiles(out_of, quantiles(df, value, keys, {name: 0.5}), keys)
    v = F.col(value) - (F.col("_row") - F.col("_all")) - (F.col("_col") - F.col("_all"))
    return out_of.withColumn(out, v).drop("_all", "_row", "_col")


def plate_quality(df: DataFrame, value: str, positive: Column, negative: Column, by: list[str]) -> DataFrame:
    """Z', signal to noise and to background, CVs, outliers outside the controls and the verdict, a row per plate."""
    v = F.col(value)
    p, n = F.when(positive, v), F.when(negative, v)
    rest = F.when(~positive & ~negative, v)
    stats = df.groupBy(*by).agg(
        F.avg(p).alias("_mp"), F.stddev_pop(p).alias("_sp"), F.avg(n).alias("_mn"), F.stddev_pop(n).alias("_sn"),
        F.count(F.lit(1)).alias("n_wells"),
    )
    stats = joined_quantiles(stats, quantiles(df.filter(~positive & ~negative), value, by, {"_q1": 0.25, "_q3": 0.75}), by)
    named = stats.withColumnsRenamed({b: f"_k_{b}" for b in by})
    outside = df.join(named, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
    spread = 1.5 * (F.col("_q3") - F.col("_q1"))
    odd = ~positive & ~negative & ((v < F.col("_q1") - spread) | (v > F.col("_q3") + spread))
    counts = outside.groupBy(*by).agg(F.count_if(odd).alias("n_outliers")).withColumnsRenamed({b: f"_o_{b}" for b in by})
    out = stats.join(counts, [F.col(b).eqNullSafe(F.col(f"_o_{b}")) for b in by])
    z = 1 - ratio(3 * (F.col("_sp") + F.col("_sn")), F.abs(F.col("_mp") - F.col("_mn")))
    cvp, cvn = ratio(100 * F.col("_sp"), F.col("_mp")), ratio(100 * F.col("_sn"), F.col("_mn"))
    return out.select(
        *by, "n_wells", z.alias("z_prime"), ratio(F.col("_mp"), F.col("_sn")).alias("signal_to_noise"), ratio(F.col("_mp"), F.col("_mn")).alias("signal_to_background"),
        cvp.alias("cv_positive"), cvn.alias("cv_negative"), "n_outliers", F.coalesce((z >= 0.5) & (cvp < 20) & (cvn < 20), F.lit(False)).alias("passed"),
    )


def outliers(df: DataFrame, value: str, by: list[str], method: str = "iqr", limit: float | None = None, out: str = "is_outlier") -> DataFrame:
    """Flag values by 'iqr' (1.5 ranges beyond a quartile), 'zscore' (3) or 'mad' (3.5), all strict."""
    v = F.col(value)
    if method == "iqr":
        k = 1.5 if limit is None else limit
        df = with_quantiles(df, value, by, _q1=0.25, _q3=0.75)
        flag = (v < F.col("_q1") - k * (F.col("_q3") - F.col("_q1"))) | (v > F.col("_q3") + k * (F.col("_q3") - F.col("_q1")))
        return df.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_q1", "_q3")
    scored = {"zscore": z_score, "mad": robust_z_score}[method](df, value, by, "_score")
    k = (3.0 if method == "zscore" else 3.5) if limit is None else limit
    return scored.withColumn(out, F.coalesce(F.abs("_score") > k, F.lit(False))).drop("_score")


def replicates(df: DataFrame, value: str, by: list[str], drop_beyond: float = 2.0) -> DataFrame:
    """Mean, median, deviation, standard error and count of a group's values.

    In groups of more than two, values ``drop_beyond`` population deviations or more off the mean are left out; where the
    deviation is 0 nothing is. Whole values are held against the limit in whole numbers, so that one that lies exactly on it
    is left out in whatever order a deviation's parts are added; others within the rounding of doubles.
    """
    v, x = F.col(value), F.col(value).cast("double")
    whole = F.min((x == F.floor(x)) & (F.abs(x) < 1 << 26))
    df = _with_stats(df, by, _m=F.avg(value), _s=F.stddev_pop(value), _n=F.count(value), _sum=F.sum(x), _squares=F.sum(x * x), _whole=whole)
    # n (v - mean) and n times the deviation, squared: doubles are exact to 2^53, and no difference is more than n times the squares
    off, spread = F.col("_n") * x - F.col("_sum"), F.col("_n") * F.col("_squares") - F.col("_sum") * F.col("_sum")
    exact = F.col("_whole") & (F.greatest(F.lit(4.0), F.lit(float(drop_beyond) ** 2)) * F.col("_n") * F.col("_squares") * F.col("_n") < float(1 << 53))
    inside = F.when(exact, off * off < float(drop_beyond) ** 2 * spread).otherwise(F.abs(v - F.col("_m")) < drop_beyond * F.col("_s"))
    near = (F.col("_n") <= 2) | (F.col("_s") == 0) | inside
    kept = df.filter(near)
    stats = kept.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n_replicates"),
    )
    return joined_quantiles(stats, quantiles(kept, value, by, {"median": 0.5}), by).select(*by, "mean", "median", "std", "sem", "n_replicates")


def hits_by_threshold(df: DataFrame, value: str, threshold: float, above: bool = True, out: str = "is_hit") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(value) > threshold if above else F.col(value) < threshold, F.lit(False)))


def hits_by_zscore(df: DataFrame, value: str, by: list[str], limit: float = 3.0, above: bool = True, out: str = "is_hit") -> DataFrame:
    df = z_score(df, value, by, "_z")
    return df.withColumn(out, F.coalesce(F.col("_z") > limit if above else F.col("_z") < -limit, F.lit(False))).drop("_z")


def hits_by_mad(df: DataFrame, value: str, by: list[str], limit: float = 3.0, above: bool = True, out: str = "is_hit") -> DataFrame:
    df = with_mad(df, value, by)
    score = ratio(F.col(value) - F.col("_med"), 1.4826 * F.col("_mad"))
    return df.withColumn(out, F.coalesce(score > limit if above else score < -limit, F.lit(False))).drop("_med", "_mad")


def activity_class(value: Column, bounds: dict[str, float] | None = None, lowest: str = "inactive") -> Column:
    """The highest class whose bound the value reaches."""
    out = F.lit(lowest)
    for name, bound in sorted((bounds or {"weak": 25.0, "moderate": 50.0, "strong": 75.0}).items(), key=lambda x: x[1]):
        out = F.when(value >= bound, F.lit(name)).otherwise(out)
    return out


def matrix_to_long(df: DataFrame, row: str, columns: list[str], value: str = "value") -> DataFrame:
    """A wide plate matrix as (well, row, column, value)."""
    long = df.unpivot([row], columns, "column", value)
    return long.select(F.concat(F.col(row), F.col("column")).alias("well"), F.col(row).alias("row"), F.col("column").cast("int").alias("column"), value)


def split_wells(df: DataFrame, well: str = "well") -> DataFrame:
    """Row letter and column number of well names."""
    return df.withColumns({"row": F.substring(well, 1, 1), "column": F.expr(f"try_cast(substring(`{well}`, 2) AS int)")})
