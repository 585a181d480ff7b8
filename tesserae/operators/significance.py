"""Significance of differences: paired t, Wilcoxon, McNemar, permutation and bootstrap, corrections for many tests.

Distribution functions of single numbers are worked out in Python; everything over rows is an aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import normal_cdf, ratio
from tesserae.operators.ordered import average_ranks
from tesserae.operators.split import draw


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    c, d, out, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1.0, 1e-300
    d = 1 / (d or tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out / a


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference, t, two-sided p and Cohen's d of paired columns."""
    d = F.col(a) - F.col(b)
    stats = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_s"), F.stddev_pop(d).alias("_sp"))
    t = ratio(F.col("mean_difference") * F.sqrt("n"), F.col("_s"))
    p = F.udf(lambda t, n: None if t is None or n < 2 else t_two_sided(t, n - 1), "double")  # one row
    return stats.select("n", "mean_difference", t.alias("t"), p(t, F.col("n")).alias("p_value"), (F.col("mean_difference") / (F.col("_sp") + 1e-10)).alias("cohens_d"))


def cohens_d(a: Column, b: Column) -> Column:
    """Difference of means over the root of the mean population variance."""
    return (F.avg(a) - F.avg(b)) / (F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2) + 1e-10)


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank statistic and its normal approximation; zero differences are left out, ties share mean ranks."""
    d = df.select((F.col(a) - F.col(b)).alias("_d")).filter("_d <> 0").withColumn("_abs", F.abs("_d"))
    ranked = average_ranks(d, "_abs", "_r")
    sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("_d") < 0, F.col("_r"))), F.lit(0.0)).alias("w_minus"))
    n, w = F.col("n").cast("double"), F.least("w_plus", "w_minus")  # n cubed leaves the longs beyond 1.6 million rows
    z = ratio(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return sums.select("n", w.alias("statistic"), z.alias("z"), F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(z))).alias("p_value"))


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Discordant counts, the corrected statistic and p of two classifiers; p is 1 without discordance."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    n = df.agg(F.count_if(ra & ~rb).alias("n10"), F.count_if(~ra & rb).alias("n01"))
    gap = F.abs(F.col("n01") - F.col("n10")) - 1
    stat = F.coalesce(ratio((gap * gap).cast("double"), F.col("n01") + F.col("n10")), F.lit(0.0))
    # chi-squared with one degree of freedom is a squared normal
    p = F.when(F.col("n01") + F.col("n10") == 0, 1.0).otherwise(2 * normal_cdf(-F.sqrt(stat)))
    return n.select("n10", "n01", stat.alias("statistic"), p.alias("p_value"))


def _repeats(df: DataFrame, times: int) -> DataFrame:
    """``df`` once per repeat; aggregated by repeat at once, so what is shuffled is a row per task and repeat."""
    return df.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(times))))


def permutation(df: DataFrame, key: str, a: str, b: str, times: int = 1000, seed: int = 0) -> DataFrame:
    """Sign-flip test of a mean paired difference: flips drawn by a hash of (repeat, key)."""
    d = F.col(a) - F.col(b)
    flip = F.when(F.xxhash64(F.lit(seed), "_rep", key) % 2 == 0, 1.0).otherwise(-1.0)
    seen = df.filter(d.isNotNull()).select(key, d.alias("_d"))
    means = _repeats(seen, times).groupBy("_rep").agg(F.avg(F.col("_d") * flip).alias("_m"))
    observed = seen.agg(F.avg("_d").alias("observed"))
    return means.join(F.broadcast(observed), how="inner").groupBy("observed").agg(F.avg((F.abs("_m") >= F.abs("observed")).cast("double")).alias("p_value"))


def _drawn(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``_w``, how often a row is drawn in repeat _rep: Poisson(1) by a hash, which is taken once a row and repeat."""
    bounds, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        bounds.append(math.ceil(total * (1 << 30)))
        term /= k + 1
    u = F.col("_u")
    times = F.when(u < bounds[0], 0)
    for k, bound in enumerate(bounds[1:], 1):
        times = times.when(u < bound, k)
    hashed = df.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "_rep", key), F.lit(1 << 30)))
    return hashed.withColumn("_w", times.otherwise(len(bounds))).drop("_u")


def bootstrap_comparison(df: DataFrame, key: str, y: str, a: str, b: str, metric: str = "mse", times: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Two predictions by their 'mse', 'rmse' or 'mae' in the same bootstrap draws: means of both and of their difference, its
    percentile interval, the share of draws with the lesser error for a, and whether the interval leaves out 0."""
    error = {"mse": lambda p: (F.col(y) - p) * (F.col(y) - p), "rmse": lambda p: (F.col(y) - p) * (F.col(y) - p), "mae": lambda p: F.abs(F.col(y) - p)}[metric]
    end = F.sqrt if metric == "rmse" else lambda x: x
    rows = df.filter(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, error(F.col(a)).alias("_a"), error(F.col(b)).alias("_b"))
    # no filter on the draw, which would be pushed below it and draw twice
    sums = [F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col(c))).alias(c) for c in ("_a", "_b")]
    each = _drawn(_repeats(rows, times), key, seed).groupBy("_rep").agg(*sums, F.sum("_w").alias("_n")).filter("_n > 0")
    each = each.select(*(end(F.col(c) / F.col("_n")).alias(c) for c in ("_a", "_b"))).withColumn("_d", F.col("_a") - F.col("_b"))
    tail = (1 - level) / 2
    found = each.agg(  # a row per repeat
        F.avg("_a").alias("metric_a"), F.avg("_b").alias("metric_b"), F.avg("_d").alias("difference"), F.percentile("_d", tail).alias("low"),
        F.percentile("_d", 1 - tail).alias("high"), F.avg((F.col("_d") < 0).cast("double")).alias("share_a_better"),
    )
    return found.withColumn("significant", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


def bootstrap(df: DataFrame, key: str, value: str, times: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of a mean by the Poisson bootstrap: each row's count in a repeat is a hash-drawn Poisson(1)."""
    drawn = _drawn(_repeats(df.filter(F.col(value).isNotNull()).select(key, value), times), key, seed)
    means = drawn.groupBy("_rep").agg(ratio(F.sum(F.col("_w") * F.col(value)), F.sum("_w").cast("double")).alias("_m"))
    tail = (1 - level) / 2
    return means.agg(F.avg("_m").alias("mean"), F.percentile("_m", tail).alias("low"), F.percentile("_m", 1 - tail).alias("high"))


def corrected(df: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg decisions for a table of tests (a row per test, so one window holds it)."""
    order = Window.orderBy(p, key)
    all_ = Window.partitionBy()
    m, i = F.count(F.lit(1)).over(all_), F.row_number().over(order)
    ranked = df.filter(F.col(p).isNotNull()).withColumns({"_m": m, "_i": i})
    passes = F.col(p) < alpha / (F.col("_m") - F.col("_i") + 1)
    ranked = ranked.withColumn("_ok", passes.cast("int"))
    holm = F.min("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    cut = F.max(F.when(F.col(p) <= F.col("_i") / F.col("_m") * alpha, F.col("_i"))).over(all_)
    return ranked.withColumns({"bonferroni": F.col(p) < alpha / F.col("_m"), "holm": holm, "benjamini_hochberg": F.coalesce(F.col("_i") <= cut, F.lit(False))}).drop("_m", "_i", "_ok")


def importance(df: DataFrame, key: str, features: list[str], weights: dict[str, float], intercept: float, y: str, seed: int = 0) -> DataFrame:
    """Permutation importance of a linear score: how much its squared error grows when one feature is shuffled.

    A feature is shuffled by swapping each row's value for that of the row at the same place in a hash order; both orders
    are joined by rank.
    """
    from functools import reduce

    base = sum((F.col(f) * weights[f] for f in features), F.lit(intercept))
    seen = df.select(key, y, *features)
    rows = []
    for k, f in enumerate(features):
        a = seen.withColumn("_r", F.row_number().over(Window.orderBy(F.col(key))))
        b = seen.select(F.col(f).alias("_x"), F.row_number().over(Window.orderBy(draw(F.col(key), seed + k), F.col(key))).alias("_r"))
        moved = base + (F.col("_x") - F.col(f)) * weights[f]
        rows.append(a.join(b, "_r").agg(F.lit(f).alias("feature"), (F.avg((F.col(y) - moved) * (F.col(y) - moved)) - F.avg((F.col(y) - base) * (F.col(y) - base))).alias("importance")))
    return reduce(DataFrame.unionByName, rows)
