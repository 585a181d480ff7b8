"""Selection: acquisition scores and greedy batches, diversity, Pareto portfolios, experiment designs.

Scores are column expressions. Loops that carry state from pick to pick do so over the bounded table of the best
``pool`` candidates by score, or take one aggregate over all rows per pick; no candidate list is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import DISTANCES, clip, normal_cdf, normal_pdf
from tesserae.operators.split import draw, stratum
from tesserae.runtime import written


def expected_improvement(mean: Column, std: Column, best: Column, xi: float = 0.01, minimize: bool = False) -> Column:
    gain = best - mean - xi if minimize else mean - best - xi
    z = gain / std
    return F.when(std <= 1e-9, F.lit(0.0)).otherwise(gain * normal_cdf(z) + std * normal_pdf(z))


def expected_improvement_gradient(mean: Column, std: Column, best: Column, mean_gradient: Column, std_gradient: Column, xi: float = 0.01, minimize: bool = False) -> Column:
    """The gradient of the expected improvement by the input, from those of mean and deviation; 0 where the deviation is."""
    gain = best - mean - xi if minimize else mean - best - xi
    z = gain / std
    by_mean, by_std = (-normal_cdf(z) if minimize else normal_cdf(z)), normal_pdf(z)
    return F.zip_with(mean_gradient, std_gradient, lambda m, s: F.when(std <= 1e-9, F.lit(0.0)).otherwise(by_mean * m + by_std * s))


def probability_improvement(mean: Column, std: Column, best: Column, xi: float = 0.01, minimize: bool = False) -> Column:
    gain = best - mean - xi if minimize else mean - best - xi
    return F.when(std <= 1e-9, (gain > 0).cast("double")).otherwise(normal_cdf(gain / std))


def confidence_bound(mean: Column, std: Column, kappa: float = 2.0, minimize: bool = False) -> Column:
    """Upper bound, or the negated lower one, so that more is better either way."""
    return -(mean - kappa * std) if minimize else mean + kappa * std


def thompson(mean: Column, std: Column, key: Column, seed: int = 0, minimize: bool = False) -> Column:
    """A normal draw by Box and Muller from two hashes of the key."""
    u, v = F.greatest(draw(key, 2 * seed + 1), F.lit(1e-12)), draw(key, 2 * seed + 2)
    x = mean + std * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return -x if minimize else x


def penalised(score: Column, probability: Column, threshold: float = 0.5, weight: float = 1.0) -> Column:
    """A score less the shortfall of a constraint's probability."""
    return score - weight * F.greatest(F.lit(0.0), threshold - probability)


ACQUISITIONS = {
    "expected_improvement": expected_improvement,
    "probability_improvement": probability_improvement,
    "upper_confidence_bound": lambda m, s, b, **k: confidence_bound(m, s, **k),
    "greedy": lambda m, s, b, minimize=False: -m if minimize else m,
    "uncertainty": lambda m, s, b, **k: s,
}


def kappa_at(step: int, steps: int, kappa: float) -> float:
    """Linear decay from kappa to half of it, always from the first value."""
    return kappa * (1 - 0.5 * min(max(step / max(steps, 1), 0.0), 1.0))


def batch_sequential(df: DataFrame, key: str, mean: str, std: str, best: float, size: int, **how) -> DataFrame:
    """Greedy batch: the highest expected improvement, then again with the best value raised to the picked mean.

    With nothing fitted in between a pick changes only ``best``, so each pick is one aggregate over the candidates.
    """
    picked: list[tuple] = []
    for n in range(size):
        rest = df.filter(~F.col(key).isin([p[0] for p in picked])) if picked else df
        score = expected_improvement(F.col(mean), F.col(std), F.lit(best), **how)
        row = rest.agg(F.max_by(F.struct(key, mean), F.struct(score, -F.col(key))).alias("x"), F.max(score).alias("s")).first()
        if row["x"] is None:
            break
        picked.append((row["x"][0], n + 1, float(row["s"])))
        best = min(best, row["x"][1]) if how.get("minimize") else max(best, row["x"][1])
    return df.sparkSession.createDataFrame(picked, "id long, pick int, score double")


def max_min(df: DataFrame, key: str, vector: str, size: int, metric: str = "euclidean", seed_key: int | None = None) -> DataFrame:
    """Farthest-point selection: (id, pick, distance). Each pick updates a running minimum where the rows lie and is one
    aggregate; ``size`` bounds the number of rounds."""
    first = df.agg(F.min(key)).first()[0] if seed_key is None else seed_key
    picked = [(first, 1, None)]
    chosen = [df.filter(F.col(key) == first).select(vector).first()[0]] if first is not None else []
    rows = df.select(key, vector)
    while len(picked) < size and first is not None:
        spread = [DISTANCES[metric](F.col(vector), F.array(*(F.lit(float(x)) for x in c))) for c in chosen[-1:]]
        rows = rows.withColumn("_d", F.least(F.col("_d"), spread[0]) if "_d" in rows.columns else spread[0])
        if len(chosen) % 8 == 0:
            rows = written(rows, "max-min")
        row = rows.filter(~F.col(key).isin([p[0] for p in picked])).agg(F.max_by(F.struct(key, vector, "_d"), F.struct("_d", -F.col(key))).alias("x")).first()["x"]
        if row is None:
            break
        picked.append((row[0], len(picked) + 1, float(row[2])))
        chosen.append(row[1])
    return df.sparkSession.createDataFrame(picked, "id long, pick int, distance double")


def sphere_exclusion(df: DataFrame, key: str, vector: str, radius: float, size: int, metric: str = "euclidean", seed: int = 0) -> DataFrame:
    """Rows in hash order, each dropping all within ``radius`` of it, until ``size`` are picked."""
    picked: list[tuple] = []
    rows = df.select(key, vector, draw(F.col(key), seed).alias("_u"))
    while len(picked) < size:
        row = rows.agg(F.min_by(F.struct(key, vector), F.struct("_u", key)).alias("x")).first()["x"]
        if row is None:
            break
        picked.append((row[0], len(picked) + 1))
        centre = F.array(*(F.lit(float(x)) for x in row[1]))
        rows = rows.filter((F.col(key) != row[0]) & (DISTANCES[metric](F.col(vector), centre) >= radius))
        if len(picked) % 8 == 0:
            rows = written(rows, "spheres")
    return df.sparkSession.createDataFrame(picked, "id long, pick int")


def best_of_groups(df: DataFrame, key: str, group: str, score: str, size: int) -> DataFrame:
    """The best member of each group, the best ``size`` of those: cluster or scaffold based diversity."""
    best = df.groupBy(group).agg(F.max_by(F.struct(key, score), F.struct(score, -F.col(key))).alias("x"))
    return best.select(group, f"x.{key}", f"x.{score}").orderBy(F.desc(score), key).limit(size)


def min_max_scaled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns scaled to [0, 1] (a constant one to 0); those to 'minimize' turned round."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(F.broadcast(stats), how="inner")
    for c, goal in columns.items():
        scaled = F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))
        out = out.withColumn(f"{c}_scaled", 1 - scaled if goal == "minimize" else scaled)
    return out.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def weighted(columns: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in columns.items()), F.lit(0.0))


def tchebycheff(columns: dict[str, float]) -> Column:
    return -F.greatest(*(F.lit(w) * -F.col(c) for c, w in columns.items()))


def pareto_front(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows that no other matches or exceeds in both columns and exceeds in one (more is better in both).

    A row is dominated exactly if some row with a greater x has a y at least as high, or one with the same x a higher y;
    that is a running maximum over x, worked out per range of x, and no row meets every other.
    """
    from tesserae.operators.ordered import PARTS

    seen = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    each = written(seen.groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_top")), "front")
    cuts = each.agg(F.percentile_approx("_x", F.array(*(F.lit(i / PARTS) for i in range(1, PARTS))), 1000).alias("_cuts"))
    parted = each.join(F.broadcast(cuts), how="inner").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    tops = parted.groupBy(F.col("_part").alias("_p")).agg(F.max("_top").alias("_m"))
    above = tops.select("_p", F.max("_m").over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_over"))
    inner = Window.partitionBy("_part").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    front = parted.join(F.broadcast(above), F.col("_part") == F.col("_p")).withColumn("_best", F.greatest("_over", F.max("_top").over(inner)))
    front = front.filter(F.col("_best").isNull() | (F.col("_top") > F.col("_best"))).select("_x", "_top")
    return seen.join(front, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_top"))).drop("_x", "_top")


def within_budget(df: DataFrame, key: str, score: str, cost: str, budget: float, pool: int = 10_000) -> DataFrame:
    """Greedy picks by falling score that still fit the budget, folded ``pool`` candidates at a time.

    What fits depends on all earlier picks, so each ordered pool is folded in one expression over one bounded array. Then
    the candidates behind it that can still fit form the next pool, until none is left.
    """
    rest = df.filter(F.col(cost).isNotNull() & F.col(score).isNotNull())
    # what negative costs could ever give back
    back = rest.agg(F.sum(F.least(F.col(cost).cast("double"), F.lit(0.0)))).first()[0] or 0.0
    spent, ids = 0.0, []
    while True:
        top = rest.filter(F.col(cost) <= budget - spent - back + 1e-9 * abs(budget)).orderBy(F.desc(score), key).limit(pool)
        row = top.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(cost).cast("double").alias("c")))).alias("_l"))
        start = F.struct(F.lit(spent).alias("spent"), F.array().cast("array<bigint>").alias("ids"))
        fold = F.aggregate("_l", start, lambda t, x: F.when(t["spent"] + x["c"] <= budget, F.struct((t["spent"] + x["c"]).alias("spent"), F.concat(t["ids"], F.array(x["k"].cast("bigint"))).alias("ids"))).otherwise(t))
        done = row.select(fold.alias("_f"), F.size("_l").alias("n"), F.try_element_at("_l", F.lit(-1)).alias("last")).first()
        spent, ids = done["_f"]["spent"], ids + done["_f"]["ids"]
        if done["n"] < pool:
            break
        s, k = -done["last"]["s"], done["last"]["k"]
        rest = rest.filter((F.col(score) < F.lit(s)) | ((F.col(score) == F.lit(s)) & (F.col(key) > F.lit(k))))
    picked = df.sparkSession.createDataFrame(list(enumerate(ids)), "_i int, _k bigint")
    return df.join(F.broadcast(picked), F.col(key) == F.col("_k")).withColumn("pick", (F.col("_i") + 1).cast("long")).drop("_i", "_k")


def latin_hypercube(df: DataFrame, key: str, columns: list[str], size: int, seed: int = 0) -> DataFrame:
    """Each of ``size`` slices of every column holds one design point; the candidate nearest to each point is picked.

    The points (``size`` of them) go to the candidates, which reduce to the least distance per point and then to the least key at
    that distance: a number per point and task, where a struct of both would have all rows sorted by point first. Where one
    candidate is nearest to several points, fewer than ``size`` rows come back.
    """
    import random

    r = random.Random(seed)
    grids = [[(i + r.random()) / size for i in r.sample(range(size), size)] for _ in columns]
    points = df.sparkSession.createDataFrame([(i, *(g[i] for g in grids)) for i in range(size)], "point int, " + ", ".join(f"_p{i} double" for i in range(len(columns))))
    scaled = min_max_scaled(df, {c: "maximize" for c in columns})
    far = sum(((F.col(f"{c}_scaled") - F.col(f"_p{i}")) ** 2 for i, c in enumerate(columns)), F.lit(0.0))
    met = scaled.join(F.broadcast(points), how="inner")
    met = met.filter(F.col(key).isNotNull()).select("point", key, far.alias("_far"))
    least = met.groupBy("point").agg(F.min("_far").alias("_least")).withColumnRenamed("point", "_at")
    near = met.join(F.broadcast(least), (F.col("point") == F.col("_at")) & F.col("_far").eqNullSafe(F.col("_least")))  # a row per point
    return near.groupBy("point").agg(F.min(key).alias(key)).select(key).distinct()


def random_pick(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows in hash order."""
    return df.orderBy(draw(F.col(key), seed), key).limit(size)


def stratified_pick(df: DataFrame, key: str, value: str, size: int, strata: int = 5, seed: int = 0) -> DataFrame:
    """Equal numbers from equally filled ranges of a value, the first ones one more; in hash order within a range."""
    rows = stratum(df.filter(F.col(value).isNotNull()), value, strata).withColumn("_u", draw(F.col(key), seed))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("_u", key))
    take = F.lit(size // strata) + (F.col("stratum") < size % strata).cast("int")
    return rows.withColumn("_r", rank).filter(F.col("_r") <= take).drop("_r", "_u")


def information_gain(std: Column, noise: float = 0.01) -> Column:
    return 0.5 * F.log1p(std * std / noise)


def local_penalty(mean: Column, picked_mean: Column, picked_std: Column, slope: float) -> Column:
    """How much a candidate keeps of its score beside a pick."""
    return clip(F.abs(mean - picked_mean) / (picked_std * slope), 0.0, 1.0)
