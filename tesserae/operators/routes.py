"""Supplier catalogues and synthesis routes: search, availability, prices, sub-scores and the ranked overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import clip, ratio, steps

#: The weights of the overall score and the steps of its sub-scores.
WEIGHTS = {"step_score": 0.25, "convergence_score": 0.15, "availability_score": 0.30, "sa_score": 0.25, "cost_score": 0.05}
STEP_LADDER = [(2, 1.0), (4, 0.8), (6, 0.6), (8, 0.4), (10, 0.2)]
COST_LADDER = [(100, 1.0), (500, 0.8), (1000, 0.6), (5000, 0.4), (10000, 0.2)]
MAKEABLE = [(0.8, "excellent"), (0.6, "good"), (0.4, "moderate"), (0.2, "challenging")]


def search(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]], equal: dict[str, str] | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows inside inclusive ranges (an end may be open) and equal to values; the first ``limit`` by ``order``."""
    for c, (low, high) in ranges.items():
        df = df.filter(F.col(c) >= low) if low is not None else df
        df = df.filter(F.col(c) <= high) if high is not None else df
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    df = df.orderBy(order) if order else df
    return df.limit(limit) if limit is not None else df


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key by ``version``; of equals the new one. An aggregate, so copies combine before they shuffle."""
    cols = table.columns
    both = table.select(*cols, F.lit(0).alias("_new")).unionByName(rows.select(*cols, F.lit(1).alias("_new")))
    return both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(F.struct(*cols), F.struct(version, "_new")).alias("_row")).select("_row.*")


def suppliers(offers: DataFrame, item: str, supplier: str, price: str, lead: str | None = None) -> DataFrame:
    """Per item: offers, suppliers, the best price and who has it, and the shortest lead time."""
    made = [F.count(F.lit(1)).alias("n_offers"), F.count_distinct(supplier).alias("n_suppliers"), F.min(price).alias("best_price"), F.min_by(supplier, F.struct(price, supplier)).alias("best_supplier")]
    return offers.groupBy(item).agg(*made, *([F.min(lead).alias("fastest")] if lead else []))


def cascade(items: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """For each item the first source (in order) that has it, and that source's value; 'not_found' if none has."""
    out, value, name = items, F.lit(None).cast("double"), F.lit("not_found")
    for i, (n, s) in reversed(list(enumerate(sources.items()))):
        out = out.join(s.select(F.col(key).alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        name = F.when(F.col(f"_k{i}").isNotNull(), n).otherwise(name)
        value = F.when(F.col(f"_k{i}").isNotNull(), F.col(f"_v{i}")).otherwise(value)
    return out.withColumns({"source": name, "value": value}).drop(*(f"_{x}{i}" for i in range(len(sources)) for x in "kv"))


def convergence(n_steps: Column, n_joins: Column) -> Column:
    """Steps with more than one reactant over the steps but one; 0 for one step."""
    return F.when(n_steps <= 1, F.lit(0.0)).otherwise(n_joins.cast("double") / (n_steps - 1))


def sub_scores(n_steps: Column, n_joins: Column, available: Column, sa: Column, cost: Column) -> dict[str, Column]:
    """The five sub-scores of a route, by name."""
    share = F.coalesce(available, F.lit(0.0))
    return {
        "step_score": steps(n_steps, STEP_LADDER, 0.0),
        "convergence_score": F.when(n_steps <= 1, F.lit(1.0)).otherwise(0.6 + 0.4 * convergence(n_steps, n_joins)),
        "availability_score": F.when(share >= 1, 1.0).when(share >= 0.8, 0.8).when(share >= 0.6, 0.6).when(share >= 0.4, 0.4).when(share > 0, 0.2).otherwise(0.0),
        "sa_score": clip(1 - (sa - 1) / 9, 0.0, 1.0),
        "cost_score": steps(cost, COST_LADDER, 0.0),
    }


def overall(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the sub-score columns; weights that don't sum to 1 are scaled."""
    w = weights or WEIGHTS
    total = sum(w.values())
    scale = 1.0 if abs(total - 1) <= 0.01 else 1.0 / total
    return sum((F.col(c) * (x * scale) for c, x in w.items()), F.lit(0.0))


def label(score: Column, ladder=MAKEABLE, lowest: str = "impractical") -> Column:
    out = F.lit(lowest)
    for bound, name in sorted(ladder):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def sa_complexity(n_atoms: Column, n_rings: Column, n_macro: Column, n_bridge: Column, n_spiro: Column, n_stereo: Column, n_kinds: Column) -> Column:
    """Complexity part of the synthetic accessibility score from counts of a structure."""
    size = F.when(n_atoms > 45, (n_atoms - 45) * 0.1).otherwise(0.0)
    return size + 0.5 * F.log(n_rings + 1.0) + F.when(n_macro > 0, 0.5).otherwise(0.0) + 0.3 * n_bridge + 0.3 * n_spiro + F.when(n_stereo > 2, 0.2 * (n_stereo - 2)).otherwise(0.0) + F.when(n_kinds > 5, 0.1 * (n_kinds - 5)).otherwise(0.0)


def sa_score(complexity: Column, fragments: Column | None = None) -> Column:
    return clip(5 + (fragments if fragments is not None else F.lit(0.0)) + complexity, 1.0, 10.0)


def recommendations(df: DataFrame) -> DataFrame:
    """``df`` with ``advice``: texts of the rules that its sub-scores break, or that the route is sound."""
    rules = [("step_score", 0.5, "shorten the route"), ("convergence_score", 0.7, "look for a convergent route"), ("availability_score", 0.5, "find other building blocks"), ("sa_score", 0.5, "simplify the target"), ("cost_score", 0.4, "find cheaper suppliers")]
    found = F.array_compact(F.array(*(F.when(F.col(c) < x, F.lit(t)) for c, x, t in rules)))
    return df.withColumn("advice", F.when(F.size(found) == 0, F.array(F.lit("the route is sound"))).otherwise(found))


def price_share(price: Column, total: Column) -> Column:
    return ratio(price, total)
