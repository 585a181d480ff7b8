"""Curation: validation, staged filters with counts, keep-first deduplication, imputation, rules over properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.quantiles import with_quantiles


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; null keys are one group. An aggregate, so copies combine before they shuffle."""
    cols = df.columns
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in cols)), F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(first.alias("_row")).select("_row.*")


def largest_part(text: Column, mark: str = ".") -> Column:
    """The longest part between marks, the first of equals: the main fragment of a mixture."""
    parts = F.split(text, f"\\{mark}")
    best = F.aggregate(parts, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(text.isNotNull(), best)


def staged(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``failed_stage``: the first stage whose condition a row doesn't meet, null if it passes all."""
    out = F.lit(None).cast("string")
    for name, passes in reversed(stages):
        out = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(out)
    return df.withColumn("failed_stage", out)


def stage_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows in, removed and left after each stage, and the share of the first count that is left: one scan."""
    flagged = staged(df, stages).groupBy("failed_stage").agg(F.count(F.lit(1)).alias("_n"))
    order = F.create_map(*(F.lit(x) for i, (name, _) in enumerate(stages) for x in (name, i + 1)))
    # a row per stage: bounded by the number of stages
    counts = flagged.agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("failed_stage", F.lit("")), "_n"))).alias("_by"))
    rows = counts.select("_all", "_by", F.explode(F.array(*(F.lit(n) for n, _ in stages))).alias("stage"))
    rows = rows.select("stage", F.element_at(order, F.col("stage")).alias("stage_no"), "_all", F.coalesce(F.try_element_at("_by", F.col("stage")), F.lit(0)).alias("removed"), "_by")
    names = [n for n, _ in stages]
    gone = F.lit(0).cast("long")
    for i, name in enumerate(names):
        gone = gone + F.when(F.col("stage_no") >= i + 1, F.coalesce(F.try_element_at("_by", F.lit(name)), F.lit(0))).otherwise(0)
    rows = rows.withColumn("rows_left", F.col("_all") - gone)
    return rows.select("stage", F.col("stage_no").cast("long").alias("stage_no"), F.col("removed").cast("long").alias("removed"), F.col("rows_left").cast("long").alias("rows_left"), F.try_divide(100.0 * F.col("rows_left"), F.col("_all")).alias("retention_rate"))


def violations(rules: dict[str, Column]) -> Column:
    """How many conditions hold; null conditions don't."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in rules.values()), F.lit(0))


def rule_of_five(mw: Column, logp: Column, hbd: Column, hba: Column) -> tuple[Column, Column]:
    """(passes, violations): at most one of MW > 500, logP > 5, HBD > 5, HBA > 10; without values (false, 5)."""
    n = violations({"mw": mw > 500, "logp": logp > 5, "hbd": hbd > 5, "hba": hba > 10})
    missing = mw.isNull() & logp.isNull() & hbd.isNull() & hba.isNull()
    return F.when(missing, False).otherwise(n <= 1), F.when(missing, 5).otherwise(n)


def rule_of_three(mw: Column, logp: Column, hbd: Column, hba: Column, rotatable: Column, tpsa: Column) -> tuple[Column, Column]:
    """(passes, violations): none of MW > 300, logP, HBD, HBA, rotatable bonds > 3, TPSA > 60; without values (false, 4)."""
    n = violations({"mw": mw > 300, "logp": logp > 3, "hbd": hbd > 3, "hba": hba > 3, "rot": rotatable > 3, "tpsa": tpsa > 60})
    missing = mw.isNull() & logp.isNull() & hbd.isNull() & hba.isNull()
    return F.when(missing, False).otherwise(n == 0), F.when(missing, 4).otherwise(n)


def within(ranges: dict[str, tuple[float, float]]) -> Column:
    """True if every named column lies in its inclusive range."""
    out = F.lit(True)
    for name, (low, high) in ranges.items():
        out = out & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return out


def matched_rules(text: Column, rules: dict[str, str]) -> Column:
    """Names of the patterns found in a text, in the order of ``rules``."""
    hits = F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()))
    return F.array_compact(hits)


def impute(df: DataFrame, how: dict[str, str]) -> DataFrame:
    """Fill nulls by column: 'mean', 'median', 'mode' (the least of the commonest) or 'zero'; 'drop' removes rows."""
    df = df.dropna(subset=[c for c, h in how.items() if h == "drop"] or None) if "drop" in how.values() else df
    made = {"mean": F.avg, "mode": lambda c: F.mode(c, deterministic=True)}
    stats = [made[h](c).alias(f"_f_{c}") for c, h in how.items() if h in made]
    if stats:
        df = df.join(F.broadcast(df.agg(*stats)), how="inner")
    for c in (c for c, h in how.items() if h == "median"):
        df = with_quantiles(df, c, [], **{f"_f_{c}": 0.5})
    filled = {c: F.coalesce(F.col(c), F.lit(0) if h == "zero" else F.col(f"_f_{c}")) for c, h in how.items() if h != "drop"}
    return df.withColumns(filled).drop(*(f"_f_{c}" for c in how))


def statistics(df: DataFrame, valid: Column, key: Column, columns: list[str]) -> DataFrame:
    """Counts of rows, valid, invalid and duplicate rows, and mean and population deviation of columns over valid rows."""
    ok = F.coalesce(valid, F.lit(False))
    made = [f(F.when(ok, F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_rows"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"), (F.count_if(ok & key.isNotNull()) - F.count_distinct(F.when(ok, key))).alias("n_duplicates"), *made)


def z_scale(df: DataFrame, columns: list[str], fitted_on: Column | None = None) -> DataFrame:
    """Columns scaled by mean and population deviation of the rows that ``fitted_on`` holds for; nulls stay."""
    on = F.lit(True) if fitted_on is None else fitted_on
    stats = df.agg(*(f(F.when(on, F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(stats), how="inner")
    out = out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns})
    return out.drop(*(f"_{n}_{c}" for c in columns for n in "ms"))


def clean(df: DataFrame, valid: Column, key: Column, order: list[str]) -> DataFrame:
    """Valid rows, the first of each key."""
    kept = df.filter(F.coalesce(valid, F.lit(False))).withColumn("_key", key)
    return keep_first(kept, ["_key"], order).drop("_key")
