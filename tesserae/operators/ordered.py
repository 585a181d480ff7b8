"""Running sums and ranks over a whole table without putting it in one task.

Rows are first summed by value, so ties are one row; values are cut into ranges at approximate quantiles; a window runs
inside each range, and the totals of the ranges before it (at most PARTS rows) are added. The ranges only say which task
does what: results don't depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import written

PARTS = 128


def running(df: DataFrame, value: str, sums: list[str], descending: bool = False) -> DataFrame:
    """A row per distinct ``value``: each of ``sums`` summed (same name), and ``before_<name>``, its sum over values before.

    Null values are left out.
    """
    each = written(df.filter(F.col(value).isNotNull()).groupBy(value).agg(*(F.sum(s).alias(s) for s in sums)), "by-value")
    cuts = each.agg(F.percentile_approx(value, F.array(*(F.lit(i / PARTS) for i in range(1, PARTS))), 1000).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    parted = each.join(F.broadcast(cuts), how="inner").withColumn("_part", F.coalesce(part, F.lit(0))).drop("_cuts")
    totals = parted.groupBy("_part").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    over = Window.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *(F.coalesce(F.sum(f"_t_{s}").over(over), F.lit(0)).alias(f"_o_{s}") for s in sums))
    inner = Window.partitionBy("_part").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return out.withColumns({f"before_{s}": F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums}).drop("_part", "_p", *(f"_o_{s}" for s in sums))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the 1-based rank of a column, ties at their mean."""
    counted = running(df.withColumn("_one", F.lit(1).cast("long")), value, ["_one"])
    ranks = counted.select(F.col(value).alias("_v"), (F.col("before__one") + (F.col("_one") + 1) / 2).alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")
