"""Exact quantiles of all groups at once, by counting in ever narrower ranges; no group is gathered in one task.

For each wanted place in a group's order a small table holds the range that place lies in. A pass cuts all ranges into
BUCKETS parts, counts what falls in each with a partial sum where the rows lie, and keeps the part that holds the place,
between the least and greatest value found there. A range is done when it holds one value or at most GATHER rows; only those
rows are then put in order. A pass that leaves more than a quarter of its rows is followed by one over the logarithm of
values, so that a few huge values cost passes and not correctness.

Null and NaN values are left out; infinities are values. A group without values gives nulls in ``with_quantiles`` and no row in
``quantiles``; null keys are a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import written

Share = float | Callable[[Column], Column]
#: Parts that a pass cuts a range into; rows of a range that are put in order.
BUCKETS, GATHER = 256, 4096
#: The least size that the logarithmic pass tells from 0.
TINY = 1e-300


def _bucket(v: Column, lo: Column, hi: Column, by_size: Column) -> Column:
    """The part of its range that a value falls in: monotone in the value; infinities have parts of their own."""
    size = lambda x: F.signum(x) * (F.log(F.greatest(F.abs(x), F.lit(TINY))) - F.log(F.lit(TINY)))
    at = lambda f: F.try_divide(f(v) - f(lo), f(hi) - f(lo))
    share = F.when(by_size, at(size)).otherwise(at(lambda x: x / 2))
    part = F.least(F.lit(BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS))
    return F.when(v == float("-inf"), F.lit(-1)).when(v == float("inf"), F.lit(BUCKETS)).otherwise(part).cast("int")


def located(rows: DataFrame, wanted: DataFrame, gather: int = GATHER) -> DataFrame:
    """(_g, _j, _v, _below, _at, _n): the value at each wanted place.

    ``rows`` are (_g, _v, _w): group, finite or infinite double, weight. ``wanted`` are (_g, _j, _t): place _j of the group is
    the least value with more than _t of the weight at or below it. _below is the weight of smaller values, _at that of the
    value, _n its rows. ``rows`` is read once a pass, so it should be a table. A place behind the whole weight has no row.
    """
    state = wanted.join(_spans(rows), "_g").filter(F.col("_t") < F.col("_mass"))
    return _narrowed(rows, written(_begun(state), "places"), gather)


def _spans(rows: DataFrame) -> DataFrame:
    """(_g, _lo, _hi, _n, _mass): least and greatest finite value, number and weight of each group."""
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    return rows.groupBy("_g").agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_mass"))


def _begun(wanted: DataFrame) -> DataFrame:
    """Places that may lie anywhere in their group."""
    return wanted.select("_g", "_j", "_t", "_lo", "_hi", "_n", (F.col("_t") - F.col("_t")).alias("_below"), F.lit(False).alias("_by_size"), F.lit(True).alias("_first"))


def _narrowed(rows: DataFrame, state: DataFrame, gather: int) -> DataFrame:
    inside = F.col("_first") | F.col("_v").between(F.col("_lo"), F.col("_hi"))
    closed = []
    while True:
        is_open = (F.col("_n") > gather) & (F.col("_first") | (F.col("_lo") < F.col("_hi")))
        closed.append(state.filter(~is_open))
        still = state.filter(is_open)
        if still.isEmpty():
            break
        met = rows.join(still, "_g").filter(inside)
        parts = met.withColumn("_b", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("_by_size"))).groupBy("_g", "_j", "_t", "_below", "_by_size", F.col("_n").alias("_n0"), "_b")
        counted = parts.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"))
        upto = Window.partitionBy("_g", "_j").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most BUCKETS + 2 rows
        summed = counted.withColumn("_upto", F.sum("_w").over(upto))
        before = F.col("_upto") - F.col("_w")
        kept = summed.filter((before <= F.col("_t")) & (F.col("_t") < F.col("_upto")))
        state = written(
            kept.select("_g", "_j", (F.col("_t") - before).alias("_t"), "_lo", "_hi", "_n", (F.col("_below") + before).alias("_below"), (~F.col("_by_size") & (F.col("_n") * 4 > F.col("_n0"))).alias("_by_size"), F.lit(False).alias("_first")), "places"
        )
    ends = reduce(DataFrame.unionByName, closed)
    each = rows.join(ends, "_g").filter(inside).groupBy("_g", "_j", "_t", "_below", "_v").agg(F.sum("_w").alias("_at"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_g", "_j").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``gather`` rows, or one
    ordered = each.withColumn("_upto", F.sum("_at").over(upto))
    before = F.col("_upto") - F.col("_at")
    return ordered.filter((before <= F.col("_t")) & (F.col("_t") < F.col("_upto"))).select("_g", "_j", "_v", (F.col("_below") + before).alias("_below"), "_at", "_n")


def _group(by: list[str]) -> Column:
    """The key of a group as one column in which nulls are equal."""
    return F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("all"))


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, Share], gather: int = GATHER) -> DataFrame:
    """(_g, a column for each share): quantiles by linear interpolation between the two values beside a share's place.

    A share is a number, or a function of the group's number of values.
    """
    v = F.col(value).cast("double")
    rows = written(df.filter(v.isNotNull() & ~F.isnan(v)).select(_group(by).alias("_g"), v.alias("_v"), F.lit(1).cast("long").alias("_w")), "values")
    return of_rows(rows, shares, gather)


def of_rows(rows: DataFrame, shares: dict[str, Share], gather: int = GATHER) -> DataFrame:
    """``quantiles`` of rows (_g, _v, _w = 1). They are made anew in each pass, so rows that are cheap to make and too many to keep
    needn't be a table: while the table of places is small they are counted where they are made and not shuffled."""
    spans = written(_spans(rows), "spans")
    places = []
    for i, share in enumerate(shares.values()):
        place = _place(share, F.col("_n"))
        low = F.floor(place).cast("long")
        places.append(F.struct(F.lit(2 * i).alias("_j"), low.alias("_t")))
        places.append(F.struct(F.lit(2 * i + 1).alias("_j"), F.when(place > low, low + 1).alias("_t")))
    wanted = spans.select("*", F.explode(F.array(*places)).alias("_p")).select("_g", "_lo", "_hi", "_n", "_p.*").filter(F.col("_t").isNotNull())
    found = _narrowed(rows, written(_begun(wanted), "places"), gather)
    pick = lambda j, c: F.max(F.when(F.col("_j") == j, F.col(c)))
    made = []
    for i, (name, share) in enumerate(shares.items()):
        low, high, part = F.col(f"_l{i}"), F.col(f"_h{i}"), _place(share, F.col("_size")) - F.floor(_place(share, F.col("_size")))
        made.append(F.when(high.isNull() | (high == low), low).otherwise(low * (1 - part) + high * part).alias(name))
    ends = [pick(2 * i + side, "_v").alias(f"_{'lh'[side]}{i}") for i in range(len(shares)) for side in (0, 1)]
    sizes = spans.select(F.col("_g").alias("_of"), F.col("_n").alias("_size"))
    return found.groupBy("_g").agg(*ends).join(sizes, F.col("_g") == F.col("_of")).select("_g", *made)


def _place(share: Share, n: Column) -> Column:
    """Where a share's place lies in a group of n values, from 0."""
    return (n - 1) * (share(n) if callable(share) else F.lit(float(share)))


def with_quantiles(df: DataFrame, value: str, by: list[str], **shares: Share) -> DataFrame:
    """``df`` with quantiles of a column in each row's group."""
    return joined_quantiles(df, quantiles(df, value, by, shares), by)


def joined_quantiles(df: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the quantiles of each row's group; null where a group has no values."""
    if not by:
        return df.join(F.broadcast(found.drop("_g")), F.lit(True), "left")  # one row
    named = found.withColumnRenamed("_g", "_quantile_group")
    return df.join(named, _group(by) == F.col("_quantile_group"), "left").drop("_quantile_group")
