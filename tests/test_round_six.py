"""Cases that the fourth round's findings brought up."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tesserae.operators import assay, pairs


def test_whole_values_on_the_limit_are_left_out(spark):
    """In a group of four equal values and another, that one lies exactly two deviations off the mean."""
    rows = [(50 * a + b, float(x)) for a in range(50) for b in range(50) if a != b for x in (a, a, a, a, b)]
    # halves aren't whole and keep the comparison of doubles; five values with two others leave out none
    rows += [(-1, x) for x in (0.5, 0.5, 1.5, 2.5, 2.5)] + [(-2, x) for x in (1.0, 2.0, 3.0, 4.0, 5.0, 30.0, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(16)
    found = {r["k"]: r["n_replicates"] for r in assay.replicates(df, "v", ["k"]).collect()}
    assert found.pop(-1) == 5 and found.pop(-2) == 5
    assert len(found) == 2450 and set(found.values()) == {4}


def test_pairs_of_few_cores_are_made_in_many_tasks(spark):
    """The pairs are those of all rows, and neither few rows nor one large core puts them into one task."""
    r = random.Random(1)
    rows = [(i, "c" if i % 10 else "d", r.choice("pqr"), float(r.randrange(40))) for i in range(1500)]
    rows += [(7, "c", "p", 1.0), (None, "c", "p", 1.0), (8, None, "p", 1.0), (9, "c", None, 1.0), (10, "c", "q", None)]
    df = spark.createDataFrame(rows, "id long, core string, part string, v double").coalesce(1)
    made = pairs.matched_pairs(df, "id", "core", "part", "v")
    whole = [x for x in rows if None not in x]
    want = Counter((c, i, j, f"{p}>>{q}", w - v) for i, c, p, v in whole for j, d, q, w in whole if c == d and p < q)
    assert Counter(map(tuple, made.collect())) == want
    shares = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) >= 4 and max(x["count"] for x in shares) < 0.5 * sum(want.values())
