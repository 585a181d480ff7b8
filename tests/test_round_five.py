"""Cases that larger tables brought up in round three's second reading."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import blocks, concordance, dose, select, significance, synthesis, ward
from tests.test_networks import dendrogram


def test_ward_of_copies_and_alike_distances_takes_few_rounds(spark, monkeypatch):
    """Copies don't take a round each, partners are found in blocks, and the dendrogram is that of one pair at a time."""
    monkeypatch.setattr(blocks, "LEAST", 30)
    monkeypatch.setattr(blocks, "GROUPS", 3)
    rounds = []
    monkeypatch.setattr(ward, "written", lambda df, name, f=ward.written: (name == "pairs" and rounds.append(1), f(df, name))[1])
    x = np.random.default_rng(8).normal(size=(50, 12)).round(3)
    x[7] = np.round(x[7] * 8) / 8  # so that means of copies are the copies
    x[30:] = x[7]
    points = {i: list(map(float, v)) for i, v in enumerate(x)}
    found = ward.merges(spark.createDataFrame(list(points.items()), "id long, v array<double>").repartition(3), "id", "v", finish=12)
    assert sorted((r["a"], r["b"], round(r["cost"], 9), r["size"]) for r in found.collect()) == sorted(dendrogram(points))
    assert 0 < len(rounds) < 12


def _plan(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_dose_points_are_summed_by_dose_before_the_fit(spark):
    r = np.random.default_rng(1)
    x = r.choice([0.1, 1.0, 3.0, 10.0, 100.0], 900)
    y = dose.curve(x, np.array([5.0, 90.0, 4.0, -1.5])) + r.normal(size=900)
    df = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("d", 1.0, 2.0)] * 3, "c string, x double, y double").repartition(4)
    fits = dose.fit(df, "c", "x", "y")
    assert _plan(fits, "optimizedPlan").count("Aggregate [") == 1
    got = {r["c"]: r for r in fits.collect()}
    want = dose.fitted(x, y)
    assert all(got["c"][k] == pytest.approx(v, rel=1e-4) for k, v in want.items()) and got["c"]["n"] == 900
    assert got["d"]["ic50"] is None and got["d"]["n"] == 3


def test_hypercube_sorts_no_candidates(spark):
    x = np.random.default_rng(2).integers(0, 9, (200, 2)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double").repartition(3)
    found = select.latin_hypercube(df, "id", ["a", "b"], 15, 4)
    assert "SortAggregate" not in _plan(found)
    draw = random.Random(4)
    grids = [[(i + draw.random()) / 15 for i in draw.sample(range(15), 15)] for _ in "ab"]
    scaled = (x - x.min(0)) / (x.max(0) - x.min(0))
    assert {r["id"] for r in found.collect()} == {int(((scaled - p) ** 2).sum(1).argmin()) for p in zip(*grids, strict=True)}


def test_bootstrap_hashes_a_row_and_repeat_once(spark):
    df = spark.createDataFrame([(i, float(i), i + 1.0, i + 2.0) for i in range(50)], "k long, y double, a double, b double")
    times = significance._drawn(significance._repeats(df.select("k"), 3), "k", 0)
    each = {(r["k"], r["_rep"]): r["_w"] for r in times.collect()}
    u = {(r["k"], r["_rep"]): r["u"] for r in significance._repeats(df.select("k"), 3).select("k", "_rep", (F.pmod(F.xxhash64(F.lit(0), "_rep", "k"), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()}
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    assert each == {k: int((v >= shares).sum()) for k, v in u.items()}
    found = significance.bootstrap_comparison(df, "k", "y", "a", "b", times=30)
    assert _plan(found, "optimizedPlan").count("xxhash64") == 1
    row = found.first()
    assert row["metric_a"] == pytest.approx(1.0) and row["metric_b"] == pytest.approx(4.0) and row["significant"]


def test_kendall_ranges_by_search(spark, monkeypatch):
    monkeypatch.setattr(concordance, "RANGE", 40)
    plans = {}
    monkeypatch.setattr(concordance, "written", lambda df, name, f=concordance.written: (plans.update({name: _plan(df, "optimizedPlan")}), f(df, name))[1])
    x, y = np.random.default_rng(3).integers(0, 25, (2, 600))
    found = concordance.kendall(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double"), "a", "b").first()[0]
    score = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    assert found == pytest.approx(score.sum() / np.sqrt((np.sign(x[:, None] - x) ** 2).sum() * (np.sign(y[:, None] - y) ** 2).sum()), abs=1e-12)
    assert "lambda" not in plans["ranges"]


def test_inversions_equal_all_pairs():
    r = np.random.default_rng(6)
    for n in (1, 2, 37, 300):
        a, b, w = r.integers(0, n, n), r.integers(0, n // 2 + 1, n), r.integers(1, 4, n)
        assert concordance.inversions(a, b, w) == (w[:, None] * w * ((a[:, None] < a) & (b[:, None] > b))).sum()


def test_steps_travel_only_for_reactions_that_can_be_among_the_best(spark):
    """Many dear reactions of one product; the reaction that comes back to it bounds nothing."""
    rows = [(i, 1, [2], 10.0 + i) for i in range(30)] + [(50, 2, [3], 1.0), (51, 4, [1], 1.0), (52, 1, [4], 0.5)]
    made = spark.createDataFrame(rows, "reaction long, product long, reactants array<long>, cost double")
    stock = spark.createDataFrame([(3, 1.0), (4, 50.0)], "item long, price double")
    each = made.select("reaction", "product", F.size("reactants").alias("_need"), "cost", F.posexplode("reactants").alias("_i", "_item"))
    step = "array<struct<price:double,steps:array<struct<reaction:bigint,product:bigint>>,depth:int>>"
    shelf = stock.select("item", F.array(F.struct("price", F.array(), F.lit(0))).cast(step).alias("_best"))
    now = shelf.unionByName(spark.createDataFrame([(2, [(2.0, [(50, 2)], 1)])], f"item long, _best {step}"))
    assert {r["reaction"] for r in synthesis._worth(each, now, shelf, 2).collect()} == {0, 1, 50}
    found = {(r["item"], r["rank"]): (r["price"], [s["reaction"] for s in r["steps"]]) for r in synthesis.routes(made, stock, 2, 5).collect()}
    assert found == {(1, 1): (12.0, [0, 50]), (1, 2): (13.0, [1, 50]), (2, 1): (2.0, [50]), (3, 1): (1.0, []), (4, 1): (13.0, [51, 0, 50]), (4, 2): (14.0, [51, 1, 50])}
