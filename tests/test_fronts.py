"""Pareto fronts in many objectives and exact isotonic regression against brute force."""

import random

import numpy as np
import pytest

from tesserae.operators import calibration, skyline

GOALS = {"a": "maximize", "b": "minimize", "c": "maximize"}


def fronts(points):
    """Front of each distinct point by peeling."""
    left, out, k = set(points), {}, 1
    better = lambda x, y: all(p >= q for p, q in zip(x, y, strict=True)) and x != y
    while left:
        front = {x for x in left if not any(better(y, x) for y in left)}
        out |= dict.fromkeys(front, k)
        left, k = left - front, k + 1
    return out


@pytest.mark.parametrize("block", [8, 2048])
@pytest.mark.parametrize("kind", ["free", "few values", "all on the front"])
def test_pareto(spark, block, kind):
    r = random.Random(8)
    draw = {"free": lambda: (r.random(), r.random(), r.random()), "few values": lambda: (r.randint(0, 4), r.randint(0, 4), r.randint(0, 4)), "all on the front": lambda: ((x := r.random()), x, r.random() * 0 + 1.0)}[kind]
    rows = [(i, *map(float, draw())) for i in range(250)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(40)]
    df = spark.createDataFrame([*rows, (5000, None, 1.0, 1.0), (5001, float("nan"), 1.0, 1.0)], "front_id long, a double, b double, c double").repartition(3)
    want = fronts([(a, -b, c) for _, a, b, c in rows])
    found = {(x["front_id"], x["front"]) for x in skyline.pareto_ranks(df, GOALS, 3, block).collect()}
    assert found == {(i, want[a, -b, c]) for i, a, b, c in rows if want[a, -b, c] <= 3}
    assert {x["front_id"] for x in skyline.pareto_front(df, GOALS, block).collect()} == {i for i, f in found if f == 1}


def test_pareto_of_nothing(spark):
    none = spark.createDataFrame([(None, 1.0, 1.0)], "a double, b double, c double")
    assert skyline.pareto_front(none, GOALS).count() == 0
    one = spark.createDataFrame([(float("inf"), 1.0, 1.0), (float("inf"), 1.0, 2.0)], "a double, b double, c double")
    assert skyline.pareto_front(one, GOALS).collect() == [(float("inf"), 1.0, 2.0)]


@pytest.mark.parametrize("rows", [50_000, 5])
@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "steps"])
def test_isotonic_is_exact(spark, rows, kind):
    r = random.Random(9)
    n = 160
    y = {"noise": lambda i: r.random() + i / n, "falling": lambda i: -i, "rising": lambda i: i, "steps": lambda i: float(r.random() < i / n)}[kind]
    points = [(i * 0.37 + 1e-7 * (i % 2), float(y(i))) for i in range(n) for _ in range(1 + i % 3)]
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None), (float("nan"), 1.0)], "p double, y double").repartition(3)
    x = sorted({p for p, _ in points})
    mean = np.array([np.mean([b for a, b in points if a == p]) for p in x])
    weight = np.array([sum(a == p for a, _ in points) for p in x], float)
    _, fitted = calibration.pool_adjacent(np.array(x), mean, weight)
    found = {a: b for a, b in calibration.isotonic(df, "y", "p", rows).collect()}
    assert found == {p: pytest.approx(f, abs=1e-9) for p, f in zip(x, fitted, strict=True)}


def test_calibrated_between_and_beyond_scores(spark):
    fit = calibration.isotonic_blocks(spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.5, 0.5), (0.9, 3.0)], "p double, y double"), "y", "p")
    new = spark.createDataFrame([(0.0,), (0.3,), (0.45,), (0.7,), (5.0,), (None,)], "s double")
    assert [(r["s"], r["fitted"]) for r in calibration.calibrated(new, "s", fit).orderBy("s").collect()] == [(None, None), (0.0, 0.0), (0.3, 0.0), (0.45, 0.75), (0.7, 0.75), (5.0, 3.0)]
    assert calibration.isotonic(spark.createDataFrame([], "p double, y double"), "y", "p").count() == 0
