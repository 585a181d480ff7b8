import random

import numpy as np
import pytest

from tesserae.operators import concordance


def brute(rows):
    rows = [(a, b) for a, b in rows if a is not None and b is not None]
    y, p = (np.array([float(r[i]) for r in rows]) for i in (0, 1))
    s = (np.sign(y[:, None] - y) * np.sign(p[:, None] - p)).sum() / 2
    n0 = len(y) * (len(y) - 1) / 2
    t = [n0 - (v[:, None] == v).sum() / 2 + len(v) / 2 for v in (y, p)]
    return s / np.sqrt(t[0] * t[1]) if t[0] and t[1] else None


@pytest.mark.parametrize("per_range", [20_000, 25])
def test_kendall(spark, monkeypatch, per_range):
    monkeypatch.setattr(concordance, "RANGE", per_range)
    r = random.Random(6)
    smooth = [(x := r.gauss(0, 1), x + r.gauss(0, 1)) for _ in range(700)]
    tied = [(r.randint(0, 9), r.randint(0, 200)) for _ in range(500)] + [(5, r.random()) for _ in range(400)] + [(r.random() * 9, 7) for _ in range(400)]
    for rows in (smooth, tied, smooth[:300] + smooth[:300] + [(None, 1.0), (1.0, None)], [(float(i), float(-i)) for i in range(200)]):
        df = spark.createDataFrame([(None if a is None else float(a), None if b is None else float(b)) for a, b in rows], "y double, p double").repartition(3)
        assert concordance.kendall(df, "y", "p").first()[0] == pytest.approx(brute(rows), abs=1e-12)


def test_kendall_of_little(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)]):
        assert concordance.kendall(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()[0] is None


def test_inversions():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 300):
        a, b, w = r.integers(0, 20, n), r.integers(0, 20, n), r.integers(1, 5, n)
        want = sum(w[i] * w[j] for i in range(n) for j in range(n) if a[i] < a[j] and b[i] > b[j])
        assert concordance.inversions(a, b, w) == want
