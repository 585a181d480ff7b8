"""Cases that larger tables brought up."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import blocks, inducing, neighbours, pairs, significance, similarity, surrogate


def test_wilcoxon_of_many_rows(spark):
    n = 2_200_000
    found = significance.wilcoxon(spark.range(n).select((F.col("id") % 5 + 1).cast("double").alias("a"), F.lit(0.0).alias("b")), "a", "b").first()
    assert found["n"] == n and found["statistic"] == 0 and found["p_value"] == 0
    assert abs(found["z"] + (n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5) < 1e-6


def test_dense_sets_meet_in_blocks(spark, monkeypatch):
    """Sets of frequent bits don't meet by prefixes: no table of prefixes is made, and blocks lose and double nothing."""
    monkeypatch.setattr(blocks, "LEAST", 100)
    monkeypatch.setattr(blocks, "GROUPS", 7)
    monkeypatch.setattr(similarity, "written", lambda df, name, f=similarity.written: pytest.fail("prefixes") if name == "prefix" else f(df, name))
    marks = np.random.default_rng(4).random((700, 30)) < 0.5
    marks[600:] = marks[:100]
    marks[5] = False
    df = spark.createDataFrame([(i, [*map(int, np.flatnonzero(m)), None]) for i, m in enumerate(marks)], "k long, s array<int>")
    x = marks.astype(float)
    common = x @ x.T
    with np.errstate(invalid="ignore"):
        score = common / (x.sum(1)[:, None] + x.sum(1)[None] - common)
    near = np.nan_to_num(score, nan=-1.0) >= 0.6
    found = similarity.similar_pairs(df, "k", "s", 0.6).collect()
    assert sorted((r.a, r.b) for r in found) == [(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))]
    assert all(r.similarity == score[r.a, r.b] for r in found)
    across = similarity.similar_to(df.filter("k % 5 = 0"), df.filter("k % 5 <> 0"), "k", "s", 0.6).collect()
    assert sorted((r.a, r.b) for r in across) == [(int(a), int(b)) for a, b in np.argwhere(near) if a % 5 == 0 and b % 5 != 0]


def test_more_observations_than_an_exact_process_takes(spark, monkeypatch):
    monkeypatch.setattr(surrogate, "MOST", 120)
    x = np.random.default_rng(1).uniform(-2, 2, (600, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    rows = spark.createDataFrame([(i, list(map(float, v)), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, y double").repartition(3)
    model = surrogate.fit(rows.filter("id % 2 = 0"), "v", "y", restarts=0)
    assert isinstance(model, inducing.Inducing)
    found = surrogate.predict(model, rows.filter("id % 2 = 1"), "v").collect()
    assert len(found) == 300 and max(abs(r["mean"] - r["y"]) for r in found) < 0.2
    optimizer = surrogate.BayesianOptimizer("id", "v", "y").fit(rows.filter("id % 2 = 0"))
    assert [r["round"] for r in surrogate.rounds(optimizer, rows, rows, 2, 2).collect()] == [1, 1, 2, 2]


def test_neighbours_of_alike_distances_are_swept(spark, monkeypatch):
    """Vectors that no bound rules out are compared in few large blocks; floats travel as floats and ties go to the least key."""
    monkeypatch.setattr(blocks, "LEAST", 150)
    monkeypatch.setattr(blocks, "GROUPS", 4)
    ran = []
    monkeypatch.setattr(neighbours, "_swept", lambda *a, f=neighbours._swept: ran.append(a) or f(*a))
    x = np.random.default_rng(3).normal(size=(900, 32)).astype(np.float32)
    x[800:] = x[:100]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "k long, v array<float>").repartition(3)
    got = neighbours.nearest(df.filter("k % 3 = 0"), df, "k", "v", 4, block=100).collect()
    assert len(ran) == 1
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(q, r + 1): (int(n), d[q, n]) for q in range(0, 900, 3) for r, n in enumerate(np.lexsort((np.arange(900), d[q]))[:4])}
    assert {(r["query"], r["rank"]): r["neighbour"] for r in got} == {at: n for at, (n, _) in want.items()}
    assert all(abs(r["distance"] - want[r["query"], r["rank"]][1]) < 1e-9 for r in got)


@pytest.mark.parametrize("held", [1 << 21, 5])
def test_medians_of_pairs_without_pairs(spark, monkeypatch, held):
    """Ties, repeated values and narrowing give the median of all pairs; transforms of larger classes are counted in ranges."""
    monkeypatch.setattr(pairs, "HELD", held)
    r = np.random.default_rng(2)
    rows = [(i, f"c{i % 3}", "pqr"[int(r.integers(3))], float(r.integers(0, 40) / 10 if i % 2 else r.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, core string, part string, v double")
    want = {}
    for _, c, p, v in rows:
        for _, d, q, w in rows:
            if c == d and p < q:
                want.setdefault(f"{p}>>{q}", []).append(w - v)
    got = {r["transform"]: r["median_change"] for r in pairs.statistics(df, "id", "core", "part", "v").collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in want.items()}, abs=1e-12)


def test_middle_of_many_differences(monkeypatch):
    monkeypatch.setattr(pairs, "LISTED", 50)
    r = np.random.default_rng(5)
    for made in (lambda n: r.integers(0, 30, n) / 10, lambda n: r.normal(size=n)):
        classes = []
        for n, m in ((60, 41), (33, 80), (1, 7)):
            (a, wa), (b, wb) = (np.unique(made(k), return_counts=True) for k in (n, m))
            classes.append(("p>>q", a, wa, b, wb))
        every = np.concatenate([(np.repeat(b, wb)[None] - np.repeat(a, wa)[:, None]).ravel() for _, a, wa, b, wb in classes])
        found = pairs._middle(pd.DataFrame(classes, columns=["transform", "va", "wa", "vb", "wb"]))
        assert found["median_change"][0] == pytest.approx(np.median(every), abs=1e-12)
