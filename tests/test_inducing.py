import numpy as np
import pytest

from tesserae.operators import inducing, surrogate

HYPER = {"constant": 1.3, "length": 0.9, "noise": 0.05}


@pytest.fixture(scope="module")
def observed(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 2))
    y, z = np.sin(2 * x[:, 0]) + x[:, 1], x[:, 0] ** 2
    rows = [(i, [float(a) for a in v], float(b), float(c)) for i, (v, b, c) in enumerate(zip(x, y, z, strict=True))]
    return spark.createDataFrame([*rows, (100, None, 1.0, 1.0), (101, [0.0, 0.0], None, 1.0)], "id long, v array<double>, y double, z double").repartition(4)


@pytest.mark.parametrize("kernel", ["rbf", "matern52"])
def test_all_points_give_the_exact_process(observed, kernel):
    known = observed.filter("v IS NOT NULL AND y IS NOT NULL").toPandas().sort_values("id")
    x, y = np.stack(known["v"].to_numpy()), known["y"].to_numpy()
    exact = surrogate.fitted(x, y, kernel, hyper=HYPER)
    some = inducing.fit(observed, "id", "v", "y", points=100, kernel=kernel, hyper=HYPER)
    at = np.random.default_rng(5).normal(size=(30, 2))
    for a, b in zip(exact.predict(at), some.predict(at), strict=True):
        assert np.allclose(a, b, atol=2e-4)


def test_few_points_come_near(observed):
    known = observed.filter("v IS NOT NULL AND y IS NOT NULL").toPandas()
    model = inducing.fit(observed, "id", "v", "y", points=25)
    mean, _ = model.predict(np.stack(known["v"].to_numpy()))
    assert np.corrcoef(mean, known["y"])[0, 1] > 0.95 and len(model.points) == 25
    with pytest.raises(ValueError):
        inducing.fit(observed.filter("id = 100"), "id", "v", "y")


def test_several_goals_and_update(spark, observed):
    rows = observed.filter("v IS NOT NULL AND y IS NOT NULL")
    loop = inducing.MultiObjective("id", "v", {"y": "maximize", "z": "minimize"}, points=40).fit(rows.filter("id % 3 = 0"))
    picks = loop.select_next(rows, 4)
    assert picks.count() == 4 and not {r["id"] % 3 for r in picks.collect()} & {0}
    first = dict(loop.models["y"].hyper)
    loop.update(rows.join(picks.select("id"), "id", "left_semi"))
    assert loop.observed.count() == 24 and loop.models["y"].hyper == first
    again = {r["id"] for r in loop.select_next(rows, 4, "tchebycheff").collect()}
    assert len(again) == 4 and not again & {r["id"] for r in picks.collect()}
    front = {(r["y"], r["z"]) for r in loop.front().collect()}
    seen = {(r["y"], r["z"]) for r in loop.observed.collect()}
    assert front == {p for p in seen if not any(q[0] >= p[0] and q[1] <= p[1] and q != p for q in seen)}
