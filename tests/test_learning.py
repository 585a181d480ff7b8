"""Operators that learn, against plain numpy or known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as command
from tesserae import settings
from tesserae.operators import bioisosteres, campaign, clusters, domains, dose, models, pairs, similarity, surrogate, uncertainty


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (40, 2)), r.normal(8, 1, (40, 2)), [[100.0, -100.0]]])
    rows = [(i, [float(v) for v in p], float(np.sin(p[0]) + 0.1 * p[1])) for i, p in enumerate(x)]
    return spark.createDataFrame([*rows, (900, None, 1.0)], "id long, v array<double>, y double")


def _plain(points):
    rows = [r for r in points.collect() if r.v is not None]
    return np.array([r.id for r in rows]), np.array([r.v for r in rows]), np.array([r.y for r in rows])


def test_surrogate_is_the_closed_form(points):
    _, x, y = _plain(points)
    model = surrogate.fitted(x[:30], y[:30], "rbf", hyper={"constant": 1.5, "length": 0.8, "noise": 0.01})
    m, s = x[:30].mean(0), x[:30].std(0)
    a, b = (x[:30] - m) / s, (x[30:50] - m) / s
    k = lambda p, q: 1.5 * np.exp(-0.5 * ((p[:, None] - q[None]) ** 2).sum(2) / 0.64)
    inverse = np.linalg.inv(k(a, a) + (0.01 + 1e-8) * np.eye(30))
    my, sy = y[:30].mean(), y[:30].std()
    want = my + sy * (k(b, a) @ inverse @ ((y[:30] - my) / sy))
    spread = sy * np.sqrt(1.51 - np.einsum("ij,jk,ik->i", k(b, a), inverse, k(b, a)))
    got = model.predict(x[30:50])
    assert np.allclose(got[0], want, atol=1e-6) and np.allclose(got[1], spread, atol=1e-6)


def test_tuning_raises_the_likelihood_and_predictions_follow(points):
    _, x, y = _plain(points)
    plain = surrogate.fitted(x[:40], y[:40], hyper={"constant": 1.0, "length": 1.0, "noise": 0.1})
    tuned = surrogate.fitted(x[:40], y[:40])
    assert tuned.hyper["log_likelihood"] >= plain.hyper["log_likelihood"]
    assert np.abs(tuned.predict(x[:40])[0] - y[:40]).mean() < 0.2


def test_optimizer_picks_unseen_rows_and_learns(points):
    seen = points.filter("id < 10")
    optimizer = surrogate.BayesianOptimizer("id", "v", "y").fit(seen)
    batch = optimizer.select_next(points, 3).collect()
    assert len(batch) == 3 and all(r.id >= 10 for r in batch)
    picked = surrogate.rounds(optimizer, points.filter("v IS NOT NULL"), points, 2, 2).collect()
    assert len({r.id for r in picked}) == 4 and optimizer.observed.count() == 14
    assert surrogate.predict(optimizer.model, points, "v").filter("id = 900").first()["mean"] is None
    assert surrogate.best_observation(points, "id", "y", True).first().id == points.orderBy("y").first().id
    both = surrogate.select_multi({"a": optimizer.model, "b": optimizer.model}, points.filter("v IS NOT NULL"), "id", "v", {"a": 0.0, "b": 0.0}, {"a": 0.5, "b": 0.5}, 4)
    assert both.count() == 4
    with pytest.raises(ValueError):
        surrogate.fit(points.limit(0), "v", "y")


def test_leverage_and_moments_are_numpys(points):
    ids, x, _ = _plain(points)
    n, mean, cov = domains.moments(points, "v")
    assert n == len(x) and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    off = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(2)), off)
    got = {r.id: r.distance for r in domains.leverage(points, points, "id", "v").collect()}
    assert np.allclose([got[i] for i in ids], want)
    assert domains.leverage(points.limit(0), points, "id", "v").filter("in_domain").count() == 0


def test_domains_leave_out_the_far_point(points):
    train = points.filter("id < 80")
    for found in (domains.local_outlier(train, points, "id", "v", 5), domains.isolation(train, points, "id", "v", trees=50)):
        got = {r.id: r for r in found.collect()}
        assert 900 not in got and not got[80].in_domain and sum(r.in_domain for r in got.values()) > 60
    assert domains.isolation(train.limit(0), points, "id", "v").count() == 0


def test_nearest_in_blocks_is_nearest_at_once(points):
    known = points.filter("v IS NOT NULL")
    a = sorted(map(tuple, similarity.nearest(known, known, "id", "v", 3).collect()))
    assert a == sorted(map(tuple, similarity.nearest(known, known, "id", "v", 3, block=7).collect()))
    ids, x, _ = _plain(points)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(int(i), int(ids[j])) for k, i in enumerate(ids) for j in [j for j in np.lexsort((ids, d[k])) if j != k][:3]}
    assert {(r[0], r[1]) for r in a} == want


def test_clusters_part_the_two_clouds(points):
    found, centres = clusters.kmeans(points.filter("id < 80"), "id", "v", 2)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(min, groups.values())) == [0, 40] and len(centres) == 2
    assert clusters.pick(points, "id", "v", 3).count() == 3
    assert clusters.pick(points, "id", "v", 3, "best", "y").count() == 3
    parts = clusters.split(points, "id", "v", 4, test=0.5).groupBy("cluster").agg(F.count_distinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in parts)
    assert clusters.kmeans(points.limit(0), "id", "v", 2)[0].count() == 0


def test_hill_fit_finds_the_curve(spark):
    x = np.logspace(-2, 2, 12)
    rows = [("a", float(d), float(dose.curve(d, np.array([5.0, 90.0, 2.0, -1.5])))) for d in x] + [("b", 1.0, 3.0), ("c", 0.0, 1.0)]
    got = {r.k: r for r in dose.fit(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert np.allclose([got["a"].bottom, got["a"].top, got["a"].ic50, got["a"].hill], [5, 90, 2, -1.5], atol=1e-3) and got["a"].r2 > 0.9999
    assert got["b"].ic50 is None and got["b"].n == 1 and "c" not in got


def test_pair_statistics_are_those_of_the_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(i, f"c{r.integers(3)}", f"p{r.integers(4)}", float(r.normal())) for i in range(90)] + [(99, None, "p1", 1.0), (98, "c1", "p1", None)]
    df = spark.createDataFrame(rows, "id long, core string, part string, v double")
    made = pairs.matched_pairs(df, "id", "core", "part", "v")
    assert made.count() == sum(1 for a in rows for b in rows if a[1] and a[1] == b[1] and a[2] < b[2] and a[3] is not None and b[3] is not None)
    want = {x.transform: x for x in pairs.transformations(made).collect()}
    got = {x.transform: x for x in pairs.paired_statistics(df, "core", "part", "v").collect()}
    assert want.keys() == got.keys()
    for k, x in got.items():
        assert x.n_pairs == want[k].n_pairs and np.allclose([x.mean_change, x.std_change, x.min_change, x.max_change], [want[k].mean_change, want[k].std_change, want[k].min_change, want[k].max_change])


def test_transform_types(spark):
    given = {"[H]>>Cl": "halogenation", "C>>Cl": "halogenation", "[H]>>OC": "oxygenation", "OC>>[H]": "other", "C>>N": "amination", "[H]>>CC": "alkylation", "C>>c1ccccc1": "ring_modification"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r.t: r.k for r in df.select("t", pairs.transform_type(F.col("t")).alias("k")).collect()} == given


def test_linear_models(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 3))
    y = 2 + x @ [3.0, -1.0, 0.0] + 0.01 * r.normal(size=200)
    df = spark.createDataFrame([(i, *map(float, p), float(v), 7.0) for i, (p, v) in enumerate(zip(x, y, strict=True))] + [(500, None, 1.0, 1.0, 1.0, 7.0)], "id long, a double, b double, c double, y double, k double")
    assert models.selected(df, ["c", "b", "a", "k"], "y", 2) == ["a", "b"]
    line = models.fit(df, ["a", "b", "c", "k"], "y")
    assert np.allclose(line.weights, [3, -1, 0, 0], atol=0.01) and abs(line.intercept - 2) < 0.01
    scores = models.cross_validated(df, ["a", "b"], "y", "id").collect()
    assert sum(s.n for s in scores) == 200 and all(s.r2 > 0.99 for s in scores)
    line.save(spark, str(tmp_path / "m"))
    assert models.Linear.load(spark, str(tmp_path / "m")) == line
    gain = {g.feature: g.increase for g in models.permuted(df, line, "y", "id").collect()}
    assert gain["a"] > gain["b"] > abs(gain["c"])


def test_evidence_and_ensembles(spark):
    df = spark.createDataFrame([(0.5, 1.0, 2.0, 1.0, 0.7), (0.1, 2.0, 1.0, 1.0, 0.2)], "g double, l double, a double, b double, y double")
    made = uncertainty.nig(*(F.col(c) for c in "glab"))
    rows = df.select(*(c.alias(n) for n, c in made.items())).collect()
    assert rows[0].aleatoric == 1.0 and rows[0].epistemic == 1.0 and rows[1].aleatoric is None
    some = spark.createDataFrame([(1.0, 3.0, None), (None, None, None)], "a double, b double, c double")
    got = some.select(*(c.alias(n) for n, c in uncertainty.ensemble([F.col(c) for c in "abc"]).items())).collect()
    assert got[0].mean == 2.0 and abs(got[0].std - 2**0.5) < 1e-12 and got[1].mean is None


def test_suggestions_and_campaigns(spark):
    rules = bioisosteres.rules(spark)
    assert rules.count() == 36
    got = bioisosteres.suggest(spark.createDataFrame([(1, ["[Cl]", "[Cl]"]), (2, ["x"]), (3, None)], "id long, f array<string>"), "id", "f", rules).collect()
    assert [(r.id, r.rank, r.name) for r in got] == [(1, 1, "Cl→Br"), (1, 2, "Cl→CF3")]
    known = spark.createDataFrame([("a", "1", "2024-01-01")], "name string, model_version string, start string")
    new = spark.createDataFrame([("a", "2", "2024-02-01"), ("b", "1", "2024-02-01")], known.schema)
    assert sorted((r.name, r.model_version) for r in campaign.created(known, new).collect()) == [("a", "2"), ("b", "1")]
    assert [campaign.exploration_weight(i, 4) for i in (0, 2, 4, 9)] == [0.5, 0.25, 0.0, 0.0]


def test_settings_and_commands(spark, points, tmp_path, capsys):
    assert settings.merge_configs({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "e": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 6}
    settings.save_config(settings.ModelConfig(cv_folds=3).to_dict(), tmp_path / "s.json")
    assert settings.ModelConfig.from_file(tmp_path / "s.json").cv_folds == 3
    with pytest.raises(FileNotFoundError):
        settings.load_config(tmp_path / "none.json")
    flat = points.select("id", F.element_at("v", 1).alias("a"), F.element_at("v", 2).alias("b"), "y").dropna()
    path = str(tmp_path / "flat.parquet")
    flat.write.parquet(path)
    model, out = str(tmp_path / "model"), str(tmp_path / "out.parquet")
    assert command.run(spark, ["--config", str(tmp_path / "s.json"), "train", "--input", path, "--model", model, "--target", "y", "--key", "id", "--features", "a,b"]) == 0
    assert json.loads(capsys.readouterr().out)["features"]
    command.run(spark, ["predict", "--input", path, "--model", model, "--output", out])
    assert json.loads(capsys.readouterr().out)["rows"] == flat.count()
    command.run(spark, ["benchmark", "--input", out, "--target", "y", "--prediction", "prediction"])
    assert "rmse" in json.loads(capsys.readouterr().out)
    command.run(spark, ["curate", "--input", path, "--output", str(tmp_path / "c.parquet"), "--key", "id"])
    assert sum(json.loads(capsys.readouterr().out).values()) == flat.count()
    pool = str(tmp_path / "pool.parquet")
    points.dropna().write.parquet(pool)
    seen = str(tmp_path / "seen.parquet")
    points.filter("id < 8").write.parquet(seen)
    command.run(spark, ["learn", "--observed", seen, "--pool", pool, "--output", str(tmp_path / "l.parquet"), "--key", "id", "--vector", "v", "--value", "y", "--rounds", "1", "--batch-size", "2"])
    assert json.loads(capsys.readouterr().out)["picks"] == 2
