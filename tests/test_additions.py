"""Validity of structures, record files in pieces and streams, gradients, comparisons, pairs without pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import logs, sources, streaming
from tesserae.operators import bioisosteres, campaign, models, pairs, select, significance, uncertainty


def test_valid_structures(spark, tmp_path):
    good = ["CCO", "c1ccccc1", "C(C(=O)O)N", "[Na+].[Cl-]", "C%12CCCC%12", "C1CC1C1CC1", "CC(C)(C)C", "C1CC%01"]
    bad = ["C(C", "CC)", "c1ccccc", "[Na", "Na]", "[[C]]", "C C", "", None, ")(", "C%12CC"]
    df = spark.createDataFrame([(s,) for s in good + bad], "s string")
    assert [r[0] for r in df.select(sources.valid_structure(F.col("s"))).collect()] == [True] * len(good) + [False] * len(bad)
    (tmp_path / "a.csv").write_text("SMILES,mol_id\nCCO,a\nC(C,b\n")
    rows = sources.read_structures(spark, str(tmp_path / "a.csv")).orderBy("mol_id").collect()
    assert [(r["smiles"], r["is_valid"]) for r in rows] == [("CCO", True), ("C(C", False)]


def test_one_record_file_is_read_by_many_tasks_and_as_a_stream(spark, tmp_path):
    record = "m{0}\n  x\n\n  0  0\nM  END\n> <logp>\n{0}.5\n\n$$$$\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sdf").write_text("".join(record.format(i) for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = sources.flattened(sources.read_records(spark, str(tmp_path / "in")), ["logp"])
        assert found.rdd.getNumPartitions() >= 4
        assert sorted((r["title"], r["logp"]) for r in found.collect()) == sorted((f"m{i}", f"{i}.5") for i in range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for n in (3000, 3010):
        sources.convert_records(sources.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), ["logp"])
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.sdf").write_text("".join(record.format(i) for i in range(10)))


def test_gradient_of_expected_improvement(spark):
    ei = lambda m, s, minimize: spark.range(1).select(select.expected_improvement(F.lit(m), F.lit(s), F.lit(1.0), minimize=minimize)).first()[0]
    for minimize in (False, True):
        got = spark.range(1).select(select.expected_improvement_gradient(F.lit(1.2), F.lit(0.7), F.lit(1.0), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), minimize=minimize)).first()[0]
        h = 1e-3
        want = [(ei(1.2 + h, 0.7, minimize) - ei(1.2 - h, 0.7, minimize)) / (2 * h), (ei(1.2, 0.7 + h, minimize) - ei(1.2, 0.7 - h, minimize)) / (2 * h)]
        assert got == pytest.approx(want, abs=1e-3)
    assert spark.range(1).select(select.expected_improvement_gradient(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.array(F.lit(1.0)), F.array(F.lit(1.0)))).first()[0] == [0.0]


def test_bootstrap_comparison(spark):
    r = np.random.default_rng(1)
    y = r.normal(size=400)
    rows = [(i, float(v), float(v + 0.1 * r.normal()), float(v + r.normal())) for i, v in enumerate(y)]
    df = spark.createDataFrame([*rows, (9999, None, 1.0, 1.0)], "k long, y double, a double, b double")
    found = significance.bootstrap_comparison(df, "k", "y", "a", "b", "rmse", times=200).first()
    a, b = (np.sqrt(np.mean([(x[1] - x[c]) ** 2 for x in rows])) for c in (2, 3))
    assert found["metric_a"] == pytest.approx(a, rel=0.05) and found["metric_b"] == pytest.approx(b, rel=0.05)
    assert found["low"] < found["difference"] < found["high"] < 0 and found["significant"] and found["share_a_better"] == 1.0
    same = significance.bootstrap_comparison(df, "k", "y", "b", "b", times=50).first()
    assert same["difference"] == 0 and not same["significant"]


def test_pairs_by_classes_equal_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.choice("xyz"), r.choice("pqrs"), r.uniform(0, 10)) for i in range(150)]
    df = spark.createDataFrame([*rows, (500, None, "p", 1.0), (501, "x", "q", None)], "id long, core string, part string, v double")
    made = pairs.matched_pairs(df, "id", "core", "part", "v")
    got = {(x["a"], x["b"], x["transform"], x["change"]) for x in pairs.cliffs_of(df, "id", "core", "part", "v", 6.0).collect()}
    assert got == {(x["a"], x["b"], x["transform"], x["change"]) for x in pairs.pair_cliffs(made, 6.0).collect()} and got
    one = {x["transform"]: x for x in pairs.transformations(made).collect()}
    two = {x["transform"]: x for x in pairs.tested(pairs.paired_statistics(df, "core", "part", "v")).collect()}
    assert set(one) == set(two)
    for t, x in one.items():
        assert two[t]["p_value"] == pytest.approx(x["p_value"], abs=1e-9) and two[t]["significant"] == x["significant"]


def test_effects_in_words(spark):
    rules = bioisosteres.rules(spark).select("effect", bioisosteres.effect_words(F.col("effect")).alias("words")).distinct().collect()
    assert all(x["words"] and "null" not in x["words"] for x in rules)
    assert {x["words"] for x in rules if x["effect"] == "P+ L-"} == {"more polar, less lipophilic"}


def test_logs(tmp_path, caplog):
    log = logs.setup("run", "INFO", str(tmp_path / "run.log"), console=False)
    with logs.experiment(log, "fit", {"b": 2, "a": 1}) as results:
        results["r2"] = 0.5
        with logs.level(log, "ERROR"):
            log.info("not said")
    with pytest.raises(ZeroDivisionError), logs.experiment(log, "bad", {}):
        1 / 0  # noqa: B018
    text = (tmp_path / "run.log").read_text()
    assert 'start fit {"a": 1, "b": 2}' in text and '"r2": 0.5' in text and "failed bad" in text and "not said" not in text


def test_ensemble_of_lines(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(2 * a - b + 1 + 0.1 * r.normal())) for i, (a, b) in enumerate(r.normal(size=(300, 2)))]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 1.0)], "k long, a double, b double, y double")
    made = models.ensemble(df, ["a", "b"], "y", "k", members=8)
    assert len(made.members) == 8 and len({tuple(m.weights) for m in made.members}) == 8
    assert all(m.weights == pytest.approx([2, -1], abs=0.1) for m in made.members)
    out = made.predict(df.filter("a IS NOT NULL")).orderBy("k").collect()
    each = np.array([[m.intercept + m.weights[0] * x[1] + m.weights[1] * x[2] for m in made.members] for x in rows])
    assert np.allclose([o["mean"] for o in out], each.mean(1)) and np.allclose([o["std"] for o in out], each.std(1))
    made.save(spark, str(tmp_path / "m"))
    assert models.Ensemble.load(spark, str(tmp_path / "m")) == made


def test_campaigns_are_saved(spark, tmp_path):
    c = spark.createDataFrame([("a", "v1")], "name string, model_version string")
    results = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "campaign string, n long, hit_rate double")
    campaign.save(c, results, str(tmp_path))
    one, two = campaign.load(spark, str(tmp_path))
    assert one.collect() == c.collect() and sorted(two.select(*results.columns).collect()) == sorted(results.collect())


def test_checksums_registry_and_batches(spark, tmp_path):
    import hashlib

    (tmp_path / "adme").mkdir()
    (tmp_path / "adme" / "hia_hou.csv").write_text("Drug,Y\nCCO,1\n")
    want = hashlib.sha256(b"Drug,Y\nCCO,1\n").hexdigest()
    found = sources.verified(spark, str(tmp_path / "adme"), {"hia_hou.csv": want.upper(), "gone.csv": "00"}).orderBy("name").collect()
    assert [(r["name"], r["matches"]) for r in found] == [("gone.csv", False), ("hia_hou.csv", True)]
    assert sources.load_admet(spark, "hia_hou", str(tmp_path)).collect() == [("CCO", "1")]
    assert sources.admet_datasets(spark).count() == 23
    with pytest.raises(ValueError):
        sources.load_admet(spark, "none", str(tmp_path))
    sizes = sources.in_batches(spark.range(25, numPartitions=2), lambda rows: rows.assign(id=len(rows)), "id long", 10)
    assert max(r["id"] for r in sizes.collect()) <= 10 and sizes.count() == 25


def test_tables_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("PRICE"))
    sources.write_jdbc(rows, url, "CATALOG", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = sources.read_jdbc(spark, url, "CATALOG", "ID", 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(100)]
    assert sources.read_jdbc(spark, url, "CATALOG", driver="org.apache.derby.jdbc.EmbeddedDriver").filter("PRICE > 190").count() == 4


def test_log_gamma(spark):
    import math

    xs = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 1e6, 0.0, -1.0, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(uncertainty.log_gamma(F.col("x"))).collect()]
    assert got[-3:] == [None] * 3
    assert got[:-3] == pytest.approx([math.lgamma(x) for x in xs[:-3]], rel=1e-11, abs=1e-11)


def test_median_of_pairs(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(i, r.choice("xy"), r.choice("pqr"), round(r.uniform(0, 10), 2)) for i in range(120)], "id long, core string, part string, v double")
    want = {x["transform"]: x["median_change"] for x in pairs.transformations(pairs.matched_pairs(df, "id", "core", "part", "v")).collect()}
    found = {x["transform"]: x["median_change"] for x in pairs.statistics(df, "id", "core", "part", "v", gather=20).collect()}
    assert found == pytest.approx(want, abs=1e-9)


def test_streams_leave_late_rows_out_and_keep_first(spark, tmp_path):
    import os
    from datetime import datetime

    def arrive(n, rows):
        made = spark.createDataFrame([(datetime.fromisoformat(t), k, float(v), i) for t, k, v, i in rows], "ts timestamp, plate string, value double, well long").coalesce(1)
        made.write.parquet(f"{tmp_path}/w{n}")
        part = next(p for p in os.listdir(f"{tmp_path}/w{n}") if p.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/w{n}/{part}", f"{tmp_path}/in/events{n}.parquet")
        os.utime(f"{tmp_path}/in/events{n}.parquet", (1_000_000 + n, 1_000_000 + n))

    arrive(1, [("2024-01-01 10:05", "p", 1, 0), ("2024-01-01 10:20", "p", 2, 1)])
    arrive(2, [("2024-01-01 14:00", "p", 3, 0)])
    arrive(3, [("2024-01-01 13:40", "p", 4, 2)])
    arrive(4, [("2024-01-01 10:30", "p", 9, 1), ("2024-01-01 19:00", "p", 5, 3)])
    schema = "ts timestamp, plate string, value double, well long"
    stream = lambda: streaming.events_stream(spark, f"{tmp_path}/in", schema)
    found = streaming.drained(streaming.plate_quality(stream(), F.col("well") == 0, F.col("well") == 1, "plate", "1 hour", "1 hour"), "late_quality")
    got = {r["start"].hour: r["n"] for r in found.collect()}
    assert got[10] == 2 and got.get(13) == 1 and got.get(14) == 1  # the row of 10:30 came after the watermark
    kept = streaming.drained(streaming.keep_first(stream(), ["plate", "well"], "1 day"), "kept_first")
    assert sorted((r["well"], r["value"]) for r in kept.collect()) == [(0, 1.0), (1, 2.0), (2, 4.0), (3, 5.0)]
