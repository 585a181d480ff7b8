"""Edge cases and numbers that the queries over the bundled tables don't reach."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import sources
from tesserae.operators import assay, calibration, curate, metrics, pairs, routes, select, significance, similarity, split
from tesserae.operators.graph import components


def test_constant_plate_gives_null_scores(spark):
    df = spark.createDataFrame([("p", 1.0), ("p", 1.0), (None, 2.0)], "plate string, v double")
    assert all(r.z_score is None for r in assay.z_score(df, "v", ["plate"]).collect())
    assert all(r.robust_z is None for r in assay.robust_z_score(df, "v", ["plate"]).collect())
    assert not any(r.is_outlier for r in assay.outliers(df, "v", ["plate"]).collect())


def test_replicates_drop_the_far_value(spark):
    df = spark.createDataFrame([("a", x) for x in [1.0] * 9 + [100.0]] + [("b", 1.0), ("b", 99.0), ("c", 5.0), ("c", 5.0), ("c", 5.0)], "k string, v double")
    got = {r.k: (r.n_replicates, r.mean) for r in assay.replicates(df, "v", ["k"]).collect()}
    assert got == {"a": (9, 1.0), "b": (2, 50.0), "c": (3, 5.0)}


def test_activity_classes(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 25.0, 74.9, 75.0)], "v double").select(assay.activity_class(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == ["inactive", "weak", "moderate", "strong"]


def test_keep_first_treats_null_keys_as_one_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "id long, k string")
    assert sorted(r.id for r in curate.keep_first(df, ["k"], ["id"]).collect()) == [1, 3]


def test_rules_without_values(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a double, b double, c double, d double")
    passes, n = curate.rule_of_five(*(F.col(c) for c in "abcd"))
    assert tuple(df.select(passes, n).first()) == (False, 5)


def test_largest_part_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("CC.OO",), ("C.OCC.N",), (None,)], "s string").select(curate.largest_part(F.col("s")).alias("p"))
    assert [r.p for r in df.collect()] == ["CC", "OCC", None]


def test_splits_cover_all_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 7)
    for made in (split.random_split(df, "k"), split.exact_split(df, "k"), split.exact_split(df, "k", by="g"), split.group_split(df, "g")):
        counts = {r.split: r["count"] for r in made.groupBy("split").count().collect()}
        assert sum(counts.values()) == 1000 and 600 < counts["train"] < 900
    assert split.group_split(df, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r.comp for r in components(edges).collect()} == {0}


def test_similar_pairs_match_brute_force(spark):
    r = random.Random(1)
    sets = {i: sorted(r.sample(range(40), r.randint(0, 12))) for i in range(60)}
    sets[60] = sets[3]
    df = spark.createDataFrame(list(sets.items()), "k long, s array<int>")
    want = set()
    for a, b in itertools.combinations(sets, 2):
        x, y = set(sets[a]), set(sets[b])
        if x and y and len(x & y) / len(x | y) >= 0.3:
            want.add((a, b))
    assert {(p.a, p.b) for p in similarity.similar_pairs(df, "k", "s", 0.3).collect()} == want


def test_nearest_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)], "k long, v array<double>")
    got = similarity.nearest(df.filter("k = 0"), df, "k", "v", 3).orderBy("rank").collect()
    assert [(p.neighbour, p.distance) for p in got] == [(3, 0.0), (6, 0.0), (1, 1.0)]


def test_auc_without_a_class_is_half(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == 0.5
    assert metrics.classification(df.withColumn("p", F.lit(0)), "y", "p").first()["precision"] == 0.0


def test_kendall_matches_pairs(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 4), r.randint(0, 4)) for _ in range(80)]
    c = d = ty = tp = 0
    for (a, b), (x, y) in itertools.combinations(rows, 2):
        s = (a - x) * (b - y)
        c, d, ty, tp = c + (s > 0), d + (s < 0), ty + (a == x), tp + (b == y)
    n = len(rows) * (len(rows) - 1) / 2
    got = metrics.kendall_classes(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()[0]
    assert got == pytest.approx((c - d) / math.sqrt((n - ty) * (n - tp)))


def test_student_t():
    assert significance.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert significance.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert significance.chi2_tail(3.841458821) == pytest.approx(0.05, abs=1e-8)


def test_corrections_step_down(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.5)], "k string, p double")
    got = {r.k: (r.bonferroni, r.holm, r.benjamini_hochberg) for r in significance.corrected(df, "k", "p").collect()}
    assert got == {"a": (True, True, True), "b": (False, False, True), "c": (False, False, True), "d": (False, False, False)}


def test_isotonic_pools():
    x, y = calibration.pool_adjacent(np.array([1.0, 2.0, 3.0]), np.array([1.0, 3.0, 1.0]), np.array([1.0, 1.0, 1.0]))
    assert y.tolist() == [1.0, 2.0, 2.0]


def test_temperature_and_platt(spark):
    r = random.Random(3)
    rows = []
    for _ in range(3000):
        z = r.gauss(0, 1)
        rows.append((int(r.random() < 1 / (1 + math.exp(-z))), 2 * z))
    df = spark.createDataFrame(rows, "y int, z double").cache()
    assert calibration.temperature(df, "y", "z") == pytest.approx(2.0, rel=0.15)
    a, b = calibration.platt(df, "y", "z")
    assert a == pytest.approx(0.5, rel=0.15) and abs(b) < 0.15


def test_pareto_front_matches_definition(spark):
    r = random.Random(4)
    rows = [(i, float(r.randint(0, 15)), float(r.randint(0, 15))) for i in range(150)] + [(500, None, 1.0)]
    pts = [p for p in rows if p[1] is not None]
    want = {p[0] for p in pts if not any(q[1] >= p[1] and q[2] >= p[2] and (q[1] > p[1] or q[2] > p[2]) for q in pts)}
    df = spark.createDataFrame(rows, "k long, x double, y double")
    assert {p.k for p in select.pareto_front(df, "k", "x", "y").collect()} == want


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 9.0, 60.0), (2, 8.0, 50.0), (3, 7.0, 40.0)], "k long, s double, c double")
    assert [r.k for r in select.within_budget(df, "k", "s", "c", 100.0).orderBy("pick").collect()] == [1, 3]


def test_max_min_takes_the_far_corner(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [10.0]), (3, [5.0])], "k long, v array<double>")
    assert [r.id for r in select.max_min(df, "k", "v", 3).orderBy("pick").collect()] == [0, 2, 3]


def test_matched_pairs_keep_the_sign(spark):
    df = spark.createDataFrame([(1, "c", "H", 5.0), (2, "c", "F", 5.5), (3, "d", "F", 1.0), (4, "d", "H", 0.0)], "k long, core string, part string, v double")
    assert {(r.transform, r.change) for r in pairs.matched_pairs(df, "k", "core", "part", "v").collect()} == {("F>>H", -0.5), ("F>>H", -1.0)}


def test_free_wilson_recovers_effects(spark):
    rows = [(a, b, {"H": 0.0, "F": 1.0}[a] + {"x": 0.0, "y": 2.0}[b]) for a in "HF" for b in "xy"] * 10
    base, table_ = pairs.contributions(spark.createDataFrame(rows, "a string, b string, v double"), ["a", "b"], "v", ridge=1e-6)
    c = {(r.position, r.substituent): r.contribution for r in table_.collect()}
    assert c[("a", "F")] - c[("a", "H")] == pytest.approx(1.0, abs=1e-3) and c[("b", "y")] - c[("b", "x")] == pytest.approx(2.0, abs=1e-3)
    assert base + c[("a", "H")] + c[("b", "x")] == pytest.approx(0.0, abs=1e-3)


def test_route_of_one_step_is_convergent(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1.0, 50.0)], "n int, j int, a double, s double, c double")
    made = routes.sub_scores(*(F.col(c) for c in "njasc"))
    assert df.withColumns(made).select(routes.overall()).first()[0] == pytest.approx(1.0)


def test_upsert_prefers_the_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, v long, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k long, v long, x string")
    assert {(r.k, r.x) for r in routes.upsert(old, new, ["k"], "v").collect()} == {(1, "c"), (2, "b"), (3, "e")}


def test_record_files_round_trip(spark, tmp_path):
    text = "one\nx\n\n  0  0\nM  END\n> <logp>\n1.5\n\n$$$$\ntwo\ny\n\n  0  0\nM  END\n> <name>\nb\n\n$$$$\nbroken\n$$$$\n"
    (tmp_path / "a.sdf").write_text(text)
    got = sources.flattened(sources.read_records(spark, str(tmp_path / "a.sdf")), ["logp", "name"]).orderBy("title").collect()
    assert [(r.title, r.block is None, r.logp, r.name) for r in got] == [("broken", True, None, None), ("one", False, "1.5", None), ("two", False, None, "b")]
    sources.write_records(sources.flattened(sources.read_records(spark, str(tmp_path / "a.sdf")), ["logp", "name"]), str(tmp_path / "b"), "title", "block", ["logp", "name"])
    again = sources.flattened(sources.read_records(spark, str(tmp_path / "b")), ["logp", "name"]).orderBy("title").collect()
    assert [(r.title, r.logp, r.name) for r in again] == [("one", "1.5", None), ("two", None, "b")]


def test_structure_lists(spark, tmp_path):
    (tmp_path / "a.smi").write_text("# note\n\nCCO mol_1\nc1ccccc1\tmol_2\nC\n")
    assert [(r.smiles, r.mol_id) for r in sources.read_smi(spark, str(tmp_path / "a.smi")).collect()] == [("CCO", "mol_1"), ("c1ccccc1", "mol_2"), ("C", None)]
    (tmp_path / "a.csv").write_text("SMILES,logp\nCCO,1\n")
    assert sources.read_structures(spark, str(tmp_path / "a.csv")).columns[:2] == ["smiles", "logp"]
    (tmp_path / "b.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        sources.read_structures(spark, str(tmp_path / "b.csv"))


def test_plate_matrix(spark, tmp_path):
    (tmp_path / "p.csv").write_text("row,1,2\nA,1.5,2.5\nB,3,\n")
    got = sources.read_plate_matrix(spark, str(tmp_path / "p.csv"), 2).orderBy("well").collect()
    assert [(r.well, r.row, r.column, r.value) for r in got][:3] == [("A1", "A", 1, 1.5), ("A2", "A", 2, 2.5), ("B1", "B", 1, 3.0)]


def test_knn_domain_uses_all_other_rows(spark, sf):
    from tesserae import plans

    given = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    train = np.array([v for i, v in given.items() if i % 5])
    near = lambda v: np.sort(np.sqrt(((train - v) ** 2).sum(axis=1)))[:5].mean()
    own = np.array([near(v) for v in train])
    limit = own.mean() + 3 * own.std()
    want = {i: near(v) for i, v in given.items() if i % 5 == 0}
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    blocks = similarity.knn_domain(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "vec_id", "embedding", block=90)
    for df in (plans.queries()["domain_knn"](spark, sf), blocks):
        got = {r.vec_id: r for r in df.collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert abs(r.distance - want[i]) < 1e-5 and abs(r.threshold - limit) < 1e-5 and r.in_domain == (want[i] <= limit)


def test_budget_goes_on_behind_the_pool(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(50)), float(r.randrange(1, 60))) for i in range(60)] + [(100, -1.0, 0.5), (101, -2.0, -3.0), (102, -3.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, score double, cost double")
    want, spent = [], 0.0
    for i, _, c in sorted(rows, key=lambda x: (-x[1], x[0])):
        if spent + c <= 200.5:
            want, spent = [*want, i], spent + c
    got = [x.id for x in select.within_budget(df, "id", "score", "cost", 200.5, 5).orderBy("pick").collect()]
    assert got == want and {101, 102} <= set(got)
