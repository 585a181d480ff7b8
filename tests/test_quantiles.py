"""Exact quantiles of groups, and what rests on them, against numpy."""

import math
import random
from collections import defaultdict

import pytest

from tesserae.operators import quantiles


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(2)
    rows = [("wide", r.gauss(0, 1) * 10 ** r.randint(-200, 200)) for _ in range(3000)]
    rows += [("ties", float(r.randint(0, 3))) for _ in range(2000)] + [("one", 4.5)] + [("two", 1.0), ("two", 2.0)]
    rows += [(None, r.random()) for _ in range(700)] + [("nothing", None)] * 3 + [("nan", math.nan), ("nan", 1.0)]
    rows += [("endless", x) for x in (math.inf, -math.inf, 0.0, 1.0, 2.0)] * 60 + [("all endless", math.inf)] * 50
    rows += [("outlier", r.random()) for _ in range(999)] + [("outlier", 1e300)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6)


@pytest.mark.parametrize("gather", [4096, 150])
def test_quantiles(values, gather):
    want = defaultdict(list)
    for r in values.collect():
        if r.v is not None and not math.isnan(r.v):
            want[r.g].append(r.v)
    found = {r["_g"]["g"]: r for r in quantiles.quantiles(values, "v", ["g"], {"low": 0.0, "q1": 0.25, "med": 0.5, "p9": 0.9, "top": 1.0}, gather).collect()}
    assert set(found) == set(want)
    for g, xs in want.items():
        xs = sorted(xs)
        for name, share in (("low", 0), ("q1", 0.25), ("med", 0.5), ("p9", 0.9), ("top", 1)):
            at = (len(xs) - 1) * share
            a, b = xs[math.floor(at)], xs[math.ceil(at)]
            expect = a if a == b else a * (1 - (at - math.floor(at))) + b * (at - math.floor(at))
            assert found[g][name] == pytest.approx(expect, rel=1e-9), (g, name)


def test_with_quantiles_keeps_rows(values, spark):
    out = quantiles.with_quantiles(values, "v", ["g"], med=0.5)
    assert out.columns == ["g", "v", "med"] and out.count() == values.count()
    assert out.filter("g = 'nothing'").select("med").distinct().collect()[0][0] is None
    some = values.filter("g IN ('ties', 'two', 'outlier')")
    assert quantiles.with_quantiles(some, "v", [], med=0.5).select("med").distinct().count() == 1
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.with_quantiles(empty, "v", ["g"], med=0.5).count() == 0


@pytest.mark.parametrize("gather", [4096, 5])
def test_located_by_weight(spark, gather):
    r = random.Random(4)
    rows = [(g, float(r.randint(0, 50)), r.randint(1, 9)) for g in range(3) for _ in range(500)]
    df = spark.createDataFrame(rows, "_g long, _v double, _w long")
    wanted = [(g, j, t) for g in range(4) for j, t in enumerate((0, 100, 1000, 10**6))]
    found = {(x["_g"], x["_j"]): x for x in quantiles.located(df, spark.createDataFrame(wanted, "_g long, _j int, _t long"), gather).collect()}
    for g, j, t in wanted:
        mine = sorted((v, w) for k, v, w in rows if k == g)
        total, at = 0, None
        for v, w in mine:
            total += w
            if at is None and total > t:
                at = v
        if at is None:
            assert (g, j) not in found
            continue
        x = found[g, j]
        assert (x["_v"], x["_below"], x["_at"], x["_n"]) == (at, sum(w for v, w in mine if v < at), sum(w for v, w in mine if v == at), sum(v == at for v, _ in mine))


def test_no_percentile_in_the_plan(values, capsys):
    quantiles.with_quantiles(values, "v", ["g"], med=0.5).explain()
    plan = capsys.readouterr().out.lower()
    assert "percentile" not in plan and "median" not in plan
