"""Ward's joins, message passing and route search against plain loops."""

import itertools
import random

import numpy as np
import pytest

from tesserae.operators import cliffs, messages, synthesis, ward


def dendrogram(points):
    """Cheapest pair first, one at a time."""
    alive = {k: (1, np.array(v, float)) for k, v in points.items()}
    out = []
    while len(alive) > 1:
        cost = lambda a, b: alive[a][0] * alive[b][0] / (alive[a][0] + alive[b][0]) * ((alive[a][1] - alive[b][1]) ** 2).sum()
        c, a, b = min((cost(a, b), a, b) for a, b in itertools.combinations(sorted(alive), 2))
        (n, x), (m, y) = alive[a], alive.pop(b)
        alive[a] = (n + m, (n * x + m * y) / (n + m))
        out.append((a, b, round(c, 9), n + m))
    return out


@pytest.fixture(scope="module")
def points():
    r = random.Random(12)
    centres = [(0, 0), (8, 1), (3, 9)]
    return {i: [c + r.gauss(0, 1) for c in r.choice(centres)] for i in range(45)}


def test_ward_joins_like_one_pair_at_a_time(spark, points):
    df = spark.createDataFrame([*points.items(), (None, [0.0, 0.0]), (99, None)], "id long, v array<double>").repartition(3)
    want = dendrogram(points)
    near = ward.merges(df, "id", "v", finish=12, look=2)
    assert sorted((r["a"], r["b"], round(r["cost"], 9), r["size"]) for r in near.collect()) == sorted(want)
    at_once = ward.merges(df, "id", "v")
    assert sorted((r["a"], r["b"], round(r["cost"], 9), r["size"]) for r in at_once.collect()) == sorted(want)
    groups = {k: {k} for k in points}
    for a, b, _, _ in sorted(want, key=lambda m: m[2])[: len(points) - 3]:
        groups[a] |= groups.pop(b)
    found = {r["id"]: r["cluster"] for r in ward.ward(df, "id", "v", 3).collect()}
    assert found == {i: k for k, members in groups.items() for i in members}
    picks = {r["cluster"]: r["id"] for r in ward.select(df, "id", "v", 3).collect()}
    for k, members in groups.items():
        mean = np.mean([points[i] for i in members], axis=0)
        assert picks[k] == min(sorted(members), key=lambda i: ((np.array(points[i]) - mean) ** 2).sum())


def test_ward_of_little(spark):
    one = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert ward.merges(one, "id", "v").count() == 0
    assert [tuple(r) for r in ward.ward(one, "id", "v", 2).collect()] == [(1, 1)]
    assert ward.merges(one.filter("id > 1"), "id", "v").count() == 0


def test_messages_equal_a_loop_over_edges(spark):
    r = np.random.default_rng(3)
    ends = [(int(a), int(b)) for a, b in r.integers(0, 8, (30, 2))] + [(0, 1), (1, 0), (0, 1), (3, 3)]
    x = r.normal(size=(len(ends), 3))
    layer = lambda a, b, relu=True: messages.Layer(r.normal(size=(a, b)), r.normal(size=b), relu)
    first, message, out = [layer(3, 4, False)], [layer(8, 5), layer(5, 4, False)], [layer(6, 4), layer(4, 2, False)]

    def run(layers, v):
        for one in layers:
            v = one(v)
        return v

    state = run(first, x)
    for _ in range(3):
        new = np.zeros_like(state)
        for i, (s, t) in enumerate(ends):
            into = [state[j] for j, (a, b) in enumerate(ends) if b == s and a != t]
            new[i] = run(message, np.concatenate([state[i], np.sum(into, axis=0) if into else np.zeros(4)])[None])[0]
        state = state + new
    rows = [(i, a, b, [float(y) for y in v]) for i, ((a, b), v) in enumerate(zip(ends, x, strict=True))]
    edges = spark.createDataFrame([*rows, (99, None, 1, [1.0] * 3), (98, 1, 2, None)], "id long, src long, dst long, f array<double>").repartition(3)
    found = messages.passed(edges, "f", first, message, 3)
    got = {e["id"]: e["state"] for e in found.collect()}
    assert set(got) == set(range(len(ends)))
    assert np.allclose([got[i] for i in range(len(ends))], state)
    nodes = [(n, [0.5, float(n)]) for n in range(9)]
    atoms = messages.read_out(spark.createDataFrame(nodes, "node long, x array<double>"), "node", "x", found, out)
    got = {n["node"]: n["state"] for n in atoms.collect()}
    for n, f in nodes:
        into = [state[j] for j, (_, b) in enumerate(ends) if b == n]
        assert np.allclose(got[n], run(out, np.concatenate([f, np.sum(into, axis=0) if into else np.zeros(4)])[None])[0])
    whole = messages.pooled(atoms.selectExpr("node % 2 AS g", "state"), "g", 2)
    assert np.allclose({g["g"]: g["state"] for g in whole.collect()}[0], np.mean([got[n] for n in range(0, 9, 2)], axis=0))


REACTIONS = [
    (1, "T", ["A", "B"], 5.0), (2, "T", ["C"], 20.0), (3, "A", ["x", "y"], 1.0), (4, "B", ["A", "x"], 2.0), (5, "C", ["T"], 1.0),
    (6, "A", ["B"], 1.0), (7, "D", ["missing"], 1.0), (8, "B", ["y", "y"], 30.0), (9, None, ["x"], 1.0), (10, "E", [], 1.0), (11, "A", ["z"], None),
]
STOCK = [("x", 1.0), ("y", 2.0), ("C", 50.0), ("x", 3.0), (None, 1.0), ("q", None)]


def derivations(depth):
    """All acyclic derivations by plain recursion: price and the tuple of steps."""
    shelf = {}
    for i, p in STOCK:
        if i is not None and p is not None:
            shelf[i] = min(p, shelf.get(i, p))
    rules = [(r, p, x, c) for r, p, x, c in REACTIONS if p and x and c is not None]

    def make(item, above, left):
        found = [(shelf[item], ())] if item in shelf else []
        for r, p, x, c in rules:
            if p == item and left and item not in above:
                for combo in itertools.product(*(make(i, above | {item}, left - 1) for i in x)):
                    found.append((c + sum(d[0] for d in combo), ((r, item), *(s for d in combo for s in d[1]))))
        return found

    return {i: sorted(make(i, frozenset(), depth)) for i in {*"TABCDExy"}}


def test_prices_and_routes(spark):
    reactions = spark.createDataFrame(REACTIONS, "reaction long, product string, reactants array<string>, cost double")
    stock = spark.createDataFrame(STOCK, "item string, price double")
    want = {i: d for i, d in derivations(8).items() if d}
    found = {r["item"]: r for r in synthesis.prices(reactions, stock).collect()}
    assert {i: r["price"] for i, r in found.items()} == {i: d[0][0] for i, d in want.items()}
    assert found["T"]["reaction"] == 1 and found["x"]["reaction"] is None
    one_deep = {r["item"]: r["price"] for r in synthesis.prices(reactions, stock, 1).collect()}
    assert "T" not in one_deep or one_deep["T"] == 70.0
    best = synthesis.routes(reactions, stock, 3, 8)
    rows = {(r["item"], r["rank"]): r for r in best.collect()}
    for item, ds in want.items():
        assert rows[item, 1]["price"] == ds[0][0]
        prices_ = [rows[item, k]["price"] for k in (1, 2, 3) if (item, k) in rows]
        assert prices_ == sorted(prices_) and all(p in {d[0] for d in ds} for p in prices_)
    acyclic = spark.createDataFrame([x for x in REACTIONS if x[0] not in (5, 6)], reactions.schema)
    top = [r["price"] for r in synthesis.routes(acyclic, stock, 2, 8).filter("item = 'T'").orderBy("rank").collect()]
    rules = [d for d in derivations(8)["T"] if not any(s[0] in (5, 6) for s in d[1])]
    assert top == [d[0] for d in rules][:2]
    steps = synthesis.route_steps(best.filter("item = 'T' AND rank = 1"), reactions).orderBy("step").collect()
    assert [(s["reaction"], s["product"]) for s in steps] == list(want["T"][0][1])
    metrics = synthesis.route_metrics(best.filter("item = 'T' AND rank = 1"), reactions).first()
    assert (metrics["n_steps"], metrics["n_joins"], metrics["n_blocks"], metrics["route_type"]) == (4, 4, 2, "convergent")


def test_routes_of_nothing(spark):
    none = spark.createDataFrame([], "reaction long, product string, reactants array<string>, cost double")
    stock = spark.createDataFrame([("x", 1.0)], "item string, price double")
    assert [(r["item"], r["price"]) for r in synthesis.prices(none, stock).collect()] == [("x", 1.0)]
    assert synthesis.routes(none, stock.limit(0)).count() == 0


def test_cliff_differences_and_opposite_sides(spark):
    r = random.Random(15)
    rows = [(i, sorted(r.sample(range(12), 6)), r.uniform(0, 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, bits array<int>, y double")
    edges = [(a, b, rows[a][2], rows[b][2]) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.04]
    cliffs_ = spark.createDataFrame(edges, "a long, b long, activity_a double, activity_b double")
    for x in cliffs.differences(cliffs_, df, "id", "bits").collect():
        a, b = set(rows[x["a"]][1]), set(rows[x["b"]][1])
        assert (x["only_a"], x["only_b"], x["n_common"]) == (sorted(a - b), sorted(b - a), len(a & b))
    sides = {x["id"]: x["split"] for x in cliffs.opposite_split(df, "id", cliffs_, 0.3).collect()}
    assert len(sides) == 60 and 8 <= sum(s == "test" for s in sides.values()) <= 28
    assert not any(sides[a] == sides[b] == "test" for a, b, _, _ in edges)
    folded = cliffs.cliff_folds(df, "id", cliffs_, 3)
    fold = {x["id"]: x["fold"] for x in folded.collect()}
    assert all(fold[a] == fold[b] for a, b, _, _ in edges)
    shares = cliffs.fold_shares(folded, "id", "fold", cliffs_).collect()
    assert sum(x["n_rows"] for x in shares) == 60 and sum(x["n_cliffs"] for x in shares) == len(edges) and not any(x["n_cut"] for x in shares)
