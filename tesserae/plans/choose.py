"""Queries that compare, select and rank: similarity, acquisition, portfolios, designs, pairs, catalogues and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import BIT_SIMILARITIES, DISTANCES, normal_cdf_sql, normal_pdf_sql
from tesserae.operators import pairs, routes, select, similarity, skyline
from tesserae.operators.graph import components
from tesserae.plans import register
from tesserae.plans._common import BITS, bits, rounded
from tesserae.runtime import table

_TANIMOTO = "len(list_intersect(a.bits, b.bits))::DOUBLE / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)))"
_PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_TANIMOTO} AS similarity, a.activity AS activity_a, b.activity AS activity_b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_TANIMOTO} >= 0.6)"


@register("similar_pairs", f"WITH {BITS}, {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def similar_pairs(spark, sf):
    return rounded(similarity.similar_pairs(bits(spark, sf), "vec_id", "bits", 0.6))


_CLIFFS = "c AS (SELECT *, abs(activity_a - activity_b) AS difference FROM p WHERE abs(activity_a - activity_b) >= 1.0), s AS (SELECT *, CASE WHEN similarity >= 1 THEN 0 ELSE difference / (1 - similarity) END AS sali FROM c)"


@register("activity_cliffs", f"WITH {BITS}, {_PAIRS}, {_CLIFFS} SELECT a, b, round(similarity, 6) AS similarity, round(activity_a, 6) AS activity_a, round(activity_b, 6) AS activity_b, round(difference, 6) AS difference, round(sali, 6) AS sali FROM s")
def activity_cliffs(spark, sf):
    return rounded(similarity.activity_cliffs(bits(spark, sf), "vec_id", "bits", "activity", 0.6))


@register("activity_cliff_summary", f"WITH {BITS}, {_PAIRS}, {_CLIFFS} SELECT count(*) AS n_cliffs, round(avg(sali), 6) AS mean_sali, round(max(sali), 6) AS max_sali, (SELECT count(DISTINCT m) FROM (SELECT a AS m FROM s UNION ALL SELECT b FROM s)) AS n_molecules FROM s")
def cliff_summary(spark, sf):
    return rounded(similarity.cliff_summary(similarity.activity_cliffs(bits(spark, sf), "vec_id", "bits", "activity", 0.6)))


@register("activity_cliff_components", f"""WITH RECURSIVE {BITS}, {_PAIRS}, g AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r(node, reach) AS (SELECT u, u FROM g UNION SELECT r.node, g.v FROM r JOIN g ON r.reach = g.u)
    SELECT node, min(reach) AS comp FROM r GROUP BY 1""")  # fmt: skip
def cliff_components(spark, sf):
    return components(similarity.similar_pairs(bits(spark, sf), "vec_id", "bits", 0.6))


@register("leakage_nearest", f"""WITH {BITS}, t AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, {_TANIMOTO} AS s FROM e a JOIN e b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 WHERE {_TANIMOTO} >= 0.6), m AS (SELECT test_id, max(s) AS s FROM t GROUP BY 1)
    SELECT count(*) AS n_leaked, round(avg(s), 6) AS mean_similarity, (SELECT count(*) FROM e WHERE vec_id % 5 = 0) AS n_test, round(count(*)::DOUBLE / (SELECT count(*) FROM e WHERE vec_id % 5 = 0), 6) AS score FROM m""")  # fmt: skip
def leakage(spark, sf):
    from tesserae.operators.split import leakage as scored

    e = bits(spark, sf)
    test, train = e.filter("vec_id % 5 = 0"), e.filter("vec_id % 5 <> 0")
    met = similarity.similar_to(test, train, "vec_id", "bits", 0.6).withColumnsRenamed({"a": "test_id", "b": "train_id"})
    return rounded(scored(met, test))


_D = "sqrt(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


@register("nearest_neighbours", f"""WITH p AS (SELECT q.vec_id AS query, d.vec_id AS neighbour, {_D} AS distance FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query, neighbour, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM p QUALIFY rank <= 5""")  # fmt: skip
def nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(similarity.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5))


@register("vector_distances", """WITH f AS (SELECT embedding AS x FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, x), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 6) AS euclidean,
    round(list_sum(list_transform(list_zip(embedding, x), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS manhattan, round(1 - list_cosine_similarity(embedding::DOUBLE[], x::DOUBLE[]), 6) AS cosine FROM embeddings, f""")  # fmt: skip
def distances(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("_x"))
    return rounded(e.join(F.broadcast(one), how="inner").select("vec_id", *(f(F.col("embedding"), F.col("_x")).alias(n) for n, f in DISTANCES.items())))


@register("bit_similarities", f"WITH {BITS}, f AS (SELECT bits AS x FROM e WHERE vec_id = 0), m AS (SELECT vec_id, len(list_intersect(bits, x))::DOUBLE AS m, len(bits) + len(x) AS n FROM e, f) SELECT vec_id, round(m / (n - m), 6) AS tanimoto, round(2 * m / n, 6) AS dice FROM m")
def bit_similarities(spark, sf):
    e = bits(spark, sf)
    one = e.filter("vec_id = 0").select(F.col("bits").alias("_x"))
    return rounded(e.join(F.broadcast(one), how="inner").select("vec_id", *(f(F.col("bits"), F.col("_x")).alias(n) for n, f in BIT_SIMILARITIES.items())))


@register("domain_knn", """WITH p AS (SELECT a.vec_id AS q, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON b.vec_id % 5 <> 0), m AS (SELECT q, avg(d) AS d FROM p WHERE r <= 5 GROUP BY 1),
    t AS (SELECT avg(d) + 3 * stddev_pop(d) AS t FROM m WHERE q % 5 <> 0) SELECT q AS vec_id, round(d, 6) AS distance, round(t, 6) AS threshold, d <= t AS in_domain, round(greatest(0, least(1, 1 - d / t)), 6) AS reliability FROM m, t WHERE q % 5 = 0""")  # fmt: skip
def knn_domain(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(similarity.knn_domain(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "vec_id", "embedding"))


@register("domain_box", """WITH b AS (SELECT i, min(embedding[i]) AS lo, max(embedding[i]) AS hi FROM embeddings, range(1, len(embedding) + 1) t(i) WHERE vec_id % 5 <> 0 GROUP BY 1), s AS (SELECT vec_id, avg((embedding[i] BETWEEN lo AND hi)::INT) AS r FROM embeddings, b WHERE vec_id % 5 = 0 GROUP BY 1)
    SELECT vec_id, round(r, 6) AS reliability, r = 1.0 AS in_domain FROM s""")  # fmt: skip
def box_domain(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(similarity.box_domain(e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0"), "vec_id", "embedding"))


@register("domain_conformal", """WITH o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM (SELECT abs(l_extendedprice / 1000 - l_quantity * 1.4) AS r FROM lineitem)),
    p AS (SELECT *, least(1.0, ceil((n + 1) * 0.9::DOUBLE) / n) * (n - 1) AS q FROM o), x AS (SELECT any_value(n) AS n, any_value(q) AS q, max(r) FILTER (i = floor(q)) AS a, max(r) FILTER (i = ceil(q)) AS b FROM p)
    SELECT n, round(a + (q - floor(q)) * (b - a), 3) AS half_width FROM x""")  # fmt: skip
def conformal(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.4).alias("p"))
    return rounded(similarity.conformal(t, "y", "p"), 3)


def _candidates(spark, sf):
    """Parts as candidates: predicted mean and deviation."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("mean"), (F.col("p_size") / 10.0).alias("std"), F.col("p_retailprice").alias("cost"), "p_type", F.col("p_size").cast("double").alias("size"))


_C = "c AS (SELECT p_partkey AS id, p_retailprice / 100 AS mean, p_size / 10.0 AS std, p_retailprice AS cost, p_type, p_size::DOUBLE AS size FROM part)"
_Z = "(mean - 15.0 - 0.01) / std"


@register("acquisition_scores", f"""WITH {_C} SELECT id, round((mean - 15.0 - 0.01) * {normal_cdf_sql(_Z)} + std * {normal_pdf_sql(_Z)}, 6) + 0.0 AS expected_improvement, round({normal_cdf_sql(_Z)}, 6) AS probability_improvement,
    round(mean + 2 * std, 6) AS upper_confidence_bound, round(mean, 6) AS greedy, round(std, 6) AS uncertainty, round(0.5 * ln(1 + std * std / 0.01), 6) AS information_gain FROM c""")  # fmt: skip
def acquisition(spark, sf):
    m, s = F.col("mean"), F.col("std")
    made = {n: f(m, s, F.lit(15.0)) for n, f in select.ACQUISITIONS.items()}
    return rounded(_candidates(spark, sf).select("id", *(c.alias(n) for n, c in made.items()), select.information_gain(s).alias("information_gain")))


@register("acquisition_constrained", f"WITH {_C} SELECT id, round(mean - 2.0 * greatest(0, 0.5 - std / 5), 6) AS score FROM c")
def constrained(spark, sf):
    return rounded(_candidates(spark, sf).select("id", select.penalised(F.col("mean"), F.col("std") / 5, 0.5, 2.0).alias("score")))


@register("acquisition_batch")
def batch(spark, sf):
    return rounded(select.batch_sequential(_candidates(spark, sf), "id", "mean", "std", 15.0, 5))


def _farthest(size: int) -> str:
    """SQL of farthest-point picks, one after the other."""
    steps = ["p1 AS (SELECT id, v, NULL::DOUBLE AS d FROM x ORDER BY id LIMIT 1)", "m1 AS (SELECT x.id, x.v, list_distance(x.v, p1.v) AS d FROM x, p1 WHERE x.id <> p1.id)"]
    for k in range(2, size + 1):
        steps.append(f"p{k} AS (SELECT id, v, d FROM m{k - 1} ORDER BY d DESC, id LIMIT 1)")
        steps.append(f"m{k} AS (SELECT m.id, m.v, least(m.d, list_distance(m.v, p.v)) AS d FROM m{k - 1} m, p{k} p WHERE m.id <> p.id)")
    picks = " UNION ALL ".join(f"SELECT id, {k} AS pick, round(d, 6) AS distance FROM p{k}" for k in range(1, size + 1))
    return f"WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), {', '.join(steps)} {picks}"


@register("diversity_max_min", _farthest(6))
def max_min(spark, sf):
    return rounded(select.max_min(table(spark, sf, "embeddings"), "vec_id", "embedding", 6))


@register("diversity_spheres")
def spheres(spark, sf):
    return select.sphere_exclusion(table(spark, sf, "embeddings"), "vec_id", "embedding", 1.0, 5)


@register("diversity_best_of_groups", f"WITH {_C}, b AS (SELECT p_type, id, mean FROM c QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY mean DESC, id) = 1) SELECT p_type, id, round(mean, 6) AS mean FROM b ORDER BY mean DESC, id LIMIT 10")
def best_of_groups(spark, sf):
    return rounded(select.best_of_groups(_candidates(spark, sf), "id", "p_type", "mean", 10))


_SCALED = "s AS (SELECT *, (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) AS mean_scaled, 1 - (std - min(std) OVER ()) / (max(std) OVER () - min(std) OVER ()) AS std_scaled FROM c)"


@register("portfolio_scalarised", f"WITH {_C}, {_SCALED} SELECT id, round(0.7 * mean_scaled + 0.3 * std_scaled, 6) AS score, round(-greatest(0.7 * -mean_scaled, 0.3 * -std_scaled), 6) AS tchebycheff FROM s")
def scalarised(spark, sf):
    s = select.min_max_scaled(_candidates(spark, sf), {"mean": "maximize", "std": "minimize"})
    w = {"mean_scaled": 0.7, "std_scaled": 0.3}
    return rounded(s.select("id", select.weighted(w).alias("score"), select.tchebycheff(w).alias("tchebycheff")))


#: Parts by price and size, and what is sold of them.
_SALES = "g AS (SELECT p_partkey, p_retailprice AS price, p_size AS size, sum(l_quantity) AS sold, avg(l_discount) AS discount FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"
_BEATEN = "(b.price >= a.price AND b.size <= a.size AND b.sold >= a.sold AND b.discount <= a.discount AND (b.price > a.price OR b.size < a.size OR b.sold > a.sold OR b.discount < a.discount))"


def _sales(spark, sf):
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("sold"), F.avg("l_discount").alias("discount"))
    return table(spark, sf, "part").join(sold, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), "sold", F.round("discount", 9).alias("discount"))


_GOALS = {"price": "maximize", "size": "minimize", "sold": "maximize", "discount": "minimize"}


@register("portfolio_pareto_many", f"WITH {_SALES.replace('avg(l_discount)', 'round(avg(l_discount), 9)')} SELECT p_partkey, round(price, 6) AS price, size, round(sold, 6) AS sold, round(discount, 6) AS discount FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE {_BEATEN})")
def pareto_many(spark, sf):
    return rounded(skyline.pareto_front(_sales(spark, sf), _GOALS))


@register("portfolio_pareto_ranks", f"""WITH {_SALES.replace('avg(l_discount)', 'round(avg(l_discount), 9)')}, f1 AS (SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE {_BEATEN})), r1 AS (SELECT * FROM g ANTI JOIN f1 USING (p_partkey)),
    f2 AS (SELECT * FROM r1 a WHERE NOT EXISTS (SELECT 1 FROM r1 b WHERE {_BEATEN})), r2 AS (SELECT * FROM r1 ANTI JOIN f2 USING (p_partkey)), f3 AS (SELECT * FROM r2 a WHERE NOT EXISTS (SELECT 1 FROM r2 b WHERE {_BEATEN}))
    SELECT p_partkey, 1 AS front FROM f1 UNION ALL SELECT p_partkey, 2 FROM f2 UNION ALL SELECT p_partkey, 3 FROM f3""")  # fmt: skip
def pareto_ranks(spark, sf):
    return skyline.pareto_ranks(_sales(spark, sf), _GOALS, 3).select("p_partkey", "front")


@register("portfolio_pareto", f"WITH {_C} SELECT a.id, round(a.mean, 6) AS mean, round(a.size, 6) AS size FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.mean >= a.mean AND b.size >= a.size AND (b.mean > a.mean OR b.size > a.size))")
def pareto(spark, sf):
    return rounded(select.pareto_front(_candidates(spark, sf).select("id", "mean", "size"), "id", "mean", "size"))


@register("portfolio_budget", f"""WITH RECURSIVE {_C}, o AS (SELECT id, mean, cost, row_number() OVER (ORDER BY mean DESC, id) AS i FROM c),
    f(i, spent, took) AS (SELECT 0::BIGINT, 0::DOUBLE, false UNION ALL SELECT o.i, CASE WHEN f.spent + o.cost <= 20000 THEN f.spent + o.cost ELSE f.spent END, f.spent + o.cost <= 20000 FROM f JOIN o ON o.i = f.i + 1)
    SELECT id, round(mean, 6) AS mean, round(cost, 6) AS cost, row_number() OVER (ORDER BY i) AS pick FROM f JOIN o USING (i) WHERE took""")  # fmt: skip
def budget(spark, sf):
    return rounded(select.within_budget(_candidates(spark, sf), "id", "mean", "cost", 20_000.0, 2000).select("id", "mean", "cost", "pick"))


@register("design_latin_hypercube")
def latin(spark, sf):
    return select.latin_hypercube(_candidates(spark, sf), "id", ["mean", "size"], 20)


@register("design_stratified", f"""WITH {_C}, q AS (SELECT quantile_cont(mean, [0.2, 0.4, 0.6, 0.8]) AS q FROM c), s AS (SELECT id, len(list_filter(q, lambda x: x < mean)) AS stratum, ('0x' || substr(md5('0:' || id), 1, 12))::BIGINT AS u FROM c, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, id) AS r FROM s) SELECT id, stratum FROM r WHERE r <= 4 + (stratum < 3)::INT""")  # fmt: skip
def stratified(spark, sf):
    return select.stratified_pick(_candidates(spark, sf), "id", "mean", 23).select("id", "stratum")


_T = "t AS (SELECT p_partkey AS id, p_brand AS core, p_type AS part, p_retailprice AS v FROM part)"
_MMP = "m AS (SELECT a.core, a.id AS a, b.id AS b, a.part || '>>' || b.part AS transform, b.v - a.v AS change FROM t a JOIN t b ON a.core = b.core AND a.part < b.part)"


def _fragments(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("core"), F.col("p_type").alias("part"), F.col("p_retailprice").alias("v"), "p_size")


@register("matched_pairs", f"WITH {_T}, {_MMP} SELECT core, a, b, transform, round(change, 4) AS change FROM m")
def matched_pairs(spark, sf):
    return rounded(pairs.matched_pairs(_fragments(spark, sf), "id", "core", "part", "v"), 4)


@register("matched_pair_statistics", f"WITH {_T}, {_MMP} SELECT transform, count(change) AS n_pairs, round(avg(change), 4) AS mean_change, round(stddev_samp(change), 4) AS std_change, round(median(change), 4) AS median_change, round(min(change), 4) AS min_change, round(max(change), 4) AS max_change, round(avg(change) / nullif(stddev_samp(change), 0), 4) AS effect_size FROM m GROUP BY 1 HAVING count(*) >= 3")
def transformations(spark, sf):
    return rounded(pairs.statistics(_fragments(spark, sf), "id", "core", "part", "v"), 4)


@register("matched_pair_classes", f"""WITH {_T}, {_MMP} SELECT transform, count(change) AS n_pairs, round(avg(change), 4) AS mean_change, round(stddev_samp(change), 4) AS std_change, round(min(change), 4) AS min_change, round(max(change), 4) AS max_change, round(avg(change) / nullif(stddev_samp(change), 0), 4) AS effect_size
    FROM m GROUP BY 1 HAVING count(*) >= 3""")
def pair_classes(spark, sf):
    return rounded(pairs.paired_statistics(_fragments(spark, sf), "core", "part", "v"), 4)


@register("matched_pair_top", f"WITH {_T}, {_MMP}, s AS (SELECT transform, count(change) AS n_pairs, avg(change) AS mean_change FROM m GROUP BY 1 HAVING count(*) >= 3) SELECT transform, n_pairs, round(mean_change, 4) AS mean_change FROM s ORDER BY s.mean_change DESC, transform LIMIT 10")
def top_pairs(spark, sf):
    stats = pairs.paired_statistics(_fragments(spark, sf), "core", "part", "v")
    return rounded(pairs.top_transformations(stats).select("transform", "n_pairs", "mean_change"), 4)


@register("matched_pair_cliffs", f"WITH {_T}, {_MMP} SELECT core, a, b, transform, round(change, 4) AS change FROM m WHERE abs(change) >= 90")
def cliff_pairs(spark, sf):
    return rounded(pairs.cliffs_of(_fragments(spark, sf), "id", "core", "part", "v", 90), 4)


@register("matched_pair_tests")
def pair_tests(spark, sf):
    return rounded(pairs.tested(pairs.paired_statistics(_fragments(spark, sf), "core", "part", "v")).select("transform", "n_pairs", "p_value", "significant", pairs.transform_type(F.col("transform")).alias("kind")))


@register("free_wilson")
def free_wilson(spark, sf):
    return rounded(pairs.contributions(_fragments(spark, sf), ["core", "part"], "v")[1], 4)


@register("catalogue_search", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice >= 1000 AND p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 50")
def search(spark, sf):
    return routes.search(table(spark, sf, "part"), {"p_size": (10, 20), "p_retailprice": (1000, None)}, {"p_brand": "Brand#11"}, "p_partkey", 50)


@register("catalogue_statistics", "SELECT p_brand, count(*) AS n, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1")
def catalogue(spark, sf):
    return rounded(table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("min_price"), F.max("p_retailprice").alias("max_price"), F.avg("p_retailprice").alias("mean_price")))


_OFFERS = "o AS (SELECT l_partkey, l_suppkey, l_extendedprice / l_quantity AS price, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS lead FROM lineitem)"


def _offers(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("lead"))


@register("catalogue_suppliers", f"WITH {_OFFERS} SELECT l_partkey, count(*) AS n_offers, count(DISTINCT l_suppkey) AS n_suppliers, round(min(price), 6) AS best_price, min(lead) AS fastest FROM o GROUP BY 1")
def suppliers(spark, sf):
    return rounded(routes.suppliers(_offers(spark, sf), "l_partkey", "l_suppkey", "price", "lead").drop("best_supplier"))


@register("catalogue_upsert", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("version"))
    return routes.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 <> 0"), ["o_custkey"], "version").drop("version")


@register("catalogue_cascade", """WITH a AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size < 10), b AS (SELECT l_partkey AS k, min(l_extendedprice) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
    SELECT p_partkey AS k, CASE WHEN a.k IS NOT NULL THEN 'local' WHEN b.k IS NOT NULL THEN 'market' ELSE 'not_found' END AS source, coalesce(a.v, b.v) AS value FROM part LEFT JOIN a ON p_partkey = a.k LEFT JOIN b ON p_partkey = b.k""")  # fmt: skip
def cascade(spark, sf):
    p, l = table(spark, sf, "part"), table(spark, sf, "lineitem")
    local = p.filter("p_size < 10").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("value"))
    market = l.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_extendedprice").alias("value"))
    return routes.cascade(p.select(F.col("p_partkey").alias("k")), "k", {"local": local, "market": market})


_ROUTE = """r AS (SELECT l_orderkey AS route, count(*) AS n_steps, count(*) FILTER (l_quantity > 25) AS n_joins, avg((l_discount > 0.02)::INT) AS available, 1 + avg(l_tax) * 100 AS sa, sum(l_extendedprice) / 100 AS cost FROM lineitem GROUP BY 1),
    s AS (SELECT *, CASE WHEN n_steps <= 2 THEN 1.0 WHEN n_steps <= 4 THEN 0.8 WHEN n_steps <= 6 THEN 0.6 WHEN n_steps <= 8 THEN 0.4 WHEN n_steps <= 10 THEN 0.2 ELSE 0 END::DOUBLE AS step_score,
      CASE WHEN n_steps <= 1 THEN 1.0 ELSE 0.6 + 0.4 * n_joins::DOUBLE / (n_steps - 1) END AS convergence_score,
      CASE WHEN available >= 1 THEN 1.0 WHEN available >= 0.8 THEN 0.8 WHEN available >= 0.6 THEN 0.6 WHEN available >= 0.4 THEN 0.4 WHEN available > 0 THEN 0.2 ELSE 0 END::DOUBLE AS availability_score,
      greatest(0, least(1, 1 - (sa - 1) / 9)) AS sa_score, CASE WHEN cost <= 100 THEN 1.0 WHEN cost <= 500 THEN 0.8 WHEN cost <= 1000 THEN 0.6 WHEN cost <= 5000 THEN 0.4 WHEN cost <= 10000 THEN 0.2 ELSE 0 END::DOUBLE AS cost_score FROM r),
    o AS (SELECT *, 0.25 * step_score + 0.15 * convergence_score + 0.30 * availability_score + 0.25 * sa_score + 0.05 * cost_score AS overall FROM s)"""


@register("route_scores", f"WITH {_ROUTE} SELECT route, round(step_score, 6) AS step_score, round(convergence_score, 6) AS convergence_score, round(availability_score, 6) AS availability_score, round(sa_score, 6) AS sa_score, round(cost_score, 6) AS cost_score, round(overall, 6) AS overall FROM o")
def route_scores(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("l_quantity") > 25).alias("n_joins"), F.avg((F.col("l_discount") > 0.02).cast("double")).alias("available"),
        (1 + F.avg("l_tax") * 100).alias("sa"), (F.sum("l_extendedprice") / 100).alias("cost"),
    )
    made = routes.sub_scores(*(F.col(c) for c in ("n_steps", "n_joins", "available", "sa", "cost")))
    scored = r.withColumns(made).withColumn("overall", routes.overall())
    return rounded(scored.select("route", *made, "overall"))


@register("route_labels", f"WITH {_ROUTE} SELECT CASE WHEN round(overall, 6) >= 0.8 THEN 'excellent' WHEN round(overall, 6) >= 0.6 THEN 'good' WHEN round(overall, 6) >= 0.4 THEN 'moderate' WHEN round(overall, 6) >= 0.2 THEN 'challenging' ELSE 'impractical' END AS label, count(*) AS n FROM o GROUP BY 1")
def route_labels(spark, sf):
    return route_scores(spark, sf).groupBy(routes.label(F.col("overall")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("sa_scores", """WITH c AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN (p_size - 45) * 0.1 ELSE 0 END + 0.5 * ln(p_size % 5 + 1.0) + CASE WHEN p_size % 7 = 0 THEN 0.5 ELSE 0 END + 0.3 * (p_size % 2) + 0.3 * (p_size % 3) + CASE WHEN p_size % 6 > 2 THEN 0.2 * (p_size % 6 - 2) ELSE 0 END + CASE WHEN p_size % 8 > 5 THEN 0.1 * (p_size % 8 - 5) ELSE 0 END AS x FROM part)
    SELECT p_partkey, round(greatest(1.0, least(10.0, 5 + x)), 6) AS sa_score FROM c""")  # fmt: skip
def sa_scores(spark, sf):
    n = F.col("p_size")
    c = routes.sa_complexity(n, n % 5, (n % 7 == 0).cast("int"), n % 2, n % 3, n % 6, n % 8)
    return rounded(table(spark, sf, "part").select("p_partkey", routes.sa_score(c).alias("sa_score")))
