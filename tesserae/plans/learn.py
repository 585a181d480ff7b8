"""Queries that learn: surrogates, domains, clusters, curves, replacements, uncertainty, campaigns and linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import bioisosteres, campaign, clusters, domains, dose, inducing, models, surrogate, uncertainty
from tesserae.plans import register
from tesserae.plans._common import bits, rounded
from tesserae.runtime import table


def _evidence(spark, sf):
    """Parts as evidential outputs: gamma, lambda, alpha, beta and a target."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("gamma"), (F.col("p_size") / 10.0 + 0.5).alias("lam"), (1.2 + F.pmod("p_partkey", F.lit(7)) / 3.0).alias("alpha"), (0.3 + F.pmod("p_partkey", F.lit(5)) / 4.0).alias("beta"), (F.col("p_retailprice") / 1000 + F.pmod("p_partkey", F.lit(11)) / 20.0 - 0.2).alias("y"))


_E = "e AS (SELECT p_partkey AS id, p_retailprice / 1000 AS gamma, p_size / 10.0::DOUBLE + 0.5::DOUBLE AS lam, 1.2::DOUBLE + (p_partkey % 7) / 3.0::DOUBLE AS alpha, 0.3::DOUBLE + (p_partkey % 5) / 4.0::DOUBLE AS beta, p_retailprice / 1000 + (p_partkey % 11) / 20.0::DOUBLE - 0.2::DOUBLE AS y FROM part)"


@register("uncertainty_nig", f"WITH {_E} SELECT id, round(gamma, 6) AS mean, round(sqrt(beta / (alpha - 1)), 6) AS aleatoric, round(sqrt(beta / (alpha - 1) / lam), 6) AS epistemic FROM e")
def nig(spark, sf):
    made = uncertainty.nig(*(F.col(c) for c in ("gamma", "lam", "alpha", "beta")))
    return rounded(_evidence(spark, sf).select("id", *(c.alias(n) for n, c in made.items())))


@register("uncertainty_evidential_loss", f"""WITH {_E}, l AS (SELECT 0.5 * ln(pi() / lam) - alpha * ln(2 * beta * (1 + lam)) + (alpha + 0.5) * ln(lam * (y - gamma) * (y - gamma) + 2 * beta * (1 + lam)) + lgamma(alpha) - lgamma(alpha + 0.5) + abs(y - gamma) * (2 * alpha + lam) AS v FROM e)
    SELECT round(avg(v), 6) AS evidential_loss FROM l""")  # fmt: skip
def evidential(spark, sf):
    return rounded(uncertainty.evidential_loss(_evidence(spark, sf), "gamma", "lam", "alpha", "beta", "y"))


_M = "l_extendedprice / 1000 AS m1, l_quantity * 1.4 AS m2, l_quantity * 1.2 + l_linenumber AS m3"


@register("uncertainty_ensemble", f"WITH m AS (SELECT l_orderkey, l_linenumber, {_M} FROM lineitem), a AS (SELECT *, (m1 + m2 + m3) / 3 AS m FROM m) SELECT l_orderkey, l_linenumber, round(m, 6) AS mean, round(sqrt(((m1 - m) * (m1 - m) + (m2 - m) * (m2 - m) + (m3 - m) * (m3 - m)) / 2), 6) AS std FROM a")
def ensemble(spark, sf):
    rows = table(spark, sf, "lineitem")
    made = uncertainty.ensemble([F.col("l_extendedprice") / 1000, F.col("l_quantity") * 1.4, F.col("l_quantity") * 1.2 + F.col("l_linenumber")])
    return rounded(rows.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in made.items())))


@register("uncertainty_passes", "SELECT user_id, count(value) AS n_passes, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def passes(spark, sf):
    return rounded(uncertainty.passes(table(spark, sf, "events"), "user_id", "value"))


@register("uncertainty_unscaled", "WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d FROM part) SELECT p_partkey, round(p_size / 10.0::DOUBLE * d + m, 4) AS price FROM part, s")
def unscaled(spark, sf):
    p = table(spark, sf, "part")
    stats = p.agg(F.avg("p_retailprice").alias("mean_price"), F.stddev_pop("p_retailprice").alias("std_price"))
    return rounded(uncertainty.unscaled(p.select("p_partkey", (F.col("p_size") / 10.0).alias("price")), stats, ["price"]), 4)


@register("uncertainty_correlation", """WITH r AS (SELECT abs(l_extendedprice / 1000 - l_quantity * 1.4) AS e, l_quantity + l_linenumber AS s FROM lineitem),
    k AS (SELECT rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs FROM r) SELECT round(corr(re, rs), 6) AS uncertainty_correlation FROM k""")  # fmt: skip
def error_correlation(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.4).alias("p"), (F.col("l_quantity") + F.col("l_linenumber")).alias("s"))
    return rounded(uncertainty.error_correlation(t, "y", "p", "s"))


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.filter("vec_id % 5 <> 0"), e.filter("vec_id % 5 = 0")


@register("domain_leverage", """WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), t AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) + 1e-6 AS va, var_samp(b) + 1e-6 AS vb, covar_samp(a, b) AS c FROM x WHERE vec_id % 5 <> 0),
    d AS (SELECT vec_id, ((a - ma) * (a - ma) * vb - 2 * (a - ma) * (b - mb) * c + (b - mb) * (b - mb) * va) / (va * vb - c * c) AS d, 6.0 / n AS h FROM x, t WHERE vec_id % 5 = 0) SELECT vec_id, round(d, 5) AS distance, round(h, 5) AS threshold, d <= h AS in_domain, round(greatest(0, least(1, 1 - d / h)), 5) AS reliability FROM d""")  # fmt: skip
def leverage(spark, sf):
    train, rows = (x.select("vec_id", F.slice("embedding", 1, 2).alias("v")) for x in _vectors(spark, sf))
    return rounded(domains.leverage(train, rows, "vec_id", "v"), 5)


@register("domain_lof", """WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT * FROM x WHERE id % 5 <> 0), p AS (SELECT a.id AS q, b.id AS n, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM x a JOIN t b ON a.id <> b.id),
    k AS (SELECT * FROM p WHERE r <= 5), h AS (SELECT q, max(d) AS reach FROM k WHERE q % 5 <> 0 GROUP BY 1), l AS (SELECT k.q, 1 / (avg(greatest(d, reach)) + 1e-10) AS lrd FROM k JOIN h ON k.n = h.q GROUP BY 1), f AS (SELECT k.q, avg(b.lrd) / any_value(a.lrd) AS lof FROM k JOIN l a ON k.q = a.q JOIN l b ON k.n = b.q WHERE k.q % 5 = 0 GROUP BY 1)
    SELECT q AS vec_id, round(lof, 5) AS distance, 1.5 AS threshold, lof <= 1.5 AS in_domain, round(greatest(0, least(1, 1 - lof / 10)), 5) AS reliability FROM f""")  # fmt: skip
def lof(spark, sf):
    return rounded(domains.local_outlier(*_vectors(spark, sf), "vec_id", "embedding", 5), 5)


@register("domain_isolation")
def isolation(spark, sf):
    return rounded(domains.isolation(*_vectors(spark, sf), "vec_id", "embedding"))


@register("domain_votes")
def votes(spark, sf):
    train, rows = _vectors(spark, sf)
    each = {"leverage": lambda: domains.leverage(train, rows, "vec_id", "embedding"), "isolation": lambda: domains.isolation(train, rows, "vec_id", "embedding")}
    return rounded(domains.votes(domains.together(each, "vec_id"), "vec_id"))


@register("cluster_rows")
def cluster_rows(spark, sf):
    return rounded(clusters.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)[0].drop("embedding"))


@register("cluster_picks")
def cluster_picks(spark, sf):
    return rounded(clusters.pick(table(spark, sf, "embeddings"), "vec_id", "embedding", 8))


@register("cluster_split")
def cluster_split(spark, sf):
    return clusters.split(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@register("dose_fit")
def dose_fit(spark, sf):
    """Events as wells: an event type is a compound, the day of the month its dose."""
    e = table(spark, sf, "events").select("event_type", F.dayofmonth("ts").cast("double").alias("dose"), (F.col("value") % 100).alias("response"))
    return rounded(dose.fit(e, "event_type", "dose", "response"), 3)


def _molecules(spark, sf):
    """Parts as molecules: two fragments that rules name, by key, and counts."""
    known = sorted({r[0] for rules in bioisosteres.RULES.values() for r in rules})
    all_ = F.array(*(F.lit(x) for x in known))
    key, n = F.col("p_partkey"), F.lit(len(known))
    pair = F.array(F.element_at(all_, (F.pmod(key, n) + 1).cast("int")), F.element_at(all_, (F.pmod(key * 3 + 1, n) + 1).cast("int")))
    return table(spark, sf, "part").select(key.alias("id"), pair.alias("fragments"), (F.col("p_size") / 50.0).alias("likeness"), (1 + F.pmod(key, F.lit(9))).cast("double").alias("sa"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KNOWN = ", ".join(_quoted(x) for x in sorted({r[0] for rules in bioisosteres.RULES.values() for r in rules}))
_RULES = ", ".join(f"({', '.join(map(_quoted, (kind, *r)))})" for kind, rules in bioisosteres.RULES.items() for r in rules)


@register("bioisostere_suggestions", f"""WITH r(kind, original, replacement, name, effect) AS (VALUES {_RULES}), k AS (SELECT [{_KNOWN}] AS l), m AS (SELECT p_partkey AS id, unnest(list_distinct([l[p_partkey % len(l) + 1], l[(p_partkey * 3 + 1) % len(l) + 1]])) AS f, 2 * (p_size / 50.0::DOUBLE) + (10 - (1 + p_partkey % 9)) / 10.0::DOUBLE AS score FROM part, k),
    s AS (SELECT DISTINCT id, kind, original, replacement, name, effect, score FROM m JOIN r ON f = original) SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY name COLLATE C, kind, original, replacement) AS rank, kind, original, replacement, name, effect, round(score, 6) AS score FROM s) WHERE rank <= 10""".replace(" COLLATE C", ""))  # fmt: skip
def suggestions(spark, sf):
    score = bioisosteres.composite(F.col("likeness"), F.col("sa"), F.lit(None).cast("double"))
    return rounded(bioisosteres.suggest(_molecules(spark, sf), "id", "fragments", bioisosteres.rules(spark), score))


def _observations(spark, sf):
    return bits(spark, sf).select("vec_id", F.slice("embedding", 1, 6).alias("v"), "activity")


@register("surrogate_predictions")
def predictions(spark, sf):
    rows = _observations(spark, sf)
    model = surrogate.fit(rows.filter("vec_id % 10 = 1"), "v", "activity", restarts=0)
    return rounded(surrogate.predict(model, rows, "v").drop("v"), 4)


@register("surrogate_next")
def select_next(spark, sf):
    rows = _observations(spark, sf)
    return rounded(surrogate.BayesianOptimizer("vec_id", "v", "activity").fit(rows.filter("vec_id % 10 = 1")).select_next(rows, 5), 4)


@register("surrogate_inducing")
def surrogate_inducing(spark, sf):
    """Nine of ten rows are observations, all rows are scored."""
    rows = bits(spark, sf).select("vec_id", F.col("embedding").alias("v"), "activity")
    model = inducing.fit(rows.filter("vec_id % 10 <> 1"), "vec_id", "v", "activity", points=128, tuned=200)
    return rounded(surrogate.predict(model, rows, "v").drop("v"), 4)


@register("surrogate_multi")
def surrogate_multi(spark, sf):
    """Two values at once: the first direction high, the second low."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 3, 8).alias("v"), F.element_at("embedding", 1).cast("double").alias("up"), F.element_at("embedding", 2).cast("double").alias("down"))
    loop = inducing.MultiObjective("vec_id", "v", {"up": "maximize", "down": "minimize"}, points=64).fit(rows.filter("vec_id % 4 = 0"))
    return rounded(loop.select_next(rows, 10), 4)


@register("surrogate_campaign")
def surrogate_campaign(spark, sf):
    rows = _observations(spark, sf)
    return rounded(surrogate.rounds(surrogate.BayesianOptimizer("vec_id", "v", "activity").fit(rows.filter("vec_id % 10 = 1")), rows, rows, 3, 3), 4)


@register("campaign_summary", "SELECT event_type AS campaign, count(*) AS n_results, sum(user_id) AS total_predictions, sum(day(ts)) AS total_experimental, round(avg(value), 6) AS mean_hit_rate FROM events GROUP BY 1")
def campaign_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("campaign"), F.col("user_id").alias("n_predictions"), F.dayofmonth("ts").alias("n_experimental"), F.col("value").alias("hit_rate"))
    return rounded(campaign.summary(e))


_ROUNDS = "SELECT l_linenumber::BIGINT AS round, count(*) AS n, avg(y) AS mean_observed, max(y) AS max_observed, min(y) AS min_observed, stddev_pop(y) AS std_observed, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(s) AS mean_uncertainty, max(s) AS max_uncertainty FROM (SELECT l_linenumber, l_extendedprice / 1000 AS y, l_quantity * 1.4 AS p, l_quantity / 10.0::DOUBLE AS s FROM lineitem) GROUP BY 1"


def _rounds(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("round"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.4).alias("p"), (F.col("l_quantity") / 10.0).alias("s"))
    return campaign.round_metrics(t, "round", "y", "p", "s")


@register("campaign_rounds", f"SELECT round, n, {', '.join(f'round({c}, 4) AS {c}' for c in 'mean_observed max_observed min_observed std_observed mae rmse mean_uncertainty max_uncertainty'.split())} FROM ({_ROUNDS})")
def campaign_rounds(spark, sf):
    return rounded(_rounds(spark, sf), 4)


@register("campaign_trend", f"WITH r AS ({_ROUNDS}) SELECT count(*) AS n_rounds, sum(n)::BIGINT AS n_samples, round(max(max_observed), 4) AS best_observed, round(arg_min(mean_uncertainty, round), 4) AS first_uncertainty, round(arg_max(mean_uncertainty, round), 4) AS last_uncertainty, arg_max(mean_uncertainty, round) < arg_min(mean_uncertainty, round) AS reduced FROM r")
def campaign_trend(spark, sf):
    return rounded(campaign.round_trend(_rounds(spark, sf), "round"), 4)


_P = "(SELECT p_partkey AS id, p_retailprice / 100 AS price, p_size::DOUBLE AS size FROM part)"


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("price"), F.col("p_size").cast("double").alias("size"))


@register("portfolio_metrics", f"SELECT count(*) AS n, round(avg(size), 6) AS mean_size, max(size) AS max_size, round(sum(price), 4) AS total_cost, round(avg(price), 6) AS mean_cost FROM {_P}")
def portfolio_metrics(spark, sf):
    out = campaign.portfolio_metrics(_parts(spark, sf), ["size"], "price")
    return rounded(out.withColumn("total_cost", F.round("total_cost", 4)))


@register("portfolio_spread", f"WITH p AS (SELECT * FROM {_P} WHERE id <= 40) SELECT round(avg(d), 6) AS mean_distance, round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance FROM (SELECT sqrt((a.price - b.price) ** 2 + (a.size - b.size) ** 2) AS d FROM p a JOIN p b ON a.id < b.id)")
def portfolio_spread(spark, sf):
    """Of a portfolio of 40 parts."""
    rows = _parts(spark, sf).filter("id <= 40").select("id", F.array("price", "size").alias("v"))
    return rounded(campaign.portfolio_spread(rows, "id", "v"))


@register("portfolio_utility", f"SELECT id, round(price, 4) AS price, size, round(ln(size) - price / 10, 6) AS utility FROM {_P} ORDER BY ln(size) - price / 10 DESC, id LIMIT 25")
def portfolio_utility(spark, sf):
    found = campaign.by_utility(_parts(spark, sf), "id", lambda p, s: F.log(s) - p / 10, ["price", "size"], 25)
    return found.select("id", F.round("price", 4).alias("price"), "size", F.round("utility", 6).alias("utility"))


@register("acquisition_penalised")
def acquisition_penalised(spark, sf):
    return rounded(campaign.batch_penalised(_parts(spark, sf), "id", "price", "size", F.col("price") + 0.1 * F.col("size"), 5))


@register("design_adaptive", f"SELECT id FROM {_P} ORDER BY price + 0.25 * size DESC, id LIMIT 30")
def design_adaptive(spark, sf):
    return campaign.adaptive(_parts(spark, sf), "id", "price", "size", 30, 0.25).select("id")


@register("design_hybrid")
def design_hybrid(spark, sf):
    return campaign.hybrid(_parts(spark, sf), "id", "price", "size", ["price", "size"], 20, 0.5)


def _regression(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), (F.col("l_extendedprice") / 1000).cast("double").alias("y"))


@register("model_line", "SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 5) AS weight, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS intercept FROM lineitem")
def model_line(spark, sf):
    line = models.fit(_regression(spark, sf), ["quantity"], "y", 0.0)
    return spark.createDataFrame([(round(line.weights[0], 5), round(line.intercept, 4))], "weight double, intercept double")


@register("model_cross_validation")
def model_cv(spark, sf):
    rows = _regression(spark, sf)
    chosen = models.selected(rows, ["quantity", "discount", "tax"], "y", 2)
    return rounded(models.cross_validated(rows, chosen, "y", "id"), 4)


@register("model_importance")
def model_importance(spark, sf):
    rows = _regression(spark, sf)
    return rounded(models.permuted(rows, models.fit(rows, ["quantity", "discount", "tax"], "y"), "y", "id"), 3)
