"""Queries that evaluate predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import normal_cdf_sql
from tesserae.operators import calibration, concordance, metrics, prospective, significance
from tesserae.plans import register
from tesserae.plans._common import rounded
from tesserae.runtime import table


def _predictions(spark, sf):
    """Prices and a rough prediction of them, by return flag."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.4).alias("p"), (F.col("l_discount") * 100 + 5).alias("u"), "l_shipdate")


_P = "t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 1.4 AS p, l_discount * 100 + 5 AS u, l_shipdate FROM lineitem)"
_REG = "count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) AS r2"
_REG2 = ", round(100 * avg(abs((y - p) / (y + 1e-10))), 6) AS mape, round(avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) * (y - p) ELSE abs(y - p) - 0.5 END), 6) AS huber"


@register("metrics_regression", f"WITH {_P} SELECT {_REG}{_REG2} FROM t")
def regression(spark, sf):
    return rounded(metrics.regression(_predictions(spark, sf), "y", "p"))


@register("metrics_multitask", f"WITH {_P}, e AS (SELECT l_returnflag AS task, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM t GROUP BY 1) SELECT task, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM e UNION ALL SELECT '(all)', sum(n)::BIGINT, round(sum(rmse * n) / sum(n), 6), round(sum(mae * n) / sum(n), 6), round(sum(r2 * n) / sum(n), 6) FROM e")
def multitask(spark, sf):
    return rounded(metrics.multitask(_predictions(spark, sf), "l_returnflag", "y", "p"))


_RANK = "{f} AS (SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{c} FROM {t})"


@register("metrics_spearman", f"WITH {_P}, {_RANK.format(f='a', c='y', t='t')}, {_RANK.format(f='b', c='p', t='a')} SELECT round(corr(ry, rp), 6) AS spearman FROM b")
def spearman(spark, sf):
    return rounded(metrics.spearman(_predictions(spark, sf), "y", "p"))


@register("metrics_kendall", """WITH c AS (SELECT quality AS y, toxic AS p, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), s AS (SELECT coalesce(sum(sign(a.y - b.y) * sign(a.p - b.p) * a.n * b.n), 0) AS s FROM c a JOIN c b ON a.y > b.y),
    t AS (SELECT sum(n) AS n FROM c), ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY y)), tp AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY p))
    SELECT round(s / nullif(sqrt((t.n * (t.n - 1) / 2 - ty.t) * (t.n * (t.n - 1) / 2 - tp.t)), 0), 6) AS kendall FROM s, t, ty, tp""")  # fmt: skip
def kendall(spark, sf):
    return rounded(metrics.kendall_classes(table(spark, sf, "labels"), "quality", "toxic"))


@register("metrics_kendall_continuous", """WITH t AS (SELECT o_totalprice::DOUBLE AS y, c_acctbal::DOUBLE AS p FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT y, p, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
    s AS (SELECT coalesce(sum(sign(a.p - b.p) * a.n * b.n), 0) AS s FROM c a JOIN c b ON a.y > b.y), n AS (SELECT sum(n) AS n FROM c),
    ty AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY y)), tp AS (SELECT sum(m * (m - 1) / 2) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY p))
    SELECT round(s / nullif(sqrt((n * (n - 1) / 2 - ty.t) * (n * (n - 1) / 2 - tp.t)), 0), 6) AS kendall FROM s, n, ty, tp""")  # fmt: skip
def kendall_continuous(spark, sf):
    """Order totals against the balance of the customer."""
    t = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("p"))
    return rounded(concordance.kendall(t, "y", "p"))


@register("metrics_kendall_prices", f"""WITH {_P}, c AS (SELECT y, p, count(*)::DOUBLE AS n FROM t GROUP BY ALL), k AS (SELECT p, y, sum(n) OVER (PARTITION BY p ORDER BY y) AS upto FROM c), m AS (SELECT p, sum(n) AS n FROM c GROUP BY 1),
    g AS (SELECT c.y, c.n, m.p AS q, m.n AS all_q FROM c JOIN m ON m.p < c.p), l AS (SELECT g.*, coalesce(k.upto, 0) AS below FROM g ASOF LEFT JOIN k ON g.q = k.p AND g.y > k.y),
    e AS (SELECT l.*, coalesce(k.upto, 0) AS reach FROM l ASOF LEFT JOIN k ON l.q = k.p AND l.y >= k.y), s AS (SELECT sum(n * (below - (all_q - reach))) AS s FROM e), a AS (SELECT sum(n) AS n FROM c),
    ty AS (SELECT sum(x * (x - 1) / 2) AS t FROM (SELECT sum(n) AS x FROM c GROUP BY y)), tp AS (SELECT sum(x * (x - 1) / 2) AS t FROM (SELECT sum(n) AS x FROM c GROUP BY p))
    SELECT round(s / nullif(sqrt((n * (n - 1) / 2 - ty.t) * (n * (n - 1) / 2 - tp.t)), 0), 6) AS kendall FROM s, a, ty, tp""")  # fmt: skip
def kendall_prices(spark, sf):
    """Prices of all order lines against the rough prediction of them."""
    return rounded(concordance.kendall(_predictions(spark, sf), "y", "p"))


@register("significance_bootstrap_models")
def bootstrap_models(spark, sf):
    """The rough prediction of prices against their mean, in the same draws."""
    t = _predictions(spark, sf).withColumns({"k": F.concat_ws("-", "l_orderkey", "l_linenumber"), "q": F.lit(38.0)})
    return rounded(significance.bootstrap_comparison(t, "k", "y", "p", "q", times=200), 4)


def _scored(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / 20000.0).alias("s"), (F.col("n_chars") > 500).cast("int").alias("p"), F.col("toxic").alias("y2"))


_S = "t AS (SELECT doc_id, quality AS y, n_chars / 20000.0 AS s, (n_chars > 500)::INT AS p, toxic AS y2 FROM labels JOIN documents USING (doc_id))"


@register("metrics_classification", f"""WITH {_S}, c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn FROM t)
    SELECT n, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""")  # fmt: skip
def classification(spark, sf):
    return rounded(metrics.classification(_scored(spark, sf), "y", "p"))


@register("metrics_roc_auc", f"WITH {_S}, {_RANK.format(f='a', c='s', t='t')} SELECT round((sum(rs) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0), 6) AS roc_auc FROM a")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(_scored(spark, sf), "y", "s"))


@register("metrics_pr_auc", f"""WITH {_S}, g AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM t GROUP BY 1), c AS (SELECT s, pos, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY s DESC)),
    l AS (SELECT *, hits / seen AS prec, lag(hits / seen) OVER (ORDER BY s DESC) AS last FROM c) SELECT round(coalesce(sum(pos * (prec + last) / 2) / nullif(sum(pos), 0), 0), 6) AS pr_auc FROM l""")  # fmt: skip
def pr_auc(spark, sf):
    return rounded(metrics.pr_auc(_scored(spark, sf), "y", "s"))


@register("metrics_top_k", f"WITH {_S}, h AS (SELECT * FROM t ORDER BY s DESC, doc_id LIMIT 50), a AS (SELECT count(*) AS k, sum(y)::BIGINT AS n_hits, avg(y) AS hit_rate FROM h), b AS (SELECT avg(y) AS base_rate FROM t) SELECT k, n_hits, round(hit_rate, 6) AS hit_rate, round(base_rate, 6) AS base_rate, round(hit_rate / base_rate, 6) AS enrichment, round(base_rate * k, 6) AS expected_hits FROM a, b")
def top_k(spark, sf):
    return rounded(metrics.top_k(_scored(spark, sf), "y", "s", "doc_id", 50))


@register("metrics_enrichment", f"WITH {_S}, n AS (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT AS k FROM t), h AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM t), a AS (SELECT count(*) AS k, avg(y) AS hit_rate FROM h, n WHERE r <= n.k), b AS (SELECT avg(y) AS base_rate FROM t) SELECT k, round(hit_rate, 6) AS hit_rate, round(base_rate, 6) AS base_rate, round(hit_rate / base_rate, 6) AS enrichment_factor FROM a, b")
def enrichment(spark, sf):
    return rounded(metrics.enrichment_factor(_scored(spark, sf), "y", "s", "doc_id", 0.1))


@register("metrics_bedroc", f"""WITH {_S}, r AS (SELECT y, rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM t), a AS (SELECT count(*) FILTER (y = 1) AS p, count(*)::DOUBLE AS n FROM t),
    s AS (SELECT sum(exp(-20.0 * r / n)) FILTER (y = 1) AS s, any_value(p) AS p, any_value(n) AS n FROM r, a), b AS (SELECT *, exp(-20.0 / n) * (1 - exp(-20.0 * p / n)) / (1 - exp(-20.0 / n)) AS best FROM s), w AS (SELECT *, best * exp(-20.0 * (n - p) / n) AS worst FROM b)
    SELECT round((s - worst) / (best - worst), 6) AS bedroc FROM w""")  # fmt: skip
def bedroc(spark, sf):
    return rounded(metrics.bedroc(_scored(spark, sf), "y", "s"))


@register("metrics_gaussian_nll", f"WITH {_P} SELECT round(avg(0.5 * ln(2 * pi() * u * u) + (y - p) * (y - p) / (2 * u * u)), 6) AS nll FROM t")
def nll(spark, sf):
    return rounded(_predictions(spark, sf).agg(metrics.gaussian_nll(F.col("y"), F.col("p"), F.col("u")).alias("nll")))


_CURVE = "c AS (SELECT least(floor(s * 10), 9)::BIGINT AS bin, count(*) AS n, avg(y2) AS accuracy, avg(s) AS confidence FROM t GROUP BY 1)"


@register("calibration_curve", f"WITH {_S}, {_CURVE} SELECT bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM c")
def curve(spark, sf):
    return rounded(calibration.curve(_scored(spark, sf), "y2", "s"))


@register("calibration_errors", f"WITH {_S}, {_CURVE} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce, round((SELECT avg((y2 - s) * (y2 - s)) FROM t), 6) AS brier FROM c")
def errors(spark, sf):
    return rounded(calibration.errors(_scored(spark, sf), "y2", "s"))


@register("calibration_coverage", f"""WITH {_P}, l(level, z) AS (VALUES (0.5, 0.6744897501960817), (0.68, 0.9944578832097532), (0.9, 1.6448536269514722), (0.95, 1.959963984540054)),
    c AS (SELECT level::DOUBLE AS level, avg((abs(y - p) <= z * u)::INT) AS coverage, avg(2 * z * u) AS mean_width FROM t, l GROUP BY 1) SELECT level, round(coverage, 6) AS coverage, round(mean_width, 6) AS mean_width, round(abs(coverage - level), 6) AS gap, abs(coverage - level) < 0.05 AS calibrated FROM c""")  # fmt: skip
def coverage(spark, sf):
    return rounded(calibration.coverage(_predictions(spark, sf), "y", "p", "u"))


@register("calibration_uncertainty", f"WITH {_P} SELECT l_returnflag, round(avg((abs(y - p) <= u)::INT), 6) AS coverage_1, round(avg((abs(y - p) <= 1.96 * u)::INT), 6) AS coverage_196, round(avg(u), 6) AS sharpness, round(stddev_pop(u), 6) AS spread FROM t GROUP BY 1")
def uncertainty(spark, sf):
    return rounded(calibration.uncertainty(_predictions(spark, sf), "y", "p", "u", ["l_returnflag"]))


@register("calibration_isotonic", f"""WITH {_S}, k AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(y) OVER w AS s, sum(n) OVER w AS n FROM (SELECT least(s, 1.0) AS p, sum(y)::DOUBLE AS y, count(*)::DOUBLE AS n FROM t GROUP BY 1) WINDOW w AS (ORDER BY p)),
    z AS (SELECT i, s, n FROM k UNION ALL SELECT 0, 0, 0), m AS (SELECT a.i AS i, b.i AS j, (b.s - a.s) / (b.n - a.n) AS mean FROM z a JOIN k b ON a.i < b.i),
    l AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS least FROM m)
    SELECT p, round(max(least), 6) AS fitted FROM k JOIN l ON l.i < k.i AND l.j = k.i GROUP BY p""")  # fmt: skip
def isotonic(spark, sf):
    fitted = calibration.isotonic(_scored(spark, sf).withColumn("s", F.least("s", F.lit(1.0))), "y", "s")
    return fitted.withColumn("fitted", F.round("fitted", 6))


@register("significance_paired_t")
def paired_t(spark, sf):
    return rounded(significance.paired_t(_predictions(spark, sf), "y", "p"))


@register("significance_wilcoxon", f"""WITH {_P}, d AS (SELECT y - p AS d, abs(y - p) AS a FROM t WHERE y - p <> 0), r AS (SELECT d, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS r FROM d),
    w AS (SELECT count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w FROM r), z AS (SELECT n, w, (w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24) AS z FROM w)
    SELECT n, round(w, 6) AS statistic, round(z, 6) AS z, round(least(1.0, 2 * {normal_cdf_sql('-abs(z)')}), 6) AS p_value FROM z""")  # fmt: skip
def wilcoxon(spark, sf):
    return rounded(significance.wilcoxon(_predictions(spark, sf), "y", "p"))


@register("significance_mcnemar", f"""WITH {_S}, c AS (SELECT count(*) FILTER (p = y AND y <> 1) AS n10, count(*) FILTER (p <> y AND y = 1) AS n01 FROM t), z AS (SELECT *, coalesce((abs(n01 - n10) - 1) * (abs(n01 - n10) - 1)::DOUBLE / nullif(n01 + n10, 0), 0) AS x FROM c)
    SELECT n10, n01, round(x, 6) AS statistic, round(CASE WHEN n10 + n01 = 0 THEN 1.0 ELSE 2 * {normal_cdf_sql('-sqrt(x)')} END, 6) AS p_value FROM z""")  # fmt: skip
def mcnemar(spark, sf):
    return rounded(significance.mcnemar(_scored(spark, sf).withColumn("q", F.lit(1)), "y", "p", "q"))


@register("significance_permutation")
def permutation(spark, sf):
    return significance.permutation(_scored(spark, sf).withColumn("a", F.col("y").cast("double")), "doc_id", "a", "s", 200)


@register("significance_bootstrap")
def bootstrap(spark, sf):
    return significance.bootstrap(_scored(spark, sf), "doc_id", "s", 200)


@register("significance_corrections", """WITH t AS (SELECT p_brand AS k, exp(-count(*) / 20.0) * 0.2 AS p FROM part GROUP BY 1), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, k) AS i FROM t),
    h AS (SELECT *, min((p < 0.05 / (m - i + 1))::INT) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING) = 1 AS holm, max(CASE WHEN p <= i / m * 0.05 THEN i END) OVER () AS cut FROM r)
    SELECT k, round(p, 9) AS p, p < 0.05 / m AS bonferroni, holm, coalesce(i <= cut, false) AS benjamini_hochberg FROM h""")  # fmt: skip
def corrections(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_brand").alias("k")).agg((F.exp(-F.count(F.lit(1)) / 20.0) * 0.2).alias("p"))
    return rounded(significance.corrected(t, "k", "p"), 9)


@register("prospective_rolling", """WITH e AS (SELECT date_diff('day', min(ts) OVER ()::DATE, ts::DATE) AS d, value::DOUBLE AS y, json_extract_string(props, '$.k')::DOUBLE AS x, ts FROM events), s AS (SELECT unnest(range(0, (SELECT max(floor((d - 10) / 5.0)) FROM e)::BIGINT + 1)) AS step), r AS (SELECT d, y, x FROM e WHERE y IS NOT NULL AND x IS NOT NULL),
    f AS (SELECT step, count(*) AS n_train, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s JOIN r ON d >= 5 * step AND d < 10 + 5 * step GROUP BY 1), t AS (SELECT step, n_train, y, b + a * x AS p FROM f JOIN r ON d >= 10 + 5 * step AND d < 15 + 5 * step)
    SELECT step, n_train, count(*) AS n_test, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM t GROUP BY 1, 2""")  # fmt: skip
def rolling(spark, sf):
    return rounded(prospective.rolling(table(spark, sf, "events").withColumn("x", F.get_json_object("props", "$.k").cast("double")), "ts", "value", "x", 10, 5))


@register("prospective_compared", """WITH p AS (SELECT p_partkey AS k, p_retailprice AS pv, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 50.0 END AS c FROM part), x AS (SELECT l_partkey AS k, avg(l_extendedprice / l_quantity) AS ev FROM lineitem GROUP BY 1), j AS (SELECT *, abs(pv - ev) AS e FROM p JOIN x USING (k))
    SELECT count(*) AS n_matched, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS mae, round(1 - sum(e * e) / (var_pop(ev) * count(*)), 4) AS r2, round(avg((ev >= 1500)::INT), 4) AS hit_rate, round(corr(coalesce(c, 1.0), e), 4) AS confidence_error_corr FROM j""")  # fmt: skip
def compared(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("predicted_value"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50.0).alias("confidence"))
    x = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("experimental_value"))
    return rounded(prospective.compared(p, x, "k", 1500.0), 4)


@register("prospective_drift", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1), i AS (SELECT (row_number() OVER (ORDER BY m) - 1)::DOUBLE AS i, v FROM m),
    s AS (SELECT count(*) AS n, regr_slope(v, i) AS slope, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM i)
    SELECT n, round(slope, 6) AS slope, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, (SELECT count(*) FROM i WHERE abs(v - mean) > 2 * std) AS n_outliers, CASE WHEN slope = 0 THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'declining' END AS direction FROM s""")  # fmt: skip
def drift(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg((F.avg("o_totalprice") / 1000).alias("v"))
    return rounded(prospective.drift(m, "m", "v"))
