"""Queries that curate and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import curate, split
from tesserae.plans import register
from tesserae.plans._common import rounded
from tesserae.runtime import table

_STAGES = "CASE WHEN NOT coalesce(p_name IS NOT NULL, false) THEN 'valid' WHEN NOT coalesce(p_size <= 40, false) THEN 'size' WHEN NOT coalesce(p_retailprice BETWEEN 900 AND 1800, false) THEN 'price' END"


@register("curate_counts", f"""WITH f AS (SELECT {_STAGES} AS s FROM part), n AS (SELECT count(*) AS n FROM f), g(stage, stage_no) AS (VALUES ('valid', 1), ('size', 2), ('price', 3)),
    r AS (SELECT stage, stage_no::BIGINT AS stage_no, (SELECT count(*) FROM f WHERE s = stage) AS removed FROM g)
    SELECT stage, stage_no, removed, (n - sum(removed) OVER (ORDER BY stage_no))::BIGINT AS rows_left, round(100.0 * (n - sum(removed) OVER (ORDER BY stage_no)) / n, 6)::DOUBLE AS retention_rate FROM r, n""")  # fmt: skip
def counts(spark, sf):
    stages = [("valid", F.col("p_name").isNotNull()), ("size", F.col("p_size") <= 40), ("price", F.col("p_retailprice").between(900, 1800))]
    return rounded(curate.stage_counts(table(spark, sf, "part"), stages))


@register("curate_keep_first", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) = 1")
def keep_first(spark, sf):
    return curate.keep_first(table(spark, sf, "part"), ["p_type", "p_size"], ["p_partkey"])


@register("curate_rule_of_five", """WITH v AS (SELECT p_partkey, (p_retailprice / 3 > 500)::INT + (p_size / 8.0 > 5)::INT + (p_size % 9 > 5)::INT + (p_size % 14 > 10)::INT AS n_violations FROM part)
    SELECT p_partkey, n_violations, n_violations <= 1 AS passes FROM v""")  # fmt: skip
def rule_of_five(spark, sf):
    passes, n = curate.rule_of_five(F.col("p_retailprice") / 3, F.col("p_size") / 8.0, F.col("p_size") % 9, F.col("p_size") % 14)
    return table(spark, sf, "part").select("p_partkey", n.alias("n_violations"), passes.alias("passes"))


_RULES = {"license": "(?i)licen[cs]e", "mail": "[a-z0-9.]+@[a-z0-9.]+", "secret": "token = ", "number": "[0-9]{6,}"}


@register("curate_pattern_flags", "WITH r AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN ['license'] ELSE [] END || CASE WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN ['mail'] ELSE [] END || CASE WHEN regexp_matches(text, 'token = ') THEN ['secret'] ELSE [] END || CASE WHEN regexp_matches(text, '[0-9]{6,}') THEN ['number'] ELSE [] END AS l FROM documents) SELECT doc_id, array_to_string(l, ',') AS rules, len(l)::INTEGER AS n_rules FROM r")
def pattern_flags(spark, sf):
    hits = table(spark, sf, "documents").select("doc_id", curate.matched_rules(F.col("text"), _RULES).alias("_l"))
    return hits.select("doc_id", F.array_join("_l", ",").alias("rules"), F.size("_l").alias("n_rules"))


@register("curate_largest_part", "WITH p AS (SELECT doc_id, unnest(string_split(text, '.')) AS x, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents) SELECT doc_id, length(arg_max(x, length(x) * 1000000 - i)) AS size, md5(arg_max(x, length(x) * 1000000 - i)) AS part_md5 FROM p GROUP BY 1")
def largest_part(spark, sf):
    part = curate.largest_part(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(part).cast("long").alias("size"), F.md5(part.cast("binary")).alias("part_md5"))


@register("curate_impute", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders),
    m AS (SELECT avg(price) AS p FROM t), c AS (SELECT priority AS q FROM t WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, round(coalesce(price, p), 4) AS price, coalesce(priority, q) AS priority FROM t, m, c""")  # fmt: skip
def impute(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))
    return rounded(curate.impute(t, {"price": "mean", "priority": "mode"}), 4)


@register("curate_statistics", """WITH t AS (SELECT *, p_size > 5 AS ok FROM part) SELECT count(*) AS n_rows, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid,
    count(p_name) FILTER (ok) - count(DISTINCT p_name) FILTER (ok) AS n_duplicates, round(avg(p_retailprice) FILTER (ok), 6) AS p_retailprice_mean, round(stddev_pop(p_retailprice) FILTER (ok), 6) AS p_retailprice_std,
    round(avg(p_size) FILTER (ok), 6) AS p_size_mean, round(stddev_pop(p_size) FILTER (ok), 6) AS p_size_std FROM t""")  # fmt: skip
def statistics(spark, sf):
    return rounded(curate.statistics(table(spark, sf, "part"), F.col("p_size") > 5, F.col("p_name"), ["p_retailprice", "p_size"]))


@register("curate_z_scale", """WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d FROM part WHERE p_partkey % 5 <> 0) SELECT p_partkey, round((p_retailprice - m) / d, 6) AS p_retailprice FROM part, s""")
def z_scale(spark, sf):
    return rounded(curate.z_scale(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], F.col("p_partkey") % 5 != 0))


_DRAW = "(('0x' || substr(md5('42:' || {k}), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0"


@register("split_random", f"SELECT p_partkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS split FROM (SELECT p_partkey, {_DRAW.format(k='p_partkey')} AS u FROM part)")
def random_split(spark, sf):
    return split.random_split(table(spark, sf, "part"), "p_partkey").select("p_partkey", "split")


@register("split_stratified", f"""WITH u AS (SELECT p_partkey, p_brand, {_DRAW.format(k='p_partkey')} AS u FROM part), q AS (SELECT p_brand, quantile_cont(u, 0.7) AS a, quantile_cont(u, 0.85) AS b FROM u GROUP BY 1)
    SELECT p_partkey, CASE WHEN u <= a THEN 'train' WHEN u <= b THEN 'valid' ELSE 'test' END AS split FROM u JOIN q USING (p_brand)""")  # fmt: skip
def stratified_split(spark, sf):
    return split.exact_split(table(spark, sf, "part"), "p_partkey", by="p_brand").select("p_partkey", "split")


@register("split_temporal", "SELECT CASE WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'train' WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN 'valid' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'test' END AS split, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def temporal_split(spark, sf):
    return split.temporal_split(table(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1997-01-01").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


_GROUPS = "g AS (SELECT p_type, count(*) AS size FROM part GROUP BY 1), o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / (sum(size) OVER ()) AS share FROM g)"


@register("split_by_group", f"WITH {_GROUPS} SELECT p_partkey, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS split FROM part JOIN o USING (p_type)")
def group_split(spark, sf):
    return split.group_split(table(spark, sf, "part"), "p_type").select("p_partkey", "split")


@register("split_by_group_test_first", f"WITH {_GROUPS} SELECT p_partkey, CASE WHEN share < 1 - 0.7 - 0.15 THEN 'test' WHEN share < 1 - 0.7 THEN 'valid' ELSE 'train' END AS split FROM part JOIN o USING (p_type)")
def group_split_test_first(spark, sf):
    return split.group_split(table(spark, sf, "part"), "p_type", fill_first="test").select("p_partkey", "split")


@register("split_group_folds", "WITH g AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS i FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END AS fold FROM part JOIN g USING (p_type)")
def group_folds(spark, sf):
    return split.group_folds(table(spark, sf, "part"), "p_type").select("p_partkey", "fold")


@register("split_statistics", f"""WITH {_GROUPS}, s AS (SELECT part.*, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS split FROM part JOIN o USING (p_type))
    SELECT split, count(*) AS n_rows, count(DISTINCT p_brand) AS n_groups, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std FROM s GROUP BY 1""")  # fmt: skip
def split_statistics(spark, sf):
    return rounded(split.split_statistics(split.group_split(table(spark, sf, "part"), "p_type"), "split", "p_brand", "p_retailprice"))


@register("split_overlap", f"WITH s AS (SELECT p_brand, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'valid' ELSE 'test' END AS split FROM (SELECT p_brand, {_DRAW.format(k='p_partkey')} AS u FROM part)), g AS (SELECT p_brand, count(DISTINCT split) AS n FROM s WHERE split <> 'valid' GROUP BY 1) SELECT count(*) FILTER (n = 2) AS n_shared_groups, count(*) AS n_groups FROM g")
def overlap(spark, sf):
    return split.overlap(split.random_split(table(spark, sf, "part"), "p_partkey"), "split", "p_brand")
