"""Queries over assay readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import assay
from tesserae.plans import register
from tesserae.plans._common import WELLS, rounded, wells


def _controls():
    """The wells of column 1 are positive controls, those of column 12 negative ones."""
    return F.col("c") == 1, F.col("c") == 12


@register("assay_percent_inhibition", f"""WITH {WELLS}, k AS (SELECT plate, avg(value) FILTER (c = 1) AS p, avg(value) FILTER (c = 12) AS n FROM wells GROUP BY plate)
    SELECT event_id, plate, round(100 * (value - n) / nullif(p - n, 0), 6) AS percent_inhibition FROM wells JOIN k USING (plate)""")  # fmt: skip
def percent_inhibition(spark, sf):
    return rounded(assay.percent_inhibition(wells(spark, sf), "value", *_controls(), ["plate"]).select("event_id", "plate", "percent_inhibition"))


@register("assay_z_score", f"""WITH {WELLS}, k AS (SELECT plate, avg(value) AS m, stddev_pop(value) AS s FROM wells GROUP BY plate)
    SELECT event_id, round((value - m) / nullif(s, 0), 6) AS z_score FROM wells JOIN k USING (plate)""")  # fmt: skip
def z_score(spark, sf):
    return rounded(assay.z_score(wells(spark, sf), "value", ["plate"]).select("event_id", "z_score"))


_MAD = "k AS (SELECT plate, median(value) AS med FROM wells GROUP BY plate), d AS (SELECT plate, median(abs(value - med)) AS mad FROM wells JOIN k USING (plate) GROUP BY plate)"


@register("assay_robust_z", f"""WITH {WELLS}, {_MAD}
    SELECT event_id, round(0.6745 * (value - med) / nullif(mad, 0), 6) AS robust_z FROM wells JOIN k USING (plate) JOIN d USING (plate)""")  # fmt: skip
def robust_z(spark, sf):
    return rounded(assay.robust_z_score(wells(spark, sf), "value", ["plate"]).select("event_id", "robust_z"))


@register("assay_b_score", f"""WITH {WELLS}, a AS (SELECT plate, median(value) AS m FROM wells GROUP BY plate), r AS (SELECT plate, r, median(value) AS mr FROM wells GROUP BY ALL),
    c AS (SELECT plate, c, median(value) AS mc FROM wells GROUP BY ALL)
    SELECT event_id, round(value - (mr - m) - (mc - m), 6) AS b_score FROM wells JOIN a USING (plate) JOIN r USING (plate, r) JOIN c USING (plate, c)""")  # fmt: skip
def b_score(spark, sf):
    return rounded(assay.b_score(wells(spark, sf), "value", "r", "c", ["plate"]).select("event_id", "b_score"))


@register("assay_plate_quality", f"""WITH {WELLS}, s AS (SELECT plate, avg(value) FILTER (c = 1) AS mp, stddev_pop(value) FILTER (c = 1) AS sp, avg(value) FILTER (c = 12) AS mn,
      stddev_pop(value) FILTER (c = 12) AS sn, quantile_cont(value, 0.25) FILTER (c NOT IN (1, 12)) AS q1, quantile_cont(value, 0.75) FILTER (c NOT IN (1, 12)) AS q3, count(*) AS n_wells FROM wells GROUP BY plate),
    o AS (SELECT plate, count(*) FILTER (c NOT IN (1, 12) AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))) AS n_outliers FROM wells JOIN s USING (plate) GROUP BY plate),
    z AS (SELECT *, 1 - 3 * (sp + sn) / nullif(abs(mp - mn), 0) AS z_prime, 100 * sp / nullif(mp, 0) AS cv_positive, 100 * sn / nullif(mn, 0) AS cv_negative FROM s JOIN o USING (plate))
    SELECT plate, n_wells, round(z_prime, 6) AS z_prime, round(mp / nullif(sn, 0), 6) AS signal_to_noise, round(mp / nullif(mn, 0), 6) AS signal_to_background, round(cv_positive, 6) AS cv_positive,
      round(cv_negative, 6) AS cv_negative, n_outliers, coalesce(z_prime >= 0.5 AND cv_positive < 20 AND cv_negative < 20, false) AS passed FROM z""")  # fmt: skip
def plate_quality(spark, sf):
    return rounded(assay.plate_quality(wells(spark, sf), "value", *_controls(), ["plate"]))


@register("assay_outliers_iqr", f"""WITH {WELLS}, k AS (SELECT plate, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM wells GROUP BY plate)
    SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM wells JOIN k USING (plate)""")  # fmt: skip
def outliers_iqr(spark, sf):
    return assay.outliers(wells(spark, sf), "value", ["plate"]).select("event_id", "is_outlier")


@register("assay_outliers_zscore", f"""WITH {WELLS}, k AS (SELECT plate, avg(value) AS m, stddev_pop(value) AS s FROM wells GROUP BY plate)
    SELECT event_id, coalesce(abs((value - m) / nullif(s, 0)) > 3, false) AS is_outlier FROM wells JOIN k USING (plate)""")  # fmt: skip
def outliers_zscore(spark, sf):
    return assay.outliers(wells(spark, sf), "value", ["plate"], "zscore").select("event_id", "is_outlier")


@register("assay_outliers_mad", f"""WITH {WELLS}, {_MAD}
    SELECT event_id, coalesce(abs(0.6745 * (value - med) / nullif(mad, 0)) > 3.5, false) AS is_outlier FROM wells JOIN k USING (plate) JOIN d USING (plate)""")  # fmt: skip
def outliers_mad(spark, sf):
    return assay.outliers(wells(spark, sf), "value", ["plate"], "mad").select("event_id", "is_outlier")


@register("assay_replicates", """WITH k AS (SELECT l_partkey, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, count(l_quantity) AS n FROM lineitem GROUP BY 1),
    f AS (SELECT l.l_partkey, l_quantity AS v FROM lineitem l JOIN k ON l.l_partkey = k.l_partkey WHERE n <= 2 OR s = 0 OR abs(l_quantity - m) < 2.0 * s)
    SELECT l_partkey, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n_replicates FROM f GROUP BY 1""")  # fmt: skip
def replicates(spark, sf):
    from tesserae.runtime import table

    return rounded(assay.replicates(table(spark, sf, "lineitem"), "l_quantity", ["l_partkey"]))


@register("assay_hits", f"""WITH {WELLS}, {_MAD}, z AS (SELECT plate, avg(value) AS m, stddev_pop(value) AS s FROM wells GROUP BY plate)
    SELECT event_id, value > 100 AS by_threshold, coalesce((value - m) / nullif(s, 0) > 2, false) AS by_zscore, coalesce((value - med) / nullif(1.4826 * mad, 0) > 3, false) AS by_mad
    FROM wells JOIN k USING (plate) JOIN d USING (plate) JOIN z USING (plate)""")  # fmt: skip
def hits(spark, sf):
    df = assay.hits_by_threshold(wells(spark, sf), "value", 100.0, out="by_threshold")
    df = assay.hits_by_zscore(df, "value", ["plate"], 2.0, out="by_zscore")
    return assay.hits_by_mad(df, "value", ["plate"], 3.0, out="by_mad").select("event_id", "by_threshold", "by_zscore", "by_mad")


@register("assay_activity_class", "SELECT CASE WHEN value >= 75 THEN 'strong' WHEN value >= 50 THEN 'moderate' WHEN value >= 25 THEN 'weak' ELSE 'inactive' END AS activity, count(*) AS n FROM events GROUP BY 1")
def activity_class(spark, sf):
    return wells(spark, sf).groupBy(assay.activity_class(F.col("value")).alias("activity")).agg(F.count(F.lit(1)).alias("n"))


@register("assay_matrix_to_long", f"""WITH {WELLS}, w AS (SELECT r, c, round(avg(value), 6) AS value FROM wells WHERE c <= 4 GROUP BY ALL)
    SELECT r || '' || c AS well, r::VARCHAR AS "row", c::INTEGER AS "column", value FROM w""")  # fmt: skip
def matrix_to_long(spark, sf):
    wide = wells(spark, sf).filter("c <= 4").groupBy(F.col("r").cast("string").alias("r")).pivot("c", [1, 2, 3, 4]).agg(F.round(F.avg("value"), 6))
    return assay.matrix_to_long(wide, "r", ["1", "2", "3", "4"]).filter("value IS NOT NULL")


@register("assay_matrix_to_long_all", f"""WITH {WELLS}, w AS (SELECT r, c, round(avg(value), 6) AS value FROM wells GROUP BY ALL)
    SELECT r || '' || c AS well, r::VARCHAR AS "row", c::INTEGER AS "column", value FROM w""")  # fmt: skip
def matrix_to_long_all(spark, sf):
    days = list(range(1, 32))
    wide = wells(spark, sf).groupBy(F.col("r").cast("string").alias("r")).pivot("c", days).agg(F.round(F.avg("value"), 6))
    return assay.matrix_to_long(wide, "r", [str(d) for d in days]).filter("value IS NOT NULL")


@register("assay_dose_response", """SELECT l_discount AS concentration, round(avg(l_quantity), 6) AS response, round(0 + (100 - 0) / (1 + pow(l_discount / 0.05, 1.0)), 6) AS fitted FROM lineitem WHERE l_discount > 0 GROUP BY 1""")
def dose_response(spark, sf):
    from tesserae.functions import hill
    from tesserae.runtime import table

    rows = table(spark, sf, "lineitem").filter("l_discount > 0").groupBy(F.col("l_discount").alias("concentration")).agg(F.avg("l_quantity").alias("response"))
    rows = rows.withColumn("fitted", hill(F.col("concentration"), 0.0, 100.0, 0.05, 1.0))
    return rows.select("concentration", F.round("response", 6).alias("response"), F.round("fitted", 6).alias("fitted"))
