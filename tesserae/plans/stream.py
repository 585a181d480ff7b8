"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae import streaming
from tesserae.plans import register
from tesserae.plans._common import rounded
from tesserae.runtime import table


def _events(spark, sf):
    return streaming.events_stream(spark, sf, table(spark, sf, "events").schema)


@register("stream_sessions", """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")  # fmt: skip
def sessions(spark, sf):
    out = streaming.drained(streaming.sessions(_events(spark, sf), "user_id", "1 day"), f"sessions_{uuid.uuid4().hex}", "complete")
    return rounded(out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total"))


@register("stream_plate_quality", """WITH s AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, avg(value) FILTER (user_id % 8 = 0) AS mp, stddev_pop(value) FILTER (user_id % 8 = 0) AS sp, avg(value) FILTER (user_id % 8 = 7) AS mn, stddev_pop(value) FILTER (user_id % 8 = 7) AS sn FROM events GROUP BY ALL)
    SELECT start::TIMESTAMP AS start, event_type, n, round(1 - 3 * (sp + sn) / nullif(abs(mp - mn), 0), 4) AS z_prime FROM s""")  # fmt: skip
def plate_quality(spark, sf):
    made = streaming.plate_quality(_events(spark, sf), F.col("user_id") % 8 == 0, F.col("user_id") % 8 == 7, "event_type")
    out = streaming.drained(made, f"quality_{uuid.uuid4().hex}", "complete")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@register("stream_drift", """WITH d AS (SELECT ts, value - user_id % 100 AS e FROM events), w AS (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS start, e FROM d)
    SELECT start::TIMESTAMP AS start, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM w GROUP BY 1""")  # fmt: skip
def drift(spark, sf):
    made = streaming.drift(_events(spark, sf).withColumn("p", (F.col("user_id") % 100).cast("double")), "value", "p")
    out = streaming.drained(made, f"drift_{uuid.uuid4().hex}", "complete")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))
