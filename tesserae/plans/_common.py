"""What the query modules share: rounding of doubles and the stand-in relations over the bundled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of additions doesn't show."""
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields))


def wells(spark, sf_dir) -> DataFrame:
    """Assay readings: plate is the event type, row the user's remainder by 8, column the day of the month."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("plate"), F.pmod("user_id", F.lit(8)).alias("r"), F.dayofmonth("ts").alias("c"), "value", "ts")


WELLS = "wells AS (SELECT event_id, event_type AS plate, user_id % 8 AS r, day(ts) AS c, value, ts FROM events)"


def bits(spark, sf_dir) -> DataFrame:
    """Fingerprints: places of the positive values of an embedding, and an activity."""
    from tesserae.functions import set_bits

    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", set_bits(F.col("embedding")).alias("bits"), (F.element_at("embedding", 1).cast("double") * 10).alias("activity"), "label", "embedding")


BITS = "e AS (SELECT vec_id, list_filter(list_transform(range(len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS bits, embedding[1]::DOUBLE * 10 AS activity, label, embedding FROM embeddings)"
