"""Structured Streaming forms of plate quality, drift, sessions and keep-first deduplication.

Each takes a streaming (or batch) DataFrame with a timestamp column and returns one; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ratio


def events_stream(spark: SparkSession, folder: str, schema, glob: str = "events*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, as a zoned timestamp ``ts``."""
    df = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def plate_quality(df: DataFrame, positive: Column, negative: Column, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Z' and counts of each plate and window; rows later than ``late`` are left out."""
    p, n = F.when(positive, F.col("value")), F.when(negative, F.col("value"))
    agg = df.withWatermark("ts", late).groupBy(F.window("ts", window), by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.stddev_pop(p).alias("sp"), F.avg(n).alias("mn"), F.stddev_pop(n).alias("sn")
    )
    return agg.select(F.col("window.start").alias("start"), by, "n", (1 - ratio(3 * (F.col("sp") + F.col("sn")), F.abs(F.col("mp") - F.col("mn")))).alias("z_prime"))


def drift(df: DataFrame, y: str, p: str, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Error of predictions over sliding windows."""
    e = F.col(y) - F.col(p)
    agg = df.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return agg.select(F.col("window.start").alias("start"), "n", "rmse", "mae")


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's rows without a pause longer than ``gap``."""
    agg = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def keep_first(df: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the collected table; for tests and backfills."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
