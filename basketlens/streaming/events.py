"""Structured Streaming forms of the event operators; each gives what its batch form gives once the stream has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    rows = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "session_id")
    return rows.withColumn("product_id", F.get_json_object("props", "$.k").cast("long"))


def popularity_stream(events: DataFrame) -> DataFrame:
    """Clicks and heat of each product, as a running count."""
    return events.where("event_type = 'click'").groupBy("product_id").agg(F.count("*").alias("clicks"), (3 * F.count("*")).alias("heat"))


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day and type; a day is final when the watermark has passed it, later events are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("day"), "event_type", "n")
