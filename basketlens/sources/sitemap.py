"""Ids from sitemaps: gzipped XML is read as text by Spark, one file a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sitemap_ids(spark: SparkSession, path: str, pattern: str = r"<loc>[^<]*/c/[^<]*?([0-9]+)</loc>") -> DataFrame:
    """Distinct ids of the locations in sitemap files (plain or .gz) that match the pattern's first group."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("id")).distinct()


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, html) of saved pages."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("html"))
