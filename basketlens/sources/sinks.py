"""Sinks: partitioned tables, JSON and CSV exports, run logs, alert messages, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.text import escape_html


def append_table(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted where a value needs it, with a header in every file."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def run_record(chain: str, source: str, started: Column, finished: Column, counts: DataFrame, warnings: list[str]) -> DataFrame:
    """One row of the run log from a one-row table of counts (scraped, matched, queued, changes, deactivated)."""
    return counts.select(
        F.lit(chain).alias("chain"), F.lit(source).alias("source"), started.alias("started_at"), finished.alias("finished_at"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("scraped", "matched", "queued", "changes", "deactivated")), F.array(*(F.lit(w) for w in warnings)).cast("array<string>").alias("warnings"),
    )


def alert_messages(hits: DataFrame) -> DataFrame:
    """Rows (email, subject, body) for a mailer: one for each subscriber and alert, from (email, word, name, price)."""
    line = F.concat(escape_html(F.col("name")), F.lit(": "), F.format_number("price", 2), F.lit(" €"))
    by = hits.withColumn("line", line).groupBy("email", "word").agg(F.array_join(F.sort_array(F.collect_set("line")), "<br>").alias("body"))
    return by.select("email", F.concat(F.lit("Offers for "), "word").alias("subject"), "body")


def sitemap(base: str, ids: DataFrame, pages: list[str]) -> DataFrame:
    """(url, priority) of fixed pages and of one page an id."""
    fixed = ids.sparkSession.createDataFrame([(f"{base}/{p}".rstrip("/"), 1.0) for p in pages], "url string, priority double")
    return fixed.unionByName(ids.select(F.concat(F.lit(f"{base}/offer/"), F.col("id").cast("string")).alias("url"), F.lit(0.6).alias("priority")))


def json_ld(name: Column, price: Column, url: Column, seller: Column) -> Column:
    """schema.org markup of an offer; fields without a value are left out."""
    offer = F.struct(F.lit("Offer").alias("@type"), F.lit("EUR").alias("priceCurrency"), price.alias("price"), url.alias("url"), F.struct(F.lit("Organization").alias("@type"), seller.alias("name")).alias("seller"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), name.alias("name"), offer.alias("offers")))
