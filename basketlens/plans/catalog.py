"""Coercion, offer kinds, profiles as maps, external scorers, expiry labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.bindings import EVENTS_NOW, OFFERS_NOW, clicks, live_offers, named_offers, products, sql, table, ts
from basketlens.functions.dates import expiry, micros
from basketlens.functions.num import decay
from basketlens.functions.validate import offer_input, offer_type
from basketlens.registry import register


@register("offer_kinds", sql("""SELECT offer_id, CASE raw WHEN 'strikethrough' THEN 'strikethrough' WHEN 'multibuy' THEN 'mono' WHEN 'super' THEN 'mono' ELSE CASE WHEN coalesce(original_price, 0) <> 0 THEN 'strikethrough' ELSE 'mono' END END AS kind
    FROM (SELECT offer_id, original_price, CASE source WHEN 'A' THEN CASE WHEN pct > 5 THEN 'multibuy' ELSE 'percentage' END WHEN 'N' THEN 'super' ELSE CASE WHEN pct > 7 THEN 'strikethrough' ELSE 'price promotion' END END AS raw FROM offers)"""))  # fmt: skip
def offer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, pct = F.col("source"), F.col("pct")
    raw = F.when(source == "A", F.when(pct > 5, " Multibuy").otherwise("Percentage")).when(source == "N", "SUPER").otherwise(F.when(pct > 7, "strikethrough").otherwise("Price promotion"))
    return named_offers(spark, sf_dir).select("offer_id", offer_type(raw, F.col("original_price")).alias("kind"))


@register("validated_offers", sql("""SELECT reject, count(*) AS n FROM (SELECT CASE WHEN product_id % 11 = 0 THEN 'name' WHEN product_id % 7 = 0 OR product_id % 13 = 0 THEN 'price' WHEN product_id % 5 = 0 THEN 'original' WHEN pct = 3 THEN 'valid_until' END AS reject FROM offers) GROUP BY reject"""))
def validated_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with planted faults, counted by the rule that they break."""
    p = F.col("product_id")
    rows = named_offers(spark, sf_dir).select(
        "chain", F.when(p % 11 == 0, "  ").otherwise(F.col("product_name")).alias("name"), "category",
        F.when(p % 7 == 0, "abc").when(p % 13 == 0, "-1").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(p % 5 == 0, "x").otherwise("").alias("original"), F.lit("").alias("percent"), F.lit("2024-01-02").alias("valid_from"),
        F.when(F.col("pct") == 3, "2024-01-01").otherwise("2024-01-02").alias("valid_until"),
    )
    return offer_input(rows, ts(OFFERS_NOW)).groupBy("reject").agg(F.count("*").alias("n"))


@register("profile_maps", sql(f"SELECT session_id, category, floor(w * 1000 + 0.5) / 1000 AS weight FROM (SELECT session_id, category, count(*) * pow(0.5, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(max(ts)) OVER (PARTITION BY session_id))) / 86400000000 / 14) AS w FROM clicks JOIN products USING (product_id) WHERE event_type = 'view' GROUP BY session_id, category) WHERE w >= 1"))
def profile_maps(spark: SparkSession, sf_dir: str, prune: float = 1.0) -> DataFrame:
    """A session's interest as a map: raw counts, decayed since the last view and pruned as map functions."""
    rows = clicks(spark, sf_dir).where("event_type = 'view'").join(products(spark, sf_dir), "product_id")
    counts = rows.groupBy("session_id", "category").agg(F.count("*").cast("double").alias("w"), F.max("ts").alias("last"))
    maps = counts.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "w"))).alias("m"), F.max("last").alias("last"))
    factor = decay((micros(ts(EVENTS_NOW)) - micros(F.col("last"))) / 86_400_000_000)
    kept = maps.select("session_id", factor.alias("f"), "m").select("session_id", F.map_filter(F.transform_values("m", lambda k, v: v * F.col("f")), lambda k, v: v >= prune).alias("m"))
    return kept.select("session_id", F.explode("m").alias("category", "w")).select("session_id", "category", (F.floor(F.col("w") * 1000 + 0.5) / 1000).alias("weight"))


def scored_by(rows: DataFrame, scorer: Callable[[pd.Series], pd.Series], column: str, name: str = "score") -> DataFrame:
    """Rows with a score from an external scorer, called once a batch inside tasks (a model, a remote service)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: scorer(b[column]).astype("float64")})

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


@register("externally_scored", sql("SELECT product_id, CAST(length(product_name) AS DOUBLE) AS score FROM products"))
def externally_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).select("product_id", "product_name")
    return scored_by(rows, lambda s: s.str.len(), "product_name").select("product_id", "score")


@register("expiry_labels", sql(f"""WITH d AS (SELECT offer_id, original_price IS NOT NULL AS r, created_at AS c, valid_until AS u, CAST(date_diff('day', DATE '1998-09-02', CAST(valid_until + INTERVAL 3 HOUR AS DATE)) AS INTEGER) AS n,
        created_at > TIMESTAMP '{OFFERS_NOW}' AS later FROM live_offers)
    SELECT offer_id, r AS real, r AND later AS upcoming, r AND n BETWEEN 0 AND 2 AS urgent, CASE WHEN r THEN n END AS days_left,
        CASE WHEN r THEN CASE WHEN later THEN 'Ξεκινά ' || strftime(c, '%d/%m') WHEN n = 0 THEN 'Λήγει σήμερα' WHEN n = 1 THEN 'Λήγει αύριο' WHEN n = 2 THEN 'Λήγει σε 2 μέρες' ELSE 'Έως ' || strftime(u, '%d/%m') END END AS chip,
        CASE WHEN NOT r THEN 'Σε ισχύ' WHEN n = 0 THEN 'Τελειώνει σήμερα' WHEN n = 1 THEN 'Τελειώνει αύριο' WHEN n = 2 THEN 'Τελειώνει σε 2 μέρες' ELSE 'Σε ' || n || ' ημέρες' END AS status,
        CASE WHEN r THEN 'έως ' || strftime(u, '%d/%m/%Y') ELSE 'ελέγχθηκε ' || strftime(c, '%d/%m/%Y') END AS status_sub, CASE WHEN r THEN strftime(c, '%d/%m/%Y') END AS start_full FROM d"""))  # fmt: skip
def expiry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_offers(spark, sf_dir)
    label = expiry(F.col("created_at"), F.col("valid_until"), F.col("created_at"), F.col("original_price").isNotNull(), ts(OFFERS_NOW))
    return rows.select("offer_id", label.alias("l")).select("offer_id", "l.*")


@register("days_left", sql(f"SELECT offer_id, CAST(date_diff('day', DATE '1998-09-02', CAST(valid_until + INTERVAL 3 HOUR AS DATE)) AS INTEGER) AS days FROM live_offers"))
def days_left_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketlens.functions.dates import days_left

    return live_offers(spark, sf_dir).select("offer_id", days_left(F.col("valid_until"), ts(OFFERS_NOW)).alias("days"))


@register("wait_list", sql("SELECT l.doc_id, quality FROM labels l WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def wait_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "left_anti").select("doc_id", "quality")


@register("alert_quota", sql("SELECT c_nationkey AS owner, least(count(*), 50) AS kept, greatest(count(*) - 50, 0) AS refused FROM customer GROUP BY owner"))
def alert_quota(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """An owner keeps at most fifty standing alerts; further ones are refused."""
    n = F.count("*")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("owner")).agg(F.least(n, F.lit(most)).alias("kept"), F.greatest(n - most, F.lit(0)).alias("refused"))


@register("subscriber_states", sql("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'unsubscribed' WHEN c_acctbal >= 5000 THEN 'confirmed' ELSE 'pending' END AS state FROM customer"))
def subscriber_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after each subscriber's last action: subscribe (pending), confirm, unsubscribe; later actions win."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))
    actions = F.array_compact(F.array(F.struct(F.lit(1).alias("at"), F.lit("pending").alias("to")), F.when(F.col("b") >= 5000, F.struct(F.lit(2).alias("at"), F.lit("confirmed").alias("to"))), F.when(F.col("b") < 0, F.struct(F.lit(3).alias("at"), F.lit("unsubscribed").alias("to")))))
    return c.select("id", F.explode(actions).alias("a")).groupBy("id").agg(F.max_by("a.to", "a.at").alias("state"))


@register("review_claims", sql("SELECT run_id, feed, CASE WHEN prev IS NULL THEN 'claim' ELSE 'update' END AS action FROM (SELECT run_id, feed, lag(run_id) OVER (PARTITION BY feed, worker ORDER BY finished_at, run_id) AS prev FROM runs WHERE NOT healthy)"))
def review_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved review rows claim a fresh offer row, or update the one that an earlier approval of the key made."""
    from pyspark.sql import Window

    from basketlens.bindings import runs

    prev = F.lag("run_id").over(Window.partitionBy("feed", "worker").orderBy("finished_at", "run_id"))
    return runs(spark, sf_dir).where(~F.col("healthy")).select("run_id", "feed", F.when(prev.isNull(), "claim").otherwise("update").alias("action"))
