"""Ingest pipelines as pure functions from tables to tables: match, upsert, snapshot on change, deactivate, alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.bindings import OFFERS_NOW, observations, offers, products, runs, sql, ts
from basketlens.operators.ingest import changed_rows, delete_keys, health_gate, snapshot_on_change, upsert
from basketlens.operators.ranking import best_per_key
from basketlens.registry import register

_OLD = "SELECT product_id, chain, arg_max(price, ROW(created_at, offer_id)) AS price, 1 AS version FROM offers WHERE created_at < TIMESTAMP '1998-06-01' GROUP BY product_id, chain"
_NEW = "SELECT product_id, chain, arg_max(price, ROW(created_at, offer_id)) AS price, 2 AS version FROM offers WHERE created_at >= TIMESTAMP '1998-06-01' AND created_at < TIMESTAMP '1998-09-02' GROUP BY product_id, chain"


def _state(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    at = F.col("created_at")
    window = (at >= ts("1998-06-01 00:00:00")) & (at < ts(OFFERS_NOW)) if new else at < ts("1998-06-01 00:00:00")
    latest = offers(spark, sf_dir).where(window).groupBy("product_id", "chain").agg(F.max_by("price", F.struct("created_at", "offer_id")).alias("price"))
    return latest.withColumn("version", F.lit(2 if new else 1))


@register("upsert_state", sql(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.product_id = o.product_id AND n.chain = o.chain)"))
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(_state(spark, sf_dir, False), _state(spark, sf_dir, True), ["product_id", "chain"], "version")


@register("snapshot_on_change", sql(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.product_id, n.chain, n.price, o.price AS before FROM n LEFT JOIN o USING (product_id, chain) WHERE n.price IS DISTINCT FROM o.price"))
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_on_change(_state(spark, sf_dir, False), _state(spark, sf_dir, True), ["product_id", "chain"], "price").select("product_id", "chain", "price", "before")


@register("alertable_offers", sql(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.product_id, n.chain, CASE WHEN o.price IS NULL THEN 'new' ELSE 'drop' END AS reason FROM n LEFT JOIN o USING (product_id, chain) WHERE o.price IS NULL OR n.price < o.price"))
def alertable_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows and price drops."""
    before = _state(spark, sf_dir, False).select("product_id", "chain", F.col("price").alias("before"))
    rows = _state(spark, sf_dir, True).join(before, ["product_id", "chain"], "left")
    return rows.where(F.col("before").isNull() | (F.col("price") < F.col("before"))).select("product_id", "chain", F.when(F.col("before").isNull(), "new").otherwise("drop").alias("reason"))


@register("deactivated_rows", sql(f"""WITH o AS ({_OLD}), n AS ({_NEW}), g AS (SELECT o.chain, count(*) AS active, (SELECT count(*) FROM n WHERE n.chain = o.chain) AS scraped FROM o GROUP BY o.chain)
    SELECT o.chain, count(*) AS stale FROM o JOIN g USING (chain) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.product_id = o.product_id AND n.chain = o.chain) AND scraped > 0 AND NOT (active > 20 AND scraped < 0.25 * active) GROUP BY o.chain"""))  # fmt: skip
def deactivated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a healthy run did not see again; a run with too few rows deactivates nothing."""
    old, new = _state(spark, sf_dir, False), _state(spark, sf_dir, True)
    healthy = health_gate(old, new, "chain", least=0.25)
    return old.join(new, ["product_id", "chain"], "left_anti").join(healthy, "chain", "left_semi").groupBy("chain").agg(F.count("*").alias("stale"))


@register("changed_only", sql("SELECT product_id, floor(retail_price / 10) AS grade FROM products WHERE floor(retail_price / 10) IS DISTINCT FROM CASE WHEN size > 25 THEN 91 END"))
def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).select("product_id", F.floor(F.col("retail_price") / 10).cast("double").alias("grade"), F.when(F.col("size") > 25, 91.0).alias("stored"))
    return changed_rows(rows, "grade", "stored").select("product_id", "grade")


@register("changed_beyond_epsilon", sql("SELECT product_id, retail_price FROM products WHERE abs(retail_price - floor(retail_price)) >= 0.25"))
def changed_beyond_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).withColumn("stored", F.floor("retail_price").cast("double"))
    return changed_rows(rows, "retail_price", "stored", epsilon=0.25).select("product_id", "retail_price")


@register("predicate_update", sql("SELECT product_id, CASE WHEN category = 'PROMO' THEN 'mono' WHEN size > 40 THEN 'strikethrough' ELSE brand END AS kind FROM products"))
def predicate_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("category") == "PROMO", "mono").when(F.col("size") > 40, "strikethrough").otherwise(F.col("brand"))
    return products(spark, sf_dir).select("product_id", kind.alias("kind"))


@register("prefix_replace", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS url FROM pages")
def prefix_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(url.startswith("http://"), F.concat(F.lit("https://"), F.substring(url, 8, 100_000))).otherwise(url).alias("url"))


@register("delete_by_key", sql("SELECT product_id FROM products WHERE product_id NOT IN (SELECT product_id FROM offers WHERE source = 'N' AND pct = 10)"))
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_keys(products(spark, sf_dir), offers(spark, sf_dir).where("source = 'N' AND pct = 10"), ["product_id"]).select("product_id")


@register("guarded_delete_counts", sql("SELECT p.product_id, count(o.offer_id) AS dependents FROM products p LEFT JOIN offers o USING (product_id) GROUP BY p.product_id"))
def guarded_delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows depend on each product; a delete goes ahead only where there are none."""
    return _dependents(products(spark, sf_dir), offers(spark, sf_dir))


def _dependents(rows: DataFrame, on: DataFrame) -> DataFrame:
    return rows.join(on, "product_id", "left").groupBy("product_id").agg(F.count("offer_id").alias("dependents"))


@register("baseline_ingest", sql("""WITH w AS (SELECT product_id, chain, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, chain ORDER BY run_id, line, recorded_at, price) AS rn FROM observations WHERE run_id >= 10000) WHERE rn = 1),
    l AS (SELECT product_id, chain, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, chain ORDER BY recorded_at DESC, run_id DESC, line DESC, price) AS rn FROM observations WHERE run_id < 10000) WHERE rn = 1)
    SELECT w.product_id, w.chain, w.price FROM w LEFT JOIN l USING (product_id, chain) WHERE l.price IS NULL OR w.price <> l.price"""))  # fmt: skip
def baseline_ingest(spark: SparkSession, sf_dir: str, cut: int = 10_000) -> DataFrame:
    """Shelf prices of a run: the first of each product and chain, written where it differs from the newest stored one."""
    rows, key = observations(spark, sf_dir), ["product_id", "chain"]
    wanted = best_per_key(rows.where(F.col("run_id") >= cut), key, [F.asc("run_id"), F.asc("line"), F.asc("recorded_at"), F.asc("price")])
    stored = best_per_key(rows.where(F.col("run_id") < cut), key, [F.desc("recorded_at"), F.desc("run_id"), F.desc("line"), F.asc("price")])
    return snapshot_on_change(stored.select(*key, "price"), wanted.select(*key, "price"), key, "price").select(*key, "price")


@register("catalog_ingest_validity", sql("SELECT count(*) FILTER (WHERE sku IS NOT NULL OR code IS NOT NULL) AS valid, count(*) FILTER (WHERE sku IS NULL AND code IS NULL) AS rejected FROM (SELECT CASE WHEN product_id % 2 = 0 THEN product_id END AS sku, CASE WHEN product_id % 3 = 0 THEN product_id END AS code FROM products)"))
def catalog_ingest_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog row needs a chain code or a barcode."""
    sku, code = F.when(F.col("product_id") % 2 == 0, F.col("product_id")), F.when(F.col("product_id") % 3 == 0, F.col("product_id"))
    valid = F.coalesce(sku, code).isNotNull()
    return products(spark, sf_dir).agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("rejected"))


@register("run_log", sql("SELECT feed, count(*) AS n_runs, CAST(sum(scraped) AS BIGINT) AS scraped, count(*) FILTER (WHERE NOT healthy) AS unhealthy FROM runs GROUP BY feed"))
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("feed").agg(F.count("*").alias("n_runs"), F.sum("scraped").alias("scraped"), F.count_if(~F.col("healthy")).alias("unhealthy"))
