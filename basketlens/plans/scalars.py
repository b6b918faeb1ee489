"""Small value operators as queries: serialised times, arrays as sets, fallbacks, clean-ups, nested groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.bindings import live_offers, offers, products, runs, sql, table
from basketlens.functions.num import half_up
from basketlens.functions.validate import or_null
from basketlens.operators.ranking import places
from basketlens.registry import register


@register("iso_timestamps", sql("SELECT run_id, strftime(finished_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS finished FROM runs"))
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("finished"))


@register("id_order_restored", sql("SELECT w.pos, p.product_id, p.product_name FROM (VALUES (0, 30), (1, 4), (2, 17), (3, 999999)) w(pos, id) JOIN products p ON p.product_id = w.id"))
def id_order_restored(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (30, 4, 17, 999999)) -> DataFrame:
    """Rows in the order of a list of ids; ids without a row are left out."""
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("pos", "product_id"))
    return products(spark, sf_dir).join(F.broadcast(wanted), "product_id").orderBy("pos").select("pos", "product_id", "product_name")


@register("array_sets", sql("""WITH t AS (SELECT product_id, string_split(product_name, ' ') AS a FROM products)
    SELECT product_id, CAST(len(list_distinct(list_concat(a, ['red', 'bolt']))) AS INTEGER) AS n_union, CAST(len(list_intersect(a, ['red', 'bolt'])) AS INTEGER) AS n_common,
    len(list_intersect(a, ['red', 'bolt'])) = 0 AS disjoint, list_contains(a, 'red') AND list_contains(a, 'bolt') AND len(a) = 2 AS same,
    array_to_string(CASE WHEN list_contains(a, 'bolt') THEN list_filter(a, lambda x: x <> 'bolt') ELSE list_append(a, 'bolt') END, '|') AS toggled FROM t"""))  # fmt: skip
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays as sets: union, intersection, disjointness, equality and toggling a member."""
    a, b, bolt = F.col("a"), F.array(F.lit("red"), F.lit("bolt")), F.array(F.lit("bolt"))
    rows = products(spark, sf_dir).select("product_id", F.split("product_name", " ").alias("a"))
    toggled = F.when(F.array_contains(a, "bolt"), F.array_except(a, bolt)).otherwise(F.array_union(a, bolt))
    return rows.select(
        "product_id", F.size(F.array_union(a, b)).alias("n_union"), F.size(F.array_intersect(a, b)).alias("n_common"),
        ((F.size(a) > 0) & ~F.arrays_overlap(a, b)).alias("disjoint"), (F.array_sort(a) == F.array_sort(b)).alias("same"), F.array_join(toggled, "|").alias("toggled"),
    )


@register("joined_parts", sql("SELECT product_id, trim(CASE WHEN size > 25 THEN brand ELSE '' END || ' ' || CASE WHEN size % 2 = 0 THEN category ELSE '' END) AS label FROM products"))
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are there, joined by a space; missing and empty ones leave no gap."""
    brand, category = F.when(F.col("size") > 25, F.col("brand")).otherwise(""), F.when(F.col("size") % 2 == 0, F.col("category"))
    return products(spark, sf_dir).select("product_id", F.concat_ws(" ", or_null(brand), or_null(category)).alias("label"))


@register("json_fallbacks", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.total'), json_extract_string(props, '$.k'), '0') AS BIGINT) AS found FROM events")
def json_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda p: F.get_json_object("props", p)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(path("$.total"), path("$.k"), F.lit("0")).cast("long").alias("found"))


@register("original_from_percent", sql("SELECT offer_id, floor(price / (1 - pct / 100.0) * 100 + 0.5) / 100 AS original FROM offers WHERE pct BETWEEN 1 AND 90"))
def original_from_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The struck price that a percentage implies, within bounds that make sense."""
    return offers(spark, sf_dir).where("pct BETWEEN 1 AND 90").select("offer_id", half_up(F.col("price") / (1 - F.col("pct") / 100.0), 2).alias("original"))


@register("rewritten_urls", "SELECT page_id, regexp_replace(url, 'page=[0-9]+', 'page=1') AS url FROM pages")
def rewritten_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "page=[0-9]+", "page=1").alias("url"))


@register("placeholders_cleaned", sql("SELECT product_id, CASE WHEN size % 3 = 0 THEN 'none' ELSE brand END AS brand FROM products"))
def placeholders_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dash or blanks stand for no value."""
    raw = F.when(F.col("size") % 3 == 0, F.when(F.col("size") % 2 == 0, " - ").otherwise("  ")).otherwise(F.col("brand"))
    return products(spark, sf_dir).select("product_id", F.coalesce(F.nullif(or_null(F.trim(raw)), F.lit("-")), F.lit("none")).alias("brand"))


@register("on_offer_signals", sql("SELECT p.product_id, (o.product_id IS NOT NULL OR size > 45 OR brand = 'Brand#3') AS on_offer FROM products p LEFT JOIN (SELECT DISTINCT product_id FROM live_offers) o USING (product_id)"))
def on_offer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On offer by any of several signals: in the offer set, a struck price, a coupon."""
    hit = live_offers(spark, sf_dir).select("product_id").distinct().withColumn("hit", F.lit(True))
    rows = products(spark, sf_dir).join(hit, "product_id", "left")
    return rows.select("product_id", (F.coalesce("hit", F.lit(False)) | (F.col("size") > 45) | (F.col("brand") == "Brand#3")).alias("on_offer"))


@register("grouped_aisles", sql("SELECT chain, category, offer_id, CAST(row_number() OVER (PARTITION BY chain, category ORDER BY pct DESC, price, offer_id) AS BIGINT) AS place FROM live_offers"))
def grouped_aisles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers by aisle with their places in it, best discount first: rows, not arrays, so that an aisle may be of any size."""
    return places(live_offers(spark, sf_dir), ["chain", "category"], "pct", [F.asc("price"), F.asc("offer_id")]).select("chain", "category", "offer_id", "place")


@register("category_discovery", sql("SELECT category, min(product_id) AS first_id FROM products WHERE category <> 'STANDARD' GROUP BY category"))
def category_discovery(spark: SparkSession, sf_dir: str, roots: tuple[str, ...] = ("STANDARD",)) -> DataFrame:
    """Categories but synthetic roots, each with the first row that names it."""
    return products(spark, sf_dir).where(~F.col("category").isin(*roots)).groupBy("category").agg(F.min("product_id").alias("first_id"))
