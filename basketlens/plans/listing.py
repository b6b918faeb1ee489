"""Listing queries: filters, sorts, pages, facets, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import HIDDEN_CHAIN, OFFERS_NOW, live, live_offers, named_offers, offers, products, runs, sellers, sql, table, ts, visible
from basketlens.functions.num import half_up
from basketlens.operators.ranking import places
from basketlens.registry import register

SORTS = {
    "discount": [F.desc_nulls_last, "pct"],
    "newest": [F.desc_nulls_last, "created_at"],
    "price_asc": [F.asc_nulls_last, "price"],
    "price_desc": [F.desc_nulls_last, "price"],
    "expiring": [F.asc_nulls_last, "valid_until"],
}


def sorted_by(df: DataFrame, order: str) -> DataFrame:
    """One of the listing orders; offer_id breaks every tie."""
    direction, column = SORTS[order]
    return df.orderBy(direction(column), F.asc("offer_id"))


def page(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit)


_SORT_SQL = {"discount": "pct DESC NULLS LAST", "newest": "created_at DESC NULLS LAST", "price_asc": "price ASC NULLS LAST", "price_desc": "price DESC NULLS LAST", "expiring": "valid_until ASC NULLS LAST"}
for _order, _by in _SORT_SQL.items():

    @register(f"listing_{_order}", sql(f"SELECT offer_id, product_name, chain, price, pct FROM live_offers ORDER BY {_by}, offer_id LIMIT 20 OFFSET 5"))
    def listing(spark: SparkSession, sf_dir: str, order: str = _order) -> DataFrame:
        return page(sorted_by(live_offers(spark, sf_dir), order), 20, 5).select("offer_id", "product_name", "chain", "price", "pct")


@register("listing_of_chains_and_categories", sql("SELECT offer_id, chain, category, price FROM live_offers WHERE chain IN ('ASIA', 'EUROPE') AND category IN ('PROMO', 'SMALL') ORDER BY price, offer_id LIMIT 50"))
def listing_of(spark: SparkSession, sf_dir: str, chains: tuple[str, ...] = ("ASIA", "EUROPE"), categories: tuple[str, ...] = ("PROMO", "SMALL")) -> DataFrame:
    """Optional filters: an empty tuple means all; at most eight categories count."""
    rows = live_offers(spark, sf_dir)
    rows = rows.where(F.col("chain").isin(*chains)) if chains else rows
    rows = rows.where(F.col("category").isin(*categories[:8])) if categories else rows
    return page(sorted_by(rows, "price_asc"), 50).select("offer_id", "chain", "category", "price")


@register("listing_total", sql("SELECT count(*) AS total FROM live_offers"))
def listing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_offers(spark, sf_dir).agg(F.count("*").alias("total"))


@register("facets_by_chain_and_category", sql("SELECT 'chain' AS facet, chain AS value, count(*) AS n FROM live_offers GROUP BY chain UNION ALL SELECT 'category', category, count(*) FROM live_offers GROUP BY category UNION ALL SELECT 'all', NULL, count(*) FROM live_offers"))
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets from one pass over the offers by grouping sets."""
    sets = live_offers(spark, sf_dir).groupingSets([["chain"], ["category"], []], "chain", "category").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return sets.select(F.when(F.col("g") == 1, "chain").when(F.col("g") == 2, "category").otherwise("all").alias("facet"), F.coalesce("chain", "category").alias("value"), "n")


@register("catalog_facets", sql("SELECT p.category, count(*) AS n_products, count(DISTINCT brand) AS n_brands, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM live_offers o WHERE o.product_id = p.product_id)) AS on_offer FROM products p GROUP BY p.category"))
def catalog_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_offer = live_offers(spark, sf_dir).select("product_id").distinct().withColumn("hit", F.lit(True))
    return products(spark, sf_dir).join(on_offer, "product_id", "left").groupBy("category").agg(F.count("*").alias("n_products"), F.countDistinct("brand").alias("n_brands"), F.count_if("hit").alias("on_offer"))


@register("point_lookup", sql("SELECT product_id, product_name, category, brand FROM products WHERE product_id = 42"))
def point_lookup(spark: SparkSession, sf_dir: str, product_id: int = 42) -> DataFrame:
    return products(spark, sf_dir).where(F.col("product_id") == product_id).select("product_id", "product_name", "category", "brand").limit(1)


@register("latest_run_of_feed", sql("SELECT run_id, feed, finished_at, healthy FROM runs WHERE feed = '1-URGENT' ORDER BY finished_at DESC, run_id DESC LIMIT 1"))
def latest_run(spark: SparkSession, sf_dir: str, feed: str = "1-URGENT") -> DataFrame:
    return runs(spark, sf_dir).where(F.col("feed") == feed).orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1).select("run_id", "feed", "finished_at", "healthy")


@register("parameterised_scan", sql("SELECT chain, count(*) AS n FROM live_offers WHERE price <= 20000.0 GROUP BY chain"))
def parameterised_scan(spark: SparkSession, sf_dir: str, top: float = 20000.0) -> DataFrame:
    """SQL text with a named parameter, as an ad-hoc scan would be."""
    return spark.sql("SELECT chain, count(*) AS n FROM {live} WHERE price <= :top GROUP BY chain", args={"top": top}, live=live_offers(spark, sf_dir))


@register("expanded_offers", sql("SELECT offer_id, product_name, brand, branch, chain FROM named_offers"))
def expanded_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with their relations as nested structs, as a reader would get them, flattened for output."""
    return _expanded(named_offers(spark, sf_dir))


def _expanded(rows: DataFrame) -> DataFrame:
    nested = rows.select("offer_id", F.struct("product_name", "brand").alias("product"), F.struct("chain", "branch").alias("store"))
    return nested.select("offer_id", "product.product_name", "product.brand", "store.branch", "store.chain")


@register("visibility_versions", sql(f"""SELECT count(*) FILTER (WHERE chain <> '{HIDDEN_CHAIN}' OR original_price IS NOT NULL) AS strict,
    count(*) FILTER (WHERE chain IS DISTINCT FROM '{HIDDEN_CHAIN}' OR original_price IS NOT NULL) AS lenient
    FROM (SELECT CASE WHEN branch = 'NATION_3' THEN NULL ELSE chain END AS chain, original_price FROM offers)"""))  # fmt: skip
def visibility_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).withColumn("chain", F.when(F.col("branch") != "NATION_3", F.col("chain")))
    return rows.agg(F.count_if(visible()).alias("strict"), F.count_if(visible(keep_null_chain=True)).alias("lenient"))


@register("not_in_id_set", sql("SELECT product_id, product_name FROM products WHERE product_id NOT IN (SELECT product_id FROM live_offers)"))
def not_in_id_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).join(live_offers(spark, sf_dir).select("product_id"), "product_id", "left_anti").select("product_id", "product_name")


@register("null_aware_inequality", sql("SELECT count(*) AS n FROM (SELECT CASE WHEN product_id % 7 = 0 THEN NULL ELSE product_id END AS p FROM offers) WHERE p IS NULL OR p <> 8"))
def null_aware_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("product_id") % 7 != 0, F.col("product_id"))
    return offers(spark, sf_dir).select(p.alias("p")).where(~F.col("p").eqNullSafe(8)).agg(F.count("*").alias("n"))


@register("null_or_future", sql(f"SELECT source, count(*) AS n FROM (SELECT source, CASE WHEN pct = 0 THEN NULL ELSE valid_until END AS until FROM offers) WHERE until IS NULL OR until > TIMESTAMP '{OFFERS_NOW}' GROUP BY source"))
def null_or_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offers(spark, sf_dir).select("source", F.when(F.col("pct") != 0, F.col("valid_until")).alias("until"))
    return rows.where(F.col("until").isNull() | (F.col("until") > ts(OFFERS_NOW))).groupBy("source").agg(F.count("*").alias("n"))


@register("ending_soon", sql(f"SELECT offer_id, product_name, valid_until FROM live_offers WHERE valid_until <= TIMESTAMP '{OFFERS_NOW}' + INTERVAL 7 DAY ORDER BY valid_until, offer_id LIMIT 10"))
def ending_soon(spark: SparkSession, sf_dir: str, days: int = 7, limit: int = 10) -> DataFrame:
    until = ts(OFFERS_NOW) + F.make_interval(days=F.lit(days))
    return sorted_by(live_offers(spark, sf_dir).where(F.col("valid_until") <= until), "expiring").limit(limit).select("offer_id", "product_name", "valid_until")


@register("substring_any_column", sql("SELECT product_id FROM products WHERE product_name ILIKE '%BOLT%' OR category ILIKE '%bolt%' OR brand ILIKE '%#1'"))
def substring_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = lambda c: F.lower(F.col(c))
    return products(spark, sf_dir).where(low("product_name").contains("bolt") | low("category").contains("bolt") | low("brand").endswith("#1")).select("product_id")


@register("products_on_offer", sql("SELECT product_id, category FROM products p WHERE EXISTS (SELECT 1 FROM live_offers o WHERE o.product_id = p.product_id AND o.pct >= 5)"))
def products_on_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).join(live_offers(spark, sf_dir).where("pct >= 5"), "product_id", "left_semi").select("product_id", "category")


@register("contains_markers", sql("SELECT count(*) FILTER (WHERE contains(url, '.example.com') OR contains(url, '.example.org')) AS known, count(*) FILTER (WHERE (contains(url, '.example.net')) AND NOT contains(url, 'page=')) AS pending FROM pages"))
def contains_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").agg(F.count_if(url.contains(".example.com") | url.contains(".example.org")).alias("known"), F.count_if(url.contains(".example.net") & ~url.contains("page=")).alias("pending"))


@register("row_ttl", sql(f"SELECT count(*) AS n FROM offers WHERE created_at + qty * INTERVAL 1 DAY < TIMESTAMP '{OFFERS_NOW}'"))
def row_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketlens.functions.dates import expired_by_ttl

    return offers(spark, sf_dir).where(expired_by_ttl(F.col("created_at"), F.col("qty"), ts(OFFERS_NOW))).agg(F.count("*").alias("n"))


@register("best_offer_per_product", sql("SELECT product_id, offer_id, pct, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY pct DESC, price, offer_id) AS rn FROM live_offers) WHERE rn = 1"))
def best_offer_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy(F.desc("pct"), F.asc("price"), F.asc("offer_id"))
    return live_offers(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("product_id", "offer_id", "pct", "price")


@register("catalog_offer_first", sql("SELECT p.product_id, p.product_name, b.best FROM products p LEFT JOIN (SELECT product_id, max(pct) AS best FROM live_offers GROUP BY product_id) b USING (product_id) ORDER BY b.best IS NULL, b.best DESC, p.product_id LIMIT 100"))
def catalog_offer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with an offer come first, then by best discount, then by id."""
    best = live_offers(spark, sf_dir).groupBy("product_id").agg(F.max("pct").alias("best"))
    return products(spark, sf_dir).join(best, "product_id", "left").orderBy(F.desc_nulls_last("best"), F.asc("product_id")).limit(100).select("product_id", "product_name", "best")


@register("favourites", sql("SELECT offer_id, product_id, product_name FROM live_offers WHERE product_id IN (3, 8, 21) OR lower(product_name) IN ('red bolt', 'hot gear') ORDER BY pct DESC, offer_id LIMIT 30"))
def favourites(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (3, 8, 21), names: tuple[str, ...] = ("red bolt", "hot gear")) -> DataFrame:
    """Offers of favourite products or names; no favourites at all give no rows."""
    hit = F.lit(False)
    hit = hit | F.col("product_id").isin(*ids) if ids else hit
    hit = hit | F.lower("product_name").isin(*names) if names else hit
    return live_offers(spark, sf_dir).where(hit).orderBy(F.desc("pct"), F.asc("offer_id")).limit(30).select("offer_id", "product_id", "product_name")


@register("percent_of_struck_price", sql("SELECT offer_id, CAST(floor((1 - price / original_price) * 100 + 0.5) AS INTEGER) AS percent FROM offers WHERE original_price > price"))
def percent_of_struck_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketlens.functions.num import percent_off

    return offers(spark, sf_dir).select("offer_id", percent_off(F.col("price"), F.col("original_price")).alias("percent")).where("percent is not null")


@register("null_order", sql("SELECT feed, run_id, coalesce(score, -1) AS score, row_number() OVER (PARTITION BY feed ORDER BY score DESC NULLS FIRST, run_id) AS rn FROM (SELECT feed, run_id, CASE WHEN healthy THEN scraped END AS score FROM runs)"))
def null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending order with nulls first, as the review queue has it; a feed's rows are numbered by score, not in one task."""
    score = F.when(F.col("healthy"), F.col("scraped"))
    rows = runs(spark, sf_dir).select("feed", "run_id", F.coalesce(score, F.lit(-1)).alias("score"), F.coalesce(score.cast("double"), F.lit(float("inf"))).alias("level"))
    return places(rows, ["feed"], "level", [F.asc("run_id")], "rn").select("feed", "run_id", "score", "rn")


@register("rounded_prices", sql("SELECT offer_id, floor(price * 10 + 0.5) / 10 AS price_1, floor(-price + 0.5) AS negative FROM offers"))
def rounded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).select("offer_id", half_up(F.col("price"), 1).alias("price_1"), half_up(-F.col("price"), 0).alias("negative"))


@register("seller_dimension", sql("SELECT s_suppkey, chain, branch, 'https://shops.example/' || lower(replace(chain, ' ', '-')) || '/' || s_suppkey AS url FROM sellers"))
def seller_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sellers(spark, sf_dir).select("s_suppkey", "chain", "branch", F.concat(F.lit("https://shops.example/"), F.lower(F.replace("chain", F.lit(" "), F.lit("-"))), F.lit("/"), F.col("s_suppkey").cast("string")).alias("url"))


@register("active_state_counts", sql(f"SELECT active, valid_until > TIMESTAMP '{OFFERS_NOW}' AS unexpired, count(*) AS n FROM offers GROUP BY ALL"))
def active_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy("active", (F.col("valid_until") > ts(OFFERS_NOW)).alias("unexpired")).agg(F.count("*").alias("n"))


@register("schema_columns", None)
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of the offers' columns: a metadata scan."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(named_offers(spark, sf_dir).dtypes)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string")


@register("live_by_source", sql("SELECT source, count(*) AS n, count(*) FILTER (WHERE original_price IS NOT NULL) AS struck FROM named_offers WHERE active AND valid_until > TIMESTAMP '1998-09-02 00:00:00' GROUP BY source"))
def live_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_offers(spark, sf_dir).where(live()).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("original_price").isNotNull()).alias("struck"))
