"""Order-dependent queries: caps, interleaving, dedupe, change capture, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import OFFERS_NOW, live_offers, observations, offers, sql, ts
from basketlens.functions.dates import micros
from basketlens.functions.num import is_price
from basketlens.operators.asof import as_of, neighbour
from basketlens.operators.ranking import best_per_key, cap_per_group, collapse_keep_position, interleave, ranked
from basketlens.registry import register

_POOL_SQL = "SELECT offer_id, chain, category, product_name, product_id, price, pct, row_number() OVER (ORDER BY pct DESC, price, offer_id) AS pos FROM live_offers"


def pool(spark: SparkSession, sf_dir: str, limit: int = 80) -> DataFrame:
    """The best offers in listing order with their position; a top-k, so its order is made on `limit` rows."""
    top = live_offers(spark, sf_dir).orderBy(F.desc("pct"), "price", "offer_id").limit(limit)
    return ranked(top, [F.desc("pct"), F.asc("price"), F.asc("offer_id")]).select("offer_id", "chain", "category", "product_name", "product_id", "price", "pct", "pos")


@register("cap_per_chain", sql(f"""WITH p AS ({_POOL_SQL}), t AS (SELECT * FROM p WHERE pos <= 80), r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY pos) AS rn FROM t)
    SELECT offer_id, chain, row_number() OVER (ORDER BY CASE WHEN rn <= 3 THEN 0 ELSE 1 END, pos) AS place FROM r QUALIFY place <= 18"""))  # fmt: skip
def cap_per_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_per_group(pool(spark, sf_dir), "chain", "pos", cap=3, need=18).select("offer_id", "chain", "place")


@register("interleave_categories", sql(f"""WITH p AS ({_POOL_SQL}), t AS (SELECT * FROM p WHERE pos <= 80), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pos) AS rn, min(pos) OVER (PARTITION BY category) AS first FROM t)
    SELECT offer_id, category, row_number() OVER (ORDER BY rn, first) AS place FROM r"""))  # fmt: skip
def interleave_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(pool(spark, sf_dir), "category", "pos").select("offer_id", "category", "place")


@register("soon_last", sql(f"WITH p AS (SELECT *, row_number() OVER (ORDER BY pct DESC, price, offer_id) AS pos FROM live_offers) SELECT offer_id, row_number() OVER (ORDER BY CASE WHEN valid_until > TIMESTAMP '{OFFERS_NOW}' + INTERVAL 1 DAY THEN 0 ELSE 1 END, pos) AS place FROM p WHERE pos <= 80"))
def soon_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable partition: offers that end within a day go behind the others, both in their order."""
    top = live_offers(spark, sf_dir).orderBy(F.desc("pct"), "price", "offer_id").limit(80)
    rows = ranked(top, [F.desc("pct"), F.asc("price"), F.asc("offer_id")])
    late = F.when(F.col("valid_until") > ts(OFFERS_NOW) + F.expr("INTERVAL 1 DAY"), 0).otherwise(1)
    return ranked(rows, [late, F.col("pos")], "place").select("offer_id", "place")


@register("collapse_names", sql("""WITH p AS (SELECT offer_id, lower(trim(product_name)) || ':' || chain AS k, price, created_at FROM live_offers), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created_at, offer_id) AS seen FROM p)
    SELECT k AS key, max(CASE WHEN seen = 1 THEN offer_id END) AS slot, arg_min(offer_id, ROW(price, seen)) AS kept, min(price) AS price FROM q GROUP BY k"""))  # fmt: skip
def collapse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a name and chain: it keeps the place of the first and is the cheapest, of equal prices the first."""
    rows = live_offers(spark, sf_dir).withColumn("key", F.concat_ws(":", F.lower(F.trim("product_name")), "chain"))
    return collapse_keep_position(rows, "key", [F.col("created_at"), F.col("offer_id")], "offer_id").select("key", "slot", "kept", "price")


@register("price_changes", sql("""WITH s AS (SELECT product_id, chain, recorded_at, run_id, line, price, lag(price) OVER (PARTITION BY product_id, chain ORDER BY recorded_at, run_id, line, price) AS before FROM observations)
    SELECT product_id, chain, recorded_at, run_id, line, price, before FROM s WHERE price IS DISTINCT FROM before"""))  # fmt: skip
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that differ from the one before of their product and chain, as a change feed stores them."""
    rows = neighbour(observations(spark, sf_dir), ["product_id", "chain"], F.date_trunc("month", "recorded_at"), ["recorded_at", "run_id", "line", "price"], "price", "before")
    return rows.where(~F.col("price").eqNullSafe(F.col("before"))).select("product_id", "chain", "recorded_at", "run_id", "line", "price", "before")


@register("collision_owner", sql("SELECT offer_id, CASE WHEN rn = 1 THEN product_id ELSE -1 END AS product_id FROM (SELECT offer_id, product_id, row_number() OVER (PARTITION BY product_id, chain, source ORDER BY created_at, offer_id) AS rn FROM live_offers)"))
def collision_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first offer of a run owns the product in its chain and source; the others lose the link (-1)."""
    w = Window.partitionBy("product_id", "chain", "source").orderBy("created_at", "offer_id")
    return live_offers(spark, sf_dir).select("offer_id", F.when(F.row_number().over(w) == 1, F.col("product_id")).otherwise(-1).alias("product_id"))


@register("first_and_last_per_key", sql("SELECT product_id, chain, arg_min(offer_id, ROW(created_at, offer_id)) AS first_offer, arg_max(offer_id, ROW(created_at, offer_id)) AS last_offer FROM live_offers GROUP BY product_id, chain"))
def first_and_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("created_at", "offer_id")
    return live_offers(spark, sf_dir).groupBy("product_id", "chain").agg(F.min_by("offer_id", at).alias("first_offer"), F.max_by("offer_id", at).alias("last_offer"))


@register("latest_observation", sql("SELECT product_id, chain, price, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id, chain ORDER BY recorded_at DESC, run_id DESC, line DESC, price) AS rn FROM observations) WHERE rn = 1"))
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("recorded_at"), F.desc("run_id"), F.desc("line"), F.asc("price")]
    return best_per_key(observations(spark, sf_dir), ["product_id", "chain"], order).select("product_id", "chain", "price", "recorded_at")


@register("shelf_rows", sql(f"""WITH s AS (SELECT * FROM observations WHERE chain <> 'AFRICA' AND price > 0 AND recorded_at >= TIMESTAMP '{OFFERS_NOW}' - INTERVAL 14 DAY AND recorded_at <= TIMESTAMP '{OFFERS_NOW}' + INTERVAL 60 SECOND)
    SELECT product_id, chain, price, row_number() OVER (PARTITION BY product_id ORDER BY price, chain) AS place FROM (SELECT *, row_number() OVER (PARTITION BY product_id, chain ORDER BY recorded_at DESC, run_id, line, price) AS rn FROM s) WHERE rn = 1"""))  # fmt: skip
def shelf_rows(spark: SparkSession, sf_dir: str, excluded: tuple[str, ...] = ("AFRICA",), max_age_days: int = 14) -> DataFrame:
    """The newest sound shelf price of each product in each chain but the excluded, cheapest first; a minute of clock skew is let in."""
    at, now = F.col("recorded_at"), ts(OFFERS_NOW)
    fresh = (at >= now - F.make_interval(days=F.lit(max_age_days))) & (at <= now + F.expr("INTERVAL 60 SECONDS"))
    rows = observations(spark, sf_dir).where(~F.col("chain").isin(*excluded) & is_price(F.col("price")) & fresh)
    newest = best_per_key(rows, ["product_id", "chain"], [F.desc("recorded_at"), F.asc("run_id"), F.asc("line"), F.asc("price")])
    return newest.withColumn("place", F.row_number().over(Window.partitionBy("product_id").orderBy("price", "chain"))).select("product_id", "chain", "price", "place")


@register("rank_and_difference", sql("SELECT offer_id, product_id, price, price = min(price) OVER w AS best, floor((price - min(price) OVER w) * 100 + 0.5) / 100 AS more, row_number() OVER (PARTITION BY product_id ORDER BY price, offer_id) AS place FROM live_offers WINDOW w AS (PARTITION BY product_id)"))
def rank_and_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketlens.functions.num import half_up

    low = F.min("price").over(Window.partitionBy("product_id"))
    place = F.row_number().over(Window.partitionBy("product_id").orderBy("price", "offer_id"))
    return live_offers(spark, sf_dir).select("offer_id", "product_id", "price", (F.col("price") == low).alias("best"), half_up(F.col("price") - low, 2).alias("more"), place.alias("place"))


@register("price_steps", sql("SELECT product_id, recorded_at, price, lead(recorded_at) OVER (PARTITION BY product_id ORDER BY recorded_at, run_id, line, price) AS until FROM observations"))
def price_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price holds until the next observation."""
    return _steps(observations(spark, sf_dir))


def _steps(rows: DataFrame) -> DataFrame:
    order = ["recorded_at", "run_id", "line", "price"]
    return neighbour(rows, ["product_id"], F.date_trunc("month", "recorded_at"), order, "recorded_at", "until", forward=True).select("product_id", "recorded_at", "price", "until")


@register("price_as_of_offer", sql("""WITH b AS (SELECT product_id, chain, recorded_at, arg_max(price, ROW(run_id, line, price)) AS price FROM observations GROUP BY ALL)
    SELECT o.offer_id, o.price, b.price AS price_as_of FROM offers o ASOF LEFT JOIN b ON o.product_id = b.product_id AND o.chain = b.chain AND o.created_at > b.recorded_at"""))  # fmt: skip
def price_as_of_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer with the last price that its product was seen at in its chain before it."""
    seen = observations(spark, sf_dir).select("product_id", "chain", F.col("recorded_at").alias("created_at"), "price", "run_id", "line")
    rows = offers(spark, sf_dir).select("offer_id", "product_id", "chain", "created_at", "price")
    return as_of(rows, seen, ["product_id", "chain"], "created_at", "price", ties=["run_id", "line", "price"]).select("offer_id", "price", "price_as_of")


@register("aisle_preview", sql("SELECT category, offer_id, rn AS place, n - least(n, 6) AS remaining FROM (SELECT category, offer_id, row_number() OVER (PARTITION BY category ORDER BY pct DESC, price, offer_id) AS rn, count(*) OVER (PARTITION BY category) AS n FROM live_offers) WHERE rn <= 6"))
def aisle_preview(spark: SparkSession, sf_dir: str, size: int = 6) -> DataFrame:
    """The first six of each aisle and how many more there are; counts and top rows are made apart, so no window holds an aisle."""
    rows = live_offers(spark, sf_dir)
    n = rows.groupBy("category").agg(F.count("*").alias("n"))
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("pct"), F.asc("price"), F.asc("offer_id")))).where(F.col("place") <= size)
    return top.join(n, "category").select("category", "offer_id", "place", (F.col("n") - F.least(F.col("n"), F.lit(size))).alias("remaining"))


@register("merge_by_product", sql("SELECT product_id, arg_min(offer_id, ROW(price, CASE WHEN original_price IS NULL THEN 1 ELSE 0 END, -epoch_us(valid_until), offer_id)) AS offer_id, min(price) AS price, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(valid_until) AS until FROM live_offers GROUP BY product_id"))
def merge_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one product become one: the cheapest, with a struck price before without, the longest valid, and all sources."""
    order = F.struct("price", F.when(F.col("original_price").isNull(), 1).otherwise(0), -micros(F.col("valid_until")), "offer_id")
    return live_offers(spark, sf_dir).groupBy("product_id").agg(
        F.min_by("offer_id", order).alias("offer_id"), F.min("price").alias("price"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.max("valid_until").alias("until")
    )


@register("better_row_wins", sql("SELECT key, offer_id, original_price FROM (SELECT product_id || ':' || chain AS key, offer_id, original_price, row_number() OVER (PARTITION BY product_id, chain ORDER BY original_price IS NULL, created_at, offer_id) AS rn FROM live_offers) WHERE rn = 1"))
def better_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_offers(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("product_id").cast("string"), "chain"))
    return best_per_key(rows, ["key"], [F.col("original_price").isNull().cast("int"), F.col("created_at"), F.col("offer_id")]).select("key", "offer_id", "original_price")


@register("ordered_concatenation", sql("SELECT part, offer_id FROM (SELECT 0 AS part, offer_id, row_number() OVER (ORDER BY pct DESC, offer_id) AS rn FROM live_offers WHERE pct >= 9) WHERE rn <= 5 UNION ALL SELECT part, offer_id FROM (SELECT 1 AS part, offer_id, row_number() OVER (ORDER BY price, offer_id) AS rn FROM live_offers WHERE pct < 9) WHERE rn <= 5"))
def ordered_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_offers(spark, sf_dir)
    first = rows.where("pct >= 9").orderBy(F.desc("pct"), "offer_id").limit(5).select(F.lit(0).alias("part"), "offer_id")
    return first.unionByName(rows.where("pct < 9").orderBy("price", "offer_id").limit(5).select(F.lit(1).alias("part"), "offer_id"))


@register("set_difference", sql("SELECT DISTINCT product_id FROM live_offers WHERE source = 'A' AND product_id NOT IN (SELECT product_id FROM live_offers WHERE source = 'R')"))
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: live_offers(spark, sf_dir).where(F.col("source") == s).select("product_id").distinct()
    return of("A").join(of("R"), "product_id", "left_anti")


@register("fixed_order_sort", sql("SELECT category, n, row_number() OVER (ORDER BY CASE category WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, category) AS place FROM (SELECT category, count(*) AS n FROM live_offers GROUP BY category)"))
def fixed_order_sort(spark: SparkSession, sf_dir: str, order: tuple[str, ...] = ("PROMO", "SMALL", "LARGE")) -> DataFrame:
    """Groups in a given order, unknown ones behind."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col("category")), F.lit(0)), F.lit(len(order) + 1))
    return ranked(live_offers(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")), [at, F.col("category")], "place")
