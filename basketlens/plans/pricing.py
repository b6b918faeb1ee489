"""Price verdicts, heat, packs, name similarity and comparisons between chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import EVENTS_NOW, OFFERS_NOW, clicks, live_offers, observations, offers, products, shop_offers, sql, ts
from basketlens.functions.num import half_up, is_price
from basketlens.functions.scores import hot_score, percent_above, verdict
from basketlens.functions.similarity import overlap
from basketlens.functions.text import brand_token, tokens
from basketlens.operators.compare import cheaper_alternatives, comparable_pairs, overlaps_of, top_overlaps, waterfall
from basketlens.registry import register

_STATS = f"""stats AS (SELECT product_id, min(price) AS low, max(price) AS high, CAST(sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mean, count(*) AS points
    FROM offers WHERE price > 0 AND created_at <= TIMESTAMP '{OFFERS_NOW}' AND created_at > TIMESTAMP '{OFFERS_NOW}' - INTERVAL 90 DAY GROUP BY product_id)"""
_VERDICT = """CASE WHEN points >= 3 AND high - low > 0.01 THEN CASE WHEN price - low <= 0.01 THEN 'lowest' WHEN (price - low) / low * 100 <= 5 THEN 'good' WHEN price < mean THEN 'fair' WHEN price <= mean + 0.01 THEN 'meh' ELSE 'high' END END"""


def price_stats(spark: SparkSession, sf_dir: str, days: int = 90) -> DataFrame:
    """Low, high, mean and number of the sound prices of each product in the window; the mean is of whole cents, so its sum is exact."""
    now = ts(OFFERS_NOW)
    rows = offers(spark, sf_dir).where(is_price(F.col("price")) & (F.col("created_at") <= now) & (F.col("created_at") > now - F.make_interval(days=F.lit(days))))
    cents = F.sum(F.floor(F.col("price") * 100 + 0.5).cast("long")).cast("double")
    return rows.groupBy("product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), (cents / F.count("*") / 100).alias("mean"), F.count("*").alias("points"))


def judged_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_offers(spark, sf_dir).join(price_stats(spark, sf_dir), "product_id", "left")
    return rows.withColumn("verdict", verdict(F.col("price"), F.col("low"), F.col("high"), F.col("mean"), F.col("points")))


@register("price_verdicts", sql(f"WITH {_STATS} SELECT offer_id, price, low, coalesce(points, 0) AS points, {_VERDICT} AS verdict, CASE WHEN low > 0 THEN floor((price - low) / low * 100 * 10 + 0.5) / 10 ELSE 0 END AS above FROM live_offers LEFT JOIN stats USING (product_id)"))
def price_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_offers(spark, sf_dir).select("offer_id", "price", "low", F.coalesce("points", F.lit(0)).alias("points"), "verdict", percent_above(F.col("price"), F.col("low")).alias("above"))


@register("verdict_tally", sql(f"WITH {_STATS} SELECT coalesce({_VERDICT}, 'none') AS verdict, count(*) AS n FROM live_offers LEFT JOIN stats USING (product_id) GROUP BY 1"))
def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: live offers judged against their product's history, counted by verdict."""
    return judged_offers(spark, sf_dir).groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@register("changed_verdicts_only", sql(f"WITH {_STATS} SELECT offer_id, {_VERDICT} AS verdict FROM live_offers LEFT JOIN stats USING (product_id) WHERE ({_VERDICT}) IS DISTINCT FROM CASE WHEN pct > 5 THEN 'lowest' END"))
def changed_verdicts_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows whose new value differs from the stored one (here: lowest for more than 5 percent off) are written back."""
    stored = F.when(F.col("pct") > 5, "lowest")
    return judged_offers(spark, sf_dir).where(~F.col("verdict").eqNullSafe(stored)).select("offer_id", "verdict")


@register("price_history", sql(f"SELECT product_id, recorded_at, price, chain FROM observations WHERE product_id = 8 AND recorded_at <= TIMESTAMP '{OFFERS_NOW}' ORDER BY recorded_at, run_id, line, price"))
def price_history(spark: SparkSession, sf_dir: str, product_id: int = 8) -> DataFrame:
    rows = observations(spark, sf_dir).where((F.col("product_id") == product_id) & (F.col("recorded_at") <= ts(OFFERS_NOW)))
    return rows.orderBy("recorded_at", "run_id", "line", "price").select("product_id", "recorded_at", "price", "chain")


@register("own_chain_shelf_price", sql("""WITH l AS (SELECT product_id, chain, price, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id, chain ORDER BY recorded_at DESC, run_id DESC, line DESC, price) AS rn FROM observations) WHERE rn = 1)
    SELECT offer_id, shelf_chain, shelf_price FROM (SELECT o.offer_id, l.chain AS shelf_chain, l.price AS shelf_price, row_number() OVER (PARTITION BY o.offer_id ORDER BY l.chain = o.chain DESC, l.recorded_at DESC, l.chain) AS rn FROM live_offers o LEFT JOIN l USING (product_id)) WHERE rn = 1"""))  # fmt: skip
def own_chain_shelf_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each offer with the newest shelf price of its own chain, else of any chain."""
    from basketlens.operators.ranking import best_per_key

    newest = best_per_key(observations(spark, sf_dir), ["product_id", "chain"], [F.desc("recorded_at"), F.desc("run_id"), F.desc("line"), F.asc("price")])
    shelf = newest.select("product_id", F.col("chain").alias("shelf_chain"), F.col("price").alias("shelf_price"), "recorded_at")
    rows = live_offers(spark, sf_dir).join(shelf, "product_id", "left")
    order = [F.desc(F.col("shelf_chain") == F.col("chain")), F.desc("recorded_at"), F.asc("shelf_chain")]
    return best_per_key(rows, ["offer_id"], order).select("offer_id", "shelf_chain", "shelf_price")


#: What a shop's name and description add to a catalog name, and the points that each is worth.
SHOP_NAMES, SHOP_NAME_POINTS = ("", " γάλα", " NESCAFE", " τυρί φέτα", " σαμπουάν", " coca cola"), (0, 10, 14, 6, 3, 14)
SHOP_TEXTS, SHOP_TEXT_POINTS = ("", "1+1 δώρο", "SUPER προσφορά", "3 για 2", "νέο"), (0, 14, 7, 8, 0)


@register("hot_scores", sql(f"""WITH c AS (SELECT product_id, count(*) FILTER (WHERE event_type = 'click') AS n_clicks, count(*) FILTER (WHERE event_type = 'purchase') AS n_adds FROM clicks WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY GROUP BY product_id), {_STATS},
    h AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(regexp_extract_all(offer_id, '.'), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS u,
        {list(SHOP_NAME_POINTS)}[product_id % 6 + 1] + {list(SHOP_TEXT_POINTS)}[qty % 5 + 1] AS words, CASE {_VERDICT} WHEN 'lowest' THEN 8 WHEN 'good' THEN 4 WHEN 'meh' THEN -2 WHEN 'high' THEN -6 ELSE 0 END AS judged
        FROM live_offers LEFT JOIN c USING (product_id) LEFT JOIN stats USING (product_id))
    SELECT offer_id, floor((words + pct * 0.2::DOUBLE + (log2(1 + coalesce(n_clicks, 0)) * 7 + log2(1 + coalesce(n_adds, 0)) * 10) + judged + greatest(0, 2 - greatest(0, (epoch_us(TIMESTAMP '{OFFERS_NOW}') - epoch_us(created_at)) / 86400000000) * 0.2::DOUBLE) + (abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 120) / 100) * 100 + 0.5) / 100 AS hot FROM h"""))  # fmt: skip
def hot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchandising score from goods, brands and mechanics of the shop's name and text, discount, trailing two weeks of
    clicks and list adds, the price's verdict, recency and a stable jitter."""
    recent = clicks(spark, sf_dir).where(F.col("ts") >= ts(EVENTS_NOW) - F.expr("INTERVAL 14 DAYS"))
    n = recent.groupBy("product_id").agg(F.count_if(F.col("event_type") == "click").alias("n_clicks"), F.count_if(F.col("event_type") == "purchase").alias("n_adds"))
    rows = judged_offers(spark, sf_dir).join(n, "product_id", "left")
    added = lambda texts, of: F.element_at(F.array(*map(F.lit, texts)), (of % len(texts) + 1).cast("int"))
    name, text = F.concat("product_name", added(SHOP_NAMES, F.col("product_id"))), added(SHOP_TEXTS, F.col("qty"))
    score = hot_score(name, text, F.col("pct"), F.col("n_clicks"), F.col("n_adds"), F.col("verdict"), F.col("created_at"), ts(OFFERS_NOW), F.col("offer_id"))
    return rows.select("offer_id", score.alias("hot"))


@register("cheaper_alternatives", sql("""WITH o AS (SELECT *, qty % 4 AS form FROM live_offers), c AS (SELECT s.offer_id, a.offer_id AS other, a.chain, a.price, floor((s.price - a.price) * 100 + 0.5) / 100 AS saving, CASE WHEN s.form = a.form THEN 1 ELSE 2 / 3 END AS score
    FROM o s JOIN o a ON a.product_id = s.product_id AND a.chain <> s.chain AND s.price - a.price >= 0.1 AND (a.form = s.form OR (a.form < 2 AND s.form < 2))),
    d AS (SELECT * FROM c QUALIFY score >= max(score) OVER (PARTITION BY offer_id, chain) - 0.05)
    SELECT offer_id, other, chain, saving FROM d QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY price, other) = 1"""))  # fmt: skip
def cheaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same goods, cheaper elsewhere: other packs and variants of a product do not count, and a plain name rather meets a plain one."""
    rows = shop_offers(spark, sf_dir)
    return cheaper_alternatives(rows, rows)


@register("cheapest_by_product", sql("SELECT product_id, arg_min(offer_id, ROW(price, offer_id)) AS offer_id, min(price) AS price FROM live_offers GROUP BY product_id"))
def cheapest_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_offers(spark, sf_dir).groupBy("product_id").agg(F.min_by("offer_id", F.struct("price", "offer_id")).alias("offer_id"), F.min("price").alias("price"))


@register("cluster_offers", sql("SELECT a.offer_id, count(*) AS others, count(DISTINCT b.chain) AS chains FROM live_offers a JOIN live_offers b ON a.product_name = b.product_name AND a.size = b.size AND a.offer_id <> b.offer_id GROUP BY a.offer_id"))
def cluster_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other offers of an offer's cluster (name and size stand for the barcode). Two counts by key, one of them by chain,
    replace the self-join: a row's own chain counts only if it has another offer there."""
    rows = live_offers(spark, sf_dir)
    per_chain = rows.groupBy("product_name", "size", "chain").agg(F.count("*").alias("here"))
    total = per_chain.groupBy("product_name", "size").agg(F.sum("here").alias("n"), F.count("*").alias("k"))
    joined = rows.join(per_chain, ["product_name", "size", "chain"]).join(total, ["product_name", "size"]).where("n > 1")
    return joined.select("offer_id", (F.col("n") - 1).alias("others"), F.when(F.col("here") > 1, F.col("k")).otherwise(F.col("k") - 1).alias("chains"))


@register("similar_names", sql("""WITH n AS (SELECT DISTINCT category || '/' || brand AS block, product_name || ' ' || brand AS name, string_split(product_name, ' ') AS w FROM products)
    SELECT a.block, a.name AS a, b.name AS b FROM n a JOIN n b ON a.block = b.block AND a.name < b.name WHERE len(list_intersect(a.w, b.w)) = 1"""))  # fmt: skip
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct names (with brand) of one category and brand that pass the variant, quantity and similarity guards."""
    names = products(spark, sf_dir).select(F.concat_ws("/", "category", "brand").alias("block"), F.concat_ws(" ", "product_name", "brand").alias("name")).distinct()
    return comparable_pairs(names, "block", "name")


@register("token_candidates", sql("""WITH q AS (SELECT 'q1' AS id, ['small', 'red', 'bolt'] AS ts UNION ALL SELECT 'q2', ['hot', 'gear', 'hot'] UNION ALL SELECT 'q3', ['nothing']),
    m AS (SELECT q.id, p.product_id, CAST(len(list_filter(q.ts, lambda t: list_contains(string_split(p.product_name, ' '), t))) AS BIGINT) AS score FROM q CROSS JOIN products p)
    SELECT id, product_id, score FROM m WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, product_id) <= 10"""))  # fmt: skip
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten products that share most tokens with each raw name, over an inverted token index instead of all pairs."""
    raw = spark.createDataFrame([("q1", "small red bolt"), ("q2", "Hot gear HOT"), ("q3", "nothing")], "id string, name string")
    catalog = products(spark, sf_dir).select("product_id", tokens(F.col("product_name")).alias("tokens"))
    return top_overlaps(raw.select("id", tokens(F.col("name")).alias("tokens")), catalog, "id", "product_id", 10)


@register("best_image_match", sql("""WITH q AS (SELECT * FROM (VALUES ('a', ['red', 'widget']), ('b', ['large', 'steel', 'anvil'])) v(id, ts)), m AS (SELECT q.id, p.product_id, len(list_filter(q.ts, lambda t: list_contains(string_split(p.product_name, ' '), t))) / CAST(least(len(q.ts), len(list_filter(string_split(p.product_name, ' '), lambda t: length(t) >= 3))) AS DOUBLE) AS score FROM q CROSS JOIN products p)
    SELECT id, product_id, score FROM m WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, product_id) = 1"""))  # fmt: skip
def best_image_match(spark: SparkSession, sf_dir: str, floor: float = 0.6) -> DataFrame:
    """The best catalog row of each name by overlap over the shorter side, if it reaches the floor."""
    raw = spark.createDataFrame([("a", "red widget"), ("b", "large steel anvil")], "id string, name string").select("id", tokens(F.col("name")).alias("tokens"))
    catalog = products(spark, sf_dir).select("product_id", tokens(F.col("product_name")).alias("tokens"))
    scored = overlaps_of(raw, catalog, "id", "product_id", floor).withColumnRenamed("share", "score")
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.asc("product_id")))).where("rn = 1").drop("rn")


@register("match_waterfall", sql("""WITH m AS (SELECT offer_id, product_name, product_id AS raw, CASE WHEN product_id % 3 = 0 THEN product_id END AS sku, CASE WHEN product_id % 5 = 0 THEN product_id END AS code FROM live_offers),
    names AS (SELECT product_name, min(product_id) AS pid FROM products GROUP BY product_name)
    SELECT offer_id, coalesce(sku, code, pid) AS product_id, CASE WHEN sku IS NOT NULL THEN 'sku' WHEN code IS NOT NULL THEN 'barcode' WHEN pid IS NOT NULL THEN 'name' END AS via FROM m LEFT JOIN names USING (product_name)"""))  # fmt: skip
def match_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve offers to products by mapping, else barcode, else cached name."""
    rows = live_offers(spark, sf_dir).select("offer_id", "product_name", F.col("product_id").alias("code"))
    known = products(spark, sf_dir)
    by_sku = known.where("product_id % 3 = 0").select(F.col("product_id").alias("code"), "product_id")
    by_code = known.where("product_id % 5 = 0").select(F.col("product_id").alias("code"), "product_id")
    by_name = known.groupBy("product_name").agg(F.min("product_id").alias("product_id"))
    return waterfall(rows, [("sku", by_sku, "code"), ("barcode", by_code, "code"), ("name", by_name, "product_name")]).select("offer_id", "product_id", "via")


@register("mapping_bands", sql("""WITH latest AS (SELECT product_id, product_name, arg_max(qty % 5, ROW(created_at, offer_id)) AS form FROM named_offers GROUP BY ALL)
    SELECT CASE WHEN form IN (1, 4) THEN 'BAD' WHEN form = 2 THEN 'SUSPECT' ELSE 'OK' END AS band, count(*) AS n FROM latest GROUP BY band"""))  # fmt: skip
def mapping_bands(spark: SparkSession, sf_dir: str, hard: float = 0.34, suspect: float = 0.5) -> DataFrame:
    """The newest raw name that each product was offered under, graded by how many of its words the product's name has.

    A raw name is the product's name, with five or three words more, its first word and another, or other words, as the quantity says.
    """
    name = F.col("product_name")
    forms = (name, F.concat(name, F.lit(" from our own fine bakery")), F.concat(name, F.lit(" two for one")), F.concat(F.split_part(name, F.lit(" "), F.lit(1)), F.lit(" other")), F.lit("something else"))
    raw = F.element_at(F.array(*forms), (F.col("qty") % 5 + 1).cast("int"))
    rows = offers(spark, sf_dir).join(products(spark, sf_dir), "product_id")
    latest = rows.groupBy("product_id", "product_name").agg(F.max_by(raw, F.struct("created_at", "offer_id")).alias("raw"))
    score = overlap(F.col("raw"), F.col("product_name"))
    return latest.groupBy(F.when(score < hard, "BAD").when(score < suspect, "SUSPECT").otherwise("OK").alias("band")).agg(F.count("*").alias("n"))


@register("brand_tokens", sql("SELECT product_id, CASE WHEN length(regexp_replace(split_part(product_name, ' ', 1), '[^a-z0-9]', '', 'g')) >= 3 THEN split_part(product_name, ' ', 1) END AS token FROM products"))
def brand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", brand_token(F.col("product_name")).alias("token"))


@register("unit_prices", sql("SELECT offer_id, floor(price / qty * 100 + 0.5) / 100 AS each_price FROM live_offers WHERE qty >= 2"))
def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_offers(spark, sf_dir).where("qty >= 2").select("offer_id", half_up(F.col("price") / F.col("qty"), 2).alias("each_price"))
