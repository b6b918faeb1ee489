"""Composite queries of the shop: home page, offer page, catalog, chain page, personal rail, resolution of raw names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import OFFERS_NOW, clicks, live_offers, observations, products, shop_offers, sql, ts
from basketlens.functions.packs import pack_count
from basketlens.functions.similarity import name_similarity, quantity_conflict, variant_conflict
from basketlens.functions.taxonomy import Rules, classify
from basketlens.functions.text import tokens
from basketlens.operators.compare import comparison_chains
from basketlens.operators.dedupe import dedupe_offers
from basketlens.operators.ranking import best_per_key, cap_per_group, ranked
from basketlens.operators.resolve import checked_verdicts, resolve_by_tokens
from basketlens.plans.ordered import pool
from basketlens.registry import register

_TOP = "SELECT *, row_number() OVER (ORDER BY pct DESC, price, offer_id) AS pos FROM live_offers"
_DEDUPED = """f1 AS (SELECT product_id, chain, product_name, min(pos) AS slot, arg_min(offer_id, ROW(price, pos)) AS id, min(price) AS price FROM p GROUP BY product_id, chain, product_name),
    f2 AS (SELECT lower(trim(product_name)) AS n, chain, min(slot) AS slot, arg_min(ROW(product_id, id, price), ROW(price, slot)) AS r FROM f1 GROUP BY n, chain)"""


@register("deduped_offers", sql(f"WITH t AS ({_TOP}), p AS (SELECT * FROM t WHERE pos <= 200), {_DEDUPED} SELECT slot, r[2] AS id, chain, r[3] AS price FROM f2"))
def deduped_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_offers(pool(spark, sf_dir, 200)).select("slot", "id", "chain", "price")


@register("top_deals", sql(f"""WITH t AS ({_TOP}), p AS (SELECT * FROM t WHERE pos <= 80), {_DEDUPED},
    f3 AS (SELECT r[1] AS product_id, chain, slot, r[2] AS id, r[3] AS price, n FROM f2), f4 AS (SELECT product_id, n, min(slot) AS slot, arg_min(ROW(id, chain, price), ROW(price, slot)) AS r FROM f3 GROUP BY product_id, n),
    f5 AS (SELECT n, min(slot) AS slot, arg_min(r, ROW(r[3], slot)) AS r FROM f4 GROUP BY n), c AS (SELECT r[1] AS offer_id, r[2] AS chain, slot, row_number() OVER (PARTITION BY r[2] ORDER BY slot) AS rn FROM f5)
    SELECT offer_id, chain, row_number() OVER (ORDER BY CASE WHEN rn <= 3 THEN 0 ELSE 1 END, slot) AS place FROM c QUALIFY place <= 10"""))  # fmt: skip
def top_deals(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    """The best 80 offers, deduped over all chains, at most three of a chain before the rest fills up."""
    rows = dedupe_offers(pool(spark, sf_dir, 80), cross_chain=True)
    return cap_per_group(rows.withColumnRenamed("id", "offer_id"), "chain", "slot", cap=3, need=limit).select("offer_id", "chain", "place")


@register("price_comparison", sql("""WITH s AS (SELECT * FROM live_offers ORDER BY pct DESC, price, offer_id LIMIT 1), c AS (SELECT o.* FROM live_offers o JOIN s ON o.product_id = s.product_id WHERE o.offer_id <> s.offer_id ORDER BY o.price, o.offer_id LIMIT 8)
    SELECT offer_id, chain, price, row_number() OVER (ORDER BY price, offer_id) AS place FROM c"""))  # fmt: skip
def price_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other offers of the best offer's product that pass the pack, variant and quantity guards, cheapest eight first."""
    rows = live_offers(spark, sf_dir)
    source = rows.orderBy(F.desc("pct"), "price", "offer_id").limit(1).select("product_id", F.col("offer_id").alias("source_id"), F.col("product_name").alias("source_name"))
    a, b = F.col("source_name"), F.col("product_name")
    hits = rows.join(F.broadcast(source), "product_id").where("offer_id <> source_id").where((pack_count(a) == pack_count(b)) & ~variant_conflict(a, b) & ~quantity_conflict(a, b))
    best = hits.withColumn("score", name_similarity(a, b))
    top = F.max("score").over(Window.partitionBy("chain"))
    kept = best.withColumn("top", top).where("score >= 0.5 AND score >= top - 0.05").orderBy("price", "offer_id").limit(8)
    return ranked(kept, [F.asc("price"), F.asc("offer_id")], "place").select("offer_id", "chain", "price", "place")


@register("comparison_counts", sql(f"""WITH o AS (SELECT *, qty % 4 AS form FROM live_offers),
    m AS (SELECT s.offer_id, s.chain AS own, a.offer_id AS other, a.chain, a.price, CASE WHEN s.form = a.form THEN 1 ELSE 2 / 3 END AS score FROM o s JOIN o a ON a.product_id = s.product_id AND a.offer_id <> s.offer_id AND (a.form = s.form OR (a.form < 2 AND s.form < 2))),
    k AS (SELECT * FROM m QUALIFY score >= max(score) OVER (PARTITION BY offer_id, chain) - 0.05), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY price, other) <= 8),
    n AS (SELECT offer_id, count(DISTINCT chain) FILTER (WHERE chain <> own) AS n FROM c GROUP BY offer_id),
    shelf AS (SELECT product_id, count(DISTINCT chain) AS n FROM observations x JOIN products USING (product_id) WHERE x.price > 0 AND size % 2 = 0 AND recorded_at >= TIMESTAMP '{OFFERS_NOW}' - INTERVAL 14 DAY AND recorded_at <= TIMESTAMP '{OFFERS_NOW}' + INTERVAL 60 SECOND
        AND NOT EXISTS (SELECT 1 FROM live_offers l WHERE l.product_id = x.product_id AND l.chain = x.chain) GROUP BY product_id)
    SELECT offer_id, CAST(coalesce(n.n, 0) + coalesce(shelf.n, 0) AS BIGINT) AS chains FROM live_offers LEFT JOIN n USING (offer_id) LEFT JOIN shelf USING (product_id)"""))  # fmt: skip
def comparison_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many other chains each offer can be compared: by offers of the same goods or, of products with a barcode, by a fresh shelf price where there is no offer."""
    at, now = F.col("recorded_at"), ts(OFFERS_NOW)
    fresh = observations(spark, sf_dir).where((F.col("price") > 0) & (at >= now - F.expr("INTERVAL 14 DAYS")) & (at <= now + F.expr("INTERVAL 60 SECONDS")))
    shelf = fresh.join(products(spark, sf_dir).where("size % 2 = 0").select("product_id"), "product_id", "left_semi").select("product_id", "chain")
    return comparison_chains(shop_offers(spark, sf_dir), shelf).select("offer_id", F.col("chains").cast("long").alias("chains"))


@register("similar_offers", sql("""WITH s AS (SELECT * FROM live_offers ORDER BY pct DESC, price, offer_id LIMIT 1), c AS (SELECT o.offer_id, o.product_name, o.pct, s.product_name AS src FROM live_offers o, s WHERE o.category = s.category AND o.product_id IS DISTINCT FROM s.product_id ORDER BY o.pct DESC, o.price, o.offer_id LIMIT 120)
    SELECT offer_id, len(list_intersect(string_split(product_name, ' '), string_split(src, ' '))) / CAST(4 - len(list_intersect(string_split(product_name, ' '), string_split(src, ' '))) AS DOUBLE) AS score FROM c ORDER BY score DESC, offer_id LIMIT 8"""))  # fmt: skip
def similar_offers(spark: SparkSession, sf_dir: str, limit: int = 8) -> DataFrame:
    """Of the 120 hottest offers of the same category and another product, those with the most similar names."""
    rows = live_offers(spark, sf_dir)
    source = rows.orderBy(F.desc("pct"), "price", "offer_id").limit(1).select("category", F.col("product_id").alias("source_product"), F.col("product_name").alias("source_name"))
    near = rows.join(F.broadcast(source), "category").where(~F.col("product_id").eqNullSafe(F.col("source_product"))).orderBy(F.desc("pct"), "price", "offer_id").limit(120)
    return near.select("offer_id", name_similarity(F.col("source_name"), F.col("product_name")).alias("score")).orderBy(F.desc("score"), "offer_id").limit(limit)


@register("catalog_browse", sql("""WITH b AS (SELECT product_id, max(pct) AS best FROM live_offers GROUP BY product_id), l AS (SELECT product_id, price, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, run_id DESC, line DESC, price) AS rn FROM observations) WHERE rn = 1)
    SELECT p.product_id, best, l.price AS shelf_price FROM products p LEFT JOIN b USING (product_id) LEFT JOIN l USING (product_id) WHERE contains(p.product_name, 'widget') ORDER BY best IS NULL, best DESC, p.product_id LIMIT 48"""))  # fmt: skip
def catalog_browse(spark: SparkSession, sf_dir: str, term: str = "widget", limit: int = 48) -> DataFrame:
    """Catalog search: products on offer first, with the newest shelf price of any chain."""
    best = live_offers(spark, sf_dir).groupBy("product_id").agg(F.max("pct").alias("best"))
    shelf = best_per_key(observations(spark, sf_dir), ["product_id"], [F.desc("recorded_at"), F.desc("run_id"), F.desc("line"), F.asc("price")]).select("product_id", F.col("price").alias("shelf_price"))
    rows = products(spark, sf_dir).where(F.col("product_name").contains(term)).join(best, "product_id", "left").join(shelf, "product_id", "left")
    return rows.orderBy(F.desc_nulls_last("best"), "product_id").limit(limit).select("product_id", "best", "shelf_price")


@register("category_browse", sql("SELECT offer_id, brand, pct FROM live_offers WHERE chain = 'ASIA' AND category = 'LARGE' ORDER BY pct DESC NULLS LAST, offer_id LIMIT 24 OFFSET 3"))
def category_browse(spark: SparkSession, sf_dir: str, chain: str = "ASIA", category: str = "LARGE") -> DataFrame:
    rows = live_offers(spark, sf_dir).where((F.col("chain") == chain) & (F.col("category") == category))
    return rows.orderBy(F.desc_nulls_last("pct"), "offer_id").offset(3).limit(24).select("offer_id", "brand", "pct")


@register("chain_page", sql("SELECT chain, count(*) AS n, count(DISTINCT product_id) AS n_products, max(pct) AS biggest, arg_max(offer_id, ROW(pct, -price, offer_id)) AS hottest FROM live_offers GROUP BY chain"))
def chain_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("offer_id", F.struct(F.col("pct"), (-F.col("price")).alias("p"), F.col("offer_id")))
    return live_offers(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("n_products"), F.max("pct").alias("biggest"), best.alias("hottest"))


@register("for_you_rail", sql("""WITH w AS (SELECT category, count(*) AS w FROM clicks JOIN products USING (product_id) WHERE session_id = 8 GROUP BY category), t AS (SELECT *, row_number() OVER (ORDER BY pct DESC, price, offer_id) AS pos FROM live_offers)
    SELECT offer_id, CASE WHEN category = 'PROMO' THEN 10 ELSE 0 END + coalesce(w, 0) AS score FROM t LEFT JOIN w USING (category) WHERE pos <= 60 ORDER BY score DESC, pos LIMIT 12"""))  # fmt: skip
def for_you_rail(spark: SparkSession, sf_dir: str, session: int = 8, declared: tuple[str, ...] = ("PROMO",)) -> DataFrame:
    """The hottest 60 re-ranked by a session's interest; the former order breaks ties."""
    w = clicks(spark, sf_dir).where(F.col("session_id") == session).join(products(spark, sf_dir), "product_id").groupBy("category").agg(F.count("*").alias("w"))
    rows = pool(spark, sf_dir, 60).join(w, "category", "left")
    score = F.when(F.col("category").isin(*declared), 10).otherwise(0) + F.coalesce("w", F.lit(0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "pos").limit(12).select("offer_id", "score")


#: Rules over the catalog's vocabulary: the same mechanism as for shop names.
PART_RULES = Rules(
    keywords=(("fasteners", ("=bolt", "screw")), ("rings", ("ring",)), ("machines", ("gear", "=anvil", "gizmo")), ("goods", ("widget", "plate"))),
    aliases={"PROMO": "promotions"}, chains={"Brand#1": {"SMALL": "small goods", "LARGE": None}}, departments=("fasteners", "rings", "machines", "goods"), overrides=(("hot things", ("hot ",)),), other="unsorted",
)


@register("classified_products", sql("""SELECT product_id, CASE WHEN contains(product_name, 'hot ') THEN 'hot things' WHEN brand = 'Brand#1' AND category = 'SMALL' THEN 'small goods'
    WHEN category = 'PROMO' AND NOT (brand = 'Brand#1' AND category = 'LARGE') THEN 'promotions' WHEN regexp_matches(product_name, '(^|[^a-z0-9α-ω])bolt([^a-z0-9α-ω]|$)|(^|[^a-z0-9])screw([^a-z0-9]|$)') THEN 'fasteners'
    WHEN regexp_matches(product_name, '(^|[^a-z0-9])ring([^a-z0-9]|$)') THEN 'rings' WHEN regexp_matches(product_name, '(^|[^a-z0-9])(gear|anvil|gizmo)([^a-z0-9]|$)') THEN 'machines' WHEN regexp_matches(product_name, '(^|[^a-z0-9])(widget|plate)([^a-z0-9]|$)') THEN 'goods' ELSE 'unsorted' END AS dept FROM products"""))  # fmt: skip
def classified_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", classify(F.col("brand"), F.col("product_name"), F.col("category"), PART_RULES)["dept"].alias("dept"))


@register("recategorized_products", sql(f"""WITH c AS (SELECT product_id, product_name AS n, CASE WHEN contains(product_name, 'hot ') THEN 'override' WHEN brand = 'Brand#1' AND category = 'SMALL' THEN 'chain' WHEN brand = 'Brand#1' AND category = 'LARGE' THEN 'chain-mixed' WHEN category = 'PROMO' THEN 'native-alias' ELSE 'name' END AS how, category,
    CASE WHEN regexp_matches(product_name, '(^| )bolt( |$)') THEN '=bolt' WHEN regexp_matches(product_name, '(^| )screw( |$)') THEN 'screw' WHEN regexp_matches(product_name, '(^| )ring( |$)') THEN 'ring' ELSE nullif(regexp_replace(regexp_extract(product_name, '(gear|anvil|gizmo|widget|plate)$'), 'anvil', '=anvil'), '') END AS term FROM products),
    d AS (SELECT *, CASE WHEN term IN ('=bolt', 'screw') THEN 'fasteners' WHEN term = 'ring' THEN 'rings' WHEN term IN ('gear', '=anvil', 'gizmo') THEN 'machines' WHEN term IS NOT NULL THEN 'goods' ELSE 'unsorted' END AS by_name FROM c),
    e AS (SELECT product_id, 'goods' AS stored, CASE how WHEN 'override' THEN 'hot things' WHEN 'chain' THEN 'small goods' WHEN 'native-alias' THEN 'promotions' ELSE by_name END AS dept, how AS via, CASE WHEN how = 'native-alias' THEN category WHEN how IN ('name', 'chain-mixed') THEN term END AS term FROM d)
    SELECT product_id, stored, dept, via, term FROM e WHERE dept NOT IN ('unsorted', 'goods')"""))  # fmt: skip
def recategorized_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New departments where they differ from the stored one; a stored department is never given up for none."""
    dept = classify(F.col("brand"), F.col("product_name"), F.col("category"), PART_RULES)
    # a generator, so that the filter does not repeat the classifier
    changed = F.inline(F.filter(F.array(dept), lambda c: (c["dept"] != PART_RULES.other) & ~c["dept"].eqNullSafe(F.lit("goods"))))
    return products(spark, sf_dir).select("product_id", F.lit("goods").alias("stored"), changed).drop("mapped")


@register("resolved_names", sql("SELECT * FROM (VALUES ('r1', NULL, 'tokens'), ('r2', (SELECT min(product_id) FROM products WHERE product_name = 'hot gear'), NULL), ('r3', NULL, 'brand'), ('r4', NULL, 'tokens'), ('r5', NULL, 'no candidate')) v(raw_id, product_id, reject_reason)"))
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few raw names to products without a model; names of two words may be accepted here."""
    raw = spark.createDataFrame([("r1", "small red bolt"), ("r2", "hot gear"), ("r3", "6x hot gear"), ("r4", "gear hot thing"), ("r5", "unknown")], "raw_id string, raw string")
    return resolve_by_tokens(raw, products(spark, sf_dir), least=2)


def _raw_names(rows: DataFrame) -> DataFrame:
    """Raw names that the catalog's own names are altered to, as the size says: the same, a word more, a pack, or turned round."""
    name, form = F.col("product_name"), F.col("size") % 4
    raw = F.when(form == 0, name).when(form == 1, F.concat(name, F.lit(" special"))).when(form == 2, F.concat(name, F.lit(" 6 x 2"))).otherwise(F.concat_ws(" ", F.reverse(F.split(name, " "))))
    return rows.select(F.col("product_id").alias("raw_id"), raw.alias("raw"), name.alias("product_name"), "size")


def _distinct_names(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_name").agg(F.min("product_id").alias("product_id"))


@register("resolved_products", sql("""SELECT p.product_id AS raw_id, CASE WHEN size % 4 = 0 THEN m.id END AS product_id, CASE size % 4 WHEN 1 THEN 'tokens' WHEN 2 THEN 'pack' WHEN 3 THEN 'brand' END AS reject_reason
    FROM products p JOIN (SELECT product_name, min(product_id) AS id FROM products GROUP BY product_name) m USING (product_name)"""))  # fmt: skip
def resolved_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An altered name of each product to one product a name; the catalog is the distinct names, so tokens are rare in it."""
    rows = products(spark, sf_dir)
    return resolve_by_tokens(_raw_names(rows).select("raw_id", "raw"), _distinct_names(rows), least=2)


@register("checked_verdicts", sql("""WITH m AS (SELECT product_name, min(product_id) AS id FROM products GROUP BY product_name),
    r AS (SELECT p.product_id AS raw_id, size, CASE WHEN size % 5 = 0 THEN -1 ELSE m.id END AS suggestion, CASE WHEN size < 10 THEN NULL ELSE 80 + size END AS confidence FROM products p JOIN m USING (product_name)),
    c AS (SELECT raw_id, suggestion, CASE WHEN confidence IS NULL OR confidence < 90 THEN 'low confidence' WHEN suggestion = -1 THEN 'no candidate' WHEN size % 4 = 3 THEN 'brand' WHEN size % 4 = 2 THEN 'pack' END AS reject_reason FROM r)
    SELECT raw_id, CASE WHEN reject_reason IS NULL THEN suggestion END AS product_id, reject_reason FROM c"""))  # fmt: skip
def checked_verdicts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a made-up scorer over the altered names, of which some are unsure and some suggest no candidate."""
    rows = products(spark, sf_dir)
    offered = _raw_names(rows).join(_distinct_names(rows), "product_name").select("raw_id", "raw", "size", "product_id", "product_name")
    suggestion = F.when(F.col("size") % 5 == 0, F.lit(-1).cast("long")).otherwise(F.col("product_id"))
    verdicts = offered.select("raw_id", "raw", suggestion.alias("suggestion"), F.when(F.col("size") >= 10, F.col("size") + 80).alias("confidence"))
    return checked_verdicts(verdicts, offered)
