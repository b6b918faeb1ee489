"""Whole ingest runs over the tables: one chain's catalog, and one chain's offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.bindings import observations, offers, products, sql, ts
from basketlens.functions.packs import pack_count
from basketlens.functions.similarity import salient_tokens, token_similarity
from basketlens.functions.text import let
from basketlens.operators.catalog_run import CatalogRun, run_catalog
from basketlens.operators.offer_run import Catalog, Run, run_offers
from basketlens.operators.ranking import best_per_key
from basketlens.plans.shop import PART_RULES
from basketlens.registry import register

CHAIN = "ASIA"
CUT = 10_000
_POS = ("run_id", "line", "product_id", "branch", "recorded_at", "price")


def _catalog_run(spark: SparkSession, sf_dir: str) -> CatalogRun:
    """The chain's sightings from run CUT on as catalog rows: a code of each branch and product, the product's barcode unless
    the product is small. Larger brands are mapped, large products are stored, and earlier sightings are the shelf prices."""
    seen, named = observations(spark, sf_dir).where(F.col("chain") == CHAIN), products(spark, sf_dir).select("product_id", "product_name", "brand", "size")
    code = F.lpad(F.col("product_id").cast("string"), 13, "0")
    sku = F.concat("branch", F.lit("-"), F.col("product_id").cast("string"))
    items = seen.where(F.col("run_id") >= CUT).join(named, "product_id").select(
        F.struct(*_POS).alias("pos"), F.when(F.col("line") <= 6, sku).alias("sku"), F.when(F.col("size") > 5, code).alias("barcode"),
        F.col("product_name").alias("name"), "brand", "price", (~F.col("is_discounted")).alias("baseline"),
    )
    stored = named.select(F.concat(F.lit("p"), F.col("product_id").cast("string")).alias("product_id"), "brand", "size", code.alias("barcode"))
    known = stored.where("size > 25").select("product_id", "barcode")
    mapped = seen.join(named.where("brand = 'Brand#1'"), "product_id").select(sku.alias("sku"), F.concat(F.lit("p"), F.col("product_id").cast("string")).alias("product_id")).distinct()
    shelf = best_per_key(seen.where((F.col("run_id") < CUT) & ~F.col("is_discounted")), ["product_id"], [F.desc("recorded_at"), F.desc("run_id"), F.desc("line"), F.asc("branch"), F.asc("price")])
    return run_catalog(items, known, mapped, shelf.select(F.concat(F.lit("p"), F.col("product_id").cast("string")).alias("product_id"), "price"), CHAIN)


_CATALOG = f"""WITH seen AS (SELECT o.*, p.product_name, p.brand, p.size, branch || '-' || product_id AS code FROM observations o JOIN products p USING (product_id) WHERE chain = '{CHAIN}'),
    items AS (SELECT *, ROW(run_id, line, product_id, branch, recorded_at, price) AS pos, CASE WHEN line <= 6 THEN code END AS sku, CASE WHEN size > 5 THEN lpad(CAST(product_id AS VARCHAR), 13, '0') END AS barcode FROM seen WHERE run_id >= {CUT}),
    fst AS (SELECT sku, arg_min(product_id, pos) AS part, min(pos) AS pos, arg_min(brand, pos) AS brand, arg_min(size, pos) AS size, CAST(arg_min(coalesce(barcode, ''), pos) AS VARCHAR) AS code FROM items WHERE sku IS NOT NULL GROUP BY sku),
    known AS (SELECT *, CASE WHEN brand = 'Brand#1' THEN 'sku' WHEN size > 25 THEN 'barcode' END AS how, CASE WHEN code = '' THEN sku ELSE code END AS slot FROM fst),
    resolved AS (SELECT k.sku, CASE WHEN how IS NOT NULL THEN 'p' || part ELSE '{CHAIN}/' || maker END AS product_id, coalesce(how, CASE WHEN maker = sku THEN 'created' ELSE 'run' END) AS via
        FROM known k LEFT JOIN (SELECT slot, arg_min(sku, pos) AS maker FROM known WHERE how IS NULL GROUP BY slot) m USING (slot)),
    wanted AS (SELECT r.product_id, arg_min(i.price, i.pos) AS price FROM items i JOIN resolved r ON i.sku = r.sku WHERE NOT is_discounted GROUP BY r.product_id),
    shelf AS (SELECT 'p' || product_id AS product_id, price AS before FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, run_id DESC, line DESC, branch, price) AS rn FROM seen WHERE run_id < {CUT} AND NOT is_discounted) WHERE rn = 1),
    snaps AS (SELECT product_id, price, before FROM wanted LEFT JOIN shelf USING (product_id) WHERE price IS DISTINCT FROM before)"""


@register("catalog_run", sql(f"{_CATALOG} SELECT sku, product_id, via FROM resolved"))
def catalog_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code of a catalog run with its product, found or made."""
    return _catalog_run(spark, sf_dir).resolved.select("sku", "product_id", "via")


@register("catalog_run_snapshots", sql(f"{_CATALOG} SELECT product_id, price, before FROM snaps"))
def catalog_run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_run(spark, sf_dir).snapshots


@register("catalog_run_report", sql(f"""{_CATALOG} SELECT 'total' AS measure, count(*) AS n FROM items UNION ALL SELECT 'skipped', count(*) FROM items WHERE sku IS NULL
    UNION ALL SELECT 'created', count(*) FROM resolved WHERE via = 'created' UNION ALL SELECT 'mapped', count(*) FROM resolved WHERE via IN ('run', 'barcode') UNION ALL SELECT 'snapshots', count(*) FROM snaps"""))  # fmt: skip
def catalog_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog_run(spark, sf_dir).report


def _offer_run(spark: SparkSession, sf_dir: str) -> Run:
    """The chain's line items of source N as one run of offers over those of source R as stored rows."""
    named = products(spark, sf_dir)
    rows = offers(spark, sf_dir).where(F.col("chain") == CHAIN).join(named, "product_id").withColumn("sku", F.concat("branch", F.lit("-"), F.col("product_id").cast("string")))
    items = rows.where("source = 'N'").select(
        F.struct("created_at", "offer_id").alias("pos"), "sku", F.lpad(F.col("product_id").cast("string"), 13, "0").alias("barcode"),
        F.col("product_name").alias("name"), "price", F.col("original_price").alias("original"), F.lit(None).cast("string").alias("kind"), F.col("category").alias("native"),
    )
    newest = best_per_key(rows.where("source = 'R'"), ["sku"], [F.desc("created_at"), F.desc("offer_id")])
    stored = newest.select(
        F.lit(CHAIN).alias("chain"), F.lit("web").alias("source"), "sku", F.col("product_name").alias("name"), "price", F.col("original_price").alias("original"), F.col("pct").alias("percent"),
        F.lit("mono").alias("kind"), "category", F.lit(None).cast("string").alias("via"), "product_id", F.lit(True).alias("active"), F.col("created_at").cast("timestamp").alias("updated_at"),
    )
    seen = rows.where("source = 'R' AND brand = 'Brand#1'").select("sku", "product_id")
    known = Catalog(seen, named.where("size > 25").select(F.lpad(F.col("product_id").cast("string"), 13, "0").alias("barcode"), "product_id"), named.where("category = 'PROMO'").select(F.col("product_name").alias("name"), "product_id"))
    return run_offers(items, stored, known, CHAIN, "web", ts("2002-01-01 00:00:00").cast("timestamp"), PART_RULES)


_OFFERS = f"""WITH o AS (SELECT *, branch || '-' || product_id AS sku, row_number() OVER (PARTITION BY source, branch, product_id ORDER BY created_at DESC, offer_id DESC) AS rn FROM named_offers WHERE chain = '{CHAIN}'),
    n AS (SELECT * FROM o WHERE source = 'N' AND rn = 1), r AS (SELECT * FROM o WHERE source = 'R' AND rn = 1),
    names AS (SELECT product_name, min(product_id) AS pid FROM products WHERE category = 'PROMO' GROUP BY product_name),
    m AS (SELECT n.*, CASE WHEN brand = 'Brand#1' AND EXISTS (SELECT 1 FROM r WHERE r.sku = n.sku) THEN 'sku' WHEN size > 25 THEN 'barcode' WHEN pid IS NOT NULL THEN 'name' END AS via, pid FROM n LEFT JOIN names USING (product_name)),
    found AS (SELECT *, CASE via WHEN 'name' THEN pid WHEN 'sku' THEN product_id WHEN 'barcode' THEN product_id END AS hit FROM m),
    owned AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY hit ORDER BY created_at, offer_id) = 1 THEN hit END AS owner FROM found)"""


@register("offer_run", sql(f"""{_OFFERS} SELECT sku, price, CASE WHEN original_price > price THEN original_price END AS original, via, owner AS product_id, true AS active FROM owned
    UNION ALL SELECT sku, price, original_price, NULL, product_id, NOT (SELECT count(*) > 0 AND NOT ((SELECT count(*) FROM r) > 20 AND count(*) < 0.5 * (SELECT count(*) FROM r)) FROM n) FROM r WHERE sku NOT IN (SELECT sku FROM n)"""))  # fmt: skip
def offer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's offers after the run: those seen, with their match, and those that a healthy run did not see again."""
    return _offer_run(spark, sf_dir).offers.select("sku", "price", "original", "via", "product_id", "active")


@register("offer_run_alertable", sql(f"{_OFFERS} SELECT n.sku, n.price FROM n LEFT JOIN r USING (sku) WHERE r.price IS NULL OR n.price < r.price"))
def offer_run_alertable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_run(spark, sf_dir).alertable.select("sku", "price")


@register("offer_run_pending", sql(f"{_OFFERS} SELECT chain, product_name AS name, price FROM m WHERE via IS NULL"))
def offer_run_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offer_run(spark, sf_dir).pending


_AUDIT = """WITH a AS (SELECT p.product_id, list_distinct(string_split(p.product_name || ' ' || lower(p.category), ' ')) AS x, list_distinct(string_split(q.product_name || ' ' || lower(q.category), ' ')) AS y, p.size % 2 + 1 AS n, q.size % 2 + 1 AS m
    FROM products p JOIN products q ON q.product_id = p.product_id + 1)"""


@register("mapping_audit", sql(f"""{_AUDIT}, s AS (SELECT product_id, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) AS score, n = m AS same FROM a)
    SELECT product_id, CASE WHEN score < 0.34 THEN 'BAD' WHEN score < 0.5 THEN 'SUSPECT' WHEN NOT same THEN 'PACK' ELSE 'OK' END AS band FROM s"""))  # fmt: skip
def mapping_audit(spark: SparkSession, sf_dir: str, hard: float = 0.34, suspect: float = 0.5) -> DataFrame:
    """Mappings (here of each product to the next) graded by the likeness of the two names, then by their packs.

    Names are read once each and pairs of names compared once each, dealt by name, however many products have them.
    """
    p = products(spark, sf_dir)
    label = F.concat_ws(" ", "product_name", F.lower("category"))
    left = p.select("product_id", label.alias("name"), (F.col("size") % 2 + 1).alias("n"))
    right = p.select((F.col("product_id") - 1).alias("product_id"), label.alias("other"), (F.col("size") % 2 + 1).alias("m"))
    pairs = left.join(right, "product_id")
    known = left.select("name").distinct().withColumn("tokens", salient_tokens(F.col("name")))
    packed = lambda name, n: F.when(F.col(n) > 1, F.concat_ws(" ", F.lit("2x5"), name)).otherwise(F.col(name))
    likeness = pairs.select("name", "other", "n", "m").distinct()
    likeness = likeness.join(known, "name").join(known.select(F.col("name").alias("other"), F.col("tokens").alias("others")), "other")
    same = pack_count(packed("name", "n")) == pack_count(packed("other", "m"))
    graded = let(
        F.struct(token_similarity(F.col("tokens"), F.col("others")).alias("score"), same.alias("same")),
        lambda x: F.when(x["score"] < hard, "BAD").when(x["score"] < suspect, "SUSPECT").when(~x["same"], "PACK").otherwise("OK"),
    )
    bands = likeness.select("name", "other", F.col("n").alias("_n"), F.col("m").alias("_m"), graded.alias("band"))
    fits = F.col("n").eqNullSafe(F.col("_n")) & F.col("m").eqNullSafe(F.col("_m"))
    return pairs.join(bands.withColumnsRenamed({"name": "_a", "other": "_b"}), (F.col("name") == F.col("_a")) & (F.col("other") == F.col("_b")) & fits).select("product_id", "band")
