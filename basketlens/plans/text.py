"""Text queries over documents and products: folding, tokens, search, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import live_offers, products, sql, table
from basketlens.functions.scores import relevance, search_terms
from basketlens.functions.text import ACCENTED, PLAIN, contains_any, escape_html, fold, fold_term, mirror_path, tokens, word_tokens
from basketlens.operators.alerts import alert_counts, alert_offers
from basketlens.operators.compare import top_overlaps
from basketlens.registry import register

_FOLD = f"translate(lower(%s), '{ACCENTED}', '{PLAIN}')"
_TOKENS_SQL = f"list_filter(regexp_split_to_array(regexp_replace({_FOLD % 'text'}, '[\u0300-\u036f]', '', 'g'), '\\s+'), lambda t: length(t) >= 3)"


@register("folded_words", f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({_FOLD % 'text'}, 'ς', 'σ', 'g'), '[^a-z0-9α-ω]+'), lambda t: t <> '') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first_word, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM w")
def folded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first_word"), F.size(F.array_distinct("w")).alias("n_distinct"))


@register("accent_insensitive_search", f"SELECT doc_id, lang FROM documents WHERE contains({_FOLD % 'text'}, 'reaux') OR contains({_FOLD % 'text'}, 'cion que')")
def accent_insensitive_search(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = ("réaux", "ción que")) -> DataFrame:
    return table(spark, sf_dir, "documents").where(contains_any(fold(F.col("text")), [fold_term(t) for t in terms])).select("doc_id", "lang")


@register("search_offers", sql("""WITH r AS (SELECT offer_id, CASE WHEN regexp_matches(product_name, '(^|[^a-z0-9])bolt([^a-z0-9]|$)') THEN 100 WHEN regexp_matches(product_name, '(^|[^a-z0-9])bolt') THEN 70 WHEN contains(lower(category), 'bolt') THEN 10 ELSE 0 END AS best, category, pct FROM live_offers)
    SELECT offer_id, best + CASE WHEN category = 'PROMO' THEN 50 ELSE 0 END + least(greatest(CAST(pct AS DOUBLE), 0), 60) * 0.1 AS score FROM r WHERE best > 0 ORDER BY score DESC, offer_id LIMIT 60"""))  # fmt: skip
def search_offers(spark: SparkSession, sf_dir: str, query: str = "bolt", limit: int = 60) -> DataFrame:
    """Recall and rank in one pass; ties by id."""
    score = relevance(search_terms(query), F.col("product_name"), F.lit(None).cast("string"), F.col("category"), F.col("pct").cast("double"), intent="PROMO")
    return live_offers(spark, sf_dir).select("offer_id", score.alias("score")).where(F.col("score") > 0).orderBy(F.desc("score"), F.asc("offer_id")).limit(limit)


_WORD = "[^a-z0-9α-ωϊϋΐΰς]"


@register("search_documents", f"""WITH d AS (SELECT doc_id, lang, replace(regexp_replace({_FOLD % 'text'}, '[\u0300-\u036f]', '', 'g'), 'ς', 'σ') AS n FROM documents), t AS (SELECT unnest(['reaux', 'ρεαυξ', 'ρεαυχ']) AS t),
    s AS (SELECT doc_id, max(CASE WHEN regexp_matches(n, '(^|{_WORD})' || t || '({_WORD}|$)') THEN 100 WHEN regexp_matches(n, '(^|{_WORD})' || t) THEN 70 WHEN contains(n, t) THEN 35 WHEN contains(lower(lang), t) THEN 10 ELSE 0 END) AS best FROM d, t GROUP BY doc_id)
    SELECT doc_id, CAST(best AS DOUBLE) AS score FROM s WHERE best > 0""")  # fmt: skip
def search_documents(spark: SparkSession, sf_dir: str, query: str = "réaux") -> DataFrame:
    score = relevance(search_terms(query), F.col("text"), F.lit(None).cast("string"), F.col("lang"), F.lit(None).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where(F.col("score") > 0)


@register("search_page", sql("""WITH o AS (SELECT DISTINCT product_id FROM live_offers WHERE contains(product_name, 'gear'))
    SELECT 'offer' AS kind, product_id FROM o UNION ALL SELECT 'catalog', product_id FROM products WHERE contains(product_name, 'gear') AND product_id NOT IN (SELECT product_id FROM o)"""))  # fmt: skip
def search_page(spark: SparkSession, sf_dir: str, term: str = "gear") -> DataFrame:
    """Products on offer, then those only in the catalog."""
    offers = live_offers(spark, sf_dir).where(F.col("product_name").contains(term)).select("product_id").distinct()
    rest = products(spark, sf_dir).where(F.col("product_name").contains(term)).select("product_id").join(offers, "product_id", "left_anti")
    return offers.select(F.lit("offer").alias("kind"), "product_id").unionByName(rest.select(F.lit("catalog").alias("kind"), "product_id"))


_ALERTS = [("a1", "Bolt", ["ASIA", "EUROPE"], "", "30000.00"), ("a2", "gear", [], "PROMO", None), ("a3", "widget", ["AFRICA"], None, "100.00"), ("a4", "zzz", [], None, None)]


@register("alert_hits", sql("""WITH a AS (SELECT * FROM (VALUES ('a1', 'bolt', ['ASIA', 'EUROPE'], '', 30000.00), ('a2', 'gear', [], 'PROMO', NULL), ('a3', 'widget', ['AFRICA'], NULL, 100.00), ('a4', 'zzz', [], NULL, NULL)) v(alert, word, chains, cat, top))
    SELECT alert, count(*) AS hits, min(offer_id) AS sample FROM a JOIN live_offers o ON contains(lower(trim(product_name)), word) AND (len(chains) = 0 OR list_contains(chains, chain)) AND (coalesce(cat, '') = '' OR cat = category) AND (top IS NULL OR price <= top) GROUP BY alert"""))  # fmt: skip
def alert_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing alerts over the offers."""
    alerts = spark.createDataFrame(_ALERTS, "alert string, word string, chains array<string>, cat string, top string").withColumn("top", F.col("top").cast("decimal(10,2)"))
    return alert_offers(live_offers(spark, sf_dir), alerts).groupBy("alert").agg(F.count("*").alias("hits"), F.min("offer_id").alias("sample"))


#: Every product's first word and last letters, in its category, as somebody's alert.
_EVERY = "SELECT product_id AS alert, substr(product_name, 1, 4) AS word, category AS cat, retail_price AS top FROM products"


@register("every_product_watched", sql(f"SELECT a.alert, count(*) AS hits FROM ({_EVERY}) a JOIN live_offers o ON contains(product_name, trim(word)) AND o.category = a.cat AND o.price <= a.top * 20 GROUP BY a.alert"))
def every_product_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many alerts as there are products: how many offers each has found."""
    alerts = products(spark, sf_dir).select(F.col("product_id").alias("alert"), F.substring("product_name", 1, 4).alias("word"), F.array().cast("array<string>").alias("chains"), F.col("category").alias("cat"), (F.col("retail_price") * 20).alias("top"))
    return alert_counts(live_offers(spark, sf_dir), alerts)


@register("first_alert_hit", sql("""WITH a AS (SELECT * FROM (VALUES ('a1', 'bolt'), ('a2', 'gear')) v(alert, word))
    SELECT alert, offer_id FROM a JOIN live_offers ON contains(product_name, word) QUALIFY row_number() OVER (PARTITION BY alert ORDER BY pct DESC, offer_id) = 1"""))  # fmt: skip
def first_alert_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = spark.createDataFrame([("a1", "bolt", [], None, None), ("a2", "gear", [], None, None)], "alert string, word string, chains array<string>, cat string, top double")
    best = alert_offers(live_offers(spark, sf_dir), alerts).groupBy("alert").agg(F.min(F.struct((-F.col("pct")).alias("p"), "offer_id")).alias("x"))
    return best.select("alert", "x.offer_id")


@register("token_overlap", f"""WITH b AS (SELECT item_id, unnest({_TOKENS_SQL}) AS t FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({_TOKENS_SQL})) AS t FROM documents),
    s AS (SELECT item_id, doc_id, count(*) AS score, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rn FROM b JOIN d USING (t) GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, score FROM s WHERE rn <= 3""")  # fmt: skip
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents that share most tokens with each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    return top_overlaps(items, docs, "item_id", "doc_id", 3)


@register("escaped_names", sql("SELECT DISTINCT brand, replace(replace(brand || '<&>', '&', '&amp;'), '<', '&lt;') AS half, 'x' || substr(sha1(brand), 1, 8) AS path FROM products"))
def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.replace(escape_html(F.concat("brand", F.lit("<&>"))), F.lit("&gt;"), F.lit(">"))
    return products(spark, sf_dir).select("brand", half.alias("half"), F.concat(F.lit("x"), F.substring(F.sha1("brand"), 1, 8)).alias("path")).distinct()


@register("mirror_paths", "SELECT page_id, 'web/' || substr(sha1(url), 1, 20) || '.jpg' AS path FROM pages")
def mirror_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", mirror_path(F.lit("web"), F.col("url")).alias("path"))


@register("composite_keys", sql("SELECT offer_id, CASE WHEN pct > 3 THEN 'p:' || product_id ELSE 'n:' || lower(product_name) || ':' || chain END AS favourite FROM live_offers"))
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_name = F.concat(F.lit("n:"), F.lower("product_name"), F.lit(":"), F.col("chain"))
    return live_offers(spark, sf_dir).select("offer_id", F.when(F.col("pct") > 3, F.concat(F.lit("p:"), F.col("product_id").cast("string"))).otherwise(by_name).alias("favourite"))


@register("share_texts", sql("SELECT chain, string_agg(product_name || ' ' || pct || '%', ' / ' ORDER BY rn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY pct DESC, price, offer_id) AS rn FROM live_offers) WHERE rn <= 3 GROUP BY chain"))
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("chain").orderBy(F.desc("pct"), F.asc("price"), F.asc("offer_id")))
    top = live_offers(spark, sf_dir).withColumn("rn", rn).where("rn <= 3").withColumn("line", F.concat(F.col("product_name"), F.lit(" "), F.col("pct").cast("string"), F.lit("%")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"])
    return top.groupBy("chain").agg(F.array_join(lines, " / ").alias("text"))


@register("truncated_text", "SELECT doc_id, substr(text, 1, 256) AS head, CAST(length(text) AS INTEGER) AS n FROM documents")
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 256).alias("head"), F.length("text").alias("n"))
