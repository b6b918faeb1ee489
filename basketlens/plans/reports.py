"""Aggregates and data-quality reports over offers, observations, runs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import EVENTS_NOW, OFFERS_NOW, clicks, live_offers, named_offers, observations, offers, products, runs, sql, table, ts
from basketlens.functions.num import share_of
from basketlens.functions.taxonomy import Rules, classify, leaks
from basketlens.operators.coverage import id_bitmaps, set_sizes
from basketlens.registry import register


@register("qa_active_by_source", sql("SELECT source, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE active AND original_price IS NOT NULL) AS struck, count(*) AS total FROM offers GROUP BY source"))
def qa_active_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy("source").agg(F.count_if("active").alias("active"), F.count_if(F.col("active") & F.col("original_price").isNotNull()).alias("struck"), F.count("*").alias("total"))


@register("qa_sample_matches", sql("SELECT offer_id, product_name, brand FROM named_offers WHERE source = 'R' ORDER BY offer_id LIMIT 20"))
def qa_sample_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_offers(spark, sf_dir).where("source = 'R'").orderBy("offer_id").limit(20).select("offer_id", "product_name", "brand")


@register("qa_polluted_prices", sql("SELECT offer_id, price, original_price FROM offers WHERE price >= original_price * 0.905"))
def qa_polluted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).where(F.col("price") >= F.col("original_price") * 0.905).select("offer_id", "price", "original_price")


@register("qa_orphans", sql("SELECT source, count(*) AS n FROM offers WHERE product_id NOT IN (SELECT product_id FROM products WHERE category <> 'PROMO') GROUP BY source"))
def qa_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).join(products(spark, sf_dir).where("category <> 'PROMO'"), "product_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@register("qa_multi_source", sql("SELECT product_id, count(DISTINCT source) AS sources, max(CASE WHEN source = 'A' THEN price END) AS price_a, max(CASE WHEN source = 'R' THEN price END) AS price_r, string_agg(DISTINCT source, ',' ORDER BY source) AS list FROM live_offers GROUP BY product_id HAVING count(DISTINCT source) >= 2"))
def qa_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = live_offers(spark, sf_dir).groupBy("product_id").agg(
        F.max(F.when(F.col("source") == "A", F.col("price"))).alias("price_a"), F.max(F.when(F.col("source") == "R", F.col("price"))).alias("price_r"), F.sort_array(F.collect_set("source")).alias("all")
    )
    return by.where(F.size("all") >= 2).select("product_id", F.size("all").cast("long").alias("sources"), "price_a", "price_r", F.array_join("all", ",").alias("list"))


@register("qa_pending_ages", sql("SELECT feed, count(*) AS n, min(finished_at) AS oldest, max(finished_at) AS newest FROM runs WHERE NOT healthy GROUP BY feed"))
def qa_pending_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where(~F.col("healthy")).groupBy("feed").agg(F.count("*").alias("n"), F.min("finished_at").alias("oldest"), F.max("finished_at").alias("newest"))


@register("qa_oldest_pending", sql("SELECT run_id, feed, finished_at FROM runs WHERE NOT healthy ORDER BY finished_at, run_id LIMIT 10"))
def qa_oldest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where(~F.col("healthy")).orderBy("finished_at", "run_id").limit(10).select("run_id", "feed", "finished_at")


@register("qa_expired_active", sql(f"SELECT chain, source, count(*) AS n FROM offers WHERE active AND valid_until < TIMESTAMP '{OFFERS_NOW}' GROUP BY chain, source"))
def qa_expired_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).where(F.col("active") & (F.col("valid_until") < ts(OFFERS_NOW))).groupBy("chain", "source").agg(F.count("*").alias("n"))


@register("qa_percent_distribution", sql("SELECT chain, count(*) FILTER (WHERE pct = 0) AS none, count(*) FILTER (WHERE pct BETWEEN 1 AND 2) AS low, count(*) FILTER (WHERE pct BETWEEN 3 AND 5) AS middle, count(*) FILTER (WHERE pct BETWEEN 6 AND 8) AS high, count(*) FILTER (WHERE pct > 8) AS top FROM offers GROUP BY chain"))
def qa_percent_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = F.col("pct")
    return offers(spark, sf_dir).groupBy("chain").agg(
        F.count_if(pct == 0).alias("none"), F.count_if(pct.between(1, 2)).alias("low"), F.count_if(pct.between(3, 5)).alias("middle"), F.count_if(pct.between(6, 8)).alias("high"), F.count_if(pct > 8).alias("top")
    )


@register("qa_offer_shape", sql("SELECT chain, count(*) AS total, count(*) FILTER (WHERE original_price IS NULL) AS no_struck, count(*) FILTER (WHERE price <= 0) AS bad_price, count(*) FILTER (WHERE pct > 0 AND original_price <= price) AS no_saving, count(*) FILTER (WHERE valid_until < created_at) AS bad_dates, count(DISTINCT product_id) AS n_products, count(DISTINCT branch) AS n_branches FROM offers GROUP BY chain"))
def qa_offer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy("chain").agg(
        F.count("*").alias("total"), F.count_if(F.col("original_price").isNull()).alias("no_struck"), F.count_if(F.col("price") <= 0).alias("bad_price"),
        F.count_if((F.col("pct") > 0) & (F.col("original_price") <= F.col("price"))).alias("no_saving"), F.count_if(F.col("valid_until") < F.col("created_at")).alias("bad_dates"),
        F.countDistinct("product_id").alias("n_products"), F.countDistinct("branch").alias("n_branches"),
    )


@register("qa_vocabulary", sql("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type"))
def qa_vocabulary(spark: SparkSession, sf_dir: str, allowed: tuple[str, ...] = ("click", "view", "purchase")) -> DataFrame:
    """Values outside a closed vocabulary, with their counts; an empty result passes the gate."""
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin(*allowed)).groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))


@register("qa_latest_runs", sql("SELECT feed, run_id, finished_at, healthy, scraped FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY finished_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1"))
def qa_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("run_id", "finished_at", "healthy", "scraped"), F.struct("finished_at", "run_id"))
    return runs(spark, sf_dir).groupBy("feed").agg(last.alias("r")).select("feed", "r.*")


@register("qa_cross_chain_products", sql("SELECT product_id, count(DISTINCT chain) AS n_chains, string_agg(DISTINCT chain, '|' ORDER BY chain) AS chains, min(price) AS low, max(price) AS high FROM live_offers GROUP BY product_id HAVING count(DISTINCT chain) >= 2"))
def qa_cross_chain_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = live_offers(spark, sf_dir).groupBy("product_id").agg(F.sort_array(F.collect_set("chain")).alias("set"), F.min("price").alias("low"), F.max("price").alias("high"))
    return by.where(F.size("set") >= 2).select("product_id", F.size("set").cast("long").alias("n_chains"), F.array_join("set", "|").alias("chains"), "low", "high")


@register("qa_cross_chain_count", sql("SELECT count(*) AS n FROM offers WHERE product_id IN (SELECT product_id FROM live_offers GROUP BY product_id HAVING count(DISTINCT chain) >= 3)"))
def qa_cross_chain_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = live_offers(spark, sf_dir).groupBy("product_id").agg(F.countDistinct("chain").alias("k")).where("k >= 3")
    return offers(spark, sf_dir).join(shared, "product_id", "left_semi").agg(F.count("*").alias("n"))


@register("qa_two_chain_matchup", sql("""WITH a AS (SELECT product_id, min(price) AS p FROM live_offers WHERE chain = 'ASIA' GROUP BY product_id), e AS (SELECT product_id, min(price) AS p FROM live_offers WHERE chain = 'EUROPE' GROUP BY product_id)
    SELECT product_id, a.p AS asia, e.p AS europe, CASE WHEN a.p < e.p THEN 'ASIA' WHEN a.p > e.p THEN 'EUROPE' ELSE 'tie' END AS winner, CAST(floor(abs(a.p - e.p) / greatest(a.p, e.p) * 100 + 0.5) AS INTEGER) AS gap FROM a JOIN e USING (product_id)"""))  # fmt: skip
def qa_two_chain_matchup(spark: SparkSession, sf_dir: str, left: str = "ASIA", right: str = "EUROPE") -> DataFrame:
    """One pass and a conditional minimum for each chain instead of a self-join."""
    best = lambda c: F.min(F.when(F.col("chain") == c, F.col("price"))).alias(c.lower())
    both = live_offers(spark, sf_dir).where(F.col("chain").isin(left, right)).groupBy("product_id").agg(best(left), best(right)).dropna()
    a, b = F.col(left.lower()), F.col(right.lower())
    return both.select("product_id", a, b, F.when(a < b, left).when(a > b, right).otherwise("tie").alias("winner"), F.floor(F.abs(a - b) / F.greatest(a, b) * 100 + 0.5).cast("int").alias("gap"))


@register("qa_observation_histogram", sql("SELECT k AS observations, count(*) AS n_products FROM (SELECT product_id, count(*) AS k FROM observations GROUP BY product_id) GROUP BY k"))
def qa_observation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("observations")).groupBy("observations").agg(F.count("*").alias("n_products"))


@register("qa_most_observed", sql("SELECT product_id, count(*) AS n, string_agg(DISTINCT chain, ',' ORDER BY chain) AS chains FROM observations GROUP BY product_id ORDER BY n DESC, product_id LIMIT 5"))
def qa_most_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = observations(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("chain")), ",").alias("chains"))
    return by.orderBy(F.desc("n"), F.asc("product_id")).limit(5)


@register("qa_currently_lowest", sql("WITH stats AS (SELECT product_id, min(price) AS low, count(*) AS n FROM offers GROUP BY product_id) SELECT o.offer_id, o.product_id, o.price FROM live_offers o JOIN stats s ON o.product_id = s.product_id WHERE s.n >= 3 AND o.price <= s.low"))
def qa_currently_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = offers(spark, sf_dir).groupBy("product_id").agg(F.min("price").alias("low"), F.count("*").alias("n"))
    return live_offers(spark, sf_dir).join(stats, "product_id").where((F.col("n") >= 3) & (F.col("price") <= F.col("low"))).select("offer_id", "product_id", "price")


@register("qa_most_observed_offers", sql("SELECT o.offer_id, (SELECT count(*) FROM observations s WHERE s.product_id = o.product_id) AS n FROM live_offers o ORDER BY n DESC, o.offer_id LIMIT 10"))
def qa_most_observed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = observations(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n"))
    return live_offers(spark, sf_dir).join(n, "product_id", "left").select("offer_id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), F.asc("offer_id")).limit(10)


@register("qa_duplicate_names", sql("SELECT product_name, count(*) AS n, min(product_id) AS first_id FROM products GROUP BY product_name HAVING count(*) > 1"))
def qa_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).groupBy("product_name").agg(F.count("*").alias("n"), F.min("product_id").alias("first_id")).where("n > 1")


@register("qa_code_formats", sql("SELECT chain, len, head, n, CAST(floor(100 * n / sum(n) OVER (PARTITION BY chain) + 0.5) AS INTEGER) AS share FROM (SELECT chain, CAST(length(offer_id) AS INTEGER) AS len, left(offer_id, 1) AS head, count(*) AS n FROM offers GROUP BY ALL)"))
def qa_code_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = offers(spark, sf_dir).groupBy("chain", F.length("offer_id").alias("len"), F.left("offer_id", F.lit(1)).alias("head")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy("chain")) + 0.5).cast("int"))


@register("qa_case_of_piece", sql("SELECT a.product_id AS piece, b.product_id AS pack FROM products a JOIN products b ON CAST(a.product_id AS VARCHAR) = substr(CAST(b.product_id AS VARCHAR), 2, 3) AND length(CAST(b.product_id AS VARCHAR)) = 4 AND left(CAST(b.product_id AS VARCHAR), 1) = '1'"))
def qa_case_of_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-join on a computed key: the code of a case holds the code of its piece."""
    p = products(spark, sf_dir).select("product_id", F.col("product_id").cast("string").alias("code"))
    packs = p.where((F.length("code") == 4) & (F.left("code", F.lit(1)) == "1")).select(F.col("product_id").alias("pack"), F.substring("code", 2, 3).alias("code"))
    return p.withColumnRenamed("product_id", "piece").join(packs, "code").select("piece", "pack")


@register("qa_totals", sql("SELECT (SELECT count(*) FROM offers) AS offers, (SELECT count(*) FROM products) AS products, (SELECT count(DISTINCT product_id) FROM offers) AS linked, (SELECT count(*) FROM runs) AS runs"))
def qa_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).agg(F.count("*").alias("offers"), F.countDistinct("product_id").alias("linked"))
    return o.join(products(spark, sf_dir).agg(F.count("*").alias("products"))).join(runs(spark, sf_dir).agg(F.count("*").alias("runs"))).select("offers", "products", "linked", "runs")


@register("qa_source_ages", sql("SELECT chain, source, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen FROM offers GROUP BY chain, source"))
def qa_source_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).groupBy("chain", "source").agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


@register("qa_first_words", sql("SELECT split_part(product_name, ' ', 1) AS word, count(*) AS n, count(*) FILTER (WHERE pct > 5) AS cheap FROM named_offers GROUP BY word"))
def qa_first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_offers(spark, sf_dir).groupBy(F.split_part("product_name", F.lit(" "), F.lit(1)).alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("pct") > 5).alias("cheap"))


#: Keywords of two words hit inside other words, too; the audit finds where they do.
LEAKY = Rules(keywords=(("hot goods", ("hot gear", "hot bolt")), ("cold goods", ("old widget", "old ring")), ("goods", ("gear", "plate"))), aliases={}, chains={}, departments=(), overrides=(), other="unsorted")


@register("qa_category_leaks", sql("""WITH n AS (SELECT CASE size % 3 WHEN 1 THEN 's' || product_name WHEN 2 THEN product_name || 's' ELSE product_name END AS n FROM products),
    t AS (SELECT n, CASE WHEN contains(n, 'hot gear') THEN 'hot gear' WHEN contains(n, 'hot bolt') THEN 'hot bolt' WHEN contains(n, 'old widget') THEN 'old widget' WHEN contains(n, 'old ring') THEN 'old ring' END AS term FROM n)
    SELECT term, CASE WHEN term LIKE 'hot%' THEN 'hot goods' ELSE 'cold goods' END AS dept, count(*) AS n, min(n) AS sample FROM t WHERE term IS NOT NULL AND NOT regexp_matches(n, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY ALL"""))  # fmt: skip
def qa_category_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that decided a department though they stand inside other words only, by the classifier's own trace."""
    named = products(spark, sf_dir).select(F.when(F.col("size") % 3 == 1, F.concat(F.lit("s"), "product_name")).when(F.col("size") % 3 == 2, F.concat("product_name", F.lit("s"))).otherwise(F.col("product_name")).alias("name"), "brand")
    traced = named.select("name", F.inline(F.array(classify(F.col("brand"), F.col("name"), F.lit(None).cast("string"), LEAKY))))
    return leaks(traced, "name").groupBy("term", "dept").agg(F.count("*").alias("n"), F.min("name").alias("sample"))


@register("qa_collisions", sql("SELECT k AS rows_per_key, count(*) AS n_keys FROM (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL) GROUP BY k"))
def qa_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("n_keys"))


@register("qa_reconciliation", sql("""WITH a AS (SELECT product_id, min(price) AS p FROM offers WHERE source = 'A' GROUP BY product_id), r AS (SELECT product_id, min(price) AS p FROM offers WHERE source = 'R' GROUP BY product_id)
    SELECT CASE WHEN r.product_id IS NULL THEN 'missing' WHEN a.product_id IS NULL THEN 'extra' WHEN abs(a.p - r.p) > 0.001 THEN 'mismatch' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN r ON a.product_id = r.product_id GROUP BY state"""))  # fmt: skip
def qa_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources side by side: what one misses, what it has besides, and prices that differ by more than 0.001."""
    best = lambda s: offers(spark, sf_dir).where(F.col("source") == s).groupBy("product_id").agg(F.min("price").alias(f"p_{s}"))
    both = best("A").join(best("R"), "product_id", "full_outer")
    state = F.when(F.col("p_R").isNull(), "missing").when(F.col("p_A").isNull(), "extra").when(F.abs(F.col("p_A") - F.col("p_R")) > 0.001, "mismatch").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@register("qa_coverage", sql("""WITH t AS (SELECT chain, count(DISTINCT product_id) AS seen FROM observations GROUP BY chain), o AS (SELECT chain, count(DISTINCT product_id) AS offered FROM live_offers GROUP BY chain)
    SELECT t.chain, seen, coalesce(offered, 0) AS offered, CAST(least(100, floor(100 * seen / (SELECT count(*) FROM products) + 0.5)) AS INTEGER) AS seen_pct, CAST(least(100, floor(100 * coalesce(offered, 0) / seen + 0.5)) AS INTEGER) AS offered_pct FROM t LEFT JOIN o USING (chain)"""))  # fmt: skip
def qa_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog coverage by chain: products ever seen of all, products on offer of those seen."""
    seen = observations(spark, sf_dir).groupBy("chain").agg(F.countDistinct("product_id").alias("seen"))
    offered = live_offers(spark, sf_dir).groupBy("chain").agg(F.countDistinct("product_id").alias("offered"))
    all_ = products(spark, sf_dir).agg(F.count("*").alias("all_products"))
    rows = seen.join(offered, "chain", "left").join(all_).withColumn("offered", F.coalesce("offered", F.lit(0)))
    return rows.select("chain", "seen", "offered", share_of(F.col("seen"), F.col("all_products")).alias("seen_pct"), share_of(F.col("offered"), F.col("seen")).alias("offered_pct"))


@register("union_cardinality", sql("SELECT count(*) AS n FROM (SELECT product_id FROM live_offers UNION SELECT product_id FROM clicks)"))
def union_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_offers(spark, sf_dir).select("product_id").union(clicks(spark, sf_dir).select("product_id")).agg(F.countDistinct("product_id").alias("n"))


@register("category_tree", sql("SELECT chain AS top, category AS grp, product_name AS leaf, count(*) AS n, CAST(grouping(category) + grouping(product_name) AS INTEGER) AS level, min(brand) AS sample FROM live_offers GROUP BY ROLLUP (chain, category, product_name) HAVING grouping(chain) = 0"))
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on three levels in one rollup."""
    r = live_offers(spark, sf_dir).rollup("chain", "category", "product_name").agg(F.count("*").alias("n"), (F.grouping("category") + F.grouping("product_name")).cast("int").alias("level"), F.min("brand").alias("sample"), F.grouping("chain").alias("g"))
    return r.where("g = 0").select(F.col("chain").alias("top"), F.col("category").alias("grp"), F.col("product_name").alias("leaf"), "n", "level", "sample")


@register("basket_totals", sql("SELECT session_id, chain, CAST(sum(CAST(floor(price * 100 + 0.5) AS BIGINT) * qty) AS BIGINT) AS subtotal_cents, CAST(sum(CAST(floor((coalesce(original_price, price) - price) * 100 + 0.5) AS BIGINT) * qty) AS BIGINT) AS saved_cents, max(pct) AS biggest FROM live_offers JOIN (SELECT DISTINCT session_id, product_id FROM clicks WHERE event_type = 'purchase') USING (product_id) GROUP BY session_id, chain"))
def basket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotal and savings of every basket by chain, in whole cents; a session's basket is what it has bought."""
    baskets = clicks(spark, sf_dir).where("event_type = 'purchase'").select("session_id", "product_id").distinct()
    return _basket(live_offers(spark, sf_dir).join(baskets, "product_id"), "session_id", "chain")


def _basket(rows: DataFrame, *keys: str) -> DataFrame:
    cents = lambda x: F.floor(x * 100 + 0.5).cast("long")
    return rows.groupBy(*keys).agg(
        F.sum(cents(F.col("price")) * F.col("qty")).alias("subtotal_cents"), F.sum(cents(F.coalesce("original_price", "price") - F.col("price")) * F.col("qty")).alias("saved_cents"), F.max("pct").alias("biggest")
    )


@register("representative_run_count", sql("""WITH p AS (SELECT feed, scraped, finished_at, run_id, max(scraped) OVER (PARTITION BY feed) AS peak FROM runs)
    SELECT feed, scraped FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY finished_at DESC, run_id DESC) AS rn FROM p WHERE scraped >= CASE WHEN peak > 20 THEN peak * 0.5 ELSE 1 END) WHERE rn = 1"""))  # fmt: skip
def representative_run_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each feed that scraped at least half of the feed's peak."""
    peak = runs(spark, sf_dir).groupBy("feed").agg(F.max("scraped").alias("peak"))
    rows = runs(spark, sf_dir).join(peak, "feed").where(F.col("scraped") >= F.when(F.col("peak") > 20, F.col("peak") * 0.5).otherwise(1.0))
    return rows.groupBy("feed").agg(F.max_by("scraped", F.struct("finished_at", "run_id")).alias("scraped"))


@register("feed_health", sql("""WITH last AS (SELECT feed, max(finished_at) AS last_at, arg_max(healthy, finished_at + run_id * INTERVAL 1 MICROSECOND) AS last_healthy, max(finished_at) FILTER (WHERE healthy) AS ok_at FROM runs WHERE finished_at < TIMESTAMP '1998-01-01' GROUP BY feed)
    SELECT f.feed, CASE WHEN last_at IS NULL THEN 'never' WHEN ok_at IS NULL OR epoch_us(TIMESTAMP '1998-01-01') - epoch_us(ok_at) > hours * 3600000000 THEN 'stale' WHEN last_healthy THEN 'ok' ELSE 'warn' END AS status
    FROM (VALUES ('1-URGENT', 36), ('2-HIGH', 48), ('3-MEDIUM', 1), ('4-NOT SPECIFIED', 192), ('6-NONE', 36)) f(feed, hours) LEFT JOIN last USING (feed)"""))  # fmt: skip
def feed_health(spark: SparkSession, sf_dir: str, now: str = "1998-01-01 00:00:00") -> DataFrame:
    from basketlens.functions.scores import feed_status

    feeds = spark.createDataFrame([("1-URGENT", 36), ("2-HIGH", 48), ("3-MEDIUM", 1), ("4-NOT SPECIFIED", 192), ("6-NONE", 36)], "feed string, hours int")
    past = runs(spark, sf_dir).where(F.col("finished_at") < ts(now))
    last = past.groupBy("feed").agg(F.max("finished_at").alias("last_at"), F.max_by("healthy", F.struct("finished_at", "run_id")).alias("last_healthy"), F.max(F.when(F.col("healthy"), F.col("finished_at"))).alias("ok_at"))
    return feeds.join(last, "feed", "left").select("feed", feed_status(F.col("last_at"), F.col("last_healthy"), F.col("ok_at"), F.col("hours"), ts(now)).alias("status"))


@register("event_stats", sql(f"SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY) AS d7, count(*) FILTER (WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 30 DAY) AS d30, count(DISTINCT session_id) AS sessions FROM clicks GROUP BY event_type"))
def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = lambda d: F.count_if(F.col("ts") >= ts(EVENTS_NOW) - F.make_interval(days=F.lit(d)))
    return clicks(spark, sf_dir).groupBy("event_type").agg(since(7).alias("d7"), since(30).alias("d30"), F.countDistinct("session_id").alias("sessions"))


@register("event_pivot", sql("SELECT product_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM clicks GROUP BY product_id"))
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).groupBy("product_id").pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)


@register("subscriber_funnel", sql("SELECT c_mktsegment AS segment, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS confirmed, count(*) FILTER (WHERE c_acctbal <= 0) AS pending FROM customer GROUP BY segment"))
def subscriber_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("confirmed"), F.count_if(F.col("c_acctbal") <= 0).alias("pending"))


@register("page_hosts", sql("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n, min(url) AS sample FROM pages GROUP BY host"))
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.min("url").alias("sample"))


_PCT = "CAST(least(100, floor(100 * {} / {} + 0.5)) AS INTEGER)"


@register("catalog_coverage", sql(f"""WITH t AS (SELECT count(*) AS products, count(*) FILTER (WHERE size > 10) AS with_image, count(*) FILTER (WHERE size % 2 = 0) AS with_barcode FROM products),
    o AS (SELECT *, active AND valid_until > TIMESTAMP '{OFFERS_NOW}' AS live, qty % 10 <> 0 AS linked, original_price IS NULL AS normal FROM offers),
    c AS (SELECT chain, count(*) FILTER (WHERE live) AS offers, count(*) FILTER (WHERE live AND linked) AS linked_offers, count(*) FILTER (WHERE live AND NOT linked) AS unlinked_offers, count(*) FILTER (WHERE normal) AS baseline_rows, count(*) FILTER (WHERE NOT linked) AS pending,
        count(DISTINCT product_id) AS mapped, count(DISTINCT product_id) FILTER (WHERE live AND linked) AS offered, count(DISTINCT product_id) FILTER (WHERE normal) AS baseline, count(DISTINCT product_id) FILTER (WHERE normal OR (live AND linked)) AS priced FROM o GROUP BY chain)
    SELECT c.*, products, with_image, with_barcode, sum(offers) OVER ()::BIGINT AS all_offers, sum(linked_offers) OVER ()::BIGINT AS all_linked, sum(pending) OVER ()::BIGINT AS all_pending, sum(mapped) OVER ()::BIGINT AS all_mappings, sum(baseline_rows) OVER ()::BIGINT AS all_baseline_rows,
        {_PCT.format('mapped', 'products')} AS mapped_pct, {_PCT.format('baseline', 'mapped')} AS baseline_pct, CASE WHEN offers > 0 THEN {_PCT.format('linked_offers', 'offers')} ELSE 0 END AS linked_pct FROM c, t"""))  # fmt: skip
def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each chain's catalog is covered, and the totals: offers, links, mappings, shelf prices and their products, from one scan of the offers."""
    live, linked, normal = F.col("active") & (F.col("valid_until") > ts(OFFERS_NOW)), F.col("qty") % 10 != 0, F.col("original_price").isNull()
    counts = {"offers": live, "linked_offers": live & linked, "unlinked_offers": live & ~linked, "baseline_rows": normal, "pending": ~linked}
    bits = id_bitmaps(offers(spark, sf_dir), ["chain"], "product_id", {"s_mapped": F.lit(True), "s_offered": live & linked, "s_baseline": normal}, counts)
    by_chain = set_sizes(bits, ["chain"], {"mapped": "s_mapped", "offered": "s_offered", "baseline": "s_baseline", "priced": ("s_baseline", "s_offered")}, list(counts))
    totals = by_chain.agg(*(F.sum(c).alias(t) for c, t in (("offers", "all_offers"), ("linked_offers", "all_linked"), ("pending", "all_pending"), ("mapped", "all_mappings"), ("baseline_rows", "all_baseline_rows"))))
    catalog = products(spark, sf_dir).agg(F.count("*").alias("products"), F.count_if(F.col("size") > 10).alias("with_image"), F.count_if(F.col("size") % 2 == 0).alias("with_barcode"))
    rows = by_chain.join(F.broadcast(totals)).join(F.broadcast(catalog))  # one row each
    return rows.select("*", share_of(F.col("mapped"), F.col("products")).alias("mapped_pct"), share_of(F.col("baseline"), F.col("mapped")).alias("baseline_pct"), share_of(F.col("linked_offers"), F.col("offers")).alias("linked_pct"))
