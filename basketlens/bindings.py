"""The engine's roles (offers, price observations, catalog, clicks, runs, ...) over the star-schema tables, in one place.

Each role is a DataFrame here and a common table expression in SQL (`CTES`), with the same column names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.num import half_up

#: Frozen clocks: the offers' and the events' "now".
OFFERS_NOW = "1998-09-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"
VALID_DAYS = 14
#: A chain whose offers are public only if they show a struck price.
HIDDEN_CHAIN = "MIDDLE EAST"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches (nations) with their chains (regions); the two dimensions have 25 and 5 rows by definition."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("chain"), F.col("n_name").alias("branch"))


def _sold(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with chain and branch for their l_suppkey. The supplier is joined by itself, so that Spark knows its size and need not shuffle the rows."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.select(*(c for c in rows.columns if c != "l_suppkey"), "chain", "branch")


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with its chain (region) and branch (nation)."""
    return table(spark, sf_dir, "supplier").join(F.broadcast(_places(spark, sf_dir)), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "chain", "branch")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail_price"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers: one row each, with a total key as offer_id. Prices are rounded half up to cents."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    rows = li.select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.date_format("l_shipdate", "yyyyMMdd"), cents.cast("string")).alias("offer_id"),
        F.col("l_partkey").alias("product_id"),
        "l_suppkey",
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("original_price"),
        half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("price"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("pct"),
        F.col("l_returnflag").alias("source"),
        (F.col("l_linestatus") == "O").alias("active"),
        F.col("l_shipdate").alias("created_at"),
        (F.col("l_shipdate") + F.make_interval(days=F.lit(VALID_DAYS))).alias("valid_until"),
        F.col("l_quantity").cast("int").alias("qty"),
    )
    return _sold(rows, spark, sf_dir)


def named_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).join(products(spark, sf_dir), "product_id")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices seen over time: product, chain, price, discounted or not, when."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        "l_suppkey",
        half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"),
        (F.col("l_discount") > 0).alias("is_discounted"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("line"),
    )
    return _sold(li, spark, sf_dir)


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("session_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("product_id"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingest runs of a feed (priority): healthy unless pending."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("feed"), F.col("o_orderdate").alias("finished_at"),
        (F.col("o_orderstatus") != "P").alias("healthy"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("scraped"), F.col("o_custkey").alias("worker"),
    )


def visible(keep_null_chain: bool = False):
    """Public visibility: any chain but the hidden one, or a struck price. SQL's <> drops a null chain unless asked to keep it."""
    other = ~F.col("chain").eqNullSafe(HIDDEN_CHAIN) if keep_null_chain else F.col("chain") != HIDDEN_CHAIN
    return other | F.col("original_price").isNotNull()


def live():
    """Active and not expired at OFFERS_NOW. Offers run for VALID_DAYS, so the test is on the stored date and reaches the scan."""
    return F.col("active") & (F.col("created_at") > ts(OFFERS_NOW) - F.make_interval(days=F.lit(VALID_DAYS)))


CTES = {
    "sellers": "SELECT s_suppkey, r_name AS chain, n_name AS branch FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "products": "SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand, p_size AS size, p_retailprice AS retail_price FROM part",
    "offers": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS offer_id,
        l_partkey AS product_id, CASE WHEN l_discount > 0 THEN l_extendedprice END AS original_price,
        floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS price, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS pct,
        l_returnflag AS source, l_linestatus = 'O' AS active, l_shipdate AS created_at, l_shipdate + INTERVAL 14 DAY AS valid_until,
        CAST(l_quantity AS INTEGER) AS qty, chain, branch
        FROM lineitem JOIN sellers ON l_suppkey = s_suppkey""",
    "named_offers": "SELECT * FROM offers JOIN products USING (product_id)",
    "observations": """SELECT l_partkey AS product_id, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_discount > 0 AS is_discounted,
        l_shipdate AS recorded_at, l_orderkey AS run_id, l_linenumber AS line, chain, branch
        FROM lineitem JOIN sellers ON l_suppkey = s_suppkey""",
    "clicks": "SELECT event_id, ts, user_id AS session_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id FROM events",
    "runs": "SELECT o_orderkey AS run_id, o_orderpriority AS feed, o_orderdate AS finished_at, o_orderstatus <> 'P' AS healthy, CAST(floor(o_totalprice / 1000) AS INTEGER) AS scraped, o_custkey AS worker FROM orders",
    "live_offers": f"SELECT * FROM named_offers WHERE active AND valid_until > TIMESTAMP '{OFFERS_NOW}' AND (chain <> '{HIDDEN_CHAIN}' OR original_price IS NOT NULL)",
}


def live_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_offers(spark, sf_dir).where(live() & visible())


#: What a shop writes behind a product's name: nothing, a size, a pack of that size, or a variant.
FORMS = ("", " 330ml", " 6 x 330ml", " light")


def shop_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live offers under the names that shops give them; the quantity says which."""
    forms = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("qty") % len(FORMS) + 1).cast("int"))
    return live_offers(spark, sf_dir).withColumn("product_name", F.concat("product_name", forms))


def sql(body: str) -> str:
    """A query over the roles: their definitions in front of its own WITH clause or SELECT."""
    head = ", ".join(f"{name} AS ({text})" for name, text in CTES.items())
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:].strip()}"
    return f"WITH {head}, {body[5:].strip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
