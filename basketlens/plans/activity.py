"""Event queries: click dedupe, rate limits, popularity, decayed interest, cooldowns (batch forms of the streaming operators)."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.bindings import EVENTS_NOW, clicks, products, sql, ts
from basketlens.functions.dates import micros
from basketlens.functions.num import decay, half_up
from basketlens.functions.text import brand_token
from basketlens.operators.events import accepted_events, windowed_limit
from basketlens.operators.profiles import profiles
from basketlens.registry import register

_ACCEPT_SQL = """WITH RECURSIVE e AS (SELECT event_id, session_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts, event_id) AS rn FROM events_),
    acc AS (SELECT event_id, session_id, event_type, us, us AS held, rn, true AS ok FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.session_id, e.event_type, e.us, CASE WHEN e.us - acc.held >= GAP THEN e.us ELSE acc.held END, e.rn, e.us - acc.held >= GAP FROM acc JOIN e ON e.session_id = acc.session_id AND e.event_type = acc.event_type AND e.rn = acc.rn + 1)
    SELECT event_id, session_id FROM acc WHERE ok"""


@register("accepted_clicks", _ACCEPT_SQL.replace("events_", "(SELECT event_id, user_id AS session_id, event_type, ts FROM events)").replace("GAP", "3600000000"))
def accepted_clicks(spark: SparkSession, sf_dir: str, gap_seconds: int = 3600) -> DataFrame:
    """Events of a session and type at least the gap after the last accepted one (not after the last event)."""
    return accepted_events(clicks(spark, sf_dir), ["session_id", "event_type"], gap_seconds).select("event_id", "session_id")


@register("rate_limited", """WITH RECURSIVE e AS (SELECT event_id, user_id AS session_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT session_id, rn, event_id, us AS opened, 1 AS n FROM e WHERE rn = 1
    UNION ALL SELECT e.session_id, e.rn, e.event_id, CASE WHEN e.us < w.opened + 86400000000 THEN w.opened ELSE e.us END, CASE WHEN e.us < w.opened + 86400000000 THEN w.n + 1 ELSE 1 END
    FROM w JOIN e ON e.session_id = w.session_id AND e.rn = w.rn + 1)
    SELECT event_id, session_id, n <= 3 AS allowed FROM w""")  # fmt: skip
def rate_limited(spark: SparkSession, sf_dir: str, most: int = 3, window_seconds: int = 86_400) -> DataFrame:
    """Fixed windows that open with a session's first event: the first `most` events of each window pass."""
    return windowed_limit(clicks(spark, sf_dir), "session_id", most, window_seconds).select("event_id", "session_id", "allowed")


@register("popularity", sql("SELECT product_id, count(*) AS clicks, 3 * count(*) AS heat FROM clicks WHERE event_type = 'click' GROUP BY product_id"))
def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).where("event_type = 'click'").groupBy("product_id").agg(F.count("*").alias("clicks"), (3 * F.count("*")).alias("heat"))


@register("trailing_counts", sql(f"SELECT product_id, count(*) AS n FROM clicks WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY GROUP BY product_id"))
def trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).where(F.col("ts") >= ts(EVENTS_NOW) - F.expr("INTERVAL 14 DAYS")).groupBy("product_id").agg(F.count("*").alias("n"))


_WEIGHT = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


_PARTS = f"CAST(floor({_WEIGHT} * pow(0.5, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(ts)) / 86400000000 / 14) * 1000000000 + 0.5) AS BIGINT)"


@register("interest_profiles", sql(f"SELECT session_id, category, floor(sum({_PARTS}) / 1000000000 * 1000 + 0.5) / 1000 AS weight FROM clicks JOIN products USING (product_id) WHERE {_WEIGHT} > 0 GROUP BY session_id, category HAVING sum({_PARTS}) >= 50000000"))
def interest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interest of a session in a category: event weights that halve in 14 days, in closed form; summed in whole billionths, so in any order."""
    w = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4).otherwise(0)
    days = (micros(ts(EVENTS_NOW)) - micros(F.col("ts"))) / 86_400_000_000
    rows = clicks(spark, sf_dir).withColumn("w", w).where("w > 0").join(products(spark, sf_dir), "product_id")
    sums = rows.groupBy("session_id", "category").agg(F.sum(F.floor(F.col("w") * decay(days) * 1_000_000_000 + 0.5).cast("long")).alias("s")).where(F.col("s") >= 50_000_000)
    return sums.select("session_id", "category", half_up(F.col("s") / 1_000_000_000, 3).alias("weight"))


@register("folded_profiles", sql(f"""WITH RECURSIVE e AS (SELECT session_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, {_WEIGHT} AS w, category, split_part(product_name, ' ', 1) AS brand, row_number() OVER (PARTITION BY session_id ORDER BY floor(epoch_us(ts) / 1000), event_id) AS rn FROM clicks JOIN products USING (product_id) WHERE {_WEIGHT} > 0),
    c AS (SELECT session_id, rn, ms AS held FROM e WHERE rn = 1 UNION ALL SELECT e.session_id, e.rn, CASE WHEN (e.ms - c.held) / 86400000::DOUBLE < 0.01::DOUBLE THEN c.held ELSE e.ms END FROM c JOIN e ON e.session_id = c.session_id AND e.rn = c.rn + 1),
    z AS (SELECT session_id, CASE WHEN (n - max(held)) / 86400000::DOUBLE < 0.01::DOUBLE THEN max(held) ELSE greatest(n, max(held)) END AS end_ms FROM c, (SELECT epoch_us(TIMESTAMP '{EVENTS_NOW}') // 1000 AS n) GROUP BY session_id, n),
    k AS (SELECT session_id, rn, w, unnest(['category', 'brand']) AS kind, unnest([category, brand]) AS name FROM e)
    SELECT session_id, kind, name, floor(sum(w * pow(0.5, (end_ms - held) / 86400000::DOUBLE / 14)) * 1000 + 0.5) / 1000 AS weight FROM k JOIN c USING (session_id, rn) JOIN z USING (session_id) GROUP BY session_id, kind, name"""))  # fmt: skip
def folded_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interest of a session in categories and brands as the shop keeps it: decay since the last change, none within a hundredth
    of a day, pruned and capped. The SQL is its closed form over the same clock; nothing here falls below the prune or over the cap."""
    w = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4).otherwise(0)
    rows = clicks(spark, sf_dir).join(products(spark, sf_dir), "product_id").withColumn("weight", w).withColumn("brand", brand_token(F.col("product_name")))
    now = int(datetime.fromisoformat(EVENTS_NOW).replace(tzinfo=UTC).timestamp()) * 1_000_000
    return profiles(rows, ["category", "brand"], now).withColumn("weight", half_up(F.col("weight"), 3))


@register("top_categories", sql("SELECT session_id, category, n FROM (SELECT session_id, category, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, category) AS rn FROM clicks JOIN products USING (product_id) GROUP BY session_id, category) WHERE rn <= 3"))
def top_categories(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    n = clicks(spark, sf_dir).join(products(spark, sf_dir), "product_id").groupBy("session_id", "category").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), F.asc("category")))
    return n.withColumn("rn", rn).where(F.col("rn") <= k).drop("rn")


@register("session_gaps", sql("SELECT session_id, count(*) AS n, max(gap) AS longest_us FROM (SELECT session_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS gap FROM clicks) GROUP BY session_id"))
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = micros(F.col("ts"))
    gap = at - F.lag(at).over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    return clicks(spark, sf_dir).select("session_id", gap.alias("gap")).groupBy("session_id").agg(F.count("*").alias("n"), F.max("gap").alias("longest_us"))


@register("daily_windows", sql("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM clicks GROUP BY ALL"))
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.window("ts", "1 day")
    return clicks(spark, sf_dir).groupBy("event_type", day).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents")).select("event_type", F.col("window.start").alias("day"), "n", "cents")


@register("alert_cooldown", _ACCEPT_SQL.replace("events_", "(SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS session_id, 'alert' AS event_type, ts FROM events WHERE event_type = 'purchase')").replace("GAP", "21600000000").replace("SELECT event_id, session_id FROM", "SELECT event_id, session_id AS product_id FROM"))
def alert_cooldown(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """A product's alert fires again only six hours after it last fired."""
    rows = clicks(spark, sf_dir).where("event_type = 'purchase'")
    return accepted_events(rows, ["product_id"], hours * 3600).select("event_id", "product_id")
