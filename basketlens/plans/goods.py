"""What the names of goods say: packs and unit prices, aisles and menu paths, letters, codes and dates.

The names are derived from the catalog's columns; the SQL computes each answer from those columns, not from the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.bindings import OFFERS_NOW, products, runs, sql, ts
from basketlens.functions.dates import badge_dates, next_sunday_end
from basketlens.functions.num import half_up
from basketlens.functions.packs import parse_pack, unit_price
from basketlens.functions.taxonomy import PERSONAL, aisle_key, browse_path
from basketlens.functions.text import ean_hits, is_uuid, parse_euro, to_greek
from basketlens.functions.validate import local_timestamp
from basketlens.registry import register


def _packed_name() -> Column:
    """The product's name with a pack of a kind that its category decides and of a number that its size decides."""
    size = F.col("size").cast("string")
    pack = (
        F.when(F.col("category") == "PROMO", F.concat(F.lit("200gr "), size, F.lit("+"), (F.col("size") % 5 + 1).cast("string"), F.lit(" δώρο")))
        .when(F.col("category") == "SMALL", F.concat(size, F.lit(" x 330ml")))
        .when(F.col("category") == "MEDIUM", F.concat(size, F.lit(" μεζούρες")))
        .when(F.col("category") == "LARGE", F.concat((F.col("size") * 5).cast("string"), F.lit(" ΤΕΜΆΧΙΑ")))
        .when(F.col("category") == "ECONOMY", F.concat((F.col("size") * 100).cast("string"), F.lit("gr")))
        .otherwise("τιμή κιλού")
    )
    return F.concat("product_name", F.lit(" "), pack)


@register("pack_sizes", sql("""WITH u AS (SELECT product_id, category, CASE category WHEN 'PROMO' THEN size + size % 5 + 1 WHEN 'SMALL' THEN size WHEN 'LARGE' THEN size * 5 END AS n FROM products)
    SELECT product_id, CASE WHEN ok THEN n END AS units, CASE WHEN ok THEN via END AS via FROM (SELECT *, CASE category WHEN 'PROMO' THEN 'gift' WHEN 'SMALL' THEN 'multipack' WHEN 'LARGE' THEN 'count' END AS via,
    n BETWEEN 2 AND CASE category WHEN 'LARGE' THEN 200 ELSE 99 END AS ok FROM u)"""))  # fmt: skip
def pack_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a gift pack, multipack or count; none otherwise or out of bounds."""
    return products(spark, sf_dir).select("product_id", parse_pack(_packed_name()).alias("p")).select("product_id", "p.units", "p.via")


@register("pack_unit_prices", sql("""WITH s AS (SELECT *, CASE category WHEN 'PROMO' THEN 200 * (size + size % 5 + 1) WHEN 'SMALL' THEN 330 * size WHEN 'ECONOMY' THEN 100 * size END AS amount,
        CASE category WHEN 'PROMO' THEN size + size % 5 + 1 WHEN 'SMALL' THEN size WHEN 'LARGE' THEN size * 5 END AS units FROM products),
    v AS (SELECT *, retail_price / CAST(amount AS DOUBLE) * 1000 AS by_size FROM s),
    w AS (SELECT product_id, CASE WHEN category = 'STANDARD' THEN 'κιλό' WHEN category = 'MEDIUM' AND size >= 2 THEN 'μεζούρα' WHEN by_size BETWEEN 0.05 AND 1000 THEN CASE category WHEN 'SMALL' THEN 'λίτρο' ELSE 'κιλό' END
        WHEN units BETWEEN 2 AND CASE category WHEN 'LARGE' THEN 200 ELSE 99 END THEN 'τεμ.' END AS per, retail_price, by_size, units, size, category FROM v)
    SELECT product_id, per, floor(CASE WHEN category = 'STANDARD' THEN retail_price WHEN per = 'μεζούρα' THEN retail_price / size WHEN per = 'τεμ.' THEN retail_price / units WHEN per IS NOT NULL THEN by_size END * 100 + 0.5) / 100 AS value FROM w"""))  # fmt: skip
def pack_unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per kilo, litre, dose or piece, the first that the name supports."""
    rows = products(spark, sf_dir).select("product_id", unit_price(_packed_name(), F.col("retail_price")).alias("u"))
    return rows.select("product_id", "u.per", "u.value")


#: Departments that stand for the catalog's categories, and shop words that stand for the second word of a product's name.
_PLACES = {"PROMO": "Κάβα", "SMALL": "Πρωινό & Ροφήματα", "MEDIUM": PERSONAL, "LARGE": "Κατεψυγμένα", "ECONOMY": "Άγνωστο τμήμα"}
_WORDS = {"ring": "Μπύρα", "bolt": "κρασί", "widget": "ΝΕΡΌ", "gear": "cola", "gizmo": "ούζο", "plate": "καφές ελληνικός", "rod": "χυμός", "anvil": "τσάι σαμπουάν"}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _shelved(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.split("product_name", " "), -1)
    return products(spark, sf_dir).select("product_id", _lookup(F.col("category"), _PLACES).alias("dept"), _lookup(word, _WORDS).alias("shop_name"))


_WORD = "(SELECT *, split_part(product_name, ' ', 2) AS w FROM products)"


@register("aisles", sql(f"""SELECT product_id, CASE category WHEN 'PROMO' THEN CASE WHEN w IN ('ring', 'bolt', 'gizmo') THEN 'alcohol' WHEN w = 'widget' THEN 'water' WHEN w = 'gear' THEN 'soft-drinks' ELSE 'drinks-other' END
    WHEN 'SMALL' THEN CASE w WHEN 'plate' THEN 'coffee' WHEN 'rod' THEN 'juice' WHEN 'anvil' THEN 'tea' ELSE 'breakfast' END
    WHEN 'MEDIUM' THEN '{PERSONAL}' WHEN 'LARGE' THEN 'Κατεψυγμένα' ELSE 'Άλλο' END AS aisle FROM {_WORD}"""))  # fmt: skip
def aisles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aisle of each product; drinks and breakfast goods are split by name."""
    return _shelved(spark, sf_dir).select("product_id", aisle_key(F.col("dept"), F.col("shop_name")).alias("aisle"))


@register("browse_paths", sql(f"""SELECT product_id, CASE WHEN category = 'PROMO' OR category = 'SMALL' AND w IN ('plate', 'rod', 'anvil') THEN 'drinks' WHEN category IN ('SMALL', 'LARGE') THEN 'food' WHEN category = 'MEDIUM' THEN 'personal' ELSE 'other' END AS top,
    CASE category WHEN 'PROMO' THEN CASE WHEN w IN ('ring', 'bolt', 'gizmo') THEN 'alcohol' WHEN w = 'widget' THEN 'water' WHEN w = 'gear' THEN 'soft-drinks' ELSE 'drinks-other' END
        WHEN 'SMALL' THEN CASE w WHEN 'plate' THEN 'coffee' WHEN 'rod' THEN 'juice' WHEN 'anvil' THEN 'tea' ELSE 'breakfast' END
        WHEN 'MEDIUM' THEN CASE w WHEN 'anvil' THEN 'hair' ELSE 'personal-other' END WHEN 'LARGE' THEN 'Κατεψυγμένα' ELSE 'other' END AS grp,
    CASE WHEN category = 'PROMO' THEN CASE w WHEN 'ring' THEN 'beer' WHEN 'bolt' THEN 'wine' WHEN 'gizmo' THEN 'spirits' END WHEN category = 'SMALL' AND w = 'plate' THEN 'greek' END AS leaf FROM {_WORD}"""))  # fmt: skip
def browse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top, group and leaf of the three-level menu."""
    path = browse_path(F.col("dept"), F.lit(None).cast("string"), F.col("shop_name"))
    return _shelved(spark, sf_dir).select("product_id", path.alias("p")).select("product_id", "p.top", "p.grp", "p.leaf")


@register("greek_names", sql("""SELECT product_id, replace(translate(replace(replace(replace(replace(replace(replace(replace(lower(product_name), 'th', 'θ'), 'ch', 'χ'), 'ps', 'ψ'), 'ou', 'ου'), 'mp', 'μπ'), 'nt', 'ντ'), 'gk', 'γκ'),
    'abgdezhiklmnxoprstuyfvwqc', 'αβγδεζηικλμνξοπρστυυφβωκκ'), 'j', 'τζ') AS greek FROM products"""))  # fmt: skip
def greek_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in Greek letters, two-letter combinations first."""
    return products(spark, sf_dir).select("product_id", to_greek(F.lower("product_name")).alias("greek"))


@register("parsed_euros", sql("SELECT product_id, floor(retail_price * 700 + 0.5) / 100 AS price, floor(retail_price * 700 + 0.5) / 100 AS plain FROM products"))
def parsed_euros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices read back from '1.234,50 €' and from '1234.50'."""
    cents = F.floor(F.col("retail_price") * 700 + 0.5).cast("long")
    rest, whole = F.lpad((cents % 100).cast("string"), 2, "0"), F.floor(cents / 100)
    thousands = F.when(whole >= 1000, F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string"))
    dotted = F.concat(whole.cast("string"), F.lit("."), rest)
    return products(spark, sf_dir).select("product_id", parse_euro(F.concat(thousands, F.lit(","), rest, F.lit(" €"))).alias("price"), parse_euro(dotted).alias("plain"))


@register("codes_in_text", sql("""SELECT product_id, CASE WHEN size > 25 THEN '' ELSE '520' || lpad(CAST(product_id AS VARCHAR), 10, '0') || CASE WHEN size > 10 THEN '' ELSE ',5211234567890' END END AS codes, size > 25 AS is_uuid FROM products"""))
def codes_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct national codes in image names, each once in order of appearance, and whether a text is a UUID."""
    code = F.concat(F.lit("520"), F.lpad(F.col("product_id").cast("string"), 10, "0"))
    text = F.when(F.col("size") > 25, F.concat(code, F.lit("7.png"))).otherwise(F.concat(F.lit("/img/"), code, F.lit("_"), code, F.when(F.col("size") <= 10, "-5211234567890.jpg").otherwise(".jpg")))
    digest = F.md5(F.col("product_id").cast("string"))
    parts = F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    given = F.when(F.col("size") > 25, F.upper(parts)).otherwise(F.concat(parts, F.lit("0")))
    return products(spark, sf_dir).select("product_id", F.array_join(ean_hits(text), ",").alias("codes"), is_uuid(given).alias("is_uuid"))


@register("badge_windows", sql("""SELECT product_id, strftime(DATE '1998-09-02' + size, '%Y-%m-%d %H:%M:%S') AS starts, strftime(DATE '1998-09-02' + size + 100 + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS ends FROM products"""))
def badge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows read from badges such as '20.10. - 12.01.', which may end in the next year."""
    day = F.lit(OFFERS_NOW[:10]).cast("date")
    show = lambda n: F.date_format(F.date_add(day, n), "dd.MM.")
    window = badge_dates(F.concat_ws(" - ", show(F.col("size")), show(F.col("size") + 100)), ts(OFFERS_NOW))
    plain = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return products(spark, sf_dir).select("product_id", plain(window["valid_from"]).alias("starts"), plain(window["valid_until"]).alias("ends"))


@register("run_clocks", sql("""SELECT run_id, strftime(date_trunc('week', finished_at) + INTERVAL 6 DAY, '%Y-%m-%d') || ' 23:59:59.999' AS week_end, CAST(epoch(finished_at) AS BIGINT) - 10800 AS seconds FROM runs"""))
def run_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each run's week, and its time read from 'dd/MM/yyyy HH:mm:ss' at a fixed offset of three hours."""
    at = F.col("finished_at")
    read = local_timestamp(F.date_format(at, "dd/MM/yyyy HH:mm:ss"))
    return runs(spark, sf_dir).select("run_id", F.date_format(next_sunday_end(at), "yyyy-MM-dd HH:mm:ss.SSS").alias("week_end"), F.unix_seconds(read).alias("seconds"))


@register("per_piece_prices", sql("SELECT product_id, CASE WHEN units >= 2 THEN floor(retail_price / units * 100 + 0.5) / 100 END AS piece FROM (SELECT *, CASE category WHEN 'PROMO' THEN size + size % 5 + 1 WHEN 'SMALL' THEN size WHEN 'LARGE' THEN CASE WHEN size <= 40 THEN size * 5 END END AS units FROM products)"))
def per_piece_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = parse_pack(_packed_name())["units"]
    return products(spark, sf_dir).select("product_id", F.when(units >= 2, half_up(F.col("retail_price") / units, 2)).alias("piece"))
