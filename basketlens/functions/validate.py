"""Validation and coercion of raw offer rows: typed values with defaults, and the reason why a row is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.taxonomy import OTHER


def or_null(s: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(s, F.lit(""))


def offer_type(raw: Column, original: Column) -> Column:
    """'strikethrough' or 'mono': labels that promise a struck price need one, mechanics never have one."""
    v = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    struck = F.when(original.isNotNull() & (original != 0), "strikethrough").otherwise("mono")
    promise = v.isin("amount", "percentage") | v.contains("percent") | v.contains("price promotion") | v.contains("discount")
    mechanic = (v == "super") | v.contains("multi") | v.contains("free") | v.contains("grocery")
    return F.when(v == "strikethrough", "strikethrough").when(v.isin("mono", "multibuy"), "mono").when(promise, struck).when(mechanic, "mono").otherwise(struck)


def local_timestamp(s: Column) -> Column:
    """'31/05/2026 20:59:00' at a fixed offset of three hours; the time may be missing."""
    day, time = F.regexp_extract(s, r"^(\d{2}/\d{2}/\d{4})", 1), F.regexp_extract(s, r"^\d{2}/\d{2}/\d{4}\s+(\d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(F.concat_ws(" ", day, F.coalesce(or_null(time), F.lit("00:00:00")), F.lit("+03:00")), F.lit("dd/MM/yyyy HH:mm:ss XXX"))


def offer_input(rows: DataFrame, now: Column) -> DataFrame:
    """Typed offers from all-string rows (chain, name, category, price, original, percent, valid_from, valid_until), with `reject`.

    The first broken rule is named; a sound row has a null reject. Missing dates run from now for a week.
    """
    number = lambda c: or_null(F.trim(c)).try_cast("double")
    price, original = number(F.col("price")), number(F.col("original"))
    start = F.coalesce(or_null(F.col("valid_from")).try_cast("timestamp"), now)
    until = F.coalesce(or_null(F.col("valid_until")).try_cast("timestamp"), now + F.expr("INTERVAL 7 DAYS"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    given = or_null(F.trim(F.col("original"))).isNotNull()
    reject = (
        F.when(or_null(F.trim(F.coalesce("chain", F.lit("")))).isNull(), "chain")
        .when(or_null(F.trim(F.coalesce("name", F.lit("")))).isNull(), "name")
        .when(~sound(price), "price")
        .when(given & ~sound(original), "original")
        .when(until < start, "valid_until")
    )
    return rows.select(
        "chain", F.trim("name").alias("name"), F.coalesce(or_null(F.col("category")), F.lit(OTHER)).alias("category"), price.alias("price"),
        F.when(original != 0, original).alias("original"), number(F.col("percent")).alias("percent"), start.alias("valid_from"), until.alias("valid_until"), reject.alias("reject"),
    )


def extracted_item(rows: DataFrame) -> DataFrame:
    """Items (name, price, original, category) as an extraction gives them: number-like prices, no name or price rejects."""
    from basketlens.functions.text import parse_euro

    price, original = parse_euro(F.col("price")), parse_euro(F.col("original"))
    ok = (F.length(F.trim("name")) > 0) & (price > 0)
    return rows.select(F.trim("name").alias("name"), price.alias("price"), F.when(original > price, original).alias("original"), F.coalesce(or_null(F.col("category")), F.lit(OTHER)).alias("category"), F.coalesce(ok, F.lit(False)).alias("valid"))
