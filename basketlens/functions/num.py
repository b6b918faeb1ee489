"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits on the binary double: ties go up, also below zero."""
    scale = 10**digits
    return (F.floor(x * scale + 0.5) / scale).cast("double")


def is_price(x: Column) -> Column:
    """Finite and above zero."""
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def percent_off(price: Column, original: Column) -> Column:
    """Whole percent saved; null unless the struck price is higher."""
    return F.when(original > price, F.floor((1 - price / original) * 100 + 0.5).cast("int"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def share_of(part: Column, whole: Column) -> Column:
    """Whole percent of a total, from 0 to 100; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(100 * part / whole + 0.5)))).otherwise(0).cast("int")


def gtin13_check_digit(first12: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(first12, i, 1).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.pmod(10 - F.aggregate(digits, F.lit(0), lambda a, b: a + b) % 10, F.lit(10))


def normalize_barcode(raw: Column) -> Column:
    """GTIN-14 cases of one packing level (leading 1) to the GTIN-13 of the piece; other digits as they are; else null."""
    code = F.trim(raw)
    inner = F.substring(code, 2, 12)
    return F.when(code.rlike(r"^1\d{13}$"), F.concat(inner, gtin13_check_digit(inner).cast("string"))).when(code.rlike(r"^\d+$"), code)


def string_hash(key: Column) -> Column:
    """The 32-bit h = 31 * h + c hash over UTF-16 units, which is the JVM's own hash of a string; 0 for null."""
    return F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), key).cast("long")


def jitter(key: Column) -> Column:
    """Stable pseudo-random 0 to 1.19 that spreads ties."""
    return F.abs(string_hash(key)) % 120 / 100


def popularity(clicks: Column, list_adds: Column) -> Column:
    return F.log2(1 + F.greatest(clicks, F.lit(0))) * 7 + F.log2(1 + F.greatest(list_adds, F.lit(0))) * 10


def decay(days: Column, half_life: float = 14.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def per_unit_price(price: Column, units: Column) -> Column:
    """Price of one of two or more pieces, to cents; null for no price or one piece."""
    return F.when(is_price(price) & (units >= 2), half_up(price / units, 2))
