"""Table operators of ingest: each is a pure function, so a failed run can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.ranking import best_per_key


def upsert(old: DataFrame, delta: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the greatest version of each key; of equal versions the delta's."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return best_per_key(rows, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def snapshot_on_change(stored: DataFrame, seen: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Seen rows whose value is not exactly the stored one, with `before`; rows without a stored value are changes."""
    before = stored.select(*keys, F.col(value).alias("before"))
    return seen.join(before, list(keys), "left").where(~F.col(value).eqNullSafe(F.col("before")))


def changed_rows(rows: DataFrame, value: str, stored: str, epsilon: float | None = None) -> DataFrame:
    """Rows to write back: the value differs from the stored one, or by epsilon at least."""
    same = F.col(value).eqNullSafe(F.col(stored)) if epsilon is None else F.coalesce(F.abs(F.col(value) - F.col(stored)) < epsilon, F.lit(False))
    return rows.where(~same)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def health_gate(active: DataFrame, scraped: DataFrame, group: str, least: float = 0.5, small: int = 20) -> DataFrame:
    """Groups whose run may deactivate rows: it scraped something, and of more than `small` active rows at least that share."""
    n = active.groupBy(group).agg(F.count("*").alias("active"))
    m = scraped.groupBy(group).agg(F.count("*").alias("scraped"))
    return n.join(m, group).where(~((F.col("active") > small) & (F.col("scraped") < least * F.col("active")))).select(group)
