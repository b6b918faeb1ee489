"""Operators that depend on the order of rows; the order is always a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number rows from 1 in an order. For pages and other bounded results: one task holds the rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def places(df: DataFrame, keys: Sequence[str], level: str, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Number the rows of each key from 1, by descending `level`, then in an order.

    Rows are numbered within a key's levels, and the counts of the levels above are added, so a key of any size is
    spread over as many tasks as it has levels. Nulls of the level come last.
    """
    above = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(level)).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, level).agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, level).orderBy(*order))
    rows, match = df.withColumn("_in", within).alias("r"), None
    for k in (*keys, level):
        same = F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
        match = same if match is None else match & same
    return rows.join(counts.alias("c"), match).select(*(F.col(f"r.{c}") for c in df.columns), (F.col("_in") + F.col("_above")).cast("long").alias(name))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key (a top-1 window, which Spark limits before it shuffles)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def cap_per_group(df: DataFrame, group: str, order: str, cap: int, need: int) -> DataFrame:
    """At most `cap` rows a group in order; if they are fewer than `need`, the rest fills up in order. Adds `place`."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = df.withColumn("_late", F.when(rn <= cap, 0).otherwise(1))
    return ranked(rows, [F.col("_late"), F.col(order)], "place").where(F.col("place") <= need).drop("_late")


def interleave(df: DataFrame, group: str, order: str) -> DataFrame:
    """Round robin over groups, which stand in the order of their first rows. Adds `place`."""
    w = Window.partitionBy(group)
    rows = df.withColumn("_turn", F.row_number().over(w.orderBy(order))).withColumn("_first", F.min(order).over(w))
    return ranked(rows, [F.col("_turn"), F.col("_first")], "place").drop("_turn", "_first")


def collapse_keep_position(df: DataFrame, key: str, order: Sequence[Column], id_: str, price: str = "price") -> DataFrame:
    """One row a key: `slot` is the id of its first row, `kept` that of its cheapest (no price counts as the dearest)."""
    cost = F.coalesce(F.col(price), F.lit(float("inf")))
    at = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(id_, at).alias("slot"), F.min_by(id_, F.struct(cost, at)).alias("kept"), F.min(price).alias(price))
