"""Values of neighbouring rows in time, and as-of joins, without putting a key's rows into one task.

Keys of many rows are windowed within slices of time (a column that grows with the order, such as the month); what a slice's
first or last row needs from the slices around it comes from one short row for each key and slice, in the same window. Rows are
shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Keys are windowed whole unless their bucket of a hash holds more rows than this; those are dealt over slices.
HOT = 100_000
BUCKETS = 1 << 16


def _cut(df: DataFrame, keys: Sequence[str], slice_: Column) -> DataFrame:
    """Adds `_n_hot`, whether the key's bucket is hot, and `_n_slice`, null unless it is; a row for each hot bucket is broadcast."""
    rows = df.withColumn("_n_slice", slice_).withColumn("_n_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    hot = rows.groupBy("_n_bucket").agg(F.count("*").alias("_n_rows")).where(F.col("_n_rows") > HOT).select("_n_bucket", F.lit(True).alias("_n_hot"))
    return rows.join(F.broadcast(hot), "_n_bucket", "left").drop("_n_bucket").withColumn("_n_slice", F.when(F.col("_n_hot"), F.col("_n_slice")))


def _with_carried(cut: DataFrame, columns: Sequence[str], keys: Sequence[str], carried: DataFrame, value: str, place: int) -> DataFrame:
    """Rows of `cut` (`_n_place` 0) and, beside those of its slice, a row with what the slices around it hand over, so that one window sees both."""
    schema = cut.schema
    filled = lambda c: F.col(c) if c in keys else (F.col("_n_carried") if c == value else F.lit(None)).cast(schema[c].dataType).alias(c)
    rows = cut.select(*columns, "_n_slice", F.lit(0).alias("_n_place"))
    return rows.unionByName(carried.select(*(filled(c) for c in columns), "_n_slice", F.lit(place).alias("_n_place")))


def neighbour(df: DataFrame, keys: Sequence[str], slice_: Column, order: Sequence[str], value: str, name: str, forward: bool = False) -> DataFrame:
    """Adds `name`: the value of the key's row before this one (with `forward`, behind it) in the order of the columns, nulls first; null at the end.

    slice_ must not fall while `order` grows. Columns that begin with `_n_` are taken.
    """
    cut = _cut(df, keys, slice_)
    edge = (F.min_by if forward else F.max_by)(F.struct(F.col(value).alias("v")), F.struct(*order))
    along = Window.partitionBy(*keys).orderBy("_n_slice")
    edges = cut.where("_n_hot").groupBy(*keys, "_n_slice").agg(edge.alias("_n_edge"))
    edges = edges.withColumn("_n_edge", (F.lead if forward else F.lag)("_n_edge").over(along)).where("_n_edge IS NOT NULL").withColumn("_n_carried", F.col("_n_edge")["v"])
    rows = _with_carried(cut, df.columns, keys, edges, value, 1 if forward else -1)
    within = Window.partitionBy(*keys, "_n_slice").orderBy("_n_place", *order)
    beside = (F.lead if forward else F.lag)(value).over(within)
    return rows.withColumn("_n_beside", beside).where("_n_place = 0").select(*df.columns, F.col("_n_beside").alias(name))


def last_known(df: DataFrame, keys: Sequence[str], slice_: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the last value that is not null in the key's rows up to and with this one."""
    cut = _cut(df, keys, slice_)
    known = F.col(value).isNotNull()
    ends = cut.where("_n_hot").groupBy(*keys, "_n_slice").agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.struct(*order))).alias("_n_end"))
    before = Window.partitionBy(*keys).orderBy("_n_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_n_carried", F.last("_n_end", ignorenulls=True).over(before)).where("_n_carried IS NOT NULL")
    rows = _with_carried(cut, df.columns, keys, ends, value, -1)
    within = Window.partitionBy(*keys, "_n_slice").orderBy("_n_place", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_n_last", F.last(value, ignorenulls=True).over(within)).where("_n_place = 0").select(*df.columns, F.col("_n_last").alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, ties: Sequence[str] = (), unit: str = "month", strict: bool = True) -> DataFrame:
    """Left rows with the value of the key's last right row before their time `at` (not strict: or at it); null without one.

    Both sides are one table in order of time, and each left row takes the last value known there: no pairs are made, and a
    hot key's rows are dealt over slices of `unit`. Of right rows of one time the greatest by `ties` counts. Right values are not null.
    """
    mine = 0 if strict else 1  # at the same time left rows stand before right ones if strict
    own = [c for c in left.columns if c not in (*keys, at)]
    r_ = right.where(F.col(value).isNotNull() & F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(1 - mine).alias("_side"), F.struct(*(ties or [value])).alias("_ties"), F.col(value).alias("_value"))
    l_ = left.select(*keys, F.col(at).alias("_at"), F.lit(mine).alias("_side"), *(F.lit(None).cast(r_.schema[c].dataType).alias(c) for c in ("_ties", "_value")), *(F.col(c).alias(f"_own_{c}") for c in own))
    both = l_.unionByName(r_, allowMissingColumns=True)
    known = last_known(both, keys, F.date_trunc(unit, "_at"), ["_at", "_side", "_ties"], "_value", "_known").where(F.col("_side") == mine)
    named = {at: "_at"} | {c: f"_own_{c}" for c in own}
    return known.select(*(F.col(named.get(c, c)).alias(c) for c in left.columns), F.col("_known").alias(f"{value}_as_of"))
