"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of ids is broadcast up to this many rows (8 to 16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Slices of an ordering hash in `prefix_sums`; each slice is one window partition.
SLICE_BITS = 12


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only for a local master whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: A table of wider rows is broadcast up to this many.
FEW_ROWS = 250_000


def sent_if_few(df: DataFrame) -> DataFrame:
    """A side of a join, stored and counted: sent to every task up to FEW_ROWS rows, so that no hot key of the other side is
    one task; beyond that both sides are shuffled, and adaptive execution splits what is hot."""
    few = stored(df, "side")
    return F.broadcast(few) if few.count() <= FEW_ROWS else few


def semi_join(df: DataFrame, ids: DataFrame, on: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids: broadcast if n_ids (counted by the caller) is within the bound, else shuffled."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, on, "left_semi")


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def unsigned_crc32(text: Column) -> Column:
    """crc32 of the UTF-8 bytes as an unsigned long; null for null."""
    return F.crc32(text.cast("binary"))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], seed: int = 0, by: Sequence[str] | None = None) -> DataFrame:
    """Add, within each key, running sums over rows in a fixed pseudo-random order.

    The order is that of a hash of the `by` columns (by default the `order` columns), then of the `order` columns. Rows that
    agree in all `by` columns are in one slice. `sums` maps a new column to a long column;
    the new column has the sum over the rows before this one (exclusive). No key's rows meet in one task: rows are
    windowed within 2**SLICE_BITS slices of the hash, and only one total for each key and slice is summed over slices.
    """
    h, s, names = free_name(df, "_order_hash"), free_name(df, "_slice"), list(sums)
    df = df.withColumn(h, F.xxhash64(F.lit(seed), *(F.col(c) for c in by or order))).withColumn(s, F.shiftright(F.col(h), 64 - SLICE_BITS).cast("int"))
    totals = df.groupBy(*keys, s).agg(*(F.sum(sums[n]).alias(n) for n in names))
    over_slices = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.col(s).alias("_o_slice"), *(F.coalesce(F.sum(n).over(over_slices), F.lit(0)).alias(f"_o_{n}") for n in names))
    within = Window.partitionBy(*keys, s).orderBy(h, *order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *(F.coalesce(F.sum(sums[n]).over(within), F.lit(0)).alias(n) for n in names))
    on = F.col(s) == F.col("_o_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = local.join(offsets, on)
    return joined.select(*(c for c in df.columns if c not in (h, s)), *((F.col(n) + F.col(f"_o_{n}")).alias(n) for n in names))
