"""Exact distinct counts that merge: ids as bits of bitmaps, one for each key and bucket of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bitmaps(rows: DataFrame, keys: Sequence[str], id_: str, sets: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """(keys, bucket, a bitmap for each set, a count for each of counts) from one scan: a set has the ids of the rows that its
    condition lets through, a count their number. Rows of different days, feeds or files give parts that `merged` puts together."""
    bit = F.bitmap_bit_position(F.col(id_))
    bitmaps = [F.bitmap_construct_agg(F.when(condition, bit)).alias(name) for name, condition in sets.items()]
    numbers = [F.count_if(condition).alias(name) for name, condition in (counts or {}).items()]
    return rows.groupBy(*keys, F.bitmap_bucket_number(F.col(id_)).alias("bucket")).agg(*bitmaps, *numbers)


def merged(parts: DataFrame, keys: Sequence[str], sets: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Parts of the same keys and buckets as one; a set's union, a count's sum."""
    return parts.groupBy(*keys, "bucket").agg(*(F.bitmap_or_agg(s).alias(s) for s in sets), *(F.sum(c).alias(c) for c in counts))


def set_sizes(bitmaps: DataFrame, keys: Sequence[str], sets: dict[str, str | tuple[str, str]], counts: Sequence[str] = ()) -> DataFrame:
    """Sizes of sets by key: each a column, or two whose union is meant."""
    unions = {name: of for name, of in sets.items() if not isinstance(of, str)}
    sizes = [F.sum(F.bitmap_count(of)).alias(name) for name, of in sets.items() if isinstance(of, str)]
    totals = bitmaps.groupBy(*keys).agg(*sizes, *(F.sum(c).alias(c) for c in counts))
    for name, pair in unions.items():
        both = bitmaps.select(*keys, "bucket", F.explode(F.array(*pair)).alias("b")).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("b").alias("b"))
        totals = totals.join(both.groupBy(*keys).agg(F.sum(F.bitmap_count("b")).alias(name)), list(keys))
    return totals
