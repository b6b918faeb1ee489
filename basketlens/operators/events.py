"""Event operators whose result depends on what was accepted before: sorted streams of a key inside a task.

A key's events are not gathered: Spark sorts partitions by key and time, and a task holds one state at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.dates import micros


def _walked(rows: DataFrame, keys: Sequence[str], decide, name: str) -> DataFrame:
    """Adds a boolean column: decide(state, microseconds) -> (state, value) over each key's rows in order of ts, event_id.

    A row without a time gets false and changes no state; null is a key of its own.
    """
    k_, at_ = (next(n for n in (f"_{x}{'_' * i}" for i in range(len(rows.columns) + 1)) if n not in rows.columns) for x in ("key", "at"))
    ready = rows.withColumn(k_, F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))).withColumn(at_, micros(F.col("ts")))
    ready = ready.repartition(k_).sortWithinPartitions(k_, at_, "event_id")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (k, at) in enumerate(zip(batch.column(k_).to_pylist(), batch.column(at_).to_pylist(), strict=True)):
                if k != key:
                    key, state = k, None
                if at is not None:
                    state, keep[i] = decide(state, at)
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (k_, at_)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keep)], [*(n for n in batch.schema.names if n not in (k_, at_)), name])

    return ready.mapInArrow(walk, schema)


@dataclass(frozen=True)
class Rule:
    """decide(state, microseconds) -> (state, value) for a key's events in order; a state is a pair and does not matter from until(state) on."""

    decide: Callable[[tuple[int, int] | None, int], tuple[tuple[int, int] | None, bool]]
    until: Callable[[tuple[int, int]], int]


def gap_rule(gap_seconds: int) -> Rule:
    """True at least the gap after the last true event."""
    gap = gap_seconds * 1_000_000
    return Rule(lambda last, at: ((at, 0), True) if last is None or at - last[0] >= gap else (last, False), lambda last: last[0] + gap)


def window_rule(most: int, window_seconds: int) -> Rule:
    """True for the first `most` events of a window that opens at the first event after the last window ended."""
    span = window_seconds * 1_000_000

    def decide(state, at):
        begin, n = state if state and at < state[0] + span else (at, 0)
        return (begin, n + 1), n < most

    return Rule(decide, lambda state: state[0] + span)


def accepted_events(rows: DataFrame, keys: Sequence[str], gap_seconds: int) -> DataFrame:
    """Rows at least the gap after the last accepted row of their key; columns (ts, event_id) give the order."""
    return _walked(rows, keys, gap_rule(gap_seconds).decide, "accepted").where("accepted").drop("accepted")


def windowed_limit(rows: DataFrame, key: str, most: int, window_seconds: int) -> DataFrame:
    """`allowed`: among the first `most` of a window that opens at the first event after the last window ended."""
    return _walked(rows, [key], window_rule(most, window_seconds).decide, "allowed")
