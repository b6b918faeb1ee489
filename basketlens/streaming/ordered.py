"""Stateful streams whose decisions depend on the events before, in event time: click dedupe, cooldowns, rate windows.

An event is decided once the watermark has passed it, when no earlier one can still arrive; until then it waits in its key's
state. So the result is that of the batch operators in `operators.events` for any order of arrival within the watermark, and
a query that starts again from its checkpoint goes on where it was. State lies in the persistent store that `STORE` names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from basketlens.functions.dates import micros
from basketlens.operators.events import Rule, gap_rule, window_rule

#: The setting that `transformWithState` needs, to be made on the session before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Events of a key wait for the watermark, then a rule decides them one by one; its state goes when it no longer matters."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long")
        self.held = handle.getValueState("held", "a long, b long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(e)) for batch in rows for us, e in zip(batch["us"], batch["event_id"], strict=True)]
        self.waiting.appendList(new)
        self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(x) for x in self.waiting.get())
        state = tuple(self.held.get()) if self.held.exists() else None
        out = []
        for us, event_id in events:
            if us <= passed:
                state, ok = self.rule.decide(state, us)
                out.append((event_id, us, ok))
        rest = events[len(out) :]
        if out and rest:
            self.waiting.put(rest)
        elif out:
            self.waiting.clear()
        if state is not None and self.rule.until(state) <= passed and not rest:
            self.held.clear()
        elif state is not None:
            self.held.update(state)
        if rest:
            self._wake(rest[0][0])
        elif state is not None and self.rule.until(state) > passed:
            self._wake(self.rule.until(state))
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "us", "ok"])
            for i, k in enumerate(key):
                frame.insert(i, f"k{i}", k)
            yield frame


def decided(events: DataFrame, keys: Sequence[str], rule: Rule, late: str = "1 day") -> DataFrame:
    """keys, event_id, ts and `ok` of every event (event_id, ts and the keys, which are not null), in append mode.

    Events behind the watermark when they arrive are dropped; `late` bounds how far events may be out of order.
    """
    rows = events.withWatermark("ts", late).select(*keys, "event_id", micros(F.col("ts")).alias("us"), "ts")
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "event_id bigint", "us bigint", "ok boolean"])
    out = rows.groupBy(*keys).transformWithStateInPandas(_InOrder(rule), schema, "append", "EventTime")
    return out.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "event_id", F.timestamp_micros("us").alias("ts"), "ok")


def accepted(events: DataFrame, keys: Sequence[str], gap_seconds: int, late: str = "1 day") -> DataFrame:
    """Events at least the gap after the last accepted one of their key: click dedupe and alert cooldown."""
    return decided(events, keys, gap_rule(gap_seconds), late).where("ok").drop("ok")


def rate_limited(events: DataFrame, key: str, most: int, window_seconds: int, late: str = "1 day") -> DataFrame:
    """`ok`: among the first `most` of a window that opens at the key's first event after the last window ended."""
    return decided(events, [key], window_rule(most, window_seconds), late)


def trailing(events: DataFrame, key: str, days: int = 14, late: str = "1 day") -> DataFrame:
    """Events of each key in the `days` before each midnight, once it has passed: until, key, n."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.end").alias("until"), key, "n")
