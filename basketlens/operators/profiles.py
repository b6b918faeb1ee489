"""Interest profiles as an ordered fold: decay since the last change, prune, bump, cap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.dates import micros

HALF_LIFE_DAYS, PRUNE, CAP, STILL_DAYS = 14, 0.05, 60, 0.01
DAY_MS = 86_400_000


@dataclass
class Profile:
    """Weights of a session's keys, by kind of key, as of `at`."""

    at: int | None = None
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def decay(self, now: int) -> None:
        """Weights halve in HALF_LIFE_DAYS and go below PRUNE; within STILL_DAYS of the last decay nothing moves, its time included."""
        if self.at is None:
            self.at = now
            return
        days = max(0.0, (now - self.at) / DAY_MS)
        if days >= STILL_DAYS:
            factor = 0.5 ** (days / HALF_LIFE_DAYS)
            self.at = now
            self.weights = {kind: {k: v * factor for k, v in of.items() if v * factor >= PRUNE} for kind, of in self.weights.items()}

    def bump(self, keys: dict[str, str | None], weight: float, now: int) -> None:
        """Add a weight to a key of each kind; of more than CAP keys the greatest stay, of equal ones those known longer."""
        self.decay(now)
        for kind, key in keys.items():
            if key is None:
                continue
            of = self.weights.setdefault(kind, {})
            of[key] = of.get(key, 0.0) + weight
            if len(of) > CAP:
                self.weights[kind] = dict(sorted(of.items(), key=lambda x: -x[1])[:CAP])


def profiles(events: DataFrame, kinds: list[str], now_us: int, key: str = "session_id") -> DataFrame:
    """key, kind, name, weight at `now_us` (microseconds) from events (key, ts, event_id, weight, a column for each kind).

    Events are taken in order of ts, event_id; those without a time or a weight above 0 and null names do nothing, a null key
    is a key like any other. Spark sorts a key's events within a partition and a task holds one profile, of CAP names a kind
    at most, so a key's events are not gathered.
    """
    rows = events.where("ts IS NOT NULL AND weight > 0").select(key, F.floor(micros(F.col("ts")) / 1000).cast("long").alias("_ms"), "event_id", F.col("weight").cast("double").alias("weight"), *(F.col(k).cast("string").alias(k) for k in kinds))
    rows = rows.repartition(key).sortWithinPartitions(key, "_ms", "event_id")
    now, names = now_us // 1000, list(kinds)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, of, profile, schema = False, None, Profile(), None

        def closed() -> list[dict]:
            profile.decay(now)
            return [{key: of, "kind": kind, "name": k, "weight": v} for kind, ks in profile.weights.items() for k, v in ks.items()]

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(key), ("kind", pa.string()), ("name", pa.string()), ("weight", pa.float64())])
            out = []
            for k, ms, weight, *values in zip(*(batch.column(c).to_pylist() for c in (key, "_ms", "weight", *names)), strict=True):
                if not open_ or k != of:
                    out += closed() if open_ else []
                    open_, of, profile = True, k, Profile()
                profile.bump(dict(zip(names, values, strict=True)), weight, ms)
            yield pa.RecordBatch.from_pylist(out, schema)
        if open_:
            yield pa.RecordBatch.from_pylist(closed(), schema)

    return rows.mapInArrow(fold, f"{key} {rows.schema[key].dataType.simpleString()}, kind string, name string, weight double")
