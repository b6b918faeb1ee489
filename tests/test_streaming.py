"""Streams give what the batch operators give, whatever the order of files, and go on from their checkpoints."""

import random

import pytest
from pyspark.sql import functions as F

from basketlens.bindings import EVENTS_NOW, clicks
from basketlens.operators.events import accepted_events, windowed_limit
from basketlens.plans.activity import popularity, trailing_counts
from basketlens.streaming.events import daily_stream, event_stream, popularity_stream
from basketlens.streaming.merge_log import MergeLog, change_stream, gated_stream, send_once, upsert_stream
from basketlens.streaming.ordered import STORE, accepted, rate_limited, trailing

SF = "/root/testdata/sf0.001"
LATE = "60 days"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set(*STORE)
    yield
    spark.conf.unset(STORE[0])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events in three files, shuffled over them, and an event far ahead, behind which the watermark passes all others."""
    out = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SF}/events.parquet").toPandas().sample(frac=1, random_state=3)
    for k in range(3):
        rows.iloc[k::3].to_parquet(out / f"{k}.parquet", coerce_timestamps="us")
    ahead = rows.iloc[:1].assign(event_id=-1, user_id=-1, ts=rows.ts.max() + (rows.ts.max() - rows.ts.min()) * 10)
    ahead.to_parquet(out / "9.parquet", coerce_timestamps="us")
    return str(out)


def drain(df, name, mode, tmp_path, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


def test_popularity(spark, folder, tmp_path):
    got = drain(popularity_stream(event_stream(spark, folder).where("event_id >= 0")), "pop", "complete", tmp_path, spark)
    assert sorted(got.collect()) == sorted(popularity(spark, SF).collect())


def test_daily_windows_close_behind_the_watermark(spark, folder, tmp_path):
    got = {(r.day, r.event_type): r.n for r in drain(daily_stream(event_stream(spark, folder), LATE), "days", "append", tmp_path, spark).collect()}
    e = spark.read.parquet(f"{SF}/events.parquet").collect()
    assert got and all(n == sum(x.ts.date() == d.date() and x.event_type == t for x in e) for (d, t), n in got.items())


def test_accepted_and_rate_limited_equal_batch_in_any_order(spark, folder, tmp_path):
    stream = event_stream(spark, folder)
    got = drain(accepted(stream, ["session_id", "event_type"], 86_400, LATE), "acc", "append", tmp_path, spark)
    want = accepted_events(clicks(spark, SF), ["session_id", "event_type"], 86_400)
    assert sorted(r.event_id for r in got.collect() if r.event_id >= 0) == sorted(r.event_id for r in want.collect())
    got = drain(rate_limited(stream, "session_id", 2, 5 * 86_400, LATE), "rate", "append", tmp_path, spark)
    want = windowed_limit(clicks(spark, SF), "session_id", 2, 5 * 86_400)
    assert {(r.event_id, r.ok) for r in got.collect() if r.event_id >= 0} == {(r.event_id, r.allowed) for r in want.collect()}


def test_cooldown_goes_on_from_its_checkpoint(spark, folder, tmp_path):
    """Stopped after each file and started again."""
    import os
    import shutil

    into = tmp_path / "in"
    into.mkdir()
    seen = []
    for name in sorted(os.listdir(folder)):
        if not name.endswith(".parquet"):
            continue
        shutil.copy(f"{folder}/{name}", into / name)
        fired = accepted(event_stream(spark, str(into)).where("product_id is not null"), ["product_id"], 6 * 3600, LATE)
        q = send_once(fired, str(tmp_path / "marks"), lambda df: seen.extend(r.event_id for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    want = accepted_events(clicks(spark, SF).where("product_id is not null"), ["product_id"], 6 * 3600)
    assert sorted(e for e in seen if e >= 0) == sorted(r.event_id for r in want.collect())


def test_trailing_counts(spark, folder, tmp_path):
    got = drain(trailing(event_stream(spark, folder), "product_id", late=LATE), "trail", "append", tmp_path, spark)
    before = clicks(spark, SF).where(F.col("ts") < F.lit(EVENTS_NOW).cast("timestamp_ntz"))
    want = before.where(F.col("ts") >= F.lit(EVENTS_NOW).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS")).groupBy("product_id").count()
    assert {(r.product_id, r.n) for r in got.where(F.col("until") == F.lit(EVENTS_NOW).cast("timestamp")).collect()} == {tuple(r) for r in want.collect()}
    assert trailing_counts(spark, SF).count() >= want.count()


def test_upserts_merge_compact_and_replay(spark, folder, tmp_path):
    log = MergeLog(spark, str(tmp_path / "state"), "session_id long, product_id long, event_id long, event_type string, ts timestamp", ["session_id", "product_id"], "event_id", buckets=4, every=2)
    rows = event_stream(spark, folder).where("event_id >= 0").select("session_id", "product_id", "event_id", "event_type", "ts")
    upsert_stream(rows, log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(240)
    want = {}
    for r in clicks(spark, SF).collect():
        want[r.session_id, r.product_id] = max(want.get((r.session_id, r.product_id), -1), r.event_id)
    state = lambda: {(r.session_id, r.product_id): r.event_id for r in log.read().collect()}
    assert state() == want and log._complete("base", "upto")
    last = log._complete("log", "batch")[-1]
    log.append(log._read("log", "batch", last).drop("bucket", "_batch"), last)
    assert state() == want
    (tmp_path / "state" / "log" / "batch=90" / "bucket=0").mkdir(parents=True)  # a write that failed
    assert state() == want
    some = spark.createDataFrame([next(iter(want))], "session_id long, product_id long")
    assert [r.event_id for r in log.read(near=some).collect()] == [next(iter(want.values()))]


def batches(spark, parts, schema, tmp_path):
    """A stream with one batch for each part."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed" / f"n={i}"))
    names = [str(tmp_path / "feed" / f"n={i}") for i in range(len(parts))]
    return [spark.read.parquet(n) for n in names]


def run_batches(writer, parts):
    """What foreachBatch does, each batch twice, as after a failure."""
    for number, batch in enumerate(parts):
        writer(batch, number)
        writer(batch, number)


class _Captured:
    """Takes the function that a writer gives to foreachBatch."""

    def __init__(self):
        self.writeStream = self

    def foreachBatch(self, f):
        return f


def test_changes_equal_a_fold_and_replay_changes_nothing(spark, tmp_path):
    rng = random.Random(7)
    parts = [[(rng.randrange(8), 10 * b + i, rng.choice([1.0, 2.0, None])) for i in range(10)] for b in range(5)]
    log = MergeLog(spark, str(tmp_path / "prices"), "product_id long, at long, price double", ["product_id"], "at", buckets=3, every=3)
    changes = MergeLog(spark, str(tmp_path / "changes"), "product_id long, at long, price double, before double", ["product_id", "at"], "at", buckets=3, every=3)
    run_batches(change_stream(_Captured(), log, "price", changes), batches(spark, parts, "product_id long, at long, price double", tmp_path))
    held, want = {}, set()
    for part in parts:
        newest = {}
        for p, at, price in part:
            newest[p] = max(newest.get(p, (-1, None)), (at, price), key=lambda x: x[0])
        for p, (at, price) in newest.items():
            if held.get(p, (0, None))[1] != price:
                want.add((p, at, price, held.get(p, (0, None))[1]))
            held[p] = (at, price)
    assert {tuple(r) for r in changes.read().select("product_id", "at", "price", "before").collect()} == want
    assert {(r.product_id, (r.at, r.price)) for r in log.read().collect()} == set(held.items())


def test_gate_sees_the_whole_run(spark, tmp_path):
    rows = lambda run, keys: [("f", k, run, "row") for k in keys]
    parts = [
        [*rows(1, range(40)), ("f", None, 1, "end")],
        rows(2, range(15)),
        [*rows(2, range(15, 30)), ("f", None, 2, "end")],  # 30 of 40, over two batches: 10 go
        [*rows(3, range(5)), ("f", None, 3, "end")],  # 5 of 30: not healthy
        [*rows(4, range(20)), ("f", None, 4, "end"), ("f", None, 4, "partial")],
        [("f", None, 5, "end")],  # saw nothing
    ]
    log = MergeLog(spark, str(tmp_path / "offers"), "feed string, k long, run long, active boolean", ["feed", "k"], "run", buckets=2, every=3)
    seen = MergeLog(spark, str(tmp_path / "seen"), "feed string, k long, run long, batch long", ["feed", "k", "run"], "batch", buckets=2, every=3)
    writer = gated_stream(_Captured(), log, seen, "feed", "run")
    active = []
    for number, batch in enumerate(batches(spark, parts, "feed string, k long, run long, kind string", tmp_path)):
        writer(batch, number)
        writer(batch, number)
        active.append(sorted(r.k for r in log.read().where("active").collect()))
    assert active == [list(range(40)), list(range(40)), *[list(range(30))] * 4]
