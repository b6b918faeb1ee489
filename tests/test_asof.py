"""Neighbours in time and as-of joins against folds, with a key that holds most rows, ties and nulls."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlens.operators import asof
from basketlens.operators.asof import as_of, last_known, neighbour

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp_ntz, n int, v double"


def rows(seed, count):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 8 + ["a", None]), None if rng.random() < 0.02 else DAY + datetime.timedelta(days=rng.randrange(400)), i, rng.choice([1.0, 2.0, 3.0, None])) for i in range(count)]


def in_order(data):
    by = {}
    for r in data:
        by.setdefault(r[0], []).append(r)
    return [sorted(x, key=lambda r: (r[1] is not None, r[1] or DAY, r[2])) for x in by.values()]


@pytest.mark.parametrize("forward", [False, True])
def test_neighbour(spark, forward):
    data = rows(1, 600)
    got = {r.n: r.beside for r in neighbour(spark.createDataFrame(data, SCHEMA), ["k"], F.date_trunc("month", "at"), ["at", "n"], "v", "beside", forward).collect()}
    want = {}
    for group in in_order(data):
        for i, r in enumerate(group):
            j = i + 1 if forward else i - 1
            want[r[2]] = group[j][3] if 0 <= j < len(group) else None
    assert got == want


def test_last_known(spark):
    data = rows(2, 600)
    got = {r.n: r.last for r in last_known(spark.createDataFrame(data, SCHEMA), ["k"], F.date_trunc("month", "at"), ["at", "n"], "v", "last").collect()}
    want = {}
    for group in in_order(data):
        held = None
        for r in group:
            held = r[3] if r[3] is not None else held
            want[r[2]] = held
    assert got == want


@pytest.mark.parametrize("strict", [True, False])
def test_as_of(spark, strict):
    left, right = rows(3, 300), rows(4, 300)
    got = {r.n: r.v_as_of for r in as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], "at", "v", ["n"], strict=strict).collect()}
    want = {}
    for k, at, n, _ in left:
        seen = [(a, m, v) for j, a, m, v in right if j == k and at is not None and a is not None and v is not None and (a < at or (not strict and a == at))]
        want[n] = max(seen)[2] if seen else None
    assert got == want and len(got) == 300


def test_a_hot_key_is_dealt_over_its_months(spark):
    """One key with all rows: no window of rows is over the key alone."""
    data = [("hot", DAY + datetime.timedelta(days=i % 700), i, 1.0) for i in range(2000)]
    df = neighbour(spark.createDataFrame(data, SCHEMA), ["k"], F.date_trunc("month", "at"), ["at", "n"], "v", "beside")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_n_slice" in w.split("], [")[1] for w in windows) == 1
    assert df.groupBy(F.date_trunc("month", "at")).count().agg(F.max("count")).collect()[0][0] <= 93


@pytest.mark.parametrize("hot", [0, 250, 10**6])
def test_hot_and_other_keys_agree_with_one_window(spark, monkeypatch, hot):
    """All keys sliced, the hot one alone, or none: the same values, and the rows are shuffled once."""
    monkeypatch.setattr(asof, "HOT", hot)
    df = spark.createDataFrame(rows(6, 500), SCHEMA)
    whole = Window.partitionBy("k").orderBy("at", "n")
    want = df.select("n", F.lag("v").over(whole), F.lead("v").over(whole), F.last("v", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))).collect()
    month, order = F.date_trunc("month", "at"), ["at", "n"]
    made = neighbour(df, ["k"], month, order, "v", "a"), neighbour(df, ["k"], month, order, "v", "b", forward=True), last_known(df, ["k"], month, order, "v", "c")
    got = [{r["n"]: r[name] for r in one.collect()} for one, name in zip(made, "abc", strict=True)]
    assert all((got[0][n], got[1][n], got[2][n]) == tuple(values) for n, *values in want) and {len(g) for g in got} == {500}
    for one in made:  # the rows; edges of hot keys by slice and key; counts of buckets, once in each of two branches
        assert one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("SortMergeJoin") == 0
