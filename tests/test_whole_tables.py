"""Queries that once stood for a range of ids give rows past it, and every row of their table has its part."""

import pytest
from pyspark.sql import functions as F

from basketlens import plans, registry  # noqa: F401
from basketlens.operators.events import accepted_events, windowed_limit
from basketlens.operators.ranking import places


@pytest.mark.parametrize("name,key,past", [("cheaper_alternatives", None, 0), ("price_steps", "product_id", 300), ("json_paths", "event_id", 2000), ("json_items", "event_id", 500), ("object_of_arrays", "event_id", 1000), ("guarded_delete_counts", "product_id", 50), ("expanded_offers", None, 0), ("basket_totals", None, 0)])
def test_whole_table(spark, name, key, past):
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert rows.where(F.col(key) > past).count() > past if key else rows.count() > 300


def test_places_match_one_window(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", None, 2), ("a", 3, 0), ("a", 5, 9), (None, 1, 4), (None, 1, 3)], "k string, level int, i int")
    got = {(r.k, r.i): r.place for r in places(rows, ["k"], "level", [F.asc("i")]).collect()}
    assert got == {("a", 9): 1, ("a", 0): 2, ("a", 1): 3, ("a", 2): 4, (None, 3): 1, (None, 4): 2}


def test_event_walks_over_rows_without_time_or_key(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:00', 1L, 7), ('a', NULL, 2L, 7), ('a', TIMESTAMP'2024-01-01 00:00:01', 3L, 7), (NULL, TIMESTAMP'2024-01-01 00:00:00', 4L, 7), ('', TIMESTAMP'2024-01-01 00:00:00', 5L, 7) AS t(u, ts, event_id, _key)")
    assert sorted((r.event_id, r._key) for r in accepted_events(rows, ["u"], 60).collect()) == [(1, 7), (4, 7), (5, 7)]
    assert {r.event_id: r.allowed for r in windowed_limit(rows, "u", 1, 60).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
