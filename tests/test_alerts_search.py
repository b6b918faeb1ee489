"""Alerts against all pairs, with many alerts and short keywords; the trigram index against a direct scan."""

import random

import pytest
from pyspark.sql import functions as F

from basketlens.functions.scores import alert_matches, relevance, search_terms
from basketlens.operators.alerts import alert_counts, alert_offers
from basketlens.operators.search import TrigramIndex

WORDS = ["γάλα", "ΓΑΛΑ", "χυμός", "χυμο", "milk", "a", "oil 1l", "ψωμί", "beer", "ένα δύο", "x*y", "  tea "]


def test_alerts_equal_all_pairs(spark):
    rng = random.Random(3)
    offers = spark.createDataFrame([(i, None if i % 31 == 0 else " ".join(rng.sample(WORDS, rng.randint(1, 3))), rng.choice(["A", "B", None]), rng.choice(["c", "d", None]), rng.choice([1.0, 2.5, 9.0])) for i in range(200)], "offer_id long, product_name string, chain string, category string, price double")
    alerts = spark.createDataFrame([(i, rng.choice([*WORDS, "γαλ", "μ", "b", "zzz", "*", "δυο"]), rng.choice([[], ["A"], ["A", "B"]]), rng.choice([None, "", "c"]), rng.choice([None, 2.0, 5.0])) for i in range(300)], "alert long, word string, chains array<string>, cat string, top double")
    match = alert_matches(F.col("word"), F.col("chains"), F.col("cat"), F.col("top"), F.col("product_name"), F.col("chain"), F.col("category"), F.col("price"))
    want = {(r.alert, r.offer_id) for r in alerts.join(offers, match & F.col("product_name").isNotNull()).collect()}
    got = [(r.alert, r.offer_id) for r in alert_offers(offers, alerts).collect()]
    assert set(got) == want and len(got) == len(want) > 1000
    assert alert_offers(offers, alerts.withColumn("word", F.lit(""))).count() == 0 == alert_offers(offers.limit(0), alerts).count()


def test_counts_equal_pairs_and_make_none(spark):
    rng = random.Random(5)
    prices = [1.0, 2.5, 9.0, 0.0, -1.0, None, float("inf"), float("nan"), 1e6]
    offers = spark.createDataFrame([(i, None if i % 31 == 0 else " ".join(rng.sample(WORDS, rng.randint(1, 3))), rng.choice(["A", "B", None]), rng.choice(["c", "d", None]), rng.choice(prices)) for i in range(300)], "offer_id long, product_name string, chain string, category string, price double")
    alerts = spark.createDataFrame([(i % 250, rng.choice([*WORDS, "γαλ", "μ", "b", "zzz", "*", ""]), rng.choice([[], ["A"], ["B", "A"], ["A", "B"], None]), rng.choice([None, "", "c"]), rng.choice([*prices, 2.0, 5.0])) for i in range(400)], "alert long, word string, chains array<string>, cat string, top double")
    want = alert_offers(offers, alerts).groupBy("alert").count().collect()
    got = alert_counts(offers, alerts).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    assert alert_counts(offers.limit(0), alerts).count() == 0 == alert_counts(offers, alerts.limit(0)).count()
    # a billion pairs of one watch: counted, not made
    many = spark.range(40_000).select(F.col("id").alias("offer_id"), F.lit("milk").alias("product_name"), F.lit("A").alias("chain"), F.lit("c").alias("category"), (F.col("id") + 1).cast("double").alias("price"))
    watchers = spark.range(40_000).select(F.col("id").alias("alert"), F.lit("milk").alias("word"), F.array().cast("array<string>").alias("chains"), F.lit("c").alias("cat"), F.col("id").cast("double").alias("top"))
    found = alert_counts(many, watchers)
    assert found.count() == 39_999 and found.where("hits <> alert").count() == 0


def test_names_are_matched_once_and_rare_letters_decide(spark):
    """100,000 alerts over names that share all but a few letters: as many hits as there are, and no more candidates."""
    offers = spark.range(20_000).select(F.col("id").alias("offer_id"), F.concat(F.lit("common name "), F.conv((F.col("id") % 500 + 500_000_000).cast("string"), 10, 36)).alias("product_name"), F.lit("A").alias("chain"), F.lit("c").alias("category"), F.lit(1.0).alias("price"))
    alerts = spark.range(100_000).select(F.col("id").alias("alert"), F.concat(F.lit("name "), F.conv((F.col("id") + 500_000_000).cast("string"), 10, 36)).alias("word"), F.array().cast("array<string>").alias("chains"), F.lit(None).cast("string").alias("cat"), F.lit(None).cast("double").alias("top"))
    assert alert_offers(offers, alerts).count() == 20_000


def test_index_finds_what_a_scan_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    index = TrigramIndex(spark, "test_trigrams", buckets=32)
    index.build(docs, "doc_id", "text")
    try:
        for query in ("réaux", "the", "schließ", "nowhere zz"):
            terms = search_terms(query)
            score = relevance(terms, F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"))
            scan = lambda rows: {(r.doc_id, r.score) for r in rows.select("doc_id", score.alias("score")).where("score > 0").collect()}  # noqa: B023, E731
            near = docs.join(index.candidates(terms).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
            assert scan(near) == scan(docs)
        plan = index.candidates(["réaux"[:1] + "eaux"])._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 3 out of 32" in plan or "SelectedBucketsCount: 2 out of 32" in plan
        with pytest.raises(ValueError):
            index.candidates(["a"])
    finally:
        spark.sql("DROP TABLE test_trigrams")
