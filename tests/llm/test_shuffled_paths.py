"""Beyond the broadcast bound the same results come by shuffled joins."""

import pytest
from pyspark.sql import functions as F

from basketlens.llm import mixing, near_dedup, quality, shared, toxicity
from basketlens.llm.near_dedup import near_duplicates
from basketlens.llm.sharding import shards


@pytest.fixture
def no_broadcast(monkeypatch):
    for module in (mixing, near_dedup, quality, shared, toxicity):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(shared, "FEW_ROWS", -1)


def test_near_duplicates(spark, tiny, request):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(150).cache()
    small = sorted(near_duplicates(docs).collect())
    request.getfixturevalue("no_broadcast")
    assert sorted(near_duplicates(docs).collect()) == small


def test_training_order(spark, tiny, request):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source").cache()
    small = sorted(r.doc_id for r in mixing.training_order(docs).collect())
    request.getfixturevalue("no_broadcast")
    assert sorted(r.doc_id for r in mixing.training_order(docs).collect()) == small


def test_shards(spark, tiny, request):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").cache()
    small = sorted((r.doc_id, r.shard, r.slot) for r in shards(docs).collect())
    request.getfixturevalue("no_broadcast")
    assert sorted((r.doc_id, r.shard, r.slot) for r in shards(docs).collect()) == small


def test_classifiers(spark, request):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.col("doc_id"), F.lit(5)).cast("int")
    one, two = toxicity.train(docs, labels, fold), quality.train(docs, labels, fold != 0, 200)
    request.getfixturevalue("no_broadcast")
    again, more = toxicity.train(docs, labels, fold), quality.train(docs, labels, fold != 0, 200)
    texts = [b"an idiot wrote this", b"plain words", b"!!! ###"]
    assert one.letters.keys() == again.letters.keys() and list(one.pairs) == list(again.pairs) and abs(one.ratios(texts) - again.ratios(texts)).max() < 1e-9
    assert abs(two.scores(texts) - more.scores(texts)).max() < 1e-9
