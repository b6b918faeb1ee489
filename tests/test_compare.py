"""Overlap and comparable joins against all pairs, with hot tokens and names of variants and quantities."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketlens import plans, registry  # noqa: F401
from basketlens.functions.similarity import comparable
from basketlens.operators import compare
from basketlens.operators.compare import _Overlaps, comparable_pairs, overlaps_of, top_overlaps


def token_rows(seed, n, words=40, longest=7):
    """Token lists with a few very common words, repeated lists, repeated words, and empty and null lists."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        size = rng.randint(0, longest)
        row = [f"w{min(int(rng.expovariate(0.12)), words)}" for _ in range(size)]
        rows.append((i, None if i % 37 == 36 else rng.choice(rows)[1] if rows and rng.random() < 0.3 else row))
    return rows


def tables(spark, left, right):
    return spark.createDataFrame(left, "l long, tokens array<string>"), spark.createDataFrame(right, "r long, tokens array<string>")


def score(a, b):
    return sum(n for t, n in Counter(a).items() if t in set(b))


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_overlaps_equal_all_pairs(spark, k):
    left, right = token_rows(1, 60), token_rows(2, 400)
    want = set()
    for i, a in left:
        hits = sorted(((-score(a, b), j) for j, b in right if a and b and score(a, b)), key=lambda x: x)
        want |= {(i, j, -s) for s, j in hits[:k]}
    got = top_overlaps(*tables(spark, left, right), "l", "r", k)
    assert {tuple(r) for r in got.select("l", "r", "score").collect()} == want
    assert top_overlaps(*tables(spark, left, []), "l", "r", k).count() == 0 == top_overlaps(*tables(spark, [], right), "l", "r", k).count()


def test_common_tokens_are_not_paired_where_a_rare_one_decides(spark):
    """Every row shares the hot token; rows that share the rare one fill the k places, so only their sets are scored."""
    right = [(i, ["hot", f"r{i % 500}", f"s{i}"]) for i in range(4000)]
    left = [(i, ["hot", f"r{i}"]) for i in range(50)]
    a, b = tables(spark, left, right)
    made = []
    scored = _Overlaps.scored
    _Overlaps.scored = lambda self, hits: made.append(hits) or scored(self, hits)
    try:
        got = top_overlaps(a, b, "l", "r", 3).collect()
    finally:
        _Overlaps.scored = scored
    assert {(r.l, r.r, r.score) for r in got} == {(i, i + 500 * j, 2) for i in range(50) for j in range(3)}
    assert sum(h.select("l", "_set").distinct().count() for h in made) == 50 * 8  # of 200,000 pairs that share a token


def test_long_rows_are_shuffled_as_short_lists(spark, monkeypatch):
    """Of right rows only tokens of the left side are kept, as numbers; with a left side too large to send, the same rows come by shuffles."""
    left, right = [(i, [f"word{i}", "common", "common"]) for i in range(20)], [(i, [f"word{i % 40}", "common", *(f"other{i}x{j}" for j in range(300))]) for i in range(120)]
    a, b = tables(spark, left, right)
    sides = _Overlaps(a, b, "l", "r")
    assert dict(sides.sets.dtypes)["_tokens"] == "array<int>" and sides.sets.agg(F.max(F.size("_tokens"))).collect()[0][0] == 2
    want = {(i, j, 3) for i in range(20) for j in (i, i + 40, i + 80)}
    for sent in (compare.SENT, -1):
        monkeypatch.setattr(compare, "SENT", sent)
        assert {tuple(r) for r in top_overlaps(a, b, "l", "r", 3).select("l", "r", "score").collect()} == want


@pytest.mark.parametrize("floor", [0.3, 0.6, 1.0])
def test_overlaps_of_equal_all_pairs(spark, floor):
    left, right = token_rows(3, 50), token_rows(4, 200)
    want = {(i, j) for i, a in left for j, b in right if a and b and score(a, b) / min(len(a), len(b)) >= floor}
    got = overlaps_of(*tables(spark, left, right), "l", "r", floor).collect()
    assert {(r.l, r.r) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        overlaps_of(*tables(spark, left, right), "l", "r", 0)


def name_rows(seed, n):
    rng = random.Random(seed)
    words = ["γαλα", "ΓΑΛΑ", "gala", "φρεσκο", "φρεσκος", "χυμος", "χυμό", "juice", "lemon", "λεμόνι", "πορτοκαλ", "σοκολατα", "light", "zero", "ελαφρυ", "ψωμι", "psomi", "τυρι", "φετα", "feta", "oil", "olive"]
    sizes = ["", "", "500g", "500 γρ", "1kg", "1000g", "330ml", "6x330ml", "1l", "12 τεμ", "1,5lt"]
    brands = ["Brand#12", "ΦΑΓΕ", "fage", ""]
    return [(rng.choice(["x", "y", None]), " ".join([*rng.sample(words, rng.randint(1, 4)), rng.choice(sizes), rng.choice(brands)]).strip()) for _ in range(n)] + [("x", None), ("y", ""), ("y", "  ")]


def test_comparable_pairs_equal_all_pairs(spark):
    rows = spark.createDataFrame(name_rows(5, 400), "block string, name string")
    a, b = (rows.distinct().select("block", F.col("name").alias(x)) for x in "ab")
    want = {tuple(r) for r in a.join(b, "block").where("a < b").where(comparable(F.col("a"), F.col("b"))).collect()}
    got = [tuple(r) for r in comparable_pairs(rows, "block", "name").select("block", "a", "b").collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_a_block_of_one_common_word_is_not_squared(spark):
    """3,000 names of one block share a brand and nothing else: no pair of them is made."""
    words = ["".join(chr(ord("a") + (i // 26**k) % 26) for k in range(3)) for i in range(26**3)]
    names = spark.createDataFrame([("x", f"{words[(7 * i) % 17576]}{i} {words[(11 * i + 5) % 17576]}{i} fage") for i in range(3000)], "block string, name string")
    plan = comparable_pairs(names, "block", "name")
    assert plan.count() == 0


def test_audit_reads_a_name_once(spark, tmp_path):
    """300,000 products of three names: three names are folded and six pairs compared, not one for each product."""
    part = spark.range(300_000).select(F.col("id").alias("p_partkey"), F.element_at(F.array(F.lit("old bolt"), F.lit("old boltz"), F.lit("red gear")), (F.col("id") % 3 + 1).cast("int")).alias("p_name"), F.lit("PROMO").alias("p_type"), F.lit("b").alias("p_brand"), F.when(F.col("id") % 7 > 0, (F.col("id") % 2).cast("int")).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    started = time.monotonic()
    got = {(r.place, r.band): r["count"] for r in registry.QUERIES["mapping_audit"](spark, str(tmp_path)).groupBy((F.col("product_id") % 3).alias("place"), "band").count().collect()}
    assert time.monotonic() - started < 60  # row by row, 20,000 products took 14.6 s in one task
    assert sum(got.values()) == 299_999 and {(p, b) for p, b in got} == {(0, "OK"), (0, "PACK"), (1, "BAD"), (2, "BAD")}
