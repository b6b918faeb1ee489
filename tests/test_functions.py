"""Expected values of the column functions, one row of literals each."""

import pytest
from pyspark.sql import functions as F

from basketlens.functions import dates, num, packs, scores, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def L(v):
    return F.lit(v)


@pytest.mark.parametrize(("raw", "want"), [("6*330ML", 6), ("5+1Δώρο", 6), ("SPF50+ 40ml", 1), (None, 1), ("", 1)])
def test_pack_count(spark, raw, want):
    assert one(spark, packs.pack_count(L(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("330ml (9+3 Δώρο)", (12, "gift")), ("6x250ml", (6, "multipack")), ("52τεμ.", (52, "count")), ("(11-16kg.)", None), (None, None)])
def test_parse_pack(spark, raw, want):
    got = one(spark, packs.parse_pack(L(raw).cast("string")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("raw", "price", "want"),
    [("Τυρί 250γρ.", 6.05, ("κιλό", 24.2)), ("6x400g", 6.15, ("κιλό", 2.56)), ("Νερό 1,5lt", 1.61, ("λίτρο", 1.07)), ("750ml", 1.64, ("λίτρο", 2.19)), ("330ml (9+3 Δώρο)", 8.42, ("λίτρο", 2.13)), ("70ΜΕΖ 3,5lt", 10.89, ("μεζούρα", 0.16)), ("x", None, None)],
)
def test_unit_price(spark, raw, price, want):
    got = one(spark, packs.unit_price(L(raw), L(price).cast("double")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("a", "b", "want"), [("500g", "400γρ", True), ("1L", "1000ml", False), ("0,33lt", "330ml", False), ("6 τεμ", "8 τεμ", True), ("x", "1kg", False)])
def test_quantity_conflict(spark, a, b, want):
    assert one(spark, packs.quantity_conflict(L(a), L(b))) is want


@pytest.mark.parametrize(("a", "b", "want"), [("Tea lemon", "Tea strawberry", True), ("cola light", "cola", True), ("LEMON tea", "Λεμόνι tea", False)])
def test_variant_conflict(spark, a, b, want):
    assert one(spark, similarity.variant_conflict(L(a), L(b))) is want


def test_similarity(spark):
    assert one(spark, similarity.name_similarity(L("Γάλα ΔΕΛΤΑ 1lt"), L("γαλα δελτα 1000ml"))) == 1.0
    assert one(spark, similarity.name_similarity(L("abc def"), L(""))) == 0.0
    assert one(spark, similarity.name_similarity(L("kafes ellinikos"), L("καφές ελληνικός"))) == 1 / 3
    assert one(spark, similarity.comparable(L("Φέτα Δωδώνη 400g"), L("ΦΕΤΑ ΔΩΔΩΝΗ 400γρ"))) is True
    assert one(spark, similarity.comparable(L("Φέτα Δωδώνη 400g"), L("ΦΕΤΑ ΔΩΔΩΝΗ 200γρ"))) is False


@pytest.mark.parametrize(
    ("now", "prices", "want"),
    [(6.99, [7.42, 7.2, 6.99, 7.1], "lowest"), (7.2, [6.99, 7.5, 8.0], "good"), (10.0, [6.0, 6.5, 7.0], "high"), (5.0, [0.0, -1.0, float("nan"), 5.0, 6.0, 5.5], "lowest"), (5.0, [5.0, 6.0], None), (5.0, [5.0, 5.0, 5.0], None)],
)
def test_verdict(spark, now, prices, want):
    rows = spark.createDataFrame([(p,) for p in prices], "p double").where(num.is_price(F.col("p")))
    s = rows.agg(F.min("p").alias("a"), F.max("p").alias("b"), F.avg("p").alias("m"), F.count("*").alias("n"))
    assert s.select(scores.verdict(L(now), F.col("a"), F.col("b"), F.col("m"), F.col("n")).alias("v")).first()["v"] == want


def test_folding(spark):
    assert one(spark, scores.alert_fold(L("  ΚΑΦΈΣ "))) == "καφες"
    assert one(spark, text.fold(L("ΚΑΦΈΣ é"), final_sigma=True)) == "καφεσ e"
    assert one(spark, text.to_greek(L("thoupsa1"))) == "θουψα1"
    assert one(spark, text.brand_token(L("  Δέλτα-X γάλα"))) == "δελταx"
    assert one(spark, text.brand_token(L("ab c"))) is None


def test_numbers(spark):
    assert one(spark, num.half_up(L(1.005), 2)) == 1.0
    assert one(spark, num.half_up(L(-2.5))) == -2.0
    assert one(spark, num.string_hash(L("row-a"))) == 108704046
    assert one(spark, num.string_hash(L(""))) == 0
    assert one(spark, num.normalize_barcode(L("15201234567891"))) == "5201234567894"
    assert one(spark, num.normalize_barcode(L("abc"))) is None
    assert one(spark, text.parse_euro(L("1.234,50 €"))) == 1234.5
    assert one(spark, text.parse_euro(L("3.40"))) == 3.4
    assert one(spark, text.ean_hits(L("x5201234567891 5201234567891 99")))[0] == "5201234567891"


def test_search(spark):
    terms = scores.search_terms("γάλα")
    names = {"Γάλα φρέσκο": 100, "γαλακτοκομικά": 0, "Μεγάλα νέα": 0, "γαλαζοπετρα": 70}
    for name, want in names.items():
        assert one(spark, scores.relevance(terms, L(name), L(None).cast("string"), L(None).cast("string"), L(0.0))) == (70 if name.startswith("γαλακ") else want)
    assert one(spark, scores.relevance(scores.search_terms("gala"), L("Μεγάλα νέα"), L(None).cast("string"), L(None).cast("string"), L(0.0))) == 0.0
    assert "γαλα" in scores.search_terms("gala") and scores.search_terms("  ") == []


def test_hot_score(spark):
    def hot(clicks, verdict):
        none = L(None).cast("string")
        return one(spark, scores.hot_score(L("Γάλα"), none, L(10), L(clicks), L(0), L(verdict), L(None).cast("timestamp"), L("2024-01-01").cast("timestamp"), none))

    assert 10 < hot(4, "fair") - hot(0, "fair") < 20
    assert hot(0, "lowest") - hot(0, "high") >= 14


def test_dates(spark):
    at = lambda s: L(s).cast("timestamp")
    assert one(spark, dates.days_left(at("2024-07-01 21:30:00"), at("2024-07-01 20:00:00"))) == 1
    e = one(spark, dates.expiry(at("2024-07-01"), at("2024-07-02 10:00:00"), at("2024-07-01"), L(True), at("2024-07-02 08:00:00")))
    assert (e.urgent, e.chip, e.status) == (True, "Λήγει σήμερα", "Τελειώνει σήμερα")
    e = one(spark, dates.expiry(at(None), at(None), at("2024-07-01"), L(False), at("2024-07-02")))
    assert (e.real, e.status, e.status_sub) == (False, "Σε ισχύ", "ελέγχθηκε 01/07/2024")
    assert str(one(spark, dates.next_sunday_end(at("2024-07-04 10:00:00")))) == "2024-07-07 23:59:59.999000"
    b = one(spark, dates.badge_dates(L("28.12. - 3.1."), at("2024-12-28")))
    assert (b.valid_from.year, b.valid_until.year) == (2024, 2025)


def test_feed_status(spark):
    now = L("2024-01-10 00:00:00").cast("timestamp")
    ago = lambda h: None if h is None else now - F.make_interval(hours=L(h))
    for last, healthy, ok, want in [(None, None, None, "never"), (6, True, 6, "ok"), (36, True, 36, "ok"), (37, True, 37, "stale"), (1, False, None, "stale"), (1, False, 25, "warn")]:
        none = L(None).cast("timestamp")
        got = one(spark, scores.feed_status(ago(last) if last is not None else none, L(healthy).cast("boolean"), ago(ok) if ok is not None else none, L(36), now))
        assert got == want
