import pytest
from pyspark.sql import functions as F

from basketlens.operators.offer_run import Catalog, run_offers

ITEM = "pos int, sku string, barcode string, name string, price double, original double, kind string, native string"
STORED = "chain string, source string, sku string, name string, price double, original double, percent int, kind string, category string, via string, product_id long, active boolean, updated_at timestamp"
def now():
    return F.lit("2024-05-02 00:00:00").cast("timestamp")



@pytest.fixture(scope="module")
def catalog(spark):
    return Catalog(
        spark.createDataFrame([("a", 1)], "sku string, product_id long"),
        spark.createDataFrame([("5201234567894", 2)], "barcode string, product_id long"),
        spark.createDataFrame([("φέτα", 1), ("ψωμί", 4)], "name string, product_id long"),
    )


def stored(spark, n=0):
    import datetime

    at = datetime.datetime(2024, 5, 1)
    rows = [("ab", "web", "a", "γάλα", 2.0, None, None, "mono", "x", "sku", 1, True, at), ("ab", "web", "old", "τσάι", 1.0, None, None, "mono", "x", None, None, True, at), ("xy", "web", "a", "άλλο", 9.0, None, None, "mono", "x", None, None, True, at)]
    rows += [("ab", "web", f"s{i}", "n", 1.0, None, None, "mono", "x", None, None, True, at) for i in range(n)]
    return spark.createDataFrame(rows, STORED)


ITEMS = [(1, "a", None, "γάλα", 1.5, 2.5, "percentage", None), (2, "b", "15201234567891", "τυρί φέτα", 3.0, None, None, None), (3, "c", None, "φέτα", 4.0, None, "super", None), (4, "d", None, "άγνωστο", 5.0, None, None, None), (5, "e", None, " ", 5.0, None, None, None), (6, "d", None, "άγνωστο", 4.5, None, None, None), (7, "f", None, "κακό", float("nan"), None, None, None)]


def test_run(spark, catalog):
    r = run_offers(spark.createDataFrame(ITEMS, ITEM), stored(spark), catalog, "ab", "web", now())
    offers = {(x.chain, x.sku): x for x in r.offers.collect()}
    assert {k: v.active for k, v in offers.items()} == {("ab", "a"): True, ("ab", "b"): True, ("ab", "c"): True, ("ab", "d"): True, ("ab", "old"): False, ("xy", "a"): True}
    a = offers["ab", "a"]
    assert (a.price, a.percent, a.kind, a.category, a.product_id, a.via) == (1.5, 40, "strikethrough", "Γαλακτοκομικά & Είδη Ψυγείου", 1, "sku")
    assert (offers["ab", "b"].product_id, offers["ab", "b"].via) == (2, "barcode")
    assert (offers["ab", "c"].product_id, offers["ab", "c"].via) == (None, "name")  # product 1 is owned by the first item
    assert [(x.sku, x.price) for x in r.snapshots.orderBy("sku").collect()] == [("a", 1.5), ("b", 3.0), ("c", 4.0), ("d", 4.5)]
    assert [x.name for x in r.pending.collect()] == ["άγνωστο"]
    assert sorted(x.sku for x in r.alertable.collect()) == ["a", "b", "c", "d"]
    assert (r.log.first().scraped, r.log.first().healthy) == (4, True)


def test_poor_runs_deactivate_nothing(spark, catalog):
    items = spark.createDataFrame(ITEMS, ITEM)
    poor = run_offers(items, stored(spark, 40), catalog, "ab", "web", now())
    assert not poor.log.first().healthy and poor.offers.where("not active").count() == 0
    assert run_offers(items, stored(spark), catalog, "ab", "web", now(), partial=True).offers.where("not active").count() == 0
    empty = run_offers(items.limit(0), stored(spark), catalog, "ab", "web", now())
    assert empty.offers.count() == 3 and not empty.log.first().healthy
