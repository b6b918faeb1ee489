import json

import pytest
from pyspark.sql import functions as F

from basketlens.functions.taxonomy import aisle_key, brands_agree, browse_path, classify, Rules
from basketlens.operators.dedupe import dedupe_offers
from basketlens.sources.sinks import alert_messages, json_ld, run_record, sitemap, write_csv, write_json


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(
    ("name", "native", "dept", "via"),
    [("Λακ μαλλιών", None, "Προσωπική Φροντίδα", "name"), ("Μαλακτικό ρούχων", None, "Είδη Καθαρισμού & Σπιτιού", "name"), ("x", "Κάβα", "Κάβα", "native-dept"), ("choCOLAte", None, "Άλλο", "none"), ("NIVEA SUN SPF50", "Κάβα", "Προσωπική Φροντίδα", "override"), ("τίποτα", "Τυριά φέτα", "Τυριά & Αλλαντικά", "native-kw")],
)
def test_classify(spark, name, native, dept, via):
    got = one(spark, classify(L("ab"), L(name), L(native).cast("string"), ))
    assert (got.dept, got.via) == (dept, via)


def test_chain_maps(spark):
    rules = Rules(keywords=(("A", ("αλφα",)),), chains={"ab": {"Παιδικά": "B", "Μικτά": None}})
    assert one(spark, classify(L("ab"), L("αλφα"), L("παιδικα"), rules))[:2] == ("B", "chain")
    assert one(spark, classify(L("ab"), L("αλφα"), L("Μικτά"), rules))[:2] == ("A", "chain-mixed")
    assert one(spark, classify(L("xy"), L("αλφα"), L("Μικτά"), rules))[:2] == ("A", "name")


def test_aisles_and_paths(spark):
    assert one(spark, aisle_key(L("Κάβα"), L("Gin Tonic"))) == "alcohol"
    assert one(spark, aisle_key(L("Κάβα"), L("Νερό 6x1,5"))) == "water"
    assert one(spark, aisle_key(L("Πρωινό & Ροφήματα"), L("Καφές"))) == "coffee"
    assert one(spark, aisle_key(L(None).cast("string"), L("x"))) == "Άλλο"
    assert tuple(one(spark, browse_path(L("Κάβα"), L(None).cast("string"), L("Μπύρα")))) == ("drinks", "alcohol", "beer")
    assert tuple(one(spark, browse_path(L("Πρωινό & Ροφήματα"), L(None).cast("string"), L("Καφές Ελληνικός")))) == ("drinks", "coffee", "greek")
    assert tuple(one(spark, browse_path(L("Είδη Κατοικιδίων"), L("Σκύλος"), L("τροφή")))) == ("pets", "dogs", None)


def test_brands(spark):
    assert one(spark, brands_agree(L("Delta γάλα"), L("ΔΕΛΤΑ milk"))) is True
    assert one(spark, brands_agree(L("Nounou"), L("ΔΕΛΤΑ"))) is False
    assert one(spark, brands_agree(L(""), L("ΔΕΛΤΑ"))) is True


def test_dedupe(spark):
    rows = [("1", 7, "ab", "Γάλα Φρέσκο", 2.0, 1), ("2", 7, "ab", "Γάλα Φρέσκο", 1.8, 2), ("3", 8, "xy", "γάλα φρέσκο", 1.5, 3), ("4", None, "ab", "Τυρί", None, 4), ("5", None, "xy", "Τυρί", 0.9, 5), ("6", 7, "ab", "Γάλα Φρέσκο 500ml", 1.0, 6), ("7", 7, "ab", "Γάλα Φρέσκο 1lt", 3.0, 7)]
    df = spark.createDataFrame(rows, "offer_id string, product_id long, chain string, product_name string, price double, pos int")
    one_chain = [(r.slot, r.id) for r in dedupe_offers(df).orderBy("slot").collect()]
    assert one_chain == [(1, "6"), (3, "3"), (4, "4"), (5, "5"), (7, "7")]
    across = {(r.slot, r.id) for r in dedupe_offers(df, cross_chain=True).collect()}
    assert (4, "5") in across and len(across) == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a@x", "γάλα", 'Γάλα "A", <b>', 1.5), ("a@x", "γάλα", "B", 2.0)], "email string, word string, name string, price double")
    (m,) = alert_messages(df).collect()
    assert m.body == "B: 2.00 €<br>Γάλα &quot;A&quot;, &lt;b&gt;: 1.50 €"
    write_csv(df, str(tmp_path / "c"))
    assert sorted(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).toPandas()["name"]) == ["B", 'Γάλα "A", <b>']
    write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(one(spark, json_ld(L("n"), L(1.5), L(None).cast("string"), L("s"))))["offers"] == {"@type": "Offer", "priceCurrency": "EUR", "price": 1.5, "seller": {"@type": "Organization", "name": "s"}}
    assert sitemap("https://s", spark.range(2), ["", "deals"]).count() == 4
    counts = spark.createDataFrame([(5, None, 1, 0, 0)], "scraped int, matched int, queued int, changes int, deactivated int")
    assert run_record("ab", "web", F.current_timestamp(), F.current_timestamp(), counts, []).first()["matched"] == 0
