import json

from pyspark.sql import functions as F

from basketlens.functions.text import decode_entities
from basketlens.operators.compare import waterfall
from basketlens.operators.events import windowed_limit
from basketlens.operators.ranking import cap_per_group, interleave
from basketlens.sources.documents import FindItems, FindKeys
from basketlens.sources.paged import PagedSource


def test_paged_source_keeps_failed_pages_apart(spark, tmp_path):
    (tmp_path / "page-1.json").write_text(json.dumps({"items": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "page-2.json").write_text(json.dumps({"items": []}))
    (tmp_path / "page-3.json").write_text("{broken")
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged_json").option("path", str(tmp_path)).option("pages", "3").load().collect()
    assert sorted((r.page, r.status) for r in rows) == [(1, "ok"), (1, "ok"), (2, "empty"), (3, "unknown")]


def test_recursive_search(spark):
    doc = json.dumps({"a": {"barcode": 1, "list": [{"barcode": "x"}, 3]}, "discounts": [{"id": 7, "name": "n"}], "shelf": {"id": 8, "name": "m"}})
    df = spark.createDataFrame([(doc,), (None,), ("{",)], "d string")
    assert sorted((r.path, r.value) for r in df.lateralJoin(FindKeys(F.col("d").outer(), F.lit("barcode"))).collect()) == [("$.a.barcode", "1"), ("$.a.list[0].barcode", "x")]
    assert sorted((r.id, r.on_offer) for r in df.lateralJoin(FindItems(F.col("d").outer())).collect()) == [("7", True), ("8", False)]


def test_interleave(spark):
    rows = [("p1", "p", 1), ("p2", "p", 2), ("p3", "p", 3), ("c1", "c", 4), ("f1", "f", 5), ("p4", "p", 6)]
    df = spark.createDataFrame(rows, "id string, category string, pos int")
    assert [r.id for r in interleave(df, "category", "pos").orderBy("place").collect()] == ["p1", "c1", "f1", "p2", "p3", "p4"]
    assert [r.id for r in cap_per_group(df, "category", "pos", 2, 5).orderBy("place").collect()] == ["p1", "p2", "c1", "f1", "p3"]


def test_waterfall_and_limits(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, sku long")
    by_sku = spark.createDataFrame([(1, 10)], "sku long, product_id long")
    by_name = spark.createDataFrame([("a", 99), ("b", 20)], "name string, product_id long")
    got = {r.name: (r.product_id, r.via) for r in waterfall(rows, [("sku", by_sku, "sku"), ("name", by_name, "name")]).collect()}
    assert got == {"a": (10, "sku"), "b": (20, "name"), "c": (None, None)}
    events = spark.createDataFrame([(i, "s") for i in range(10)], "event_id long, k string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 2))
    allowed = {r.event_id: r.allowed for r in windowed_limit(events, "k", 2, 7).collect()}
    assert [i for i, ok in sorted(allowed.items()) if ok] == [0, 1, 4, 5, 8, 9]
    assert spark.range(1).select(decode_entities(F.lit("&lt;a&gt; &amp;amp;")).alias("x")).first()["x"] == "<a> &amp;"


def test_sitemaps_and_saved_pages(spark, tmp_path):
    import gzip

    from basketlens.sources.html import Elements, links
    from basketlens.sources.sitemap import saved_pages, sitemap_ids

    with gzip.open(tmp_path / "s.xml.gz", "wt") as f:
        f.write("<urlset><url><loc>https://x/c/milk/s123</loc></url><url><loc>https://x/c/b/9</loc></url><url><loc>https://x/p/7</loc></url></urlset>")
    assert sorted(r.id for r in sitemap_ids(spark, str(tmp_path / "s.xml.gz")).collect()) == ["123", "9"]
    (tmp_path / "p.html").write_text('<h1>A <b>b</b> &amp; c</h1><a class="x" href="/m">M</a>')
    pages = saved_pages(spark, str(tmp_path / "p.html"))
    (r,) = pages.select(links(F.col("html")).alias("a")).collect()
    (t,) = pages.lateralJoin(Elements(F.col("html").outer(), F.lit("h1").outer())).collect()
    assert t.text == "A b & c" and [tuple(a) for a in r.a] == [("/m", "M")]


def test_validation(spark):
    from basketlens.functions.validate import extracted_item, local_timestamp

    rows = spark.createDataFrame([(" Milk ", "1,20 €", "1,50", None), ("", "2", None, "x"), ("Tea", "free", None, "x"), ("Oil", "7.5", "5", "")], "name string, price string, original string, category string")
    got = [tuple(r) for r in extracted_item(rows).collect()]
    assert got[0] == ("Milk", 1.2, 1.5, "Άλλο", True) and [g[-1] for g in got] == [True, False, False, True] and got[3][2] is None
    x = spark.range(1).select(local_timestamp(F.lit("31/05/2026 20:59:00")).alias("a"), local_timestamp(F.lit("31/05/2026")).alias("b"), local_timestamp(F.lit("x")).alias("c")).first()
    assert (x.a.hour, x.b.day, x.b.hour, x.c) == (17, 30, 21, None)
