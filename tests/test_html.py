"""The tokenizer, selectors and cards on small pages, and on all saved pages against a plain reading."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from basketlens import plans, registry  # noqa: F401
from basketlens.sources.html import Elements, card_offers, find, parse

SF = "/root/testdata/sf0.01"


def texts(html, selector):
    return [e.text() for e in find(parse(html), selector)]


@pytest.mark.parametrize(
    "html, selector, want",
    [
        ("<p>a<p>b</p>c", "p", ["a", "b"]),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", "li", ["1", "23", "3"]),
        ("<div class='x y'><b>k</b></div><b>n</b>", ".x b", ["k"]),
        ("<a><b><i>1</i></b></a><b><i>2</i></b>", "a b i", ["1"]),
        ("<i data-k='v1'>1</i><i data-k=v2>2</i><i>3</i>", "i[data-k]", ["1", "2"]),
        ("<i data-k='v1'>1</i><i data-k=v2>2</i>", "[data-k=v2]", ["2"]),
        ("<i class='big-badge'>1</i><i class=label>2</i>", "[class*=badge]", ["1"]),
        ("<script>var x='<p>no</p>';</script><p>yes &amp; no &#233;</p>", "p", ["yes & no é"]),
        ("</b></p>x<br>y<img src=a>z<p>q", "p", ["q"]),
        ("", "p", []),
        ("<!-- <p>no</p> --><P CLASS=A>yes", "p.A", ["yes"]),
        ("no tags", "p", []),
    ],
)
def test_selectors(html, selector, want):
    assert texts(html, selector) == want


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "<p>y</p>"
    assert texts(deep, "p") == ["y"] and len(list(find(parse(deep), "div"))) == 20_000
    assert len(texts("<p>a</p>" * 50_000, "p")) == 50_000


def test_all_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: re.sub(r"(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", r.html) for r in pages.collect()}
    hrefs, labels = {}, {}
    for r in pages.lateralJoin(Elements(F.col("html").outer(), F.lit("nav a[href]").outer())).orderBy("page_id", "pos").collect():
        hrefs.setdefault(r.page_id, []).append(r.attrs["href"])
        labels.setdefault(r.page_id, []).append(r.text)
    for i, html in rows.items():
        nav = re.search(r"(?s)<nav>(.*?)</nav>", html)[1]
        assert hrefs[i] == [h.replace("&amp;", "&") for h in re.findall(r'<a href="([^"]*)"', nav)]
        assert labels[i] == [" ".join(x.replace("&quot;", '"').replace("&amp;", "&").split()) for x in re.findall(r"<a[^>]*>([^<]*)</a>", nav)]
    assert len(hrefs) == len(rows)


JSON = "{&quot;id&quot;: 5, &quot;name&quot;: &quot; Φέτα &quot;, &quot;price&quot;: &quot;3.5&quot;, &quot;brand&quot;: &quot;B&quot;}"
ROW = '<div class="selling-unit-row is-on-offer"><i class="teaser-display-price-whole">2</i><i class="teaser-display-price-fraction">40</i></div>'
PAIR = '<p class="measure-label-wrapper">Αρχ. τιμή 10,00</p><p class="measure-label-wrapper">Τελ. τιμή 8,00</p>'
article = lambda inside, data=JSON: f'<article data-google-analytics-item-value="{data}">{inside}</article>'
card = lambda sku, inside: f'<div class="product-thumb" data-product-id="{sku}"><h4><a>N {sku}</a></h4>{inside}</div>'

CASES = [
    ("cards", card("1", '<b class="price-new">1.234,50 €</b><b class="price-old">1.300,00 €</b><i class="priceperkg"> 2 €/kg</i><img src="//i/a.jpg">'), [("1", "N 1", 1234.5, 1300.0, "strikethrough", "2 €/kg", "https://i/a.jpg")]),
    ("cards", card("1", '<b class="price-new">2,00</b><b class="price-old">1,50</b>'), [("1", "N 1", 2.0, None, "mono", None, None)]),
    ("cards", card("1", '<b class="price-new">2,00</b>') + card("1", '<b class="price-new">3,00</b>') + card("2", '<b class="price-new">free</b>') + card("", '<b class="price-new">1</b>'), [("1", "N 1", 2.0, None, "mono", None, None)]),
    ("json", article(ROW + PAIR), [("5", "Φέτα", 2.4, 3.0, "strikethrough", None, None)]),
    ("json", article(ROW + '<span class="line-through">3,00 €</span>'), [("5", "Φέτα", 2.4, 3.0, "strikethrough", None, None)]),
    ("json", article(ROW + '<span class="line-through">30,00 €</span>'), [("5", "Φέτα", 2.4, None, "mono", None, None)]),
    ("json", article(PAIR), [("5", "Φέτα", 8.0, 10.0, "strikethrough", None, None)]),
    ("json", article('<p class="measure-label-wrapper">Τελ. τιμή 8,00</p>') + article(ROW, "{broken") + article(ROW, "[1]") + article(ROW, "{&quot;id&quot;: 1}"), []),
    ("json", article('<div class="selling-unit-row is-on-offer"></div>'), [("5", "Φέτα", 3.5, None, "mono", None, None)]),
    ("ancestors", '<li><h4 class="product__title"><a>T</a></h4><div class="product_prices"><i class="price" data-price="1,10">x</i></div><div><div><b data-productsku="k"></b></div></div></li>', [("k", "T", 1.1, None, "mono", None, None)]),
    ("ancestors", '<div><h4 class="product__title"><a>A</a></h4></div><b data-productsku="k"></b>', []),
    ("unknown", card("1", '<b class="price-new">2,00</b>'), []),
    ("cards", None, []),
]


def test_cards_of_all_layouts(spark):
    pages = spark.createDataFrame([(i, layout, html) for i, (layout, html, _) in enumerate(CASES)], "n int, layout string, html string")
    got = {}
    for r in card_offers(pages).collect():
        got.setdefault(r.n, []).append((r.sku, r.name, r.price, r.original, r.kind, r.unit, r.image))
    for i, (_, _, want) in enumerate(CASES):
        assert got.get(i, []) == want, i
    assert card_offers(pages.limit(0)).count() == 0


def test_headings_are_the_sql_ones(spark, tmp_path):
    """Cut-off references, other references, spaces, headings outside articles, with attributes, markup or capitals, and in comments."""
    html = ["<article><h1> a &amp;&amp</h1></article>", "<h1>b  c\n&amp;lt; &lt;&#39; &copy &copy; &quot;&middot;</h1><h1></h1>", "<H1>d</H1><h1 class=x>e</h1><h1>f<b>g</b></h1>", "<!-- <h1>h</h1> --><h1>\ti </h1>", "<h1>j", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["page_headings"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["page_headings"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 5
