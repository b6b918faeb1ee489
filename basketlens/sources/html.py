"""Extraction from saved web pages: a streaming tokenizer with a stack of open elements, selectors, and offer cards.

A page is one row and its tree lives in its task only; what is taken from it becomes rows at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from basketlens.functions.num import half_up
from basketlens.functions.text import parse_euro

# Fixed values of the format: elements without an end, and those that an opening one of the same kind ends.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
SELF_CLOSING = frozenset(("p", "li", "option", "tr", "td", "th", "dt", "dd"))


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def inside(self) -> Iterator[Element]:
        """Elements below this one in the order of the page; no recursion, as pages nest as deep as they like."""
        stack = [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Element):
                    yield part
                    stack.append(iter(part.parts))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out, stack = [], [iter(self.parts)]
        while stack:
            for part in stack[-1]:
                if isinstance(part, Element):
                    stack.append(iter(part.parts))
                    break
                out.append(part)
            else:
                stack.pop()
        return " ".join("".join(out).split())

    def ancestors(self) -> Iterator[Element]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


class _Tree(HTMLParser):
    """Builds the elements; an end without a beginning is left out, a missing end comes with that of its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SELF_CLOSING and self.at.tag == tag:
            self.at = self.at.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.parts.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if self.at.tag == tag or any(a.tag == tag for a in self.at.ancestors()):
            while self.at.tag != tag:
                self.at = self.at.parent
            self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


_TESTS = re.compile(r"\.([\w-]+)|\[([\w-]+)(?:(\*?=)([^\]]*))?\]|([\w-]+)")


def _compound(text: str):
    """Test of one element: tag, .class, [attribute], [attribute=value], [attribute*=part]."""
    tests = _TESTS.findall(text)

    def holds(e: Element) -> bool:
        for cls, attr, op, value, tag in tests:
            if tag and e.tag != tag or cls and cls not in e.attrs.get("class", "").split():
                return False
            if attr and (attr not in e.attrs or op == "=" and e.attrs[attr] != value or op == "*=" and value not in e.attrs[attr]):
                return False
        return True

    return holds


def find(root: Element, selector: str) -> Iterator[Element]:
    """Elements inside root that a selector names; parts with a space between them are ancestors, up to root, and descendant."""
    *above, last = map(_compound, selector.split())
    for e in root.inside():
        if not last(e):
            continue
        need = list(above)
        for a in e.ancestors():
            if a is root or not need:
                break
            if need[-1](a):
                need.pop()
        if not need:
            yield e


def _first(root: Element, selector: str) -> Element | None:
    return next(find(root, selector), None) if selector else None


def _text(root: Element, selector: str) -> str | None:
    e = _first(root, selector)
    return e.text() if e is not None else None


@udtf(returnType="pos int, tag string, attrs map<string,string>, text string")
class Elements:
    """Elements of a page that a selector names, in order, with their attributes and their whole text."""

    def eval(self, html: str, selector: str) -> Iterator[tuple[int, str, dict, str]]:
        if html is not None:
            for i, e in enumerate(find(parse(html), selector)):
                yield i, e.tag, e.attrs, e.text()


@dataclass(frozen=True)
class Layout:
    """Where a shop's pages hold an offer. A card is the element that `sku` names or, with `holds`, its nearest ancestor that
    has an element of each. `json` is an attribute of the card with a JSON object that has at least a name. With `on_offer` a
    card counts if it has such an element (packaged goods) or a pair of labelled prices (weighed goods)."""

    sku: str
    attribute: str
    holds: tuple[str, ...] = ()
    json: str = ""
    name: str = ""
    price: str = ""
    price_attribute: str = ""
    cents: str = ""
    struck: str = ""
    unit: str = ""
    image: str = "img"
    on_offer: str = ""
    labels: str = ""
    before: str = ""
    after: str = ""


# The marks of the shops' pages.
LAYOUTS = {
    "cards": Layout(".product-thumb[data-product-id]", "data-product-id", name="h4 a", price=".price-new", struck=".price-old", unit=".priceperkg"),
    "json": Layout("article[data-google-analytics-item-value]", "data-id", json="data-google-analytics-item-value", price=".teaser-display-price-whole", cents=".teaser-display-price-fraction", struck="span.line-through", on_offer=".selling-unit-row.is-on-offer", labels=".measure-label-wrapper", before="Αρχ. τιμή", after="Τελ. τιμή", image="picture img"),
    "ancestors": Layout("[data-productsku]", "data-productsku", holds=("h4.product__title", ".product_prices"), name="h4.product__title a", price=".product_prices .price", price_attribute="data-price", unit=".priceKil", image=".product__figure img"),
}


def _cards(html: str, layout: Layout) -> Iterator[tuple]:
    root, seen = parse(html), set()
    for mark in find(root, layout.sku):
        card = mark if not layout.holds else next((a for a in mark.ancestors() if a.parent is not None and all(_first(a, h) is not None for h in layout.holds)), None)
        if card is None:
            continue
        data = {}
        if layout.json:
            try:
                data = json.loads(card.attrs[layout.json])
            except ValueError:
                continue
            if not isinstance(data, dict):
                continue
        name = str(data.get("name") or "").strip() if layout.json else _text(card, layout.name)
        sku = mark.attrs.get(layout.attribute) or str(data.get("id") or "")
        if not name or not sku or sku in seen:
            continue
        area, before, after = card, None, None
        if layout.labels:
            for label in find(card, layout.labels):
                text = label.text()
                before, after = (text, after) if layout.before in text else (before, text if layout.after in text else after)
        packed = not layout.on_offer or _first(card, layout.on_offer) is not None
        if layout.on_offer and packed:
            area = _first(card, layout.on_offer)
        elif layout.on_offer and (before is None or after is None):
            continue
        price = _first(area, layout.price)
        shown = price.attrs.get(layout.price_attribute) or price.text() if price is not None else None
        if shown and layout.cents:
            shown = f"{shown},{_text(area, layout.cents) or '00'}"
        image = _first(card, layout.image)
        source = image.attrs.get("src") or image.attrs.get("data-src") if image is not None else None
        seen.add(sku)
        yield sku, name, packed, shown or data.get("price") and str(data["price"]), _text(card, layout.struck), before, after, _text(card, layout.unit), source, data.get("brand") and str(data["brand"]).strip()


@udtf(returnType="sku string, name string, packed boolean, shown string, struck string, before string, after string, unit string, image string, brand string")
class Cards:
    """Offer cards of a page in a layout, the first of each sku; prices as they are written."""

    def eval(self, html: str, layout: str) -> Iterator[tuple]:
        if html is not None and layout in LAYOUTS:
            yield from _cards(html, LAYOUTS[layout])


def card_offers(pages: DataFrame, html: str = "html", layout: str = "layout") -> DataFrame:
    """The pages' other columns with an offer in each row: sku, name, price, original, kind, unit, image, brand.

    A struck price counts if it is greater. Packaged goods of a layout with `on_offer` take over the per cent of the labelled
    pair, or of a struck price of at most three times the price, if it lies between 1 and 95; weighed goods have the pair's
    prices. Cards without a price above 0 are left out. kind: `strikethrough` with an original price, else `mono`.
    """
    other = [c for c in pages.columns if c not in (html, layout)]
    rows = pages.lateralJoin(Cards(F.col(html).outer(), F.col(layout).outer()))
    euro = {c: parse_euro(F.col(c)) for c in ("shown", "struck", "before", "after")}
    rows = rows.withColumns({f"_{c}": v for c, v in euro.items()})
    pair = (F.col("_before") > F.col("_after")) & (F.col("_after") > 0)
    by_share = F.col(layout) == "json"
    price = F.when(F.col("packed"), F.col("_shown")).when(pair, F.col("_after"))
    share = F.when(pair, 1 - F.col("_after") / F.col("_before")).when((F.col("_struck") > F.col("_shown")) & (F.col("_struck") / F.col("_shown") <= 3), 1 - F.col("_shown") / F.col("_struck"))
    from_share = F.when((share > 0.01) & (share < 0.95), half_up(F.col("_shown") / (1 - share), 2))
    original = F.when(~F.col("packed"), F.col("_before")).when(by_share, from_share).when(F.col("_struck") > F.col("_shown"), F.col("_struck"))
    image = F.when(F.col("image").startswith("//"), F.concat(F.lit("https:"), "image")).otherwise(F.col("image"))
    out = rows.select(*other, "sku", "name", price.alias("price"), original.alias("original"), F.nullif("unit", F.lit("")).alias("unit"), image.alias("image"), "brand").where("price > 0")
    return out.withColumn("kind", F.when(F.col("original").isNotNull(), "strikethrough").otherwise("mono"))


def links(html: Column) -> Column:
    """(href, label) of anchors without nested markup, by a pattern on the JVM side: for link lists of very many pages."""
    anchor = r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    return F.zip_with(F.regexp_extract_all(html, F.lit(anchor), F.lit(1)), F.regexp_extract_all(html, F.lit(anchor), F.lit(2)), lambda h, t: F.struct(h.alias("href"), F.trim(t).alias("label")))


def category_path(url: Column, parts: int = 2) -> Column:
    """The first parts of a URL's path as a slug."""
    path = F.filter(F.split(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+/?", ""), r"[?#].*$", ""), "/"), lambda x: x != "")
    return F.array_join(F.slice(path, 1, parts), "/")
