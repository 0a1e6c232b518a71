"""Product pages to item rows: structured data first, then what the page shows, then discount rules and stock."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import apply_discount, format_price, host_currency, parse_price
from ..functions.stock import availability_status, stock_status
from ..functions.urls import host
from ..shipping import in_pieces, map_arrow
from . import pages as P
from .cards import STOCK_ATTRIBUTES, STOCK_ORDER, Node, tree

Test = Callable[[Node], bool]


def _has(attr: str, start: str = "", part: str = "") -> Test:
    return lambda n: bool(n.attrs.get(attr)) and n.attrs[attr].startswith(start) and part in n.attrs[attr]


def _is(tag: str, css_class: str = "") -> Test:
    return lambda n: (not tag or n.tag == tag) and (not css_class or css_class in n.classes())


# Where a product page shows its price, as (around, at), in the order they are tried.
PRICE_SPOTS: list[tuple[Test | None, Test]] = [
    (_is("span", "price-final_price"), _has("data-price-amount")),
    (_is("span", "price-final_price"), _is("span", "price")),
    (_is("div", "price-box"), _has("data-price-amount")),
    (_is("div", "price-box"), _is("span", "price")),
    (lambda n: n.tag == "span" and _has("id", start="product-price-")(n), _has("data-price-amount")),
    (lambda n: n.tag == "span" and _has("id", start="product-price-")(n), _is("span", "price")),
    (None, _is("span", "price")),
    (None, _has("class", part="price")),
    (None, _has("id", part="price")),
]
# Boxes that hold the main image, and those with the description.
GALLERY = [{"gallery-placeholder"}, {"product", "media"}, {"fotorama"}, {"product-image"}]
DESCRIPTION = {"description", "product-description", "product-short-description"}


def _at(page: Node, around: Test | None, at: Test) -> Iterator[Node]:
    boxes = [page] if around is None else [n for n in page.below() if n.attrs and around(n)]
    seen: set[int] = set()
    for box in boxes:
        for n in box.below():
            if n.attrs and at(n) and id(n) not in seen:
                seen.add(id(n))
                yield n


def _image(box: Node) -> str:
    for attr in ("data-src", "srcset", "src"):
        if image := box.first("img", attr=attr):
            return image.attrs.get("data-src") or image.attrs.get("src") or ""
    return ""


def _stock(page: Node) -> tuple[str, list[str]]:
    """What the page's metadata says, and the texts of its stock elements in the order they are read."""
    said = next((n.attrs.get("content") for n in page.all("meta") if (n.attrs.get("itemprop") == "availability" or n.attrs.get("property") == "product:availability") and n.attrs.get("content")), None)
    link = next((n.attrs["href"] for n in page.all("link", attr="href") if n.attrs.get("itemprop") == "availability"), None)
    spots = [n for a in STOCK_ATTRIBUTES[:3] if (n := page.first(attr=a))]
    named: dict[str, Node] = {}  # the first element of each class
    for n in page.below():
        for c in n.classes():
            named.setdefault(c, n)
    spots += [named[c] for c in STOCK_ORDER if c in named]
    return said or link or "", [t for n in spots for t in [*(n.attrs.get(a) for a in STOCK_ATTRIBUTES), n.text()] if t]


PARTS = "amount string, price_texts array<string>, image string, said string, stock_texts array<string>, description string"


def parts_of(page: Node) -> tuple:
    """What one page's tree has of `PARTS`."""
    amount, box, about = page.first(attr="data-price-amount"), next((n for n in page.all() if any(g <= n.classes() for g in GALLERY)), None), page.first(classes=DESCRIPTION)
    prices = list(dict.fromkeys(n.text() for spot in PRICE_SPOTS for n in _at(page, *spot)))
    return (amount.attrs["data-price-amount"] if amount else "", prices, _image(box or page), *_stock(page), about.text() if about else "")


def page_parts(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with what takes a tag tree to find: raw price, image, stock and description texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for b in in_pieces(batches, 2):
            out = [parts_of(tree(html)) for html in b.column(2).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=["page_id", "url", "html", *(f.split()[0] for f in PARTS.split(", "))])

    some = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_arrow(some, run, "page_id long, url string, html string, " + PARTS)


def product_rows(pages: DataFrame, percent_off: float = 0.0, absolute_off: float = 0.0) -> DataFrame:
    """One item row per product page: url, site, title, prices and their texts, source, image, stock and description."""
    return parts_rows(page_parts(pages), percent_off, absolute_off)


def parts_rows(parts: DataFrame, percent_off: float = 0.0, absolute_off: float = 0.0) -> DataFrame:
    """The item rows of what `page_parts` gives."""
    html, url = F.col("html"), F.col("url")
    first = lambda k: F.get(F.filter(F.transform("named", lambda x: x[k]), lambda v: v.isNotNull() & (v.cast("string") != "")), F.lit(0))
    named = F.transform(P.structured_products(html), P.product_facts)
    told = parts.withColumns({"named": named, "canonical": P.canonical_url(html, url), "shown_title": P.page_title(html)})
    shown = F.coalesce(F.col("amount").try_cast("double"), F.get(F.filter(F.transform("price_texts", parse_price), lambda p: p.isNotNull()), F.lit(0)))
    rows = told.select(
        "page_id", F.col("canonical").alias("url"), host(url).alias("site"), F.coalesce(first("name"), "shown_title").alias("title"),
        F.coalesce(first("price"), shown).alias("price_value"), F.coalesce(F.when(first("price").isNotNull(), first("currency")), host_currency(host(url))).alias("price_currency"),
        F.when(first("price").isNotNull(), "jsonld").when(F.col("amount").try_cast("double").isNotNull(), "data-price-amount").when(shown.isNotNull(), "page").otherwise("product").alias("source"),
        F.col("image").alias("image_url"), "description",
        F.coalesce(first("stock_status"), availability_status(F.nullif("said", F.lit(""))), F.get(F.filter(F.transform("stock_texts", stock_status), lambda s: s.isNotNull()), F.lit(0))).alias("stock_status"),
    )
    cut = apply_discount(F.col("price_value"), F.lit(percent_off), F.lit(absolute_off))
    rows = rows.withColumns({"discounted_value": cut, "price_text": F.when(F.col("price_value").isNull(), "price_not_found_or_hidden").otherwise("")})
    shown_price = lambda c: format_price(F.col(c), F.col("price_currency"), F.col("site"))
    return rows.withColumns({"original_formatted": shown_price("price_value"), "discounted_formatted": shown_price("discounted_value")})
