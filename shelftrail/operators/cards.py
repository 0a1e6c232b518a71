"""Listing cards and product prices from saved pages: the rules that need a tree, one pass per page in `mapInArrow`."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import apply_discount, parse_price
from ..functions.stock import stock_status
from ..shipping import in_pieces, map_arrow

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag of these ends an open one of its group, if nothing of the second group was opened since.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}
#: A paragraph ends where one of these begins.
BLOCKS = {"p", "div", "ul", "ol", "li", "table", "form", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "pre", "blockquote"}
# Classes and attributes in which shops keep the stock text, in the order they are read.
STOCK_ORDER = [
    "stock-status", "stock", "availability", "product-stock", "stock-status-label", "stock-label", "stock-message", "stock-info", "inventory-status",
    "availability-value", "availability-indicator", "availability-message", "item-stock", "stock-qty", "qty-status", "qty-indicator",
]
STOCK_CLASSES = set(STOCK_ORDER)
STOCK_ATTRIBUTES = ["data-stock-status", "data-stock", "data-availability", "data-in-stock", "data-instock", "aria-label", "title", "data-original-title"]


class Page:
    """A page's elements and texts in document order. What stands below an element is one run of each."""

    __slots__ = ("nodes", "texts", "owners")

    def __init__(self):
        self.nodes: list[Node] = []
        self.texts: list[str] = []
        self.owners: list[Node] = []  # of each text, the element that it stands in


@lru_cache(4096)
def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


class Node:
    """`at` and `end`: the places of the element and of the first one behind it; `text_at` and `text_end` those of its texts."""

    __slots__ = ("tag", "attrs", "parent", "page", "at", "end", "text_at", "text_end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, page: Page, at: int, text_at: int):
        self.tag, self.attrs, self.parent, self.page = tag, attrs, parent, page
        self.at, self.end, self.text_at, self.text_end = at, at + 1, text_at, text_at

    def below(self) -> list[Node]:
        """Every element below, in document order."""
        return self.page.nodes[self.at + 1 : self.end]

    def text(self) -> str:
        return " ".join(" ".join(self.page.texts[self.text_at : self.text_end]).split())

    def classes(self) -> frozenset[str]:
        return _names(self.attrs.get("class", ""))

    def all(self, tag: str = "", classes: set[str] | None = None, attr: str = "") -> Iterator[Node]:
        for x in self.below():
            if (not tag or x.tag == tag) and (not attr or x.attrs.get(attr)) and (not classes or "class" in x.attrs and not classes.isdisjoint(x.classes())):
                yield x

    def first(self, tag: str = "", classes: set[str] | None = None, attr: str = "") -> Node | None:
        return next(self.all(tag, classes, attr), None)


#: Markup in which nothing is left to a parser's discretion: texts, end tags, start tags with quoted values without entities.
_PLAIN = re.compile(r'([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z0-9_-]*="[^"<>&]*")*)[ \n]*(/?)>')
_PLAIN_VALUE = re.compile(r'([a-zA-Z][a-zA-Z0-9_-]*)="([^"]*)"')
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}
_NO_ATTRS: dict[str, str] = {}


@lru_cache(1024)
def _plain_attrs(text: str) -> dict[str, str]:
    """Attributes as they stand in a tag; nodes share them and none changes them."""
    return {k if k.islower() else k.lower(): v for k, v in _PLAIN_VALUE.findall(text)}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.page = Page()
        self.top = self.at = Node("", _NO_ATTRS, None, self.page, -1, 0)
        self.open: dict[str, int] = {}  # open tags by name: an end tag that nothing answers is not looked for

    def _close(self, node: Node) -> None:
        """The innermost open tag is the parent of `node` from now on."""
        n, m = len(self.page.nodes), len(self.page.texts)
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at.end, self.at.text_end = n, m
            self.at = self.at.parent

    def _innermost(self, some: set[str], until: set[str]) -> Node | None:
        if not any(self.open.get(t) for t in some):
            return None
        node, found = self.at, None
        while node.parent is not None and node.tag not in until:
            found = node if node.tag in some else found
            node = node.parent
        return found

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        ends = CLOSES.get(tag)
        old = self._innermost(*ends) if ends else None
        if old is None and tag in BLOCKS and self.open.get("p"):
            old = self._innermost({"p"}, {"td", "th", "table", "button", "object"})
        if old is not None:
            self._close(old)
        page = self.page
        node = Node(tag, attrs, self.at, page, len(page.nodes), len(page.texts))
        page.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        self.start(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        if self.open.get(tag):
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._close(node)

    def handle_data(self, data):
        self.page.texts.append(data)
        self.page.owners.append(self.at)

    def plain(self, html: str) -> bool:
        """Read a page that is plain markup from end to end, as `feed` would; False leaves it to that."""
        upto, texts, owners, nodes, page, opened = 0, self.page.texts, self.page.owners, self.page.nodes, self.page, self.open
        for m in _PLAIN.finditer(html):
            at, end = m.span()
            if at != upto:
                return False
            upto = end
            text, ends, tag, attrs, alone = m.groups()
            if text:
                texts.append(unescape(text) if "&" in text else text)
                owners.append(self.at)
                continue
            if not tag.islower():
                tag = tag.lower()
            if tag in _RAW:
                return False
            if ends:
                if attrs or alone:
                    return False
                node = self.at
                if node.tag == tag:  # the usual case of `handle_endtag`
                    opened[tag] -= 1
                    node.end, node.text_end, self.at = len(nodes), len(texts), node.parent
                else:
                    self.handle_endtag(tag)
                continue
            if tag in CLOSES or tag in BLOCKS or tag in VOID:
                self.start(tag, _plain_attrs(attrs) if attrs else _NO_ATTRS)
            else:
                self.at = node = Node(tag, _plain_attrs(attrs) if attrs else _NO_ATTRS, self.at, page, len(nodes), len(texts))
                nodes.append(node)
                opened[tag] = opened.get(tag, 0) + 1
            if alone:
                self.handle_endtag(tag)
        return upto == len(html)

    def done(self) -> Node:
        self.top.text_at = 0
        for node in self._still_open():
            node.end, node.text_end = len(self.page.nodes), len(self.page.texts)
        return self.top

    def _still_open(self) -> Iterator[Node]:
        node = self.at
        while node is not None:
            yield node
            node = node.parent


def tree(html: str | None) -> Node:
    parser = _Tree()
    if not parser.plain(html or ""):
        parser = _Tree()
        parser.feed(html or "")
        parser.close()
    return parser.done()


@dataclass(frozen=True)
class Layout:
    """How a shop lists products: the classes of a card, of its title, sale price, list price, and of the breadcrumbs."""

    cards: frozenset[str]
    title: frozenset[str] = frozenset()
    sale_in: str = "ins"
    list_in: str = "del"
    price: frozenset[str] = frozenset({"price", "amount", "cost"})
    crumbs: frozenset[str] = frozenset({"breadcrumbs", "breadcrumb", "woocommerce-breadcrumb"})
    link_part: str = ""


LAYOUTS = {
    "generic": Layout(frozenset({"item", "product-item", "product-item-info", "product-card", "product"})),
    "grid": Layout(frozenset({"item"}), frozenset({"product-name", "product-title"})),
    "loop": Layout(frozenset({"product", "type-product", "product-item"}), frozenset({"woocommerce-loop-product__title", "product-title", "product-name"})),
    "links": Layout(frozenset(), link_part="/product/"),
}


def _card_texts(card: Node, layout: Layout) -> tuple[Node | None, str, tuple[str, str], list[str]]:
    """A card's title element, image address, sale and list price, and stock texts: one pass over what stands below it."""
    sale = was = amount = shown = named = lazy = image = None
    by_class: list[Node] = []
    by_attr: tuple[list[Node], ...] = ([], [], [])
    for n in card.below():
        tag, attrs = n.tag, n.attrs
        if tag == layout.sale_in:
            sale = sale or n
        elif tag == layout.list_in:
            was = was or n
        elif tag == "img":
            lazy = lazy or (n if attrs.get("data-src") else None)
            image = image or (n if attrs.get("src") else None)
        if not attrs:
            continue
        if "class" in attrs:
            classes = n.classes()
            if shown is None and not layout.price.isdisjoint(classes):
                shown = n
            if named is None and not layout.title.isdisjoint(classes):
                named = n
            if not STOCK_CLASSES.isdisjoint(classes):
                by_class.append(n)
        if amount is None and attrs.get("data-price-amount"):
            amount = n
        for a, held in zip(STOCK_ATTRIBUTES, by_attr, strict=False):
            if attrs.get(a):
                held.append(n)
    found = re.search(r"\$\d[\d,.]*", card.text()) if layout.link_part else None
    sold = sale.text() if sale else amount.attrs["data-price-amount"] if amount else shown.text() if shown else found[0] if found else ""
    picture = lazy or image
    source = (picture.attrs.get("data-src") or picture.attrs.get("src")) if picture else ""
    spots = [card, *by_class, *by_attr[0], *by_attr[1], *by_attr[2]]
    said = [n.attrs[a] for n in spots if n.attrs for a in STOCK_ATTRIBUTES if n.attrs.get(a)] + [n.text() for n in spots[1:]]
    return named, source, (sold, was.text() if was else ""), [t for t in [*said, card.text()] if t]


@lru_cache(1024)
def _root(base: str) -> str:
    return urljoin(base, "/")[:-1]


def _absolute(base: str, href: str) -> str:
    """`urljoin`, with a shorter way for plain paths from the root."""
    return _root(base) + href if _PATH.fullmatch(href) else urljoin(base, href)


_PATH = re.compile(r"(?:/[A-Za-z0-9_-]+)+")


def _priced(page: Node) -> set[Node]:
    """The nodes whose text names a price: each is marked once, from the text up to what is marked already."""
    marked: set[Node] = set()
    for up, text in zip(page.page.owners, page.page.texts, strict=True):
        if re.search(r"\$\d", text):
            while up and up not in marked:
                marked.add(up)
                up = up.parent
    return marked


def _cards(page: Node, layout: Layout) -> Iterator[tuple[Node, Node]]:
    """(card, link) pairs. Without card classes a card is the nearest ancestor of a product link, up to five levels, that names a price."""
    if layout.cards:
        for card in page.all(classes=set(layout.cards)):
            link = card.first("a", attr="href")
            if link:
                yield card, link
        return
    by_target: dict[str, list[Node]] = {}
    for link in page.all("a", attr="href"):
        if layout.link_part in link.attrs["href"]:
            by_target.setdefault(link.attrs["href"], []).append(link)
    priced = _priced(page)
    for links in by_target.values():  # an image link and a title link for each product
        card, up = links[0], 0
        while card.parent and up < 5 and card not in priced:
            card, up = card.parent, up + 1
        yield card, next((x for x in links if x.text()), links[0])


#: card: the number of the card in its page; the stock texts of a card stand in its first row alone, as many links may share one.
SCHEMA = "page_id long, position int, card int, url string, title string, image_url string, sale_text string, list_text string, stock_texts array<string>, category_path string, description string"


def cards_of(page: Node, url: str | None, layout: str) -> list[tuple]:
    """The card rows of one page's tree, without its id."""
    chosen, out = LAYOUTS[layout], []
    trail = page.first(classes=set(chosen.crumbs))
    path = " > ".join([a.text() for a in trail.all("a")][1:]) if trail else ""
    about = page.first(classes={"description", "product-description"})
    seen: dict[Node, tuple] = {}  # what a card shows is read once
    base, told = url or "", about.text() if about else ""
    for k, (card, link) in enumerate(_cards(page, chosen)):
        new = card not in seen
        if new:
            seen[card] = (len(seen), *_card_texts(card, chosen))
        number, named, source, prices, stock = seen[card]
        title = link.attrs.get("title") or (named or link).text() or link.text()
        out.append((k, number, _absolute(base, link.attrs["href"]), title, _absolute(base, source) if source else "", *prices, stock if new else None, path, told))
    return out


def card_rows(pages: DataFrame, layout: str = "generic") -> DataFrame:
    """Raw card rows of pages (page_id, url, html): one page gives any number, texts as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string()]
        for b in in_pieces(batches, 2):
            out = [(page_id, *row) for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in cards_of(tree(html), url, layout)]
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, SCHEMA)


def listing_items(pages: DataFrame, layout: str = "generic", percent_off: float = 0.0, absolute_off: float = 0.0) -> DataFrame:
    """Item rows of listing pages: prices, discount rules and stock are native expressions over the raw cards."""
    return card_items(card_rows(pages, layout), layout, percent_off, absolute_off)


def card_items(rows: DataFrame, layout: str = "generic", percent_off: float = 0.0, absolute_off: float = 0.0) -> DataFrame:
    """Item rows of card rows."""
    price = F.coalesce(parse_price(F.col("sale_text")), parse_price(F.col("list_text")))
    rows = rows.withColumn("_stock", F.get(F.filter(F.transform("stock_texts", stock_status), lambda x: x.isNotNull()), F.lit(0)))
    if LAYOUTS[layout].link_part:  # several links may share a card
        rows = rows.withColumn("_stock", F.max("_stock").over(Window.partitionBy("page_id", "card")))
    return rows.select(
        "page_id", "position", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Product")).alias("title"), price.alias("price_value"),
        apply_discount(price, F.lit(percent_off), F.lit(absolute_off)).alias("discounted_value"), F.col("list_text").alias("original_formatted"),
        F.col("_stock").alias("stock_status"), "image_url", "category_path", "description",
    )
