"""Category links of a shop's menus, with the brand that a menu stands under: one tree per page, links as rows."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow
from .cards import Node, tree
from .catalog import first_wins

# The brands that a menu entry's class may name, the classes of its lists and links, and the parts of category
# addresses beside which a link counts without them, with the brand that it then gets.
BRANDS = ["apple", "samsung", "motorola", "google", "lg", "sony", "htc", "blackberry"]
MENU, MENU_LIST, MENU_ROW, MENU_LINK = {"mobile-nav"}, {"level0"}, {"sview-row"}, {"nlabel-f"}
OTHER_PARTS = {"/replacement-parts/": "Unknown", "/product-category/": "WooCommerce"}
SCHEMA = "page_id long, position int, url string, label string, brand string"


def _inside(node: Node, classes: set[str]) -> Iterator[Node]:
    return (x for x in node.all() if classes & x.classes())


def menu_links(page: Node) -> Iterator[tuple[str, str, str | None]]:
    """(href, label, brand) of a page's menus, in order: below an entry whose class holds a brand, and named by that class alone
    if it is one; then links to category addresses anywhere in navigation."""
    for menu in _inside(page, MENU):
        for entry in menu.all("li"):
            named = entry.attrs.get("class", "").split()
            if not any(b in " ".join(named) for b in BRANDS):
                continue
            brand = next((c.capitalize() for c in named if c.lower() in BRANDS), None)
            for listed in list(_inside(entry, MENU_LIST))[:1]:
                for row in _inside(listed, MENU_ROW):
                    for link in row.all("a", MENU_LINK, "href"):
                        if link.attrs["href"].startswith("/"):
                            yield link.attrs["href"], link.text(), brand
    for nav in page.all("nav"):
        for link in nav.all("a", attr="href"):
            found = next((b for part, b in OTHER_PARTS.items() if part in link.attrs["href"]), None)
            if found:
                yield link.attrs["href"], link.text(), found


def category_menu(pages: DataFrame) -> DataFrame:
    """The category links of pages (page_id, url, html): url (absolute), label and brand of the place where each was first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in in_pieces(batches, 2):
            out: list[tuple] = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(page_id, k, urljoin(url or "", href), label, brand) for k, (href, label, brand) in enumerate(menu_links(tree(html)))]
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    found = map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), run, SCHEMA)
    return first_wins(found, ["url"], ["page_id", "position"]).select("url", "label", "brand")
