"""One pass over saved pages for all that takes a tag tree: cards, product parts and menus from one tree per page.

`parse_pages` gives one row per page with a typed column for each kind of record; written once, it is read by as many of the
views below as are wanted, and no page is parsed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow
from . import cards, navigation, product_pages
from .catalog import first_wins

_CARD = cards.SCHEMA.removeprefix("page_id long, ")
_MENU = navigation.SCHEMA.removeprefix("page_id long, ")
_SQL = "array<struct<{}>>"
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def _struct(schema: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", "))


def _arrow(schema: str) -> pa.StructType:
    return pa.struct([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")])


SCHEMA = f"page_id long, url string, html string, cards {_SQL.format(_struct(_CARD))}, parts struct<{_struct(product_pages.PARTS)}>, menu {_SQL.format(_struct(_MENU))}"


def parse_pages(pages: DataFrame, layout: str = "generic") -> DataFrame:
    """`pages` (page_id, url, html) with their cards in a layout, product parts and menu links."""

    def records(schema: pa.StructType, rows: list[tuple]) -> list[dict]:
        return [dict(zip((f.name for f in schema), r, strict=True)) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        card, part, menu = _arrow(_CARD), _arrow(product_pages.PARTS), _arrow(_MENU)
        for b in in_pieces(batches, 2):
            out = [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                page = cards.tree(html)
                out[0].append(records(card, cards.cards_of(page, url, layout)))
                out[1].append(records(part, [product_pages.parts_of(page)])[0])
                links = [(k, urljoin(url or "", href), label, brand) for k, (href, label, brand) in enumerate(navigation.menu_links(page))]
                out[2].append(records(menu, links))
            columns = [pa.array(out[0], pa.list_(card)), pa.array(out[1], part), pa.array(out[2], pa.list_(menu))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=["page_id", "url", "html", "cards", "parts", "menu"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, SCHEMA)


def listing_items(parsed: DataFrame, layout: str = "generic", percent_off: float = 0.0, absolute_off: float = 0.0) -> DataFrame:
    """As `cards.listing_items`."""
    rows = parsed.select("page_id", F.explode("cards").alias("c")).select("page_id", "c.*")
    return cards.card_items(rows, layout, percent_off, absolute_off)


def product_rows(parsed: DataFrame, percent_off: float = 0.0, absolute_off: float = 0.0) -> DataFrame:
    """As `product_pages.product_rows`."""
    return product_pages.parts_rows(parsed.select("page_id", "url", "html", "parts.*"), percent_off, absolute_off)


def category_menu(parsed: DataFrame) -> DataFrame:
    """As `navigation.category_menu`."""
    found = parsed.select("page_id", F.explode("menu").alias("m")).select("page_id", "m.*")
    return first_wins(found, ["url"], ["page_id", "position"]).select("url", "label", "brand")
