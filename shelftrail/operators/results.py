"""The result list: money, discounts, comparison, filters, duplicates, orders and pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, stock
from ..functions.text import contains_all, contains_any, let, model_key, natural_key, normal_title
from ..functions.urls import domain
from .compare import with_compare_price
from .ranking import ranked


@dataclass(frozen=True)
class ResultOptions:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    least: float | None = None
    most: float | None = None
    hide_duplicates: bool = False
    order: str = "final-asc"
    page: int = 1
    page_size: int = 50
    percent_off: float = 0.0


# The named settings that come with the list.
PRESETS = {
    "lcd-imports": {"percent_off": 15.0, "least": 50.0, "most": 500.0, "include": ["lcd", "incell", "oem"], "exclude": ["with frame", "grade b"]},
    "oem-only": {"percent_off": 10.0, "include": ["oem", "original"], "exclude": ["aftermarket", "copy"]},
    "refurbished": {"percent_off": 20.0, "include": ["refurbished", "renewed"], "most": 200.0},
}


def priced(items: DataFrame) -> DataFrame:
    """Items (original_formatted, discounted_formatted, ...) with `original` and `final` as numbers."""
    shown = F.coalesce("original_formatted", F.lit(""))
    last = let(F.coalesce("discounted_formatted", F.lit("")), lambda d: F.when(d != "", d).otherwise(shown))
    return items.withColumns({"original": money.parse_price(shown), "final": money.parse_price(last)})


def shown(rows: DataFrame, sheet: DataFrame | None = None) -> DataFrame:
    """Rows of `priced` (title, site, url, stock_status) with what the list shows beside them."""
    rows = with_compare_price(rows, sheet) if sheet is not None else rows.withColumn("cmp_price", F.lit(None).cast("double"))
    rows = rows.withColumns({"model": model_key(F.col("title")), "stock": stock.shown_status(F.col("stock_status")), "domain": domain(F.col("url"))})
    original, final, other = F.col("original"), F.col("final"), F.col("cmp_price")
    return rows.withColumns({
        "discount_percent": money.discount_percent(original, final),
        "discount_amount": money.discount_amount(original, final),
        "delta": money.compare_delta(original, final, other),
        "delta_percent": money.compare_delta_percent(original, final, other),
        "stock_label": stock.shown_label(F.col("stock")), "stock_tone": stock.shown_tone(F.col("stock")),
    })


def enrich(items: DataFrame, sheet: DataFrame | None = None) -> DataFrame:
    """Items (title, site, url, original_formatted, discounted_formatted, stock_status) with what the list shows."""
    return shown(priced(items), sheet)


def keyword_filter(rows: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows with all of the included and none of the excluded terms in title and URL, all in normal form."""
    if not include and not exclude:
        return rows
    text = normal_title(F.concat_ws(" ", "title", "url"))
    plain = lambda terms: [normal_title(F.lit(t)) for t in terms]
    return rows.where(let(text, lambda t: contains_all(t, plain(include)) & ~contains_any(t, plain(exclude))))


def price_filter(rows: DataFrame, least: float | None, most: float | None, price: str = "final") -> DataFrame:
    """A lower bound drops rows without a price, an upper bound keeps them. One predicate, so the price is worked out once."""
    if least is None and most is None:
        return rows

    def fits(p: Column) -> Column:
        low = F.lit(True) if least is None else F.coalesce(p >= least, F.lit(False))
        return low if most is None else low & F.coalesce(p <= most, F.lit(True))

    return rows.where(let(F.col(price), fits))


def hide_duplicates(rows: DataFrame, order: str = "ordinal") -> DataFrame:
    """The first row of each model in input order (`order` is unique); titles without a model stand for themselves.

    The model is worked out once per distinct title, only those rows move, and what is joined back is one place per model.
    """
    titles = rows.groupBy("title").agg(F.min(order).alias("_first"))
    key = let(model_key(F.col("title")), lambda m: F.when(m != "", m).otherwise(F.lower("title")))
    firsts = titles.groupBy(key.alias("_key")).agg(F.min("_first").alias(order)).select(order)
    return rows.join(firsts, order, "left_semi").select(*rows.columns)


def order_columns(order: str) -> list[Column]:
    """`final`, `original`, `discount`, `title` or `source`, `-asc` or `-desc`; rows without a price come last either way."""
    name, _, way = order.partition("-")
    column = {
        "final": F.col("final"), "original": F.col("original"), "discount": F.coalesce("discount_percent", F.lit(0.0)),
        "title": natural_key(F.col("title")), "source": natural_key(F.col("site")), "model": F.struct(natural_key(F.col("model")), natural_key(F.col("title"))),
    }[name]
    return [column.desc_nulls_last() if way == "desc" else column.asc_nulls_last(), F.col("ordinal").asc()]


def blanks_last(title: Column) -> list[Column]:
    text = F.trim(F.coalesce(title, F.lit("")))
    return [(text == "").asc(), F.lower(text).asc()]


def watched(rows: DataFrame, watchlist: DataFrame) -> DataFrame:
    return rows.join(watchlist.select("url"), "url", "left_semi")


def page(rows: DataFrame, number: int, size: int, order: str) -> DataFrame:
    """A page near the head of the list, with the place of each row in the whole list: a bounded top-k of `number` pages.
    For pages from anywhere, and the last one, see `deep_page`."""
    held = rows.orderBy(*order_columns(order)).limit(number * size)  # windows over these rows are small
    place = F.row_number().over(Window.orderBy(*order_columns(order)))
    held = held.withColumns({"position": place, "_n": F.count("*").over(Window.partitionBy())})
    last = F.greatest(F.lit(1), F.ceil(F.col("_n") / size))
    return held.where(F.col("position") > (last - 1) * size).drop("_n")


def heads(rows: DataFrame, size: int, orders: list[str], path: str) -> DataFrame:
    """The first `size` rows of each order, as (sorted, position, ordinal). What the orders look at is worked out once for all
    of them, and written to the new folder `path`."""
    rows.select("ordinal", "title", "site", "original", "final", "discount_percent", *(["model"] if any(o.startswith("model") for o in orders) else [])).write.parquet(path)
    told = rows.sparkSession.read.parquet(path)
    found = [page(told, 1, size, o).select(F.lit(o).alias("sorted"), "position", "ordinal") for o in orders]
    return reduce(DataFrame.unionByName, found)


def deep_page(rows: DataFrame, number: int, size: int, order: str, path: str) -> DataFrame:
    """The same page by its number, or the last page there is, from the list ranked under the new folder `path`: no task
    holds more than a partition of it, and what is read is the partition that the page is in."""
    return ranked(rows, order_columns(order), path).page(number, size)


def results(items: DataFrame, options: ResultOptions, sheet: DataFrame | None = None, watchlist: DataFrame | None = None) -> DataFrame:
    """The list: filters and duplicates first, on what they need, then what is shown of the rows that are left."""
    rows = keyword_filter(priced(items), options.include, options.exclude)
    if options.percent_off:
        cut = money.apply_discount(F.col("final"), F.lit(options.percent_off), F.lit(0.0))
        rows = price_filter(rows.withColumn("_cut", cut), options.least, options.most, "_cut")
    else:
        rows = price_filter(rows, options.least, options.most)
    if options.hide_duplicates:
        rows = hide_duplicates(rows)
    if watchlist is not None:
        rows = watched(rows, watchlist)
    out = shown(rows, sheet)
    return out.withColumn("final", F.col("_cut")).drop("_cut") if options.percent_off else out


def with_preset(name: str, **more) -> ResultOptions:
    return ResultOptions(**(PRESETS[name] | more))
