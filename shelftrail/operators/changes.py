"""The change feed: typed price and property events of one shape, filtered, ordered and told."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import change as C
from ..functions.text import clean_category, display_sku, display_title, truncate_value
from .history import price_changes
from .ranking import ranked

PRODUCT_COLUMNS = ["product_id", "sku", "title", "url", "brand", "category", "model", "stock_status"]
DEFAULT_TYPES = ("new", "price", "stock", "description")


@dataclass(frozen=True)
class ChangeFilter:
    types: tuple[str, ...] | None = None
    since: Column | None = None
    until: Column | None = None
    search: str | None = None

    def apply(self, feed: DataFrame) -> DataFrame:
        if self.types:
            feed = feed.where(F.lower("change_type").isin([t.lower() for t in self.types]))
        if self.since is not None:
            feed = feed.where(F.col("changed_at") >= self.since)
        if self.until is not None:
            feed = feed.where(F.col("changed_at") <= self.until)
        if term := (self.search or "").strip().lower():
            feed = feed.where(F.lower("title").contains(term) | F.lower("sku").contains(term))
        return feed


def property_changes(changes: DataFrame, products: DataFrame) -> DataFrame:
    """Significant non-price events (product_id, change_type, old_value, new_value, changed_at) that are no first fill, with canonical types."""
    known = changes.join(products.select("product_id", "created_at"), "product_id")
    first = C.is_first_fill(F.col("change_type"), F.col("old_value"), F.col("new_value"), F.col("changed_at"), F.col("created_at"))
    known = known.where(C.is_significant(F.col("old_value"), F.col("new_value")) & ~first)
    return known.withColumn("change_type", C.change_type(F.col("change_type"))).drop("created_at")


def union_feed(history: DataFrame, changes: DataFrame, products: DataFrame) -> DataFrame:
    """One row per event with its product: numeric old and new for prices, text for the rest."""
    prices = price_changes(history).select(
        "product_id", F.lit("price").alias("change_type"), F.col("recorded_at").alias("changed_at"),
        F.col("old_price").alias("old_numeric"), F.col("price").alias("new_numeric"),
    )
    properties = property_changes(changes, products).where("change_type <> 'price'").select(
        "product_id", "change_type", "changed_at", F.col("old_value").alias("old_text"), F.col("new_value").alias("new_text")
    )
    events = prices.unionByName(properties, allowMissingColumns=True)
    return events.join(products.select(*PRODUCT_COLUMNS), "product_id")


def feed_order() -> list[Column]:
    return [F.desc("changed_at"), F.asc("product_id"), F.asc("change_type"), F.asc("new_numeric"), F.asc("new_text")]


def recent_changes(feed: DataFrame, wanted: ChangeFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    """The head of the feed: a top-k of offset + limit rows. For pages from anywhere see `feed_page`."""
    return wanted.apply(feed).orderBy(*feed_order()).offset(offset).limit(limit)


def feed_page(feed: DataFrame, wanted: ChangeFilter, number: int, size: int, path: str) -> DataFrame:
    """A page of the filtered feed by its number, or the last page there is, with places (`position`), total and number of
    pages, from the feed ranked under the new folder `path`."""
    listed = ranked(wanted.apply(feed), [*feed_order(), F.asc("old_numeric"), F.asc("old_text")], path)
    return listed.page(number, size).withColumns({"total": F.lit(listed.total).cast("long"), "pages": F.lit(listed.pages(size)).cast("long")})


def told(feed: DataFrame) -> DataFrame:
    """`feed` with what a reader sees: shown values, difference, direction and label."""
    kind, old, new = F.col("change_type"), F.col("old_numeric"), F.col("new_numeric")
    old_text, new_text = F.col("old_text"), F.col("new_text")
    difference = F.when(kind == "price", C.price_difference(old, new))
    shown_old, shown_new = C.display_value(kind, old, old_text), C.display_value(kind, new, new_text)
    return feed.withColumns({
        "old_value": shown_old,
        "new_value": shown_new,
        "difference": difference,
        "difference_direction": C.direction(difference),
        "delta_display": C.display_delta(kind, difference),
        "change_label": C.change_label(kind, difference, C.raw_value(old, old_text), C.raw_value(new, new_text), shown_old, shown_new),
        "product_title": display_title(F.col("title")),
        "sku": display_sku(F.col("sku")),
        "category": clean_category(F.col("category")),
    })


def baseline_feed(products: DataFrame, baselines: DataFrame) -> DataFrame:
    """Current products as `baseline` events, at the time their first snapshot was taken."""
    out = products.join(baselines.select("product_id", "captured_at"), "product_id", "left")
    return out.withColumn("change_type", F.lit("baseline")).withColumn("changed_at", F.coalesce("captured_at", "updated_at", "created_at")).drop("captured_at")


def feed_with_fallback(feed: DataFrame, baseline: DataFrame) -> DataFrame:
    """`feed`, or `baseline` when it is empty, in one plan: the baseline passes only when the feed's count is 0."""
    empty = feed.limit(1).agg((F.count("*") == 0).alias("empty"))
    columns = [c for c in feed.columns if c in baseline.columns]
    return feed.select(*columns).unionByName(baseline.select(*columns).crossJoin(empty).where("empty").drop("empty"))


def legacy_feed(items: DataFrame, site_pattern: str) -> DataFrame:
    """Items of a supplier without a catalog, each as a price event."""
    return items.where(F.col("site").ilike(site_pattern)).withColumns({"change_type": F.lit("price"), "change_label": F.lit("Price recorded")})


def counts_by_type(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def feed_pages(feed: DataFrame, page_size: int) -> DataFrame:
    """Total and number of pages, at least one."""
    return feed.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long"))


def loggable(changes: DataFrame) -> DataFrame:
    """Events that are worth keeping, values trimmed and cut to length."""
    some = C.is_meaningful_change(F.col("change_type"), F.col("old_value"), F.col("new_value"))
    return changes.where(some).withColumns({"old_value": truncate_value(F.col("old_value")), "new_value": truncate_value(F.col("new_value"))})
