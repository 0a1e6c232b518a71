"""What kind of change an event is, whether it counts, and how it is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stock import stock_state

# Names of change types, and parts of names, by canonical type in the order tried.
TYPE_NAMES = {
    "stock": ["stock", "stock_status", "availability", "inventory"],
    "description": ["description", "desc", "details", "product_description"],
    "price": ["price", "pricing", "cost"],
}
TYPE_PARTS = {
    "stock": ["stock", "availability", "inventory", "qty"],
    "description": ["description", "content", "copy"],
    "price": ["price", "cost"],
}
NEW_TYPES = ["new", "product_new", "new_product"]
NO_VALUE = "—"


def change_type(name: Column) -> Column:
    low = F.lower(name)
    out = low
    for kind in reversed(TYPE_NAMES):
        hit = low.isin(TYPE_NAMES[kind])
        for part in TYPE_PARTS[kind]:
            hit = hit | low.contains(part)
        out = F.when(hit, kind).otherwise(out)
    return out


def is_significant(old: Column, new: Column) -> Column:
    """Old and new differ after trimming and lower-casing; null differs from anything else."""
    return ~F.trim(F.lower(old)).eqNullSafe(F.trim(F.lower(new)))


def is_first_fill(kind: Column, old: Column, new: Column, changed_at: Column, created_at: Column) -> Column:
    """A value that was there from the start: no "new" event, blank before, and not later than the product itself."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.coalesce(~F.lower(kind).isin(NEW_TYPES) & blank(old) & ~blank(new) & (changed_at <= created_at), F.lit(False))


def _comparable(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s_-]+", " "))


def is_meaningful_change(kind: Column, old: Column, new: Column) -> Column:
    """Worth logging: different beyond spacing, dashes and case; descriptions also as trimmed text."""
    same_text = (F.lower(F.trim(kind)) == "description") & (F.trim(F.coalesce(old, F.lit(""))) == F.trim(F.coalesce(new, F.lit(""))))
    return ~F.coalesce(same_text, F.lit(False)) & (_comparable(old) != _comparable(new))


def price_difference(old: Column, new: Column) -> Column:
    return F.when(old.isNotNull() | new.isNotNull(), F.coalesce(new, F.lit(0.0)) - F.coalesce(old, F.lit(0.0)))


def direction(difference: Column) -> Column:
    return F.when(difference > 0, "up").when(difference < 0, "down").otherwise("flat")


def display_value(kind: Column, number: Column, text: Column) -> Column:
    said = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(kind == "price", F.when(number.isNull(), NO_VALUE).otherwise(F.format_string("$%.2f", number)))
        .when(said == "", NO_VALUE)
        .when(kind == "stock", F.initcap(F.lower(F.regexp_replace(said, "[_-]+", " "))))
        .otherwise(said)
    )


def display_delta(kind: Column, difference: Column) -> Column:
    sign = F.when(difference > 0, "+").otherwise("-")
    return F.when((kind == "price") & (F.abs(difference) >= 1e-9), F.concat(sign, F.format_string("$%.2f", F.abs(difference))))


def raw_value(number: Column, text: Column) -> Column:
    return F.coalesce(number.cast("string"), text)


def change_label(kind: Column, difference: Column, old_raw: Column, new_raw: Column, old_shown: Column, new_shown: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    moved = F.abs(difference) >= 1e-9
    old, new = (stock_state(F.coalesce(F.nullif(raw, F.lit("")), shown)) for raw, shown in ((old_raw, old_shown), (new_raw, new_shown)))

    def moved_to(states: Column) -> Column:
        out = F.lit("Stock status changed")
        for state, label in (("backorder", "Backorder status updated"), ("out_of_stock", "Out of stock"), ("in_stock", "Back in stock")):
            out = F.when((states["new"] == state) & (states["old"] != state), label).otherwise(out)
        return out

    # through a lambda both states are worked out once, which keeps the generated code small
    stock = F.get(F.transform(F.array(F.struct(old.alias("old"), new.alias("new"))), moved_to), F.lit(0))
    return (
        F.when(k.isin(NEW_TYPES), "New product added")
        .when(k == "price", F.when(moved & (difference > 0), "Price increased").when(moved, "Price decreased").otherwise("Price changed"))
        .when(k == "stock", stock)
        .when(k == "description", "Description updated")
        .otherwise("Value updated")
    )


def stock_badge(old: Column, new: Column) -> Column:
    """Which way stock moved: restocked, out, backorder, removed, added, or updated."""
    o, n = stock_state(old), stock_state(new)
    return (
        F.when((n == "in_stock") & (o != "in_stock"), "restocked")
        .when((n == "out_of_stock") & (o != "out_of_stock"), "out")
        .when((n == "backorder") & (o != "backorder"), "backorder")
        .when((o != "") & (n == ""), "removed")
        .when((o == "") & (n != ""), "added")
        .otherwise("updated")
    )


def describe_change(kind: Column, old: Column, new: Column) -> Column:
    """What happened to a value, by which side of it is there."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    words = {"price": ("added", "removed", "updated"), "stock": ("captured", "cleared", "updated"), "description": ("added", "removed", "edited")}
    out = F.lit("Value updated")
    for k, (first, gone, other) in words.items():
        name = k.capitalize()
        told = F.when(~has(old) & has(new), f"{name} {first}").when(has(old) & ~has(new), f"{name} {gone}").otherwise(f"{name} {other}")
        out = F.when(kind == k, told).otherwise(out)
    return F.when(F.lower(kind).isin(NEW_TYPES), "New product added").otherwise(out)
