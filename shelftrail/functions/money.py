"""Prices: parsing, discount rules, currencies and differences. Casts never raise: ANSI mode is on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thousands are grouped only where cents follow, else digits with optional cents.
PRICE = r"([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})|[0-9]+(?:\.[0-9]{2})?)"
SYMBOLS = {"USD": "$", "CAD": "CA$"}


def _double(c: Column) -> Column:
    return c.try_cast("double")


def parse_price(text: Column) -> Column:
    """The first amount in a text; null if there is none."""
    return _double(F.replace(F.regexp_extract(text, PRICE, 1), F.lit(","), F.lit("")))  # an empty text is no number


def parse_price_digits(text: Column) -> Column:
    """Everything but digits and dots removed; what is no number is 0."""
    return F.coalesce(_double(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d.]", "")), F.lit(0.0))


def parse_price_local(text: Column) -> Column:
    """Tolerant of decimal commas, grouping and repeated dots; null when no number is left.

    With both signs commas group. Commas alone are decimal points if at most two digits follow the last one. Of several
    points only the last counts.
    """
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9.,-]", "")
    without, pointed = F.replace(kept, F.lit(","), F.lit("")), F.replace(kept, F.lit(","), F.lit("."))
    short_tail = F.length(F.element_at(F.split(kept, ","), -1)) <= 2
    number = F.when(kept.contains(",") & ~kept.contains(".") & short_tail, pointed).otherwise(without)
    left, right = (F.regexp_extract(number, r"^(.*)\.([^.]*)$", i) for i in (1, 2))
    last_point = F.concat(F.replace(left, F.lit("."), F.lit("")), F.when(right != "", F.concat(F.lit("."), right)).otherwise(""))
    return F.when(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) > 1, _double(last_point)).otherwise(_double(number))


def host_currency(host: Column) -> Column:
    h = F.lower(F.coalesce(host, F.lit("")))
    return F.when(h.endswith(".ca") | h.startswith("ca.") | h.contains(".ca."), "CAD").otherwise("USD")


def format_price(value: Column, currency: Column, host: Column) -> Column:
    """Two decimals with grouping behind the symbol of the currency, or else of the host's; null is empty."""
    code = F.upper(F.coalesce(currency, F.lit("")))
    known = F.when(code.isin(list(SYMBOLS)), code).otherwise(host_currency(host))
    symbol = F.when(known == "CAD", SYMBOLS["CAD"]).otherwise(SYMBOLS["USD"])
    return F.when(value.isNull(), "").otherwise(F.concat(symbol, F.format_number(value, 2)))


def apply_discount(price: Column, percent_off: Column, absolute_off: Column) -> Column:
    """Percent first, then the amount, rounded to cents; may go below zero."""
    cut = price * (1 - F.greatest(percent_off, F.lit(0.0)) / 100) - F.greatest(absolute_off, F.lit(0.0))
    return F.bround(cut + 1e-9, 2)


def apply_discount_floor(price: Column, percent_off: Column, absolute_off: Column) -> Column:
    """The same without rounding, never below zero."""
    after = F.greatest(F.lit(0.0), price * (1 - F.greatest(percent_off, F.lit(0.0)) / 100))
    return F.greatest(F.lit(0.0), after - F.greatest(absolute_off, F.lit(0.0)))


def discount_amount(original: Column, final: Column) -> Column:
    return F.bround(original - final, 2)


def discount_percent(original: Column, final: Column) -> Column:
    return F.when(original > 0, F.bround(F.try_divide(original - final, original) * 100, 2))


def compare_delta(original: Column, final: Column, other: Column) -> Column:
    """How much dearer than the comparison price, by the original price if there is one."""
    return F.bround(F.coalesce(original, final) - other, 2)


def compare_delta_percent(original: Column, final: Column, other: Column) -> Column:
    return F.bround(F.try_divide(F.coalesce(original, final) - other, F.nullif(other, F.lit(0.0))) * 100, 2)
