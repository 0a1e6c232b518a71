"""Stock texts to states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, let

# Texts that are a status by themselves, after `-` and `_` became spaces.
DIRECT = {
    "in_stock": ["in stock", "instock", "available", "available now", "yes", "y", "stock yes"],
    "out_of_stock": ["out of stock", "sold out", "no", "n", "stock no"],
    "back_order": ["backorder", "back order", "backordered"],
    "preorder": ["preorder", "pre order"],
    "limited": ["limited availability", "low stock", "limited stock"],
}
# Phrases that tell a status, tried in this order.
PHRASES = {
    "out_of_stock": r"\b(not\s+available|unavailable|out\s+of\s+stock|sold\s+out|no\s+stock|currently\s+unavailable|temporarily\s+unavailable|stock\s*:?(?:\s|\s*&nbsp;)?no)\b",
    "back_order": r"\b(back[\s-]?order(?:ed)?|backordered|awaiting\s+stock|ships\s+in\s+\d+|ships\s+within\s+\d+|special\s+order)\b",
    "preorder": r"\b(pre[\s-]?order|coming\s+soon|pre\s+order)\b",
    "limited": r"\b(low\s+stock|limited\s+stock|few\s+left|only\s+\d+\s+(?:left|remaining)|almost\s+gone|last\s+(?:few|units)|limited\s+availability)\b",
    "in_stock": r"\b(in\s*stock|available\s+now|ready\s+to\s+ship|ships\s+today|available\s+for\s+immediate|stock\s*:?(?:\s|\s*&nbsp;)?yes|qty\s+available|stock\s+available)\b",
}
# Availability terms of the public product vocabulary.
AVAILABILITY = {
    "schema.org/instock": "in_stock",
    "schema.org/outofstock": "out_of_stock",
    "schema.org/limitedavailability": "limited",
    "schema.org/backorder": "back_order",
    "schema.org/preorder": "preorder",
    "schema.org/discontinued": "discontinued",
}
# Markers of the coarse state used in change labels, tried in this order.
STATE_MARKERS = {
    "in_stock": ["in stock", "instock", "available", "ready", "yes", "available now"],
    "out_of_stock": ["out of stock", "sold out", "oos", "unavailable", "no stock"],
    "backorder": ["backorder", "back order", "preorder", "pre order", "back-ordered"],
}
# Statuses that are shown, with label and tone.
SHOWN = {
    "in_stock": ("In Stock", "positive"),
    "limited": ("Limited", "warning"),
    "back_order": ("Back Order", "warning"),
    "preorder": ("Preorder", "info"),
    "pre_order": ("Preorder", "info"),
    "out_of_stock": ("Out of Stock", "danger"),
    "sold_out": ("Sold Out", "danger"),
    "discontinued": ("Discontinued", "muted"),
    "unavailable": ("Unavailable", "muted"),
    "unknown": ("Unknown", "muted"),
}
# Keyword families for texts that are no shown status, tried in this order.
SHOWN_KEYWORDS = {
    "out_of_stock": r"(not available|no stock|sold out|unavailable|out of stock|out-of-stock|outofstock)",
    "back_order": r"(back[-\s]?order|awaiting stock|ships in|special order|backordered|backorder)",
    "preorder": r"(pre[-\s]?order|coming soon|preorder)",
    "limited": r"(limited|low stock|few left|almost gone|only \d+|limitedavailability)",
    "discontinued": r"(discontinued|no longer available|retired)",
    "in_stock": r"(in stock|available now|ready to ship|ships today|instock|yes$|available$)",
}


def _first(cases: list[tuple[Column, Column | str]], otherwise: Column) -> Column:
    for condition, value in reversed(cases):
        otherwise = F.when(condition, value).otherwise(otherwise)
    return otherwise


def stock_status(value: Column) -> Column:
    """Canonical status of a stock text; null when it tells nothing."""

    def told(x: Column) -> Column:
        low, spaced = x["low"], x["spaced"]
        none = spaced.contains("not available") | spaced.contains("unavailable") | spaced.contains("no availability")
        cases = [(low == "", F.lit(None)), (none, "out_of_stock")]
        cases += [(spaced.isin(texts), status) for status, texts in DIRECT.items()]
        cases += [(low.rlike(p), status) for status, p in PHRASES.items()]
        return _first(cases, F.lit(None)).cast("string")

    return let(F.lower(clean_text(value)), lambda low: let(F.struct(low.alias("low"), F.translate(low, "-_", "  ").alias("spaced")), told))


def stock_status_of_flag(value: Column) -> Column:
    return F.when(value, "in_stock").when(~value, "out_of_stock")


def availability_status(value: Column) -> Column:
    """Status of a structured-data availability: a vocabulary URL, or any stock text."""
    return let(F.lower(value), lambda low: _first([(low.contains(k), v) for k, v in AVAILABILITY.items()], stock_status(value)))


def stock_state(value: Column, out_first: bool = False) -> Column:
    """Coarse state for labels. In-stock markers are tested first, so `unavailable` counts as available; `out_first` undoes that."""
    order = ["out_of_stock", "in_stock", "backorder"] if out_first else list(STATE_MARKERS)

    def told(text: Column) -> Column:
        cases = []
        for state in order:
            found = F.lit(False)
            for marker in STATE_MARKERS[state]:
                found = found | text.contains(marker)
            cases.append((found, state))
        return _first(cases, text)

    return let(F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "(?i)[^a-z0-9]+", " "))), told)


def shown_status(value: Column) -> Column:
    def told(x: Column) -> Column:
        low, canonical = x["low"], x["canonical"]
        cases = [(low == "", F.lit("unknown")), (canonical.isin(list(SHOWN)), canonical)]
        cases += [(low.rlike(p), F.lit(status)) for status, p in SHOWN_KEYWORDS.items()]
        return _first(cases, canonical)

    both = lambda low: F.struct(low.alias("low"), F.regexp_replace(low, "[^a-z]+", "_").alias("canonical"))
    return let(F.lower(F.trim(F.coalesce(value, F.lit("")))), lambda low: let(both(low), told))


def shown_label(status: Column) -> Column:
    def told(s: Column) -> Column:
        words = F.filter(F.split(s, r"[_\s-]+"), lambda x: x != "")
        titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")
        return _first([(s == k, F.lit(label)) for k, (label, _) in SHOWN.items()], titled)

    return let(status, told)


def shown_tone(status: Column) -> Column:
    return let(status, lambda s: _first([(s == k, F.lit(tone)) for k, (_, tone) in SHOWN.items()], F.lit("muted")))
