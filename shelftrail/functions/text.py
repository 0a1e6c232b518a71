"""Titles, slugs, keys and other text columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which model a title names.
TITLE_STOP_WORDS = [
    "for", "with", "without", "frame", "lcd", "assembly", "screen", "display", "series", "model", "global", "original", "grade", "version", "and", "the", "a", "an",
]
# What counts as a model code or family in a normalised title.
MODEL_TOKEN = r"\b([a-z]{1,3}-?\d{1,4}[a-z]?)\b|\b(galaxy|iphone|ipad|a\d{2}|a0?\d{1,2}|xs?max|pro|max|mini|se|plus)\b"
# What people type for "no value".
PLACEHOLDERS = ["-", "—", "n/a", "na", "none", "null", "tbd", "pending"]
UNTITLED = "Untitled product"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_text(c: Column) -> Column:
    """White space of any kind collapsed to one space and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normal_title(c: Column) -> Column:
    """Lower case, letters and digits only, without stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")
    telling = F.regexp_replace(plain, rf"\b({'|'.join(TITLE_STOP_WORDS)})\b", "")
    return F.trim(F.regexp_replace(telling, r"\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key_of_normal_title(title: Column) -> Column:
    return let(F.array_join(F.regexp_extract_all(title, F.lit(MODEL_TOKEN), 0), " "), lambda k: F.when(k != "", k).otherwise(title))


def model_key(c: Column) -> Column:
    """All model codes and family names of a title in order, or else its normal form."""
    return let(normal_title(c), key_of_normal_title)


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("general"))


def truncate_value(c: Column, limit: int = 500) -> Column:
    """Trimmed, at most `limit` characters with an ellipsis; blank becomes null."""
    t = blank_to_null(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def display_title(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(UNTITLED))


def clean_category(c: Column) -> Column:
    return clean_text(c)


def display_sku(c: Column, placeholder: str = "N/A") -> Column:
    return F.coalesce(blank_to_null(c), F.lit(placeholder))


def model_identifier(brand: Column, model: Column, compatibility: Column) -> Column:
    """Brand and model, or else the first compatible device that is named."""
    named = F.concat_ws(" ", blank_to_null(brand), blank_to_null(model))
    fallback = F.get(F.filter(F.transform(compatibility, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))
    return F.coalesce(F.nullif(named, F.lit("")), fallback)


# Where a chipset is named, and what names one in a title.
CHIPSET_KEYS = ["chipset", "chip", "processor"]
CHIPSET_IN_TITLE = r"(?i)(A\d{2}|Snapdragon\s?\d+|Dimensity\s?\d+)"


def chipset(details_json: Column, metadata_json: Column, title: Column) -> Column:
    """From the variant details, the event metadata or the title, in that order."""
    named = [blank_to_null(F.get_json_object(j, f"$.{k}")) for j in (details_json, metadata_json) for k in CHIPSET_KEYS]
    return F.coalesce(*named, F.nullif(F.regexp_extract(title, CHIPSET_IN_TITLE, 1), F.lit("")))


def taxonomy(path: Column, label: Column, brand: Column, default: str = "General") -> Column:
    """struct(brand, category, model) from a breadcrumb path `A > B > C`, or else from what the category page says."""
    label = F.nullif(clean_text(label), F.lit(""))
    crumbs = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">"), clean_text), lambda x: x != "")
    crumbs = F.when((F.size(crumbs) == 0) & label.isNotNull(), F.array(label)).otherwise(crumbs)
    n = F.size(crumbs)
    first = F.get(crumbs, F.lit(0))
    category = F.when(n >= 3, F.get(crumbs, F.lit(1))).otherwise(first)
    model = F.when(n >= 2, F.get(crumbs, n - 1)).otherwise(first)
    named = F.coalesce(F.nullif(clean_text(brand), F.lit("")), first, F.lit(default))
    return F.struct(named.alias("brand"), F.coalesce(category, F.lit(default)).alias("category"), F.coalesce(model, F.lit(default)).alias("model"))


def derive_sku(sku: Column, url: Column) -> Column:
    """The sku itself, or the last part of the URL's path, or a digest of the URL; upper case, word characters and dashes."""

    def safe(c: Column) -> Column:
        return F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "-"), F.lit("-")), F.lit(""))

    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))
    return F.upper(F.coalesce(safe(F.coalesce(F.nullif(clean_text(sku), F.lit("")), last)), F.md5(F.coalesce(url, F.lit("")))))


def compatibility_list(entries: Column, model: Column) -> Column:
    """Trimmed entries without blanks, the model itself and later repeats that differ in case only."""
    own = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    named = F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: (F.coalesce(x, F.lit("")) != "") & (F.lower(x) != own))
    return F.filter(named, lambda x, i: F.array_position(F.transform(named, F.lower), F.lower(x)) == i + 1)


def is_meaningful(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(["", *PLACEHOLDERS])


#: Compares texts by Unicode's rules, case and accents left out.
NATURAL = "UNICODE_CI_AI"


def natural_key(c: Column, width: int = 12) -> Column:
    """A key that sorts in natural order: digits compared as numbers, case and accents left out."""
    padded = F.regexp_replace(F.coalesce(c, F.lit("")), r"(\d+)", "0" * width + "$1")
    return F.collate(F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1"), NATURAL)


def contains_all(haystack: Column, terms: list) -> Column:
    return reduce(lambda a, t: a & haystack.contains(t), terms, F.lit(True))


def contains_any(haystack: Column, terms: list) -> Column:
    return reduce(lambda a, t: a | haystack.contains(t), terms, F.lit(False))
