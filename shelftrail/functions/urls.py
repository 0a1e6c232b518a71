"""Hosts, paths and what they say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path parts that name a section of a shop and never a model.
SECTION_PARTS = [
    "replacement-parts", "parts", "apple", "samsung", "huawei", "xiaomi", "oneplus", "google", "lg", "sony", "nokia", "motorola", "oppo", "vivo",
    "ipad", "iphone", "watch", "macbook", "mac", "tablet", "iphone-parts", "ipad-parts", "watch-parts", "tablet-parts", "phone-parts", "category",
    "products", "product", "collections", "accessories", "accessory", "shop", "all", "index",
]
# Words of model names that are written in capitals.
CAPITAL_WORDS = ["se", "tv", "lte", "5g", "usb"]
# Fixed value: how a model name spells it, with a hyphen that does not break.
WIFI = "Wi\u2011Fi"
DISPLAY_ZONE = "Asia/Karachi"


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def domain(url: Column) -> Column:
    """Host without `www.`; empty if the URL has none."""
    return F.coalesce(F.regexp_replace(host(url), r"(?i)^www\.", ""), F.lit(""))


def source_label(site: Column) -> Column:
    """A short name for a site given as URL or host; blank stays blank."""
    raw = F.trim(F.coalesce(site, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)^https?://", ""), r"(?i)^www\.", "")
    return F.coalesce(F.nullif(F.trim(F.split(bare, "/")[0]), F.lit("")), raw)


def normal_url(url: Column) -> Column:
    """For matching: trimmed, lower case, no slash at the end."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", ""))


def _model_word(w: Column) -> Column:
    low = F.lower(w)
    return (
        F.when(w.rlike("^(?i)[a-z]?[0-9]+[a-z]?$"), F.upper(w))
        .when(low.isin(CAPITAL_WORDS), F.upper(w))
        .when(low == "iphone", "iPhone").when(low == "ipad", "iPad").when(low == "ipod", "iPod")
        .otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 10_000)))
    )


def model_name(url: Column) -> Column:
    """A readable model name from the last part of a URL's path that is no section; empty if there is no path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.transform(F.split(path, "/"), lambda x: F.coalesce(F.try_url_decode(x), x)), lambda x: x != "")
    telling = F.filter(parts, lambda x: ~F.lower(x).isin(SECTION_PARTS))
    chosen = F.when(F.size(telling) > 0, F.get(telling, F.size(telling) - 1)).otherwise(F.get(parts, F.size(parts) - 1))
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(chosen, F.lit("")), r"[-_\s]+", " "), r"(?i)\.(htm|html)$", "")
    words = F.filter(F.split(F.trim(spaced), " "), lambda x: x != "")
    return F.regexp_replace(F.array_join(F.transform(words, _model_word), " "), r"(?i)\bwi\s?fi\b", WIFI)


def region_source(url: Column, prefix: str = "S") -> Column:
    h = host(url)
    return F.when(h.isNull(), prefix).when(F.lower(h).endswith(".ca"), f"{prefix}-CA").otherwise(f"{prefix}-US")


def route(url: Column, suppliers: dict[str, str], default: str = "generic") -> Column:
    """Which supplier's parser a URL goes to: the first whose pattern its host contains."""
    h, out = F.lower(F.coalesce(host(url), F.lit(""))), F.lit(default)
    for pattern, name in reversed(suppliers.items()):
        out = F.when(h.contains(pattern), name).otherwise(out)
    return out


def next_page_url(url: Column) -> Column:
    """The URL with its `p`, `page` or `paged` parameter one higher; null if it has none with a number."""
    out = F.lit(None).cast("string")
    for name in ("paged", "page", "p"):
        number = F.regexp_extract(url, rf"[?&]{name}=(\d+)(?:[&#]|$)", 1)
        raised = F.regexp_replace(url, F.lit(rf"([?&]{name}=)\d+(?=[&#]|$)"), F.concat(F.lit("$1"), F.coalesce(number.try_cast("long") + 1, F.lit(0)).cast("string")))
        out = F.when(F.coalesce(number, F.lit("")) != "", raised).otherwise(out)
    return out


def absolute_url(href: Column, base: Column) -> Column:
    """http(s) as it is, `//host` with https, `/path` on the base's host, anything else behind the base."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return (
        F.when(href.rlike("^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def local_time(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    """UTC wall clock (timestamp_ntz) to the display zone's."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
