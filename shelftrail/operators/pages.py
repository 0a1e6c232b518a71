"""Saved pages to columns, where one pattern says the rule: all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_price
from ..functions.stock import availability_status, stock_status, stock_status_of_flag
from ..functions.text import clean_text
from ..functions.urls import absolute_url, next_page_url
from .catalog import first_wins

# What challenge pages of a well-known protection service say; the last three are strong signs.
CHALLENGE_SIGNS = [
    "checking your browser before accessing", "cf-browser-verification", "cf-error-details", "__cf_chl_jschl_tk__", "challenge-platform",
    "please wait while we check your browser",
]
STRONG_SIGNS = ["checking your browser", "challenge-platform", "cf-browser-verification"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column, quote: str = '"') -> Column:
    """`quote` is what `&quot;` becomes: a caller whose SQL writes it otherwise says so."""
    for entity, char in (ENTITIES | {"&quot;": quote}).items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def inner_text(html: Column, quote: str = '"') -> Column:
    return clean_text(unescape(F.regexp_replace(html, "<[^>]*>", " "), quote))


def _first_match(html: Column, patterns: list[str], quote: str = '"') -> Column:
    return F.coalesce(*[F.nullif(inner_text(F.regexp_extract(html, p, 1), quote), F.lit("")) for p in patterns])


def is_challenge(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    some, strong = F.lit(False), F.lit(False)
    for s in CHALLENGE_SIGNS:
        some = some | low.contains(s)
    for s in STRONG_SIGNS:
        strong = strong | low.contains(s)
    return some & strong


def page_kind(html: Column) -> Column:
    product = html.rlike(r'(?i)<h1[^>]*class="[^"]*\b(page-title|product)\b') | html.rlike(r'"@type"\s*:\s*"Product"')
    listing = html.rlike(r'(?i)<li[^>]*class="[^"]*\b(item|product-item|product)\b|<div[^>]*class="[^"]*\b(product-item-info|product-card)\b')
    return F.when(product, "product").when(listing, "category").otherwise("default")


def page_title(html: Column, quote: str = '"') -> Column:
    heads = [r'(?is)<h1[^>]*class="[^"]*page-title[^"]*"[^>]*>(.*?)</h1>', r'(?is)<span[^>]*data-ui-id="page-title-wrapper"[^>]*>(.*?)</span>', r'(?is)<h1[^>]*class="[^"]*product[^"]*"[^>]*>(.*?)</h1>', r"(?is)<h1[^>]*>(.*?)</h1>"]
    return F.coalesce(_first_match(html, [*heads, r'(?i)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'], quote), F.lit(""))


def canonical_url(html: Column, url: Column) -> Column:
    found = [F.regexp_extract(html, p, 1) for p in (r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]+)"', r'(?i)<meta[^>]*property="og:url"[^>]*content="([^"]+)"')]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in found], url)


def image_url(html: Column) -> Column:
    """Of the first image that has a `data-src`, or else a `srcset`, or else a `src`: its `data-src` or `src`."""
    tags = [F.regexp_extract(html, rf'(?i)<img[^>]*\s{a}="[^"]+"[^>]*>', 0) for a in ("data-src", "srcset", "src")]
    first = F.coalesce(*[F.nullif(t, F.lit("")) for t in tags])
    found = [F.nullif(F.regexp_extract(first, rf'(?i)\s{a}="([^"]+)"', 1), F.lit("")) for a in ("data-src", "src")]
    return F.coalesce(*found, F.lit(""))


def page_facts(pages: DataFrame, quote: str = '"') -> DataFrame:
    """One row per page: url, canonical_url, title, kind, challenged, image_url."""
    html, url = F.col("html"), F.col("url")
    return pages.select(
        "page_id", "url", canonical_url(html, url).alias("canonical_url"), page_title(html, quote).alias("title"), page_kind(html).alias("kind"),
        is_challenge(html).alias("challenged"), image_url(html).alias("image_url"),
    )


ANCHOR = r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'


def links(pages: DataFrame, quote: str = '"') -> DataFrame:
    """One row per anchor of each page: page_id, position, url (absolute), label."""
    found = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("position", "anchor"))
    href = unescape(F.regexp_extract("anchor", r'(?is)href="([^"]*)"', 1))
    return found.select("page_id", "position", absolute_url(href, F.col("base")).alias("url"), inner_text(F.col("anchor"), quote).alias("label"))


def category_links(pages: DataFrame, pattern: str, quote: str = '"') -> DataFrame:
    """Distinct link targets that contain `pattern`, each with the label it had first."""
    some = links(pages, quote).where(F.col("url").contains(pattern) & (F.col("label") != ""))
    return first_wins(some, ["url"], ["page_id", "position"]).select("url", "label")


# How pages mark the link to the next one: by relation, by class, by title, or by the list item around it.
NEXT_LINKS = [
    r'(?is)<li[^>]*class="[^"]*\bpages-item-next\b[^"]*"[^>]*>\s*(<a\s[^>]*>)', r'(?is)(<a\s[^>]*class="[^"]*\bnext\b[^"]*"[^>]*>)', r'(?is)(<a\s[^>]*rel="next"[^>]*>)',
    r'(?is)<[^a][^>]*class="[^"]*\bnext\b[^"]*"[^>]*>\s*(<a\s[^>]*>)', r'(?is)(<a\s[^>]*title="[^"]*Next[^"]*"[^>]*>)',
]


def next_link(html: Column, url: Column) -> Column:
    """The page's own link to the next page, absolute; null if it has none."""
    hrefs = [F.nullif(F.regexp_extract(F.regexp_extract(html, p, 1), r'(?is)\shref="([^"]+)"', 1), F.lit("")) for p in NEXT_LINKS]
    return absolute_url(unescape(F.coalesce(*hrefs)), url)


def next_page(html: Column, url: Column) -> Column:
    """The page's own next link, or else the URL with its page number raised."""
    return F.coalesce(next_link(html, url), next_page_url(url))


def following_page(html: Column, url: Column, cards: Column) -> Column:
    """The next page of a listing: its own link, or else, where the page says or seems to have more, the next number."""
    added = F.concat(url, F.when(url.contains("?"), "&p=2").otherwise("?p=2"))
    return F.coalesce(next_link(html, url), F.when(has_more(html, cards), F.coalesce(next_page_url(url), added)))


def has_more(html: Column, cards: Column, full_page: int = 20) -> Column:
    """By the toolbar's `a-b of n`, or else by a full page of cards."""
    last, total = (F.regexp_extract(html, r"(\d+)\s*-\s*(\d+)\s+of\s+(\d+)", i).try_cast("int") for i in (2, 3))
    return F.coalesce(last < total, cards >= full_page)


# Where pages and scripts name the address of more items.
LOAD_MORE = [r'"loadMoreUrl"\s*:\s*"([^"]+)"', r'"nextUrl"\s*:\s*"([^"]+)"', r"'loadMoreUrl'\s*:\s*'([^']+)'", r'data-load-more-url="([^"]+)"', r'data-next-url="([^"]+)"']


def _addresses(found: Column, url: Column) -> Column:
    """Array of addresses as scripts and attributes write them, made absolute, each once."""
    clean = F.transform(found, lambda x: F.trim(F.replace(unescape(x), F.lit("\\/"), F.lit("/"))))
    return F.array_distinct(F.transform(F.filter(clean, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: absolute_url(x, url)))


def load_more_urls(html: Column, url: Column) -> Column:
    return _addresses(F.concat(*[F.regexp_extract_all(html, F.lit("(?i)" + p), 1) for p in LOAD_MORE]), url)


# Keys of the answers that carry more items: the fragment, one address, lists of addresses.
FRAGMENT_KEYS = ["items_html", "html", "content"]
NEXT_KEYS = ["next_url", "nextUrl", "loadMoreUrl", "load_more_url"]
MORE_KEYS = ["additional_urls", "more_urls", "urls"]


def load_more_answers(answers: DataFrame) -> DataFrame:
    """Answers (page_id, url, body) to load-more requests as pages: page_id, url, html, urls. A body that is a JSON object
    gives its fragment and the addresses it names, any other is the fragment itself; addresses in the fragment follow."""
    text = lambda k: F.nullif(F.trim(F.try_variant_get("v", f"$.{k}", "string")), F.lit(""))
    each = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "array<string>"), F.array().cast("array<string>"))
    body = F.trim(F.coalesce("body", F.lit("")))
    read = answers.select("page_id", "url", body.alias("body"), F.when(body.startswith("{"), F.try_parse_json(body)).alias("v"))
    named = F.concat(F.array(*map(text, NEXT_KEYS)), *map(each, MORE_KEYS))
    html = F.coalesce(*map(text, FRAGMENT_KEYS), F.col("body"))
    out = read.select("page_id", "url", html.alias("html"), _addresses(named, F.col("url")).alias("named"))
    return out.select("page_id", "url", "html", F.array_distinct(F.concat("named", load_more_urls(F.col("html"), F.col("url")))).alias("urls"))


SITEMAP_PART = "/replacement-parts/"


def sitemap_categories(entries: DataFrame, part: str = SITEMAP_PART) -> DataFrame:
    """Sitemap entries (loc) of categories, labelled from the last part of the path."""
    slug = F.element_at(F.filter(F.split("loc", "/"), lambda x: x != ""), -1)
    return entries.where(F.col("loc").contains(part)).select(F.col("loc").alias("url"), F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))).alias("label"))


JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def structured_products(html: Column) -> Column:
    """The Product objects of a page's structured data (object, list or @graph) in order, as array<variant>."""
    blocks = F.transform(F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1)), lambda b: F.try_parse_json(F.trim(b)))
    each = F.flatten(F.transform(F.filter(blocks, lambda v: v.isNotNull()), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    none = F.array().cast("array<variant>")
    graph = F.flatten(F.transform(each, lambda v: F.concat(F.array(v), F.coalesce(F.try_variant_get(v, '$["@graph"]', "array<variant>"), none))))
    return F.filter(graph, lambda v: F.try_variant_get(v, '$["@type"]', "string") == "Product")


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _status(v: Column, key: str, of_text) -> Column:
    """Status of a flag or a text under a key."""
    flag = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "BOOLEAN", F.try_variant_get(v, f"$.{key}", "boolean"))
    return F.coalesce(stock_status_of_flag(flag), of_text(_text(v, key)))


def offers_of(product: Column) -> Column:
    """The offers of a product, each followed by the offers inside it, as array<variant>."""
    none = F.array().cast("array<variant>")

    def listed(v: Column) -> Column:
        inner = F.try_variant_get(v, "$.offers", "variant")
        return F.when(inner.isNull(), none).otherwise(F.coalesce(F.try_variant_get(v, "$.offers", "array<variant>"), F.array(inner)))

    return F.flatten(F.transform(listed(product), lambda o: F.concat(F.array(o), listed(o))))


def _offer_price(o: Column) -> Column:
    return F.coalesce(_text(o, "price").try_cast("double"), parse_price(_text(o, "price")))


def _offer_status(o: Column) -> Column:
    named = [_status(o, "availability", availability_status), _status(o, "availabilityText", availability_status)]
    return F.coalesce(*named, *[_status(o, k, stock_status) for k in ("inStock", "isInStock", "available", "availabilityValue")])


def _first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def product_facts(product: Column) -> Column:
    """struct(name, price, currency, stock_status) of a structured-data product; each from the first offer that tells it."""
    offers = offers_of(product)
    priced = F.get(F.filter(offers, lambda o: _offer_price(o).isNotNull()), F.lit(0))
    return F.struct(
        clean_text(_text(product, "name")).alias("name"), _offer_price(priced).alias("price"), _text(priced, "priceCurrency").alias("currency"),
        _first_of(F.transform(offers, _offer_status)).alias("stock_status"),
    )


def jsonld_products(pages: DataFrame) -> DataFrame:
    """One row per Product of the pages' structured data: page_id, name, price, currency, stock_status."""
    found = pages.select("page_id", F.explode(structured_products(F.col("html"))).alias("v"))
    return found.select("page_id", product_facts(F.col("v")).alias("x")).select("page_id", "x.*")


def backfill_stock(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items without a status take it from the saved page of their URL, read once per URL."""
    missing = items.where("stock_status is null").select("url").distinct()
    found = pages.join(missing, "url").select("url", stock_status(inner_text(F.col("html"))).alias("found"))
    found = found.groupBy("url").agg(F.max("found").alias("found"))
    return items.join(found, "url", "left").withColumn("stock_status", F.coalesce("stock_status", "found")).drop("found")
