"""Collection sessions and their items: pages, search, filters and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain, local_time

# Families that stand for all their models in the rough model count.
FAMILIES = ["iPhone", "Galaxy", "iPad", "Pixel", "OnePlus"]
INDEXED_ITEMS = 25


def newest(df: DataFrame, at: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, newest first, ties by key. Spark keeps `offset + limit` rows per task, not a sorted table."""
    return df.orderBy(F.desc(at), F.desc(key)).offset(offset).limit(limit)


def session_detail(sessions: DataFrame, items: DataFrame, session_id) -> DataFrame:
    """One session with its items in order, one row per item."""
    return sessions.where(F.col("session_id") == session_id).join(items, "session_id").orderBy("ordinal")


#: What a session's rules may say; keys that it does not name are null.
RULES = "struct<site:string,percent_off:double,absolute_off:double,category_path:string,category_urls:array<string>>"
URLS = "array<string>"


def tolerant_json(text: Column, schema: str, default: Column | None = None) -> Column:
    """The JSON value of a text; the default where there is none or it does not parse."""
    empty = F.lit(None) if default is None else default
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", schema), empty.cast(schema))


def with_json(sessions: DataFrame) -> DataFrame:
    """Sessions with their JSON columns `urls` and `rules` read: an array (empty if unreadable) and a struct."""
    return sessions.withColumns({"urls": tolerant_json(F.col("urls"), URLS, F.array()), "rules": tolerant_json(F.col("rules"), RULES)})


def as_json(sessions: DataFrame) -> DataFrame:
    """The other way: `urls` and `rules` as the JSON texts they are stored as. Texts stay, a null is JSON's; columns that are not
    there are empty."""
    kinds = dict(sessions.dtypes)
    text = lambda c: F.col(c) if kinds[c] == "string" else F.to_json(c)
    return sessions.withColumns({c: F.coalesce(text(c), F.lit("null")) if c in kinds else F.lit(none) for c, none in (("urls", "[]"), ("rules", "{}"))})


def session_report(sessions: DataFrame, items: DataFrame, session_id) -> DataFrame:
    """The summary part of a session's report as (line, value)."""
    one = session_detail(sessions, items, session_id)
    summed = one.agg(
        F.count("*").alias("items"), F.count_if(F.col("price") > 0).alias("priced"), F.bround(F.avg("price"), 2).alias("average"),
        F.min("price").alias("lowest"), F.max("price").alias("highest"), F.countDistinct("site").alias("sites"), F.bround(F.sum(F.col("price").cast("decimal(18,2)")), 2).alias("total"),
    )
    names = ["items", "priced", "average", "lowest", "highest", "sites", "total"]
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return summed.selectExpr(f"stack({len(names)}, {pairs}) as (line, value)")


# The lines of a session's exported report, and the columns of its item list.
REPORT_LINES = ["Session ID", "Timestamp", "Timezone", "URLs Crawled", "Items Captured", "Discount %", "Absolute Off"]
REPORT_ITEMS = ["title", "original_formatted", "discounted_formatted", "price_text", "price_value", "url", "source", "site", "price_currency", "image_url"]
ZONE_LABEL = "Pakistan Standard Time (UTC+05:00)"


def export_report(sessions: DataFrame, items: DataFrame, session_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A session's report: its seven lines (place, line, value), its URLs in order, and its items in order.

    sessions: session_id, ts (UTC), urls, rules, n_items, as `with_json` gives them.
    """
    one = sessions.where(F.col("session_id") == session_id)
    shown = F.concat(F.date_format(local_time(F.col("ts")), "dd MMM yyyy hh:mm a"), F.lit(" PKT"))
    number = lambda c: F.coalesce(F.col(f"rules.{c}"), F.lit(0.0)).cast("string")
    values = [F.col("session_id").cast("string"), shown, F.lit(ZONE_LABEL), F.size("urls").cast("string"), F.coalesce("n_items", F.lit(0)).cast("string"), number("percent_off"), number("absolute_off")]
    lines = one.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("line"), v.alias("value")) for n, v in zip(REPORT_LINES, values, strict=True)])).alias("place", "x")).select("place", "x.*")
    urls = one.select(F.posexplode("urls").alias("place", "url"))
    listed = items.where(F.col("session_id") == session_id)
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in items.columns else F.lit("").alias(c) for c in REPORT_ITEMS]
    return lines, urls, listed.select("ordinal", *known).orderBy("ordinal")


def search_items(items: DataFrame, sessions: DataFrame, query: str, limit: int) -> DataFrame:
    hits = items.where(F.col("title").ilike(f"%{query}%") | F.col("url").ilike(f"%{query}%"))
    return hits.join(sessions, "session_id").orderBy(F.desc("ts"), "session_id", "ordinal").limit(limit)


def search_index(items: DataFrame, most: int = INDEXED_ITEMS) -> DataFrame:
    """Per session: its hosts and a lower-case text of its first items to search in."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("ordinal") <= most, F.struct("ordinal", "title")))), 1, most)
    return items.groupBy("session_id").agg(
        F.array_sort(F.collect_set("site")).alias("hosts"), F.count("*").alias("n_items"), first.alias("first")
    ).select("session_id", "hosts", "n_items", F.lower(F.array_join(F.transform("first", lambda x: x["title"]), " ")).alias("search_text"))


def filter_sessions(
    sessions: DataFrame, text: str | None = None, first_day: Column | None = None, last_day: Column | None = None, least_items: int = 0, hosts: list[str] | None = None
) -> DataFrame:
    """Sessions (with search_text, n_items, hosts, ts) by text, local days (both inclusive), size and any of the hosts."""
    if text:
        sessions = sessions.where(F.col("search_text").contains(text.lower()))
    day = local_time(F.col("ts")).cast("date")
    if first_day is not None:
        sessions = sessions.where(day >= first_day)
    if last_day is not None:
        sessions = sessions.where(day <= last_day)
    if least_items:
        sessions = sessions.where(F.col("n_items") >= least_items)
    if hosts:
        sessions = sessions.where(F.arrays_overlap("hosts", F.array(*map(F.lit, hosts))))
    return sessions


def model_family(title: Column, families: list[str] = FAMILIES) -> Column:
    out = F.substring(title, 1, 20)
    for name in reversed(families):
        out = F.when(title.ilike(f"%{name}%"), name).otherwise(out)
    return out


def unique_models(items: DataFrame, families: list[str] = FAMILIES) -> DataFrame:
    named = items.where(F.col("title") != "")
    return named.agg(F.countDistinct(model_family(F.col("title"), families)).alias("unique_models"))


def top_site(items: DataFrame) -> DataFrame:
    counts = items.where(F.col("site") != "").groupBy("site").agg(F.count("*").alias("item_count"))
    return counts.orderBy(F.desc("item_count"), "site").limit(1)


def site_label(site: Column) -> Column:
    bare = F.regexp_replace(site, r"www\.|\.com|\.ca", "")
    first = F.split(bare, r"\.")[0]
    return F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 10_000)))


def statistics(sessions: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """One row of totals: one pass over each table. Money is summed as decimal, so the order of rows does not show."""
    valid = F.when(F.col("price") > 0, F.col("price").cast("decimal(18,2)"))
    over_items = items.agg(
        F.count("*").alias("total_items"), F.countDistinct(F.nullif("site", F.lit(""))).alias("unique_sites"), F.count(valid).alias("priced"),
        F.sum(valid).alias("total"), F.max(valid).alias("highest"), F.min(valid).alias("lowest"),
    )
    over_sessions = sessions.agg(
        F.count("*").alias("total_sessions"), F.count_if(F.col("ts") >= as_of - F.expr("interval 30 days")).alias("recent_sessions")
    )
    money = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.greatest(F.col(b), F.lit(1)).cast("double"))
    return over_sessions.crossJoin(over_items).select(
        "total_sessions", "recent_sessions", "total_items", "unique_sites",
        F.bround(ratio("total_items", "total_sessions"), 1).alias("avg_items_per_session"),
        F.bround(money("total") / F.greatest(F.col("priced"), F.lit(1)), 2).alias("avg_price"),
        F.bround(100 * ratio("priced", "total_items"), 1).alias("success_rate"),
        money("total").alias("total_value"), money("highest").alias("highest_price"), money("lowest").alias("lowest_price"),
    )


def site_totals(items: DataFrame, site: str, as_of: Column, hours: int = 24) -> DataFrame:
    """For suppliers that only have sessions: a site's items, and those of the last hours, which stand for price and for
    stock changes alike."""
    some = items.where(F.col("site").ilike(site))
    recent = F.count_if(F.col("seen_at") >= as_of - F.expr(f"interval {hours} hours"))
    return some.agg(F.count("*").alias("products"), recent.alias("price_changes"), recent.alias("stock_changes"))


def category_urls(sessions: DataFrame) -> DataFrame:
    """(session_id, site, url) for every category URL that a session's rules name."""
    return sessions.select("session_id", F.col("rules.site").alias("site"), F.explode("rules.category_urls").alias("url"))


def json_completion(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Per site what its sessions (as `with_json` gives them) set out to collect and what sessions with items did: distinct
    category paths, and distinct category URLs; the totals are 1 at least."""
    filled = items.select("session_id").distinct().withColumn("filled", F.lit(True))
    paths = sessions.select("session_id", F.col("rules.site").alias("site"), F.lit("path").alias("kind"), F.col("rules.category_path").alias("value"))
    urls = category_urls(sessions).select("session_id", "site", F.lit("url").alias("kind"), F.col("url").alias("value"))
    both = paths.unionByName(urls).where("site is not null").join(filled, "session_id", "left")
    counted = both.groupBy("site", "kind").agg(F.countDistinct("value").alias("total"), F.countDistinct(F.when(F.col("filled"), F.col("value"))).alias("completed"))
    return counted.withColumn("total", F.greatest("total", F.lit(1)))


def span_labels(sessions: DataFrame) -> DataFrame:
    """Local days of the newest and the oldest session, as shown."""
    label = lambda f, p: F.date_format(local_time(f("ts")), p)
    return sessions.agg(
        F.coalesce(label(F.max, "MMM dd"), F.lit("Never")).alias("latest_session"), F.coalesce(label(F.min, "MMM dd, yyyy"), F.lit("N/A")).alias("oldest_session")
    )


def site_options(urls: DataFrame) -> DataFrame:
    """Distinct hosts in order."""
    return urls.select(domain(F.col("url")).alias("host")).where("host <> ''").distinct().orderBy("host")


def items_bound(sizes: DataFrame) -> DataFrame:
    """Upper end of the size slider: the largest session rounded up to tens, at least 50."""
    return sizes.agg(F.greatest(F.lit(50), F.coalesce(F.ceil(F.max("n_items") / 10) * 10, F.lit(0))).cast("long").alias("bound"))


def canonical_items(rows: DataFrame, site: str, source: str, currency: str = "USD") -> DataFrame:
    """Items of the second schema (url, site, title, original, discounted and both as text, image_url) in the columns of all
    others: the price is the discounted one unless it is missing or 0, its text likewise unless blank."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(None).cast("string"))
    cut = F.col("discounted")
    return rows.select(
        "url", F.coalesce(text("site"), F.lit(site)).alias("site"), "title", F.when(F.coalesce(cut != 0, F.lit(False)), cut).otherwise(F.col("original")).alias("price_value"),
        F.lit(currency).alias("price_currency"), F.coalesce(text("discounted_formatted"), F.col("original_formatted")).alias("price_text"), cut.alias("discounted_value"),
        "discounted_formatted", "original_formatted", F.lit(source).alias("source"), "image_url",
    )


def supplier_items(suppliers: list[DataFrame]) -> DataFrame:
    """Items of several suppliers as one table; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), suppliers)
