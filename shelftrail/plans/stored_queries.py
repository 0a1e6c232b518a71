"""Queries over what sessions and runs store as JSON, their reports, completion, and the orders of the result list."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import change as C
from ..operators import day_tables as D
from ..operators import partials as P
from ..operators import results as E
from ..operators import runs as U
from ..operators import sessions as S
from ..operators.ranking import ranked
from ..operators.search_index import SearchIndex
from ..sources import readers as R
from ..sources.writers import save_session
from .registry import query
from .tables import ITEMS_SQL, PRODUCTS_SQL, dimensions, items, newest, price_history, products, scratch, table

#: Orders as stored sessions: every eleventh has unreadable JSON, every third names its URLs by number of the customer.
STORED_SQL = """stored AS (
  SELECT o_orderkey AS session_id, o_orderdate AS ts, o_orderkey % 11 = 0 AS broken, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS site,
         o_custkey % 4 AS n_urls, o_orderpriority AS path, o_custkey
  FROM orders
)"""


def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = lambda i: F.concat(F.lit("https://shop.example/c/"), (F.col("o_custkey") + i).cast("string"))
    urls = F.slice(F.array(url(0), url(1), url(2)), 1, (F.col("o_custkey") % 4).cast("int"))
    second = F.col("o_orderkey") % 3 == 0
    rules = F.struct(
        F.when(second, "second").otherwise("first").alias("site"), (F.col("o_custkey") % 30).cast("double").alias("percent_off"), F.when(~second, F.col("o_orderpriority")).alias("category_path"),
        F.when(second, urls).alias("category_urls"),
    )
    broken = F.col("o_orderkey") % 11 == 0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("ts"), F.when(broken, "[oops").otherwise(F.to_json(urls)).alias("urls"),
        F.when(broken, "oops").otherwise(F.to_json(rules)).alias("rules"),
    )


@query(f"""WITH {STORED_SQL} SELECT session_id, epoch_ms(ts) AS epoch_ms, CASE WHEN broken THEN 0 ELSE least(n_urls, 3) END AS n_urls,
  CASE WHEN NOT broken AND n_urls > 0 THEN 'https://shop.example/c/' || o_custkey END AS first_url, site, CASE WHEN NOT broken THEN CAST(o_custkey % 30 AS DOUBLE) END AS percent_off
FROM stored ORDER BY ts DESC, session_id DESC LIMIT 200 OFFSET 20""")
def session_json_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = S.with_json(S.newest(stored_sessions(spark, sf_dir), "ts", "session_id", 200, 20))
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) * 1000
    return page.select("session_id", at.alias("epoch_ms"), F.size("urls").alias("n_urls"), F.get("urls", F.lit(0)).alias("first_url"), "rules.site", "rules.percent_off")


@query(f"""WITH {STORED_SQL} SELECT site, 'https://shop.example/c/' || (o_custkey + i) AS url, count(*) AS n FROM stored, unnest(range(3)) AS t(i)
WHERE site = 'second' AND i < n_urls GROUP BY ALL""")
def session_category_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.category_urls(S.with_json(stored_sessions(spark, sf_dir))).groupBy("site", "url").agg(F.count("*").alias("n"))


@query(f"""WITH {STORED_SQL}, filled AS (SELECT DISTINCT l_orderkey AS session_id FROM lineitem WHERE l_quantity > 45), v AS (
  SELECT session_id, site, 'path' AS kind, CASE WHEN site = 'first' THEN path END AS value FROM stored WHERE site IS NOT NULL
  UNION ALL SELECT session_id, site, 'url', 'https://shop.example/c/' || (o_custkey + i) FROM stored, unnest(range(3)) AS t(i) WHERE site = 'second' AND i < n_urls
)
SELECT site, kind, greatest(1, count(DISTINCT value)) AS total, count(DISTINCT value) FILTER (f.session_id IS NOT NULL) AS completed FROM v LEFT JOIN filled f USING (session_id) GROUP BY site, kind""")
def session_json_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("session_id"))
    return S.json_completion(S.with_json(stored_sessions(spark, sf_dir)), listed)


@query(f"WITH {STORED_SQL} SELECT site, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, sum(least(n_urls, 3))::BIGINT AS urls FROM stored WHERE NOT broken GROUP BY ALL")
def session_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions stored with JSON columns and read back."""
    held = S.with_json(stored_sessions(spark, sf_dir)).where("rules is not null")
    path = scratch(spark, "json_sessions")
    save_session(held, held.select("session_id", "ts"), path)
    back = S.with_json(spark.read.parquet(f"{path}/sessions"))
    return back.groupBy("rules.site", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum(F.size("urls")).alias("urls"))


@query(f"""WITH {ITEMS_SQL}, {STORED_SQL}, one AS (SELECT * FROM stored WHERE session_id = 7), lines AS (
  SELECT 'Session ID' AS line, '7' AS value, 0 AS place FROM one UNION ALL SELECT 'Timestamp', strftime(ts + INTERVAL 5 HOUR, '%d %b %Y %I:%M %p PKT'), 1 FROM one
  UNION ALL SELECT 'Timezone', 'Pakistan Standard Time (UTC+05:00)', 2 FROM one UNION ALL SELECT 'URLs Crawled', CAST(least(n_urls, 3) AS VARCHAR), 3 FROM one
  UNION ALL SELECT 'Items Captured', (SELECT count(*) FROM lineitem WHERE l_orderkey = 7)::VARCHAR, 4 FROM one UNION ALL SELECT 'Discount %', CAST(o_custkey % 30 AS DOUBLE)::VARCHAR, 5 FROM one UNION ALL SELECT 'Absolute Off', '0.0', 6 FROM one
)
SELECT 'summary' AS part, CAST(place AS BIGINT) AS place, line, value FROM lines
UNION ALL SELECT 'urls', i, 'url', 'https://shop.example/c/' || (o_custkey + i) FROM one, unnest(range(3)) AS t(i) WHERE i < n_urls
UNION ALL SELECT 'items', ordinal, title, '$' || format('{{:,.2f}}', CAST(original AS DOUBLE)) || '|' || url || '|' || site || '||' FROM items WHERE session_id = 7""")
def session_export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = S.with_json(stored_sessions(spark, sf_dir))
    counts = table(spark, sf_dir, "lineitem").where("l_orderkey = 7").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count("*").alias("n_items"))
    lines, urls, listed = S.export_report(held.join(counts, "session_id", "left"), items(spark, sf_dir), 7)
    place = F.col("place").cast("long").alias("place")
    shown = F.concat_ws("|", "original_formatted", "url", "site", "price_currency", "image_url").alias("value")
    return (
        lines.select(F.lit("summary").alias("part"), place, "line", "value")
        .unionByName(urls.select(F.lit("urls").alias("part"), place, F.lit("url").alias("line"), F.col("url").alias("value")))
        .unionByName(listed.select(F.lit("items").alias("part"), F.col("ordinal").alias("place"), F.col("title").alias("line"), shown))
    )


@query("SELECT event_id AS run_id, event_type AS status, CAST(ts AS VARCHAR) AS started_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.col("props").alias("details"))
    return U.recent_runs(runs, 40, "struct<k:bigint>").select("run_id", "status", F.col("started_at").cast("string"), "details.k")


@query(f"""WITH {STORED_SQL} SELECT 'third' AS client, CAST(max(ts) AS VARCHAR) AS last_run FROM events WHERE event_type = 'purchase'
UNION ALL SELECT site, CAST(max(ts) AS VARCHAR) FROM stored WHERE site IS NOT NULL GROUP BY site""")
def last_run_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    runs = events.select(F.lit("third").alias("client"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), F.col("ts").alias("started_at"))
    out = U.last_run_by_client(runs, S.with_json(stored_sessions(spark, sf_dir)), ["third"])
    return out.select("client", F.col("last_run").cast("string"))


@query(f"""WITH {PRODUCTS_SQL}, n AS (SELECT max(ts) AS newest FROM events), r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT (SELECT count(*) FROM region) AS brands, (SELECT count(*) FROM nation) AS categories, (SELECT count(*) FROM customer) AS models, count(*) AS products,
  round_even(CAST(sum(CAST(price AS DECIMAL(18,2))) FILTER (price > 0) AS DOUBLE) / count(*) FILTER (price > 0), 2) AS avg_price, count_if(stock_status = 'In Stock') AS in_stock,
  (SELECT count(DISTINCT user_id) FROM events, n WHERE ts >= newest - INTERVAL 7 DAY) AS priced, (SELECT count(*) FROM events, n WHERE ts >= newest - INTERVAL 7 DAY) AS runs,
  (SELECT event_type FROM r) AS last_status, (SELECT CAST(ts AS VARCHAR) FROM r) AS last_started, (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM r) AS last_products FROM products""")
def catalog_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, categories, brands = dimensions(spark, sf_dir)
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.get_json_object("props", "$.k").try_cast("long").alias("total_products")
    )
    known = {"brands": brands, "categories": categories, "models": models}
    out = U.catalog_statistics(known, products(spark, sf_dir), price_history(spark, sf_dir), runs, newest(spark, sf_dir, "events", "ts"), "In Stock")
    return out.withColumn("last_started", F.col("last_started").cast("string"))


@query(f"""WITH {ITEMS_SQL}, n AS (SELECT max(l_shipdate) AS newest FROM lineitem) SELECT count(*) AS products, count_if(seen_at >= newest - INTERVAL 480 HOUR) AS price_changes,
  count_if(seen_at >= newest - INTERVAL 480 HOUR) AS stock_changes FROM items, n WHERE site ILIKE '%siter%'""")
def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.site_totals(items(spark, sf_dir), "%siteR%", newest(spark, sf_dir, "lineitem", "l_shipdate"), 480)


_LISTED_SQL = f"""{ITEMS_SQL}, listed AS (
  SELECT ordinal, title || ' ' || (ordinal % 37) AS title, site, CASE WHEN ordinal % 97 <> 0 THEN CAST(original AS DOUBLE) END AS o, CASE WHEN ordinal % 97 <> 0 THEN CAST(final AS DOUBLE) END AS f,
         lower(title || ' ' || lpad((ordinal % 37)::VARCHAR, 12, '0')) AS natural_title FROM items
), shown AS (SELECT *, CASE WHEN o > 0 THEN round_even((o - f) / o * 100, 2) END AS d FROM listed)"""
_ORDERS = {"final": "f", "original": "o", "discount": "coalesce(d, 0)", "title": "natural_title", "source": "lower(site)"}


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with numbered titles, every 97th without prices."""
    priced = F.col("ordinal") % 97 != 0
    blank = {c: F.when(priced, F.col(c)).otherwise("") for c in ("original_formatted", "discounted_formatted")}
    return items(spark, sf_dir).withColumns(blank | {"title": F.concat("title", F.lit(" "), (F.col("ordinal") % 37).cast("string"))})


@query(f"WITH {_LISTED_SQL} " + " UNION ALL ".join(
    f"(SELECT '{name}-{way}' AS sorted, row_number() OVER (ORDER BY {by} {way} NULLS LAST, ordinal) AS position, ordinal FROM shown ORDER BY position LIMIT 12)" for name, by in _ORDERS.items() for way in ("asc", "desc")
))
def result_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the list in each of its ten orders."""
    orders = [f"{name}-{way}" for name in _ORDERS for way in ("asc", "desc")]
    return E.heads(E.enrich(_listed(spark, sf_dir)), 12, orders, scratch(spark, "heads"))


#: A page number that no list reaches, however large the tables are.
_BEYOND = 1 << 62


@query(f"WITH {_LISTED_SQL}, last AS (SELECT greatest(0, ((count(*) - 1) // 50) * 50) AS skip FROM shown WHERE f > 99000) SELECT ordinal, title, row_number() OVER (ORDER BY f DESC, ordinal) AS position FROM shown WHERE f > 99000 QUALIFY position > (SELECT skip FROM last)")
def result_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page number beyond the end is the last page."""
    rows = E.price_filter(E.priced(_listed(spark, sf_dir)), 99000.01, None).select("ordinal", "title", "final")
    return E.deep_page(rows, _BEYOND, 50, "final-desc", scratch(spark, "ranked")).select("ordinal", "title", "position")


@query(f"WITH {_LISTED_SQL}, r AS (SELECT ordinal, title, d, row_number() OVER (ORDER BY coalesce(d, 0) DESC, ordinal) AS position, count(*) OVER () AS n FROM shown) SELECT ordinal, title, position FROM r WHERE position > 50 * (n // 100) AND position <= 50 * (n // 100) + 50")
def result_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of the whole list, by discount, where thousands of rows share a value."""
    rows = E.enrich(_listed(spark, sf_dir)).select("ordinal", "title", "discount_percent")  # all that the order and the page need
    listed = ranked(rows, E.order_columns("discount-desc"), scratch(spark, "ranked"))
    return listed.page(listed.total // 100 + 1, 50).select("ordinal", "title", "position")


@query(f"WITH {_LISTED_SQL} SELECT ordinal, row_number() OVER (ORDER BY f NULLS LAST, ordinal) AS position FROM shown")
def result_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row in the list."""
    return ranked(E.priced(_listed(spark, sf_dir)).select("final", "ordinal"), E.order_columns("final-asc"), scratch(spark, "ranked")).all().select("ordinal", "position")


@query(f"""WITH {_LISTED_SQL}, m AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'a' || (p_size % 90 + 10) ELSE '' END AS code FROM part),
n AS (SELECT p_partkey, CASE WHEN code = '' THEN p_name ELSE p_name || ' ' || code END AS title, CASE WHEN code = '' THEN p_name ELSE code END AS model, code FROM m)
SELECT p_partkey AS ordinal, row_number() OVER (ORDER BY regexp_replace(model, '(\\d+)', '0000000000\\1'), title, p_partkey) AS position FROM n ORDER BY position LIMIT 60""")
def results_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by model, then by title."""
    size = F.col("p_size")
    code = F.when(size % 3 == 0, F.concat(F.lit("a"), (size % 90 + 10).cast("string")))
    listed = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.concat_ws(" ", "p_name", code).alias("title"), F.lit("s").alias("site"), F.lit("u").alias("url"),
        F.lit("$1.00").alias("original_formatted"), F.lit("").alias("discounted_formatted"), F.lit("yes").alias("stock_status"),
    )
    return E.page(E.enrich(listed), 1, 60, "model-asc").select("ordinal", "position")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size % 4 = 0, CASE WHEN p_size % 4 = 0 THEN '' ELSE lower(p_name) END, p_partkey) AS position FROM part ORDER BY position DESC LIMIT 80""")
def blank_titles_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_name")).alias("title"))
    blank, text = E.blanks_last(F.col("title"))
    total = part.agg(F.count("*").alias("n"))
    # the end of the list, taken from its end: a top-k, not a sorted table
    tail = part.orderBy((F.trim("title") == "").desc(), F.lower(F.trim("title")).desc(), F.desc("p_partkey")).limit(80)
    place = F.row_number().over(Window.orderBy(blank, text, "p_partkey"))
    return tail.withColumn("_at", place).crossJoin(total).select("p_partkey", (F.col("n") - F.count("*").over(Window.partitionBy()) + F.col("_at")).alias("position"))


@query(f"""WITH {ITEMS_SQL}, s AS (SELECT p_name AS title, arg_max(CAST(p_retailprice AS DOUBLE), p_partkey) AS p FROM part GROUP BY 1)
SELECT ordinal, round_even(CAST(original AS DOUBLE) - p, 2) AS delta, round_even((CAST(original AS DOUBLE) - p) / p * 100, 2) AS delta_percent FROM items JOIN s USING (title) WHERE final > 95000""")
def compare_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("title"), F.lit("").alias("site"), F.lit("").alias("url"), F.col("p_retailprice").alias("price"))
    return E.results(items(spark, sf_dir), E.ResultOptions(least=95000.01), sheet).select("ordinal", "delta", "delta_percent")


_BADGES = {
    ("sold out", "in stock"): "restocked", ("yes", "oos"): "out", ("yes", "preorder"): "backorder", ("gone", ""): "removed", ("", "some"): "added", ("In Stock", "in stock"): "updated",
}


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BADGES.values())) + " END AS badge FROM events")
def stock_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("event_id") % len(_BADGES) + 1).cast("int")
    old, new = (F.element_at(F.array(*[F.lit(p[k]) for p in _BADGES]), at) for k in (0, 1))
    return table(spark, sf_dir, "events").select("event_id", C.stock_badge(old, new).alias("badge"))


#: An event's session is named by its user; the cut lies in the middle of a day.
_CUT_SQL = "cut AS (SELECT date_trunc('day', max(ts)) - INTERVAL 10 DAY + INTERVAL 9 HOUR AS cut_at FROM events)"


def _cut(spark: SparkSession, sf_dir: str) -> dt.datetime:
    newest_day = table(spark, sf_dir, "events").agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz")).first()[0]
    return newest_day - dt.timedelta(days=10) + dt.timedelta(hours=9)


@query(f"WITH {_CUT_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, (SELECT count(*) FROM events WHERE ts < (SELECT cut_at FROM cut)) AS removed FROM events WHERE ts >= (SELECT cut_at FROM cut) GROUP BY 1")
def purge_stored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by day and purged up to a time: whole days are dropped, one day is written again."""
    path = scratch(spark, "days")
    D.write_days(table(spark, sf_dir, "events"), "ts", path)
    removed = sum(D.purge_days(spark, path, "ts", _cut(spark, sf_dir)).values())
    left = spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))
    return left.withColumn("removed", F.lit(removed).cast("long"))


@query("""WITH t AS (SELECT min(l_orderkey) AS k FROM lineitem) SELECT CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS day, count(*) AS rows, (SELECT count(*) FROM lineitem, t WHERE l_orderkey = k) AS removed
FROM lineitem JOIN orders ON o_orderkey = l_orderkey, t WHERE l_orderkey <> k GROUP BY 1""")
def session_delete_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session deleted from items stored by day."""
    path = scratch(spark, "sessions")
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.date_trunc("quarter", "o_orderdate").alias("ts"))
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_extendedprice").alias("price"))
    save_session(known, listed.join(known, "session_id"), path)
    removed = D.delete_session(spark, path, listed.agg(F.min("session_id")).first()[0])
    left = spark.read.parquet(f"{path}/items").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))
    return left.withColumn("removed", F.lit(removed).cast("long"))


@query("""WITH w AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 14)
SELECT event_type AS site, count(*) AS rows, round(sum(value), 2) AS total, count(DISTINCT event_id) AS events, count(DISTINCT user_id) AS users, TRUE AS events_close, TRUE AS users_close FROM w GROUP BY 1""")
def window_from_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks added up from daily partials: sums are those of the rows, estimates within five deviations of the exact numbers."""
    events, path = table(spark, sf_dir, "events").withColumn("site", F.col("event_type")), scratch(spark, "partials")
    day = F.to_date("ts")
    told = lambda rows: P.daily_partials(rows, "ts", ["site"], {"rows": F.lit(1).cast("long"), "total": F.col("value")}, {"events": F.col("event_id"), "users": F.col("user_id")})
    last = events.agg(F.max(day)).first()[0]
    P.store_partials(told(events.where(day < F.lit(last))), path)
    P.store_partials(told(events.where(day == F.lit(last))), path)  # a later run adds the day that was missing
    first = F.lit(last - dt.timedelta(days=13))
    found = P.merged(spark.read.parquet(path), ["site"], ["rows", "total"], ["events", "users"], first)
    exact = events.where(day >= first).groupBy("site").agg(F.countDistinct("event_id").alias("e"), F.countDistinct("user_id").alias("u"))
    close = lambda estimate, n: F.abs(F.col(estimate) - F.col(n)) <= 5 * P.ERROR * F.col(n) + 1
    return found.join(exact, "site").select(
        "site", "rows", F.round("total", 2).alias("total"), F.col("e").alias("events"), F.col("u").alias("users"), close("events", "e").alias("events_close"), close("users", "u").alias("users_close")
    )


_TERMS = ("widget", "CON_M%", "RED b", "lt")


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, p_partkey, p_name FROM part WHERE p_name ILIKE '%{t}%' OR p_type ILIKE '%{t}%'" for t in _TERMS))
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring searches through a trigram index; a term without three characters in a row is a scan."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    index = SearchIndex(spark, scratch(spark, "index"), "p_partkey", ("p_name", "p_type"), 8).build(parts)
    found = [index.search(term).select(F.lit(term).alias("term"), "p_partkey", "p_name") for term in _TERMS]
    return reduce(DataFrame.unionByName, found)


@query("""WITH f AS (SELECT DISTINCT p_size, p_size % 3 AS k FROM part) SELECT CASE k WHEN 0 THEN 'GIF' WHEN 1 THEN 'WEBP' END AS format, count(*) AS processed,
  CASE WHEN k < 2 THEN count(*) ELSE 0 END AS successful, CASE WHEN k < 2 THEN 0 ELSE count(*) END AS failed FROM f GROUP BY k""")
def image_file_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, one per size of part, of which two formats are known: counted from their first twelve bytes."""
    head = F.element_at(F.array(F.lit("GIF89a"), F.lit("RIFF0000WEBPVP8 "), F.lit("plain words")), (F.col("p_size") % 3 + 1).cast("int"))
    path = scratch(spark, "images")
    lines = table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.concat(head, F.col("p_name")).alias("value"))
    lines.repartition(8, "size").write.partitionBy("size").text(path)
    return R.image_census(spark, path)
