"""Queries over sessions, items, results and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..functions.urls import local_time, route, source_label
from ..operators import changes as G
from ..operators import results as E
from ..operators import retention as R
from ..operators import runs as U
from ..operators import sessions as S
from ..operators.compare import with_compare_price
from ..sources.readers import comparison_sheet
from ..sources.writers import export_results, export_watchlist, save_session
from .registry import query
from .tables import ITEMS_SQL, items, listed_lines, listings, scratch, sessions, table


@query("SELECT o_orderkey AS session_id, CAST(o_orderdate AS VARCHAR) AS ts, epoch_ms(o_orderdate) AS epoch_ms FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.newest(sessions(spark, sf_dir), "ts", "session_id", 25, 50)
    micros = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return out.select("session_id", F.col("ts").cast("string"), (micros * 1000).alias("epoch_ms"))


@query(f"WITH {ITEMS_SQL} SELECT ordinal, title, price, url FROM items WHERE session_id = (SELECT max(l_orderkey) FROM lineitem)")
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = items(spark, sf_dir)
    last = listed.agg(F.max("session_id").alias("session_id"))
    return listed.join(last, "session_id", "left_semi").orderBy("ordinal").select("ordinal", "title", "price", "url")


@query(f"""WITH {ITEMS_SQL}, one AS (SELECT i.* FROM items i JOIN orders ON o_orderkey = session_id WHERE session_id = 7)
SELECT 'items' AS line, CAST(count(*) AS DOUBLE) AS value FROM one UNION ALL SELECT 'priced', CAST(count_if(price > 0) AS DOUBLE) FROM one
UNION ALL SELECT 'average', round_even(avg(price), 2) FROM one UNION ALL SELECT 'lowest', min(price) FROM one UNION ALL SELECT 'highest', max(price) FROM one
UNION ALL SELECT 'sites', CAST(count(DISTINCT site) AS DOUBLE) FROM one UNION ALL SELECT 'total', CAST(sum(original) AS DOUBLE) FROM one""")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_report(sessions(spark, sf_dir), items(spark, sf_dir), 7)


@query(f"""WITH {ITEMS_SQL} SELECT session_id, ordinal, title, price FROM items JOIN orders ON o_orderkey = session_id WHERE title ILIKE '%red%' OR url ILIKE '%red%'
ORDER BY o_orderdate DESC, session_id, ordinal LIMIT 100""")
def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_items(items(spark, sf_dir), sessions(spark, sf_dir), "RED", 100).select("session_id", "ordinal", "title", "price")


@query(f"WITH {ITEMS_SQL} SELECT session_id, ordinal, site, price, 'price' AS change_type FROM items WHERE site ILIKE '%siter%'")
def legacy_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.legacy_feed(items(spark, sf_dir), "%siteR%").select("session_id", "ordinal", "site", "price", "change_type")


@query(f"WITH {ITEMS_SQL} SELECT site, count(*) AS total, count_if(seen_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY) AS recent FROM items GROUP BY site")
def site_proxy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = items(spark, sf_dir)
    at = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("as_of"))
    return listed.crossJoin(at).groupBy("site").agg(F.count("*").alias("total"), F.count_if(F.col("seen_at") >= F.col("as_of") - F.expr("interval 1 day")).alias("recent"))


@query(f"""WITH {ITEMS_SQL}, x AS (
  SELECT session_id, count(*) AS n_items, list_sort(list(DISTINCT site)) AS hosts FROM items GROUP BY 1
), y AS (
  SELECT session_id, lower(string_agg(title, ' ' ORDER BY ordinal)) AS search_text FROM items WHERE ordinal % 10 <= 25 GROUP BY 1
)
SELECT session_id, n_items, array_to_string(hosts, ',') AS hosts FROM x JOIN y USING (session_id) JOIN orders ON o_orderkey = session_id
WHERE contains(search_text, 'bolt') AND CAST(o_orderdate + INTERVAL 5 HOUR AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' AND n_items >= 4 AND list_has_any(hosts, ['sitea.example', 'siter.example'])""")
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = items(spark, sf_dir).withColumn("key", F.col("ordinal"))
    index = S.search_index(listed.withColumn("ordinal", F.pmod("ordinal", F.lit(10))))
    found = S.filter_sessions(index.join(sessions(spark, sf_dir), "session_id"), "Bolt", F.lit("1997-01-01").cast("date"), F.lit("1998-06-30").cast("date"), 4, ["sitea.example", "siter.example"])
    return found.select("session_id", "n_items", F.array_join("hosts", ",").alias("hosts"))


@query("""WITH i AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS p, l_returnflag FROM lineitem), t AS (
  SELECT count(*) AS total_items, count(DISTINCT l_returnflag) AS unique_sites, count_if(p > 0) AS priced, CAST(sum(p) FILTER (p > 0) AS DOUBLE) AS total_value,
         CAST(max(p) AS DOUBLE) AS highest_price, CAST(min(p) FILTER (p > 0) AS DOUBLE) AS lowest_price FROM i
), s AS (SELECT count(*) AS total_sessions, count_if(o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY) AS recent_sessions FROM orders)
SELECT total_sessions, recent_sessions, total_items, unique_sites, round_even(total_items / total_sessions, 1) AS avg_items_per_session, round_even(total_value / priced, 2) AS avg_price,
       round_even(100 * priced / total_items, 1) AS success_rate, total_value, highest_price, lowest_price FROM t, s""")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("site"))
    held = sessions(spark, sf_dir)
    return S.statistics(held.crossJoin(held.agg(F.max("ts").alias("as_of"))), listed, F.col("as_of"))


@query("SELECT count(DISTINCT CASE WHEN p_name ILIKE '%ring%' THEN 'ring' WHEN p_name ILIKE '%bolt%' THEN 'bolt' ELSE substr(p_name, 1, 20) END) AS unique_models FROM part WHERE p_name <> ''")
def unique_model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_models(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")), ["ring", "bolt"])


@query("""SELECT 'www.' || lower(l_returnflag) || '-parts.com' AS site, count(*) AS item_count, upper(l_returnflag) || '-parts' AS label FROM lineitem WHERE l_returnflag <> ''
GROUP BY l_returnflag ORDER BY item_count DESC, site LIMIT 1""")
def top_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("www."), F.lower("l_returnflag"), F.lit("-parts.com")).alias("site"))
    return S.top_site(listed).withColumn("label", S.site_label(F.col("site")))


@query("SELECT strftime(max(o_orderdate) + INTERVAL 5 HOUR, '%b %d') AS latest_session, strftime(min(o_orderdate) + INTERVAL 5 HOUR, '%b %d, %Y') AS oldest_session FROM orders")
def session_span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.span_labels(sessions(spark, sf_dir))


@query("SELECT greatest(50, CAST(ceil(max(n) / 10.0) * 10 AS BIGINT)) AS bound FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def facet_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.items_bound(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items")))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY AS old FROM orders)
SELECT 'sessions' AS "table", count_if(old) AS removed, (SELECT count(*) FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE NOT old) AS items_kept FROM o""")
def retention_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sessions(spark, sf_dir)
    held = held.crossJoin(held.agg(F.max("ts").alias("as_of")))
    listed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    _, kept_items, removed = R.retain_sessions(held, listed, F.col("as_of"), 900)
    return removed.crossJoin(kept_items.agg(F.count("*").alias("items_kept")))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey <> 7) AS sessions, (SELECT count(*) FROM lineitem WHERE l_orderkey <> 7) AS items")
def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, listed = R.delete_session(sessions(spark, sf_dir), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "session_id"), 7)
    return held.agg(F.count("*").alias("sessions")).crossJoin(listed.agg(F.count("*").alias("items")))


@query(f"WITH {ITEMS_SQL} SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(original) AS DOUBLE) AS total FROM items JOIN orders ON o_orderkey = session_id GROUP BY 1")
def session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions but the newest are stored with their items, then the newest is appended; both tables are read back."""
    listed_at = F.concat(F.lit("https://shop.example/c/"), F.col("o_custkey").cast("string"))
    held = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("ts"), F.array(listed_at).alias("urls"),
        F.struct((F.col("o_custkey") % 30).cast("double").alias("percent_off"), F.col("o_orderpriority").alias("category_path")).alias("rules"),
    )
    path, newest = scratch(spark, "sessions"), F.lit(held.agg(F.max("session_id")).first()[0])
    for some in (held.where(F.col("session_id") != newest), held.where(F.col("session_id") == newest)):
        save_session(some, listed_lines(spark, sf_dir, some), path, lambda lines: listings(lines).withColumnRenamed("price", "price_value"))
    counted = spark.read.parquet(f"{path}/sessions").where("n_items > 0").select(F.to_date("ts").alias("day"), "n_items", F.lit(None).cast("decimal(18,2)").alias("price"))
    priced = spark.read.schema("price_value double, day date").parquet(f"{path}/items").select("day", F.lit(0).cast("long").alias("n_items"), F.col("price_value").cast("decimal(18,2)").alias("price"))
    return counted.unionByName(priced).groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n_items").alias("n"), F.sum("price").cast("double").alias("total"))


ENRICHED = f"""{ITEMS_SQL}, money AS (
  SELECT *, CAST(original AS DOUBLE) AS o, CAST(final AS DOUBLE) AS f FROM items
), enriched AS (
  SELECT *, CASE WHEN o > 0 THEN round_even((o - f) / o * 100, 2) END AS discount_percent, round_even(o - f, 2) AS discount_amount,
         CASE stock_status WHEN 'In stock' THEN 'in_stock' ELSE 'back_order' END AS stock FROM money
)"""


@query(f"""WITH {ENRICHED} SELECT ordinal, title, o AS original, f AS final, discount_percent, discount_amount, stock, CASE stock WHEN 'in_stock' THEN 'In Stock' ELSE 'Back Order' END AS stock_label,
  site AS domain FROM enriched WHERE title LIKE '%bolt%' AND title NOT LIKE '%red%' AND f >= 1000 AND f <= 60000""")
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = E.ResultOptions(include=["bolt"], exclude=["red"], least=1000.0, most=60000.0)
    return E.results(items(spark, sf_dir), options).select("ordinal", "title", "original", "final", "discount_percent", "discount_amount", "stock", "stock_label", "domain")


@query(f"WITH {ENRICHED} SELECT ordinal, title, f AS final, row_number() OVER (ORDER BY f DESC NULLS LAST, ordinal) AS position FROM enriched ORDER BY position LIMIT 100 OFFSET 100")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.page(E.enrich(items(spark, sf_dir)), 2, 100, "final-desc").select("ordinal", "title", "final", "position")


@query(f"WITH {ENRICHED}, d AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ordinal) AS rn FROM enriched) SELECT ordinal, title, site FROM d WHERE rn = 1")
def unique_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.results(items(spark, sf_dir), E.ResultOptions(hide_duplicates=True)).select("ordinal", "title", "site")


@query(f"WITH {ENRICHED} SELECT ordinal, round_even(f * 0.8 + 1e-9, 2) AS final FROM enriched WHERE round_even(f * 0.8 + 1e-9, 2) <= 2000 AND title LIKE '%ring%'")
def preset_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.results(items(spark, sf_dir), E.with_preset("refurbished", most=2000.0, include=["Ring"])).select("ordinal", "final")


@query(f"WITH {ITEMS_SQL} SELECT ordinal, url FROM items WHERE url IN (SELECT 'https://sitea.example/p/' || p_partkey FROM part WHERE p_size > 40)")
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("https://sitea.example/p/"), "p_partkey").alias("url"))
    return E.watched(items(spark, sf_dir), wanted).select("ordinal", "url")


@query(f"""WITH {ITEMS_SQL}, sheet AS (SELECT p_partkey AS k, p_name AS title, p_retailprice AS price, CASE WHEN p_partkey % 3 = 0 THEN 'https://siten.example/p/' || p_partkey ELSE '' END AS url,
    CASE WHEN p_partkey % 2 = 0 THEN 'sitea.example' ELSE '' END AS site FROM part),
by_url AS (SELECT url, arg_max(price, k) AS p FROM sheet WHERE url <> '' GROUP BY 1), by_site AS (SELECT title, site, arg_max(price, k) AS p FROM sheet WHERE site <> '' GROUP BY 1, 2),
by_title AS (SELECT title, arg_max(price, k) AS p FROM sheet GROUP BY 1)
SELECT ordinal, coalesce(u.p, s.p, t.p) AS cmp_price FROM items i LEFT JOIN by_url u ON u.url = i.url LEFT JOIN by_site s ON s.title = i.title AND s.site = i.site LEFT JOIN by_title t ON t.title = i.title""")
def compare_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sheet = part.select(
        F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://siten.example/p/"), "p_partkey")).otherwise("").alias("url"),
        F.when(F.col("p_partkey") % 2 == 0, "sitea.example").otherwise("").alias("site"),
    )
    return with_compare_price(items(spark, sf_dir), sheet).select("ordinal", "cmp_price")


@query("""WITH x AS (SELECT p_partkey AS k, p_name AS name, 'a' || (p_size % 90 + 10) AS code, CAST(p_retailprice AS DOUBLE) AS price, p_partkey % 4 AS kind FROM part),
s AS (SELECT k, price, name || ' ' || code AS norm, code AS model, CASE WHEN kind = 1 THEN 'Shop.example' ELSE '' END AS site, kind FROM x WHERE kind < 3),
site_model AS (SELECT model, arg_max(price, k) AS p FROM s WHERE site <> '' GROUP BY 1), by_norm AS (SELECT CASE WHEN kind = 0 THEN norm ELSE 'other ' || norm END AS norm, arg_max(price, k) AS p FROM s GROUP BY 1),
by_model AS (SELECT model, arg_max(price, k) AS p FROM s GROUP BY 1)
SELECT x.k AS ordinal, coalesce(CASE WHEN x.k % 2 = 0 THEN a.p END, b.p, c.p) AS cmp_price FROM x LEFT JOIN site_model a ON a.model = code LEFT JOIN by_norm b ON b.norm = name || ' ' || code LEFT JOIN by_model c ON c.model = code""")
def compare_lookup_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that only agree in normal form or in their model code, with and without a site."""
    code = F.concat(F.lit("a"), (F.col("p_size") % 90 + 10).cast("string"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat("p_name", F.lit(" "), code).alias("named"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 4).alias("kind"))
    told = F.when(F.col("kind") == 0, F.concat(F.lit("LCD Screen for "), F.upper("named"))).otherwise(F.concat(F.lit("Other, "), "named"))
    sheet = part.where("kind < 3").select("ordinal", told.alias("title"), F.when(F.col("kind") == 1, "Shop.example").otherwise("").alias("site"), F.lit("").alias("url"), "price")
    rows = part.select("ordinal", F.col("named").alias("title"), F.when(F.col("ordinal") % 2 == 0, "shop.EXAMPLE").otherwise("elsewhere").alias("site"), F.lit(None).cast("string").alias("url"))
    return with_compare_price(rows, sheet).select("ordinal", "cmp_price")


@query("SELECT 0 AS ordinal, 'no-such-part' AS url")
def seed_scope_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed that no known category has becomes a category of its own."""
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("https://shop.example/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"), F.col("p_name").alias("label"))
    return U.seed_scope(known, "no-such-part").select("ordinal", "url")


@query("""SELECT p_name AS title, CAST(p_retailprice AS DOUBLE) AS price, p_brand AS site, '' AS url, p_size % 10 <> 0 AS ok FROM part WHERE p_size % 10 <> 0
UNION ALL SELECT NULL, CAST(p_retailprice AS DOUBLE), p_brand, '', false FROM part WHERE p_size % 10 = 0""")
def comparison_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 10 == 0, "  ").otherwise(F.col("p_name")).alias(" Product Name "), F.concat(F.lit("USD "), F.format_number("p_retailprice", 2)).alias("AMOUNT"), F.col("p_brand").alias("Vendor")
    )
    return comparison_sheet(raw)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.first_seen(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("price"))


@query("""WITH pages AS (SELECT l_suppkey, l_linenumber AS page, count_if(l_quantity > 48) AS fresh FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, page, fresh FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.l_suppkey = p.l_suppkey AND q.page <= p.page AND q.fresh = 0)""")
def page_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("page")).agg(F.count_if(F.col("l_quantity") > 48).alias("fresh"))
    return U.cut_pages(pages, ["l_suppkey"], "page", "fresh")


@query("""WITH pages AS (SELECT l_suppkey, l_linenumber AS page, count_if(l_quantity > 49) AS fresh FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, coalesce(fresh = 0 AND lag(fresh) OVER (PARTITION BY l_suppkey ORDER BY page) = 0, false) AS two, row_number() OVER (PARTITION BY l_suppkey ORDER BY page) AS n FROM pages)
SELECT l_suppkey, page, fresh FROM t WHERE n <= 5 AND NOT EXISTS (SELECT 1 FROM t q WHERE q.l_suppkey = t.l_suppkey AND q.page < t.page AND q.two)""")
def page_cutoff_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("page")).agg(F.count_if(F.col("l_quantity") > 49).alias("fresh"))
    return U.cut_pages_after_two(pages, ["l_suppkey"], "page", "fresh", 5)


@query("SELECT min(o_orderkey) AS ordinal, o_orderpriority AS url FROM orders GROUP BY 2")
def requested_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("url"))
    return U.distinct_urls(asked.unionByName(asked.limit(5).withColumn("url", F.lit("  "))))


@query(f"WITH {ITEMS_SQL} SELECT DISTINCT url FROM items WHERE url LIKE 'https://siter%'")
def watchlist_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "watch")
    export_watchlist(items(spark, sf_dir).where(F.col("url").startswith("https://siter")), path)
    return spark.read.csv(path, header=True)


@query("""SELECT o_orderkey AS ordinal, 'https://shop.example/' || lower(n_name) || '/' AS url, CASE WHEN n_nationkey < 15 THEN 'Known ' || n_name ELSE 'Nation ' || n_nationkey END AS label, n_nationkey >= 15 AS made_up
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def category_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    url = F.concat(F.lit("https://shop.example/"), F.lower("n_name"), F.lit("/"))
    known = nation.where("n_nationkey < 15").select(F.concat(F.lit("HTTPS://shop.example/"), "n_name").alias("url"), F.concat(F.lit("Known "), "n_name").alias("label"), F.col("n_nationkey").alias("ordinal"))
    asked = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return U.category_scope(asked.select(F.col("o_orderkey").alias("ordinal"), url.alias("url")), known)


@query("""WITH hits AS (SELECT CAST(p_partkey AS BIGINT) AS ordinal, 'https://shop.example/' || replace(p_name, ' ', '-') || '/' || p_partkey AS url FROM part WHERE contains(p_name, 'red ring') AND p_size > 25)
(SELECT * FROM hits ORDER BY ordinal LIMIT 150) UNION ALL SELECT 0, 'red-ring' WHERE NOT EXISTS (SELECT 1 FROM hits)""")
def seed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("https://shop.example/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), "p_partkey").alias("url"), F.col("p_name").alias("label"), "p_size")
    return U.category_text_filter(U.seed_scope(known.where("p_size > 25"), "red-ring"), "RING", ("label", "url")).select("ordinal", "url")


@query(f"""WITH {ITEMS_SQL} SELECT CASE WHEN site = 'sitea.example' THEN 'first' WHEN site = 'siter.example' THEN 'second' ELSE 'generic' END AS supplier, site AS label, count(*) AS n,
  CAST(sum(final) AS DOUBLE) AS total FROM items GROUP BY 1, 2""")
def supplier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = items(spark, sf_dir)
    first = listed.where("site <> 'siter.example'").select("url", "site", "title", F.coalesce(money.parse_price(F.col("discounted_formatted")), money.parse_price(F.col("original_formatted"))).alias("price_value"))
    second = listed.where("site = 'siter.example'").select(
        "url", "site", "title", money.parse_price(F.col("original_formatted")).alias("original"), F.coalesce(money.parse_price(F.col("discounted_formatted")), F.lit(0.0)).alias("discounted"),
        "original_formatted", "discounted_formatted", F.lit("").alias("image_url"),
    )
    both = S.supplier_items([first, S.canonical_items(second, "siter.example", "second_auto")])
    supplier = route(F.col("url"), {"sitea": "first", "siter": "second"})
    return both.groupBy(supplier.alias("supplier"), source_label(F.col("site")).alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("price_value").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"WITH {ENRICHED} SELECT title, ordinal, CAST(o AS VARCHAR) AS original, site AS domain FROM enriched")
def results_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    export_results(E.enrich(items(spark, sf_dir)), path)
    back = spark.read.csv(path, header=True, escape='"')
    return back.select("title", F.col("ordinal").cast("long"), F.col("original").cast("double").cast("string").alias("original"), "domain")


@query("""SELECT o_orderpriority AS site, o_orderstatus AS url, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1, 2""")
def category_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site"), F.col("o_orderstatus").alias("url"), F.col("o_orderkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("discovered_at"))
    return U.register_categories(rows.where("k % 2 = 0"), rows.where("k % 2 = 1")).select("site", "url", "k")


@query("SELECT CAST(date_trunc('day', o_orderdate + INTERVAL 5 HOUR) AS DATE)::VARCHAR AS day, count(*) AS sessions FROM orders GROUP BY 1")
def sessions_by_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy(local_time(F.col("ts")).cast("date").cast("string").alias("day")).agg(F.count("*").alias("sessions"))


@query(f"""WITH {ITEMS_SQL} SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN 'fallback.example' ELSE site END AS site, CAST(final AS DOUBLE) AS price_value, 'USD' AS price_currency, 'second_auto' AS source,
  CASE WHEN final <> original THEN CAST(final AS DOUBLE) ELSE 0.0 END AS discounted_value FROM items WHERE ordinal % 3 = 0""")
def second_schema_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the second schema in the common one, some without a site, some without a discount."""
    listed = items(spark, sf_dir).where("ordinal % 3 = 0").select(
        F.col("ordinal").cast("string").alias("url"), F.when(F.col("ordinal") % 5 != 0, F.col("site")).otherwise("").alias("site"), "title",
        money.parse_price(F.col("original_formatted")).alias("original"), F.coalesce(money.parse_price(F.col("discounted_formatted")), F.lit(0.0)).alias("discounted"),
        "original_formatted", "discounted_formatted", F.lit("").alias("image_url"),
    )
    out = S.canonical_items(listed, "fallback.example", "second_auto")
    return out.select(F.col("url").cast("long").alias("ordinal"), "site", "price_value", "price_currency", "source", "discounted_value")
