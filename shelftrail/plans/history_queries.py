"""Queries over price history, the change feed and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import change as C
from ..functions.urls import local_time
from ..operators import catalog as K
from ..operators import changes as G
from ..operators import history as H
from ..operators import retention as R
from ..operators import runs as U
from ..sources.writers import change_report
from .registry import query
from .tables import CHANGE_LOG_SQL, PRODUCTS_SQL, catalog, change_log, newest, price_history, products, scratch, table

LAGGED = """lagged AS (
  SELECT event_id, user_id AS product_id, value AS price, ts AS recorded_at, lag(value) OVER w AS old_price, lag(ts) OVER w AS previous_at
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), price_changes AS (
  SELECT *, price - old_price AS difference, CASE WHEN price > old_price THEN 'up' WHEN price < old_price THEN 'down' ELSE 'flat' END AS direction
  FROM lagged WHERE previous_at IS NOT NULL AND price IS DISTINCT FROM old_price
)"""


@query(f"WITH {LAGGED} SELECT product_id, price, old_price, round_even(difference, 2) AS difference, direction, CAST(recorded_at AS VARCHAR) AS recorded_at FROM price_changes ORDER BY price_changes.recorded_at DESC, product_id LIMIT 50")
def price_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.price_changes(price_history(spark, sf_dir)).orderBy(F.desc("recorded_at"), "product_id").limit(50)
    return out.select("product_id", "price", "old_price", F.bround("difference", 2).alias("difference"), "direction", F.col("recorded_at").cast("string"))


@query("""
SELECT e.user_id AS product_id, e.event_id, p.value AS old_price, e.value AS price
FROM (SELECT *, (SELECT max(ts) FROM events x WHERE x.user_id = events.user_id AND x.ts < events.ts) AS before FROM events) e
JOIN events p ON p.user_id = e.user_id AND p.ts = e.before WHERE p.value IS DISTINCT FROM e.value""")
def price_change_feed_tiesafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.price_changes(price_history(spark, sf_dir)).select("product_id", "event_id", "old_price", "price")


@query(f"WITH {LAGGED} SELECT count(*) AS n FROM price_changes WHERE recorded_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def changes_last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.count_recent_changes(price_history(spark, sf_dir), newest(spark, sf_dir, "events", "ts"))


TYPED = """typed AS (
  SELECT c.*, CASE WHEN lower(change_type) LIKE '%stock%' OR lower(change_type) LIKE '%availability%' OR lower(change_type) LIKE '%inventory%' OR lower(change_type) LIKE '%qty%' THEN 'stock'
    WHEN lower(change_type) IN ('desc', 'details') OR lower(change_type) LIKE '%description%' OR lower(change_type) LIKE '%content%' OR lower(change_type) LIKE '%copy%' THEN 'description'
    WHEN lower(change_type) = 'pricing' OR lower(change_type) LIKE '%price%' OR lower(change_type) LIKE '%cost%' THEN 'price' ELSE lower(change_type) END AS kind
  FROM changes c JOIN products p USING (product_id)
  WHERE trim(lower(old_value)) IS DISTINCT FROM trim(lower(new_value))
    AND NOT (lower(change_type) NOT IN ('new', 'product_new', 'new_product') AND trim(coalesce(old_value, '')) = '' AND trim(coalesce(new_value, '')) <> '' AND changed_at <= p.created_at)
)"""


@query(f"WITH {CHANGE_LOG_SQL}, {PRODUCTS_SQL}, {TYPED} SELECT kind AS change_type, count(*) AS n FROM typed GROUP BY kind")
def change_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counts_by_type(G.property_changes(change_log(spark, sf_dir), products(spark, sf_dir)))


@query(f"""WITH {CHANGE_LOG_SQL}, {PRODUCTS_SQL}, {TYPED}, {LAGGED}
SELECT count_if(kind = 'stock') AS stock_changes, count_if(kind = 'description') AS description_changes,
       (SELECT count(*) FROM price_changes JOIN products USING (product_id) WHERE recorded_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS price_changes
FROM typed WHERE changed_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def totals_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, known = newest(spark, sf_dir, "events", "ts"), products(spark, sf_dir)
    recent = G.property_changes(change_log(spark, sf_dir), known).where(F.col("changed_at") >= at - F.expr("interval 24 hours"))
    typed = recent.agg(F.count_if(F.col("change_type") == "stock").alias("stock_changes"), F.count_if(F.col("change_type") == "description").alias("description_changes"))
    prices = price_history(spark, sf_dir).join(known.select("product_id"), "product_id")
    return typed.crossJoin(H.count_recent_changes(prices, at).withColumnRenamed("n", "price_changes"))


FEED = f"""{CHANGE_LOG_SQL}, {PRODUCTS_SQL}, {TYPED}, {LAGGED}, feed AS (
  SELECT product_id, 'price' AS change_type, recorded_at AS changed_at, old_price AS old_numeric, price AS new_numeric, NULL AS old_text, NULL AS new_text FROM price_changes
  UNION ALL SELECT product_id, kind, changed_at, NULL, NULL, old_value, new_value FROM typed WHERE kind <> 'price'
), full_feed AS (SELECT f.*, sku, title, url, brand, category, model, stock_status FROM feed f JOIN catalog USING (product_id))"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.union_feed(price_history(spark, sf_dir), change_log(spark, sf_dir), catalog(spark, sf_dir))


@query(f"""WITH {FEED}
SELECT product_id, sku, change_type, CAST(changed_at AS VARCHAR) AS changed_at, old_numeric, new_numeric, old_text, new_text, brand, category, model FROM full_feed
WHERE change_type IN ('price', 'stock', 'description') AND changed_at >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND changed_at <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
  AND (lower(title) LIKE '%high%' OR lower(sku) LIKE '%high%')
ORDER BY full_feed.changed_at DESC, product_id, change_type, new_numeric NULLS FIRST, new_text NULLS FIRST LIMIT 100 OFFSET 5""")
def union_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = newest(spark, sf_dir, "events", "ts")
    wanted = G.ChangeFilter(("price", "stock", "description"), as_of - F.expr("interval 10 days"), as_of - F.expr("interval 1 day"), "HIGH")
    out = G.recent_changes(_feed(spark, sf_dir), wanted, limit=100, offset=5)
    return out.select("product_id", "sku", "change_type", F.col("changed_at").cast("string"), "old_numeric", "new_numeric", "old_text", "new_text", "brand", "category", "model")


@query(f"""WITH {PRODUCTS_SQL}, h AS (SELECT user_id AS product_id, date_trunc('day', ts) AS day, value AS price FROM events),
b AS (SELECT c.product_id, c.day, c.price, max(p.day) AS before FROM (SELECT *, row_number() OVER () AS id FROM h) c JOIN (SELECT DISTINCT product_id, day FROM h) p ON p.product_id = c.product_id AND p.day < c.day GROUP BY c.id, c.product_id, c.day, c.price)
SELECT b.product_id, sku, CAST(b.day AS VARCHAR) AS changed_at, p.price AS old_numeric, b.price AS new_numeric FROM b JOIN h p ON p.product_id = b.product_id AND p.day = b.before
JOIN catalog c ON c.product_id = b.product_id WHERE p.price IS DISTINCT FROM b.price""")
def union_feed_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by day, several a day: each is held against every price of the day before it that has any."""
    daily = price_history(spark, sf_dir).withColumn("recorded_at", F.date_trunc("day", "recorded_at").cast("timestamp_ntz"))
    feed = G.union_feed(daily, change_log(spark, sf_dir), catalog(spark, sf_dir)).where("change_type = 'price'")
    return feed.select("product_id", "sku", F.col("changed_at").cast("string"), "old_numeric", "new_numeric")


@query(f"""WITH {FEED}, r AS (
  SELECT *, row_number() OVER (ORDER BY changed_at DESC, product_id, change_type, new_numeric NULLS FIRST, new_text NULLS FIRST, old_numeric NULLS FIRST, old_text NULLS FIRST) AS position, count(*) OVER () AS total FROM full_feed)
SELECT product_id, change_type, CAST(changed_at AS VARCHAR) AS changed_at, old_numeric, new_numeric, old_text, new_text, position, total, CAST(ceil(total / 40.0) AS BIGINT) AS pages FROM r WHERE position > ((total - 1) // 40) * 40""")
def change_feed_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of the whole feed: the last page stands for any page beyond it."""
    out = G.feed_page(_feed(spark, sf_dir), G.ChangeFilter(), 1_000_000, 40, scratch(spark, "feed"))
    return out.select("product_id", "change_type", F.col("changed_at").cast("string"), "old_numeric", "new_numeric", "old_text", "new_text", "position", "total", "pages")


@query(f"WITH {FEED} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS pages FROM full_feed WHERE change_type IN ('new', 'stock')")
def change_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.feed_pages(G.ChangeFilter(("new", "stock")).apply(_feed(spark, sf_dir)), 25)


@query(f"""WITH {FEED}, s AS (
  SELECT *, round_even(new_numeric - old_numeric, 2) AS d FROM full_feed
)
SELECT product_id, change_type, CAST(changed_at AS VARCHAR) AS changed_at,
  CASE WHEN change_type = 'price' THEN CASE WHEN old_numeric IS NULL THEN '—' ELSE '$' || printf('%.2f', old_numeric) END WHEN trim(coalesce(old_text, '')) = '' THEN '—'
       WHEN change_type = 'stock' THEN upper(old_text[1]) || lower(old_text[2:]) ELSE old_text END AS old_value,
  CASE WHEN change_type = 'price' THEN '$' || printf('%.2f', new_numeric) WHEN change_type = 'stock' THEN upper(new_text[1]) || lower(new_text[2:]) ELSE new_text END AS new_value,
  CASE WHEN change_type = 'price' THEN CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END ELSE 'flat' END AS difference_direction,
  CASE WHEN change_type = 'price' AND abs(d) > 0 THEN (CASE WHEN d > 0 THEN '+' ELSE '-' END) || '$' || printf('%.2f', abs(d)) END AS delta_display,
  CASE change_type WHEN 'new' THEN 'New product added' WHEN 'price' THEN CASE WHEN d > 0 THEN 'Price increased' WHEN d < 0 THEN 'Price decreased' ELSE 'Price changed' END
       WHEN 'stock' THEN 'Stock status changed' WHEN 'description' THEN 'Description updated' ELSE 'Value updated' END AS change_label, title AS product_title
FROM s""")
def change_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.told(_feed(spark, sf_dir).withColumns({c: F.bround(c, 2) for c in ("old_numeric", "new_numeric")}))
    return out.select("product_id", "change_type", F.col("changed_at").cast("string"), "old_value", "new_value", "difference_direction", "delta_display", "change_label", "product_title")


@query(f"""WITH {CHANGE_LOG_SQL} SELECT event_id,
  CASE WHEN lower(regexp_replace(trim(coalesce(old_value, '')), '[\\s_-]+', ' ', 'g')) <> lower(regexp_replace(trim(coalesce(new_value, '')), '[\\s_-]+', ' ', 'g')) THEN 1 ELSE 0 END AS logged,
  CASE WHEN change_type = 'new' THEN 'New product added' WHEN change_type IN ('stock_status', 'Qty') THEN CASE WHEN old_value IS NULL THEN 'Stock captured' ELSE 'Stock updated' END
       WHEN change_type = 'Pricing' THEN CASE WHEN old_value IS NULL THEN 'Price added' ELSE 'Price updated' END
       WHEN old_value IS NULL THEN 'Description added' ELSE 'Description edited' END AS told FROM changes""")
def change_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    kept = G.loggable(log).select("event_id", F.lit(1).alias("k"))
    out = log.join(kept, "event_id", "left")
    return out.select("event_id", F.coalesce("k", F.lit(0)).alias("logged"), C.describe_change(C.change_type(F.col("change_type")), F.col("old_value"), F.col("new_value")).alias("told"))


@query(f"""WITH {PRODUCTS_SQL}, first_prices AS (SELECT user_id AS product_id, min(ts) AS captured_at FROM events GROUP BY 1)
SELECT product_id, sku, brand, category, model, CAST(coalesce(captured_at, updated_at) AS VARCHAR) AS changed_at FROM catalog LEFT JOIN first_prices USING (product_id)
ORDER BY updated_at DESC, created_at DESC, product_id LIMIT 200""")
def baseline_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    baselines = price_history(spark, sf_dir).groupBy("product_id").agg(F.min("recorded_at").alias("captured_at"))
    out = G.baseline_feed(catalog(spark, sf_dir), baselines).orderBy(F.desc("updated_at"), F.desc("created_at"), "product_id").limit(200)
    return out.select("product_id", "sku", "brand", "category", "model", F.col("changed_at").cast("string"))


@query(f"WITH {PRODUCTS_SQL} SELECT product_id, sku, 'baseline' AS change_type, CAST(updated_at AS VARCHAR) AS changed_at FROM catalog")
def feed_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = catalog(spark, sf_dir)
    nothing = G.ChangeFilter(search="no such product").apply(_feed(spark, sf_dir))
    base = G.baseline_feed(known, price_history(spark, sf_dir).limit(0).select("product_id", F.col("recorded_at").alias("captured_at")))
    return G.feed_with_fallback(nothing, base).select("product_id", "sku", "change_type", F.col("changed_at").cast("string"))


@query(f"""WITH {PRODUCTS_SQL} SELECT product_id, sku, title, brand, category, model, price FROM catalog
WHERE (title ILIKE '%urgent%' OR sku ILIKE '%urgent%') AND lower(brand) = 'asia' ORDER BY updated_at DESC, sku LIMIT 75""")
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = catalog(spark, sf_dir).withColumn("brand_slug", F.lower("brand"))
    return K.search_products(known, "Urgent", brand="asia", limit=75).select("product_id", "sku", "title", "brand", "category", "model", "price")


@query(f"""WITH {PRODUCTS_SQL} SELECT (SELECT count(*) FROM region) AS brands, (SELECT count(*) FROM nation) AS categories, (SELECT count(*) FROM customer) AS models,
  count(*) AS products, round_even(CAST(sum(CAST(price AS DECIMAL(18,2))) FILTER (price > 0) AS DOUBLE) / count(*) FILTER (price > 0), 2) AS avg_price,
  count_if(stock_status = 'In Stock') AS in_stock, (SELECT count(DISTINCT user_id) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS priced_7d FROM products""")
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = F.when(F.col("price") > 0, F.col("price").cast("decimal(18,2)"))
    out = products(spark, sf_dir).agg(
        F.count("*").alias("products"), F.bround(F.sum(priced).cast("double") / F.count(priced), 2).alias("avg_price"),
        F.count_if(F.col("stock_status") == "In Stock").alias("in_stock"),
    )
    for name, t in (("brands", "region"), ("categories", "nation"), ("models", "customer")):
        out = out.crossJoin(table(spark, sf_dir, t).agg(F.count("*").alias(name)))
    recent = price_history(spark, sf_dir).where(F.col("recorded_at") >= newest(spark, sf_dir, "events", "ts") - F.expr("interval 7 days"))
    return out.crossJoin(recent.agg(F.countDistinct("product_id").alias("priced_7d")))


@query("""SELECT total, completed, round_even(completed / greatest(total, 1) * 100, 2) AS completion_pct FROM
  (SELECT count(DISTINCT n_nationkey) AS total FROM nation), (SELECT count(DISTINCT c_nationkey) AS completed FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 495000)""")
def category_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"))
    owned = catalog(spark, sf_dir).where("price > 495000").select("category_id")
    return U.completion(categories, owned, "category_id")


@query("""WITH r AS (SELECT event_type AS site, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id FROM events)
SELECT site, count(DISTINCT k) AS total, count(DISTINCT CASE WHEN s.l_orderkey IS NOT NULL THEN k END) AS completed FROM r
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) s ON s.l_orderkey = r.event_id GROUP BY site""")
def json_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), "event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id")).distinct().withColumn("has", F.lit(True))
    return runs.join(seen, "event_id", "left").groupBy("site").agg(F.countDistinct("k").alias("total"), F.countDistinct(F.when(F.col("has"), F.col("k"))).alias("completed"))


@query("""SELECT CAST(max(ts) AS VARCHAR) AS last_run,
  greatest(0, CAST(floor(date_diff('second', (SELECT max(ts) FROM events), max(ts) + INTERVAL 12 HOUR) / 60.0) AS BIGINT)) AS eta_minutes FROM events WHERE event_type = 'purchase'""")
def last_run_and_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"), F.col("ts").alias("started_at"))
    last, at = U.last_run(runs, "purchase"), F.date_trunc("second", newest(spark, sf_dir, "events", "ts")).cast("timestamp_ntz")
    out = U.minutes_to_next(last.withColumn("shown", F.col("last_run")).withColumn("last_run", F.date_trunc("second", "last_run").cast("timestamp_ntz")), at, 12)
    return out.select(F.col("shown").cast("string").alias("last_run"), "eta_minutes")


@query("""SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(CASE WHEN value > 50 THEN value END, CASE WHEN value > 50 THEN (ts, event_id) END) AS total,
  CAST(arg_max(ts, (ts, event_id)) AS VARCHAR) AS changed_at FROM events GROUP BY 1""")
def run_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("event_type").alias("status"), F.when(F.col("value") > 50, F.col("value")).alias("total"))
    return U.latest_state(log.withColumn("changed_at", F.col("ts").cast("string")), "run_id", ["ts", "event_id"], ["status", "total", "changed_at"])


@query("""SELECT event_id, user_id AS run_id, count(*) OVER w AS done, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER w AS BIGINT) AS items_so_far FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "ts", F.get_json_object("props", "$.k").try_cast("long").alias("items"))
    return U.progress(events, "run_id", "ts").select("event_id", "run_id", "done", "items_so_far")


@query("""WITH o AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price FROM events)
SELECT event_id AS ordinal, user_id AS url, last_price, value AS price FROM o WHERE (last_price - value) / last_price * 100 >= 10""")
def price_drop_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("url"), F.col("value").alias("price"), F.col("ts").alias("seen_at"))
    return H.price_drops(seen, 10.0).drop("seen_at", "drop_percent")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first FROM events)
SELECT event_id, user_id AS run_id, count(*) OVER w AS products, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS new_products, CAST(sum(first::INT) OVER w AS BIGINT) AS models
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "ts", "event_type", (F.col("value") > 50).alias("is_new"))
    return U.running_counters(steps, "run_id", ["ts", "event_id"], "event_type").select("event_id", "run_id", "products", "new_products", "models")


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderdate AS s, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 SECOND END AS c, o_custkey % 50 AS done, 40 AS total FROM orders),
a AS (SELECT max(o_orderdate) + INTERVAL 1 DAY AS now FROM orders), e AS (SELECT *, CAST(epoch(coalesce(c, now)) - epoch(s) AS BIGINT) AS elapsed_s FROM j, a),
r AS (SELECT *, CASE WHEN c IS NOT NULL THEN 0 WHEN done > 0 AND total >= done THEN CAST(round(elapsed_s / done * (total - done)) AS BIGINT) END AS remaining_s FROM e)
SELECT id, elapsed_s, remaining_s, CAST(coalesce(c, now + to_seconds(remaining_s)) AS VARCHAR) AS finish_at FROM r""")
def run_timing_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    now = orders.agg((F.max("o_orderdate") + F.expr("interval 1 day")).alias("now"))
    jobs = orders.crossJoin(now).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 90 seconds")).alias("completed_at"),
        (F.col("o_custkey") % 50).alias("done"), F.lit(40).alias("total"), "now",
    )
    return U.timing_estimate(jobs, F.col("now")).select("id", "elapsed_s", "remaining_s", F.col("finish_at").cast("string"))


@query("""WITH t AS (SELECT count(*) AS products, (SELECT count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS changes_24h FROM orders)
SELECT products, changes_24h, CAST((SELECT max(ts) FROM events WHERE event_type = 'purchase') AS VARCHAR) AS last_run, 80 AS total, (SELECT max(value) FILTER (event_type = 'error')::INT % 80 FROM events) AS completed,
  round_even((SELECT max(value) FILTER (event_type = 'error')::INT % 80 FROM events) / 80.0 * 100, 2) AS completion_pct FROM t""")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, at = table(spark, sf_dir, "events"), newest(spark, sf_dir, "events", "ts")
    totals = products(spark, sf_dir).agg(F.count("*").alias("products"))
    totals = totals.crossJoin(H.count_recent(events, "ts", at).withColumnRenamed("n", "changes_24h"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"))
    done = U.completion(nations, catalog(spark, sf_dir).select("category_id"), "category_id")
    last = U.last_run(events.select(F.col("event_type").alias("status"), F.col("ts").alias("started_at")), "purchase").select(F.col("last_run").cast("string"))
    job = events.where("event_type = 'error'").agg(F.round(F.max("value")).cast("int").alias("v")).select((F.col("v") % 80).alias("done"), F.lit(80).alias("total"))
    return U.dashboard(totals, done, last, job)


@query("""SELECT (SELECT count(*) FROM orders) AS products, CAST((SELECT max(ts) FROM events WHERE event_type = 'purchase') AS VARCHAR) AS last_run, total, completed, round_even(completed / total * 100, 2) AS completion_pct
FROM (SELECT count(*) AS total FROM nation), (SELECT count(DISTINCT c_nationkey) AS completed FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 495000)""")
def dashboard_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's row while no job runs: completion is that of the catalog."""
    events = table(spark, sf_dir, "events")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"))
    done = U.completion(nations, catalog(spark, sf_dir).where("price > 495000").select("category_id"), "category_id")
    last = U.last_run(events.select(F.col("event_type").alias("status"), F.col("ts").alias("started_at")), "purchase").select(F.col("last_run").cast("string"))
    no_job = events.where("event_type = 'no such type'").select(F.lit(1).alias("done"), F.lit(2).alias("total"))
    return U.dashboard(products(spark, sf_dir).agg(F.count("*").alias("products")), done, last, no_job)


@query(f"WITH {FEED} SELECT product_id, sku, change_type, CAST(changed_at AS VARCHAR) AS changed_at FROM full_feed WHERE change_type = 'stock'")
def feed_before_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed that has rows stays as it is, without the baselines."""
    base = G.baseline_feed(catalog(spark, sf_dir), price_history(spark, sf_dir).limit(0).select("product_id", F.col("recorded_at").alias("captured_at")))
    feed = G.feed_with_fallback(G.ChangeFilter(("stock",)).apply(_feed(spark, sf_dir)), base)
    return feed.select("product_id", "sku", "change_type", F.col("changed_at").cast("string"))


@query("""WITH x AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS o, p_brand, p_type, p_name FROM part)
SELECT count(*) AS saved, count_if(p_partkey % 4 <> 0) AS new, count_if(p_partkey % 4 = 0) AS updated, count(DISTINCT p_brand) AS distinct_brand, count(DISTINCT p_type) AS distinct_category, count(DISTINCT p_name) AS distinct_model,
  arg_max(p_brand, o) AS last_brand, arg_max(p_type, o) AS last_category, arg_max(p_name, o) AS last_model, 's' || max(p_partkey) AS last_sku, 0 AS errors FROM x""")
def catalog_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), key).alias("sku"), F.concat(F.lit("u"), key).alias("product_url"), F.lit(1).cast("long").alias("model_id"), F.col("p_name").alias("title"), F.lit("").alias("description"),
        F.col("p_retailprice").alias("price"), F.lit("in_stock").alias("stock_status"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_name").alias("model"),
    )
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stored = part.where("ordinal % 4 = 0").withColumns({"created_at": at, "updated_at": at})
    out = K.upsert_products(stored, part, at).summary
    names = [f"{k}_{c}" for k in ("distinct", "last") for c in ("brand", "category", "model")]
    return out.select("saved", "new", "updated", *names, "last_sku", "errors")


UPSERT_SQL = """cut AS (SELECT make_timestamp(epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) * 7 // 10) AS cut_at FROM events), old AS (
  SELECT user_id AS sku, arg_max(value, (ts, event_id)) AS price, arg_max(event_type, (ts, event_id)) AS stock_status, min(event_id) AS model_id FROM events, cut
  WHERE ts < cut_at AND user_id % 7 <> 0 GROUP BY 1
), new AS (
  SELECT user_id AS sku, arg_min(value, (ts, event_id)) AS price, arg_min(event_type, (ts, event_id)) AS stock_status, min((ts, event_id)) AS o FROM events, cut WHERE ts >= cut_at GROUP BY 1
)"""


def _upsert(spark: SparkSession, sf_dir: str) -> K.Upsert:
    """Products as they stood at a cut in time, and the events since as a batch: stored SKUs leave out every seventh."""
    events = table(spark, sf_dir, "events")
    first, last = F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))
    at = events.agg((first + F.floor((last - first) * 7 / 10)).alias("at"))
    timed = events.crossJoin(at).withColumn("before", F.unix_micros(F.col("ts").cast("timestamp")) < F.col("at"))
    order = F.struct("ts", "event_id")
    old = timed.where("before and user_id % 7 <> 0").groupBy(F.col("user_id").cast("string").alias("sku")).agg(
        F.max_by("value", order).alias("price"), F.max_by("event_type", order).alias("stock_status"), F.min("event_id").alias("model_id"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )
    told = lambda df: df.withColumns({"product_url": F.concat(F.lit("u"), "sku"), "title": F.concat(F.lit("Product "), "sku"), "description": F.lit("")})
    new = timed.where("not before").select(F.col("user_id").cast("string").alias("sku"), F.col("value").alias("price"), F.col("event_type").alias("stock_status"), F.col("event_id").alias("model_id"), "ts", F.col("event_id").alias("ordinal"))
    return K.upsert_products(told(old), told(new), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), ["ts", "ordinal"])


@query(f"WITH {UPSERT_SQL} SELECT CAST(new.sku AS VARCHAR) AS sku, 'new' AS change_type, CAST(NULL AS VARCHAR) AS old_value, 'Product ' || new.sku AS new_value FROM new LEFT JOIN old USING (sku) WHERE old.sku IS NULL")
def catalog_upsert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir).changes.where("change_type = 'new'").select("sku", "change_type", "old_value", "new_value")


@query(f"WITH {UPSERT_SQL} SELECT CAST(new.sku AS VARCHAR) AS sku, new.price, new.stock_status FROM new LEFT JOIN old USING (sku) WHERE new.price IS DISTINCT FROM old.price AND new.price IS NOT NULL")
def catalog_upsert_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir).prices.select("sku", "price", "stock_status")


@query(f"WITH {UPSERT_SQL} SELECT CAST(new.sku AS VARCHAR) AS sku, old.stock_status AS old_value, new.stock_status AS new_value FROM new JOIN old USING (sku) WHERE lower(new.stock_status) <> lower(old.stock_status)")
def catalog_upsert_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir).changes.where("change_type = 'stock'").select("sku", "old_value", "new_value")


@query(f"WITH {UPSERT_SQL} SELECT count(*) AS saved, count_if(old.sku IS NULL) AS new, count_if(old.sku IS NOT NULL) AS updated FROM new LEFT JOIN old USING (sku)")
def catalog_upsert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir).summary.select("saved", "new", "updated")


@query("""WITH i AS (SELECT l_orderkey, l_partkey, p_brand, p_type, p_name, ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS o FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT l_partkey, arg_min(p_brand, o) AS b, arg_min(p_type, o) AS c, arg_min(p_name, o) AS m FROM i GROUP BY 1)
SELECT 'brands' AS "table", count(DISTINCT b) AS n, min(b) AS first FROM f UNION ALL SELECT 'categories', count(DISTINCT (b, c)), min(c) FROM f
UNION ALL SELECT 'models', count(DISTINCT (b, c, m)), min(m) FROM f UNION ALL SELECT 'products', count(*), 'P-' || min(CAST(l_partkey AS VARCHAR)) FROM f""")
def item_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    line = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    batch = K.item_batch(line.select(
        F.concat(F.lit("https://shop.example/p-"), "l_partkey", F.lit("/")).alias("url"), F.lit(None).cast("string").alias("sku"), F.col("p_name").alias("title"), F.lit("").alias("description"),
        F.col("l_extendedprice").alias("price"), F.col("l_linestatus").alias("stock_status"), F.concat_ws(" > ", "p_brand", "p_type", "p_name").alias("category_path"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("brand"), (((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("o"),
    ), ["o"], scratch(spark, "items"))
    parts = [("brands", batch.brands, "name"), ("categories", batch.categories, "name"), ("models", batch.models, "name"), ("products", batch.products, "sku")]
    counted = [df.agg(F.count("*").alias("n"), F.min(c).alias("first")).select(F.lit(name).alias("table"), "n", "first") for name, df, c in parts]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


@query("""SELECT o_orderpriority AS slug, arg_min(o_custkey, o_orderkey)::VARCHAR AS name, 'https://shop.example/' || arg_min(o_orderkey, o_orderkey) AS url FROM orders GROUP BY 1
UNION ALL SELECT c_mktsegment, 'kept', 'kept' FROM customer GROUP BY 1""")
def dimension_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("slug")).distinct().withColumns({"name": F.lit("kept"), "url": F.lit("kept"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    incoming = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("slug"), F.col("o_custkey").cast("string").alias("name"), F.concat(F.lit("https://shop.example/"), "o_orderkey").alias("url"), "o_orderkey")
    return K.upsert_dimension(stored, incoming, ["slug"], ["o_orderkey"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).drop("updated_at")


@query("""WITH c AS (SELECT max(ts) - INTERVAL 7 DAY AS cut_at FROM events), stay AS (SELECT o_orderkey FROM orders, (SELECT max(o_orderdate) - INTERVAL 900 DAY AS stay_at FROM orders) WHERE o_orderdate >= stay_at)
SELECT 'changes' AS "table", count_if(ts < cut_at) AS removed, count_if(ts >= cut_at AND o_orderkey IS NULL) AS cascaded FROM events CROSS JOIN c LEFT JOIN stay ON o_orderkey = user_id
UNION ALL SELECT 'prices', count_if(ts < cut_at), count_if(ts >= cut_at AND o_orderkey IS NULL) FROM events CROSS JOIN c LEFT JOIN stay ON o_orderkey = user_id
UNION ALL SELECT 'products', (SELECT count(*) FROM orders) - (SELECT count(*) FROM stay), 0
UNION ALL SELECT 'baselines', 0, (SELECT count(*) FROM orders) - (SELECT count(*) FROM stay)""")
def purge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, known = newest(spark, sf_dir, "events", "ts"), products(spark, sf_dir)
    # both tables on one clock: the products' dates are moved so that their newest is the events' newest
    shift = known.agg(F.max("updated_at").alias("newest"))
    recent = known.crossJoin(shift).withColumn("updated_at", F.when(F.col("updated_at") >= F.col("newest") - F.expr("interval 900 days"), at).otherwise(at - F.expr("interval 8 days")))
    _, removed = R.purge_history(change_log(spark, sf_dir), price_history(spark, sf_dir), recent, known.select("product_id"), at - F.expr("interval 7 days"), include_products=True)
    return removed


@query("SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def clear_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts({t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "events")})


@query(f"WITH {FEED} SELECT sku, title, url, change_type, CAST(old_numeric AS VARCHAR) AS old_value, CAST(new_numeric AS VARCHAR) AS new_value, CAST(changed_at AS VARCHAR) AS changed_at FROM full_feed WHERE change_type = 'price' ORDER BY full_feed.changed_at DESC, sku, change_type LIMIT 10000")
def change_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = G.ChangeFilter(("price",)).apply(_feed(spark, sf_dir)).withColumns({"old_value": F.col("old_numeric").cast("string"), "new_value": F.col("new_numeric").cast("string")})
    return change_report(feed).withColumn("changed_at", F.col("changed_at").cast("string"))


@query("SELECT strftime(max(ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS newest, CAST(max(event_id) AS BIGINT) AS last_id FROM events")
def last_write_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.date_format(local_time(F.max("ts")), "yyyy-MM-dd HH:mm").alias("newest"), F.max("event_id").alias("last_id"))


#: A third of the events as one product's: `hot` is 0 for them.
HOT_SQL = "hot AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS hot FROM events)"


def _hot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_history(spark, sf_dir).withColumn("product_id", F.when(F.col("product_id") % 3 == 0, 0).otherwise(F.col("product_id")))


@query(f"""WITH {HOT_SQL}, t AS (SELECT hot, ts, lag(ts) OVER (PARTITION BY hot ORDER BY ts) AS before FROM (SELECT DISTINCT hot, ts FROM hot))
SELECT e.hot AS product_id, e.event_id, p.value AS old_price, e.value AS price, CASE WHEN e.value > p.value THEN 'up' WHEN e.value < p.value THEN 'down' ELSE 'flat' END AS direction
FROM hot e JOIN t ON t.hot = e.hot AND t.ts = e.ts JOIN hot p ON p.hot = t.hot AND p.ts = t.before WHERE p.value IS DISTINCT FROM e.value""")
def hot_product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price changes where one product has a third of the history."""
    return H.price_changes(_hot_history(spark, sf_dir)).select("product_id", "event_id", "old_price", "price", "direction")


@query(f"""WITH {HOT_SQL}, o AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY hot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_price FROM hot)
SELECT event_id AS ordinal, hot AS url, last_price, value AS price FROM o WHERE (last_price - value) / last_price * 100 >= 60""")
def hot_product_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _hot_history(spark, sf_dir).select(F.col("event_id").alias("ordinal"), F.col("product_id").alias("url"), "price", F.col("recorded_at").alias("seen_at"))
    return H.price_drops(seen, 60.0).drop("seen_at", "drop_percent")


@query(f"""WITH {HOT_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY hot, event_type ORDER BY ts, event_id) = 1 AS first FROM hot)
SELECT event_id, hot AS run_id, count(*) OVER w AS products, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS new_products, CAST(sum(first::INT) OVER w AS BIGINT) AS models
FROM s WINDOW w AS (PARTITION BY hot ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def hot_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("run_id"), "ts", "event_type", (F.col("value") > 50).alias("is_new")
    )
    return U.running_counters(steps, "run_id", ["ts", "event_id"], "event_type").select("event_id", "run_id", "products", "new_products", "models")


#: Prices rounded to tens and times to days, so that many rows share product, time and price.
TIED_SQL = "tied AS (SELECT event_id, user_id % 50 AS product_id, date_trunc('day', ts) AS day, CASE WHEN event_id % 41 <> 0 THEN floor(value / 10) * 10 END AS price FROM events)"


def _tied_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_history(spark, sf_dir).select(
        "event_id", (F.col("product_id") % 50).alias("product_id"), F.date_trunc("day", "recorded_at").cast("timestamp_ntz").alias("recorded_at"),
        F.when(F.col("event_id") % 41 != 0, F.floor(F.col("price") / 10) * 10.0).alias("price"),
    )


@query(f"""WITH {TIED_SQL}, s AS (SELECT product_id, day, price, count(*) AS n FROM tied GROUP BY ALL), d AS (SELECT product_id, day, lag(day) OVER (PARTITION BY product_id ORDER BY day) AS before FROM (SELECT DISTINCT product_id, day FROM s))
SELECT d.product_id, CAST(d.day AS VARCHAR) AS recorded_at, CAST(d.before AS VARCHAR) AS previous_at, CAST(coalesce(sum(c.n * p.n) FILTER (c.price IS DISTINCT FROM p.price), 0) AS BIGINT) AS changed,
  CAST(coalesce(sum(c.n * p.n) FILTER (c.price > p.price), 0) AS BIGINT) AS up, CAST(coalesce(sum(c.n * p.n) FILTER (c.price < p.price), 0) AS BIGINT) AS down, CAST(count(DISTINCT coalesce(c.price, -1)) AS INTEGER) AS n_prices
FROM d JOIN s c ON c.product_id = d.product_id AND c.day = d.day JOIN s p ON p.product_id = d.product_id AND p.day = d.before GROUP BY d.product_id, d.day, d.before""")
def tied_price_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product and day: how many pairs of one of its rows and one of the day before differ in price, without making them."""
    steps = H.step_counts(H.price_steps(_tied_history(spark, sf_dir), hours=24 * 7))
    return steps.select("product_id", F.col("recorded_at").cast("string"), F.col("previous_at").cast("string"), "changed", "up", "down", F.size("prices").alias("n_prices"))


@query(f"""WITH {TIED_SQL}, k AS (SELECT product_id, day, arg_max(event_id, event_id) AS event_id, arg_max(coalesce(price, -1), event_id) AS p FROM tied GROUP BY ALL),
l AS (SELECT product_id, day, event_id, nullif(p, -1) AS price, nullif(lag(p) OVER w, -1) AS old_price, lag(day) OVER w AS before FROM k WINDOW w AS (PARTITION BY product_id ORDER BY day))
SELECT product_id, event_id, CAST(day AS VARCHAR) AS recorded_at, old_price, price FROM l WHERE before IS NOT NULL AND price IS DISTINCT FROM old_price""")
def prices_kept_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price of a product and time is kept when a batch is written; then the row before is the time before."""
    kept = H.one_price_a_time(_tied_history(spark, sf_dir), ["event_id"])
    return H.price_changes(kept, strict=False).select("product_id", "event_id", F.col("recorded_at").cast("string"), "old_price", "price")
