"""Collection runs: timing, progress, completion, last run and the dashboard row; category scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normal_url
from .catalog import first_wins
from .scans import time_range, totals_upto
from .sessions import newest, tolerant_json


def timing_rollup(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per category: pages, items, mean and total fetch time, any challenge, and whether it worked."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.sum("items").alias("items"), F.bround(F.sum("fetch_ms") / F.greatest(F.count("*"), F.lit(1)), 2).alias("mean_fetch_ms"),
        F.bround(F.sum("fetch_ms"), 2).alias("total_ms"), F.bool_or("challenged").alias("challenged"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def run_summary(categories: DataFrame, most: int | None = None) -> DataFrame:
    """Categories found, targeted (at most `most` of them) and scraped, their items, any challenge, and errors."""
    return categories.agg(
        F.count("*").alias("found"), F.least(F.count("*"), F.lit(most).cast("long")).alias("targeted"), F.count_if(F.col("pages") > 0).alias("scraped"), F.sum("items").alias("items"),
        F.bool_or("challenged").alias("challenged"), F.sum("errors").alias("errors"),
    )


def progress(events: DataFrame, run: str, at: str) -> DataFrame:
    """Running number and value of a run's events in time."""
    w = Window.partitionBy(run).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"done": F.count("*").over(w), "items_so_far": F.sum("items").over(w)})


def latest_state(log: DataFrame, key: str, at: list[str], columns: list[str]) -> DataFrame:
    """A run's row from its partial updates: per column the last value that was set."""
    order = F.struct(*at)
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def completion(categories: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """Total, completed and percentage of categories that own at least one row of `owned`."""
    done = categories.join(owned.select(key).distinct(), key, "left_semi")
    both = categories.agg(F.countDistinct(key).alias("total")).crossJoin(done.agg(F.countDistinct(key).alias("completed")))
    return both.withColumn("completion_pct", F.bround(F.col("completed") / F.greatest(F.col("total"), F.lit(1)) * 100, 2))


def last_run(runs: DataFrame, status: str = "completed") -> DataFrame:
    return runs.agg(F.max(F.when(F.col("status") == status, F.col("started_at"))).alias("last_run"))


def recent_runs(runs: DataFrame, limit: int, schema: str) -> DataFrame:
    """The newest runs, their JSON column `details` read by a schema; unreadable ones are null."""
    return newest(runs, "started_at", "run_id", limit).withColumn("details", tolerant_json(F.col("details"), schema))


def last_run_by_client(runs: DataFrame, sessions: DataFrame, with_runs: list[str]) -> DataFrame:
    """(client, last_run): the newest completed run of clients that keep runs, and of all others the newest session whose
    rules name them."""
    kept = runs.where(F.col("client").isin(with_runs) & (F.col("status") == "completed")).select("client", F.col("started_at").alias("at"))
    other = sessions.select(F.col("rules.site").alias("client"), F.col("ts").alias("at")).where(~F.col("client").isin(with_runs))
    return kept.unionByName(other).groupBy("client").agg(F.max("at").alias("last_run"))


def catalog_statistics(tables: dict[str, DataFrame], products: DataFrame, history: DataFrame, runs: DataFrame, as_of: Column, in_stock: str = "in_stock", days: int = 7) -> DataFrame:
    """One row: rows of the dimension tables, products, their mean price and how many are in stock, products priced and runs
    started in the last days, and the newest run. `as_of` is a literal, so the time bounds reach the scans."""
    since = as_of - F.expr(f"interval {days} days")
    priced = F.when(F.col("price") > 0, F.col("price").cast("decimal(18,2)"))
    out = products.agg(
        F.count("*").alias("products"), F.coalesce(F.bround(F.sum(priced).cast("double") / F.nullif(F.count(priced), F.lit(0)), 2), F.lit(0.0)).alias("avg_price"),
        F.count_if(F.col("stock_status") == in_stock).alias("in_stock"),
    )
    for name, t in tables.items():
        out = out.crossJoin(t.agg(F.count("*").alias(name)))
    out = out.crossJoin(history.where(F.col("recorded_at") >= since).agg(F.countDistinct("product_id").alias("priced")))
    newest_run = F.max_by(F.struct("status", "started_at", "total_products"), F.struct("started_at", "run_id"))
    last = runs.agg(F.count_if(F.col("started_at") >= since).alias("runs"), newest_run.alias("_last"))
    return out.crossJoin(last.select("runs", F.col("_last.status").alias("last_status"), F.col("_last.started_at").alias("last_started"), F.col("_last.total_products").alias("last_products")))


def minutes_to_next(last: DataFrame, as_of: Column, cadence_hours: int) -> DataFrame:
    """Whole minutes until the next run is due: never below 0, and 0 if none ever ran."""
    due = F.timestamp_diff("SECOND", as_of, F.col("last_run") + F.expr(f"interval {cadence_hours} hours"))
    return last.withColumn("eta_minutes", F.coalesce(F.greatest(F.lit(0), F.floor(due / 60)), F.lit(0)).cast("long"))


def category_scope(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested URLs with their known category, in order and with repeats; unknown ones get a label from the URL."""
    named = first_wins(known.withColumn("match", normal_url(F.col("url"))).select("match", "label", "ordinal"), ["match"], ["ordinal"]).drop("ordinal")
    out = requested.withColumn("match", normal_url(F.col("url"))).join(named, "match", "left")
    made = F.initcap(F.regexp_replace(F.element_at(F.split("match", "/"), -1), "[-_]+", " "))
    return out.select("ordinal", "url", F.coalesce("label", made).alias("label"), F.col("label").isNull().alias("made_up"))


def seed_scope(known: DataFrame, seed: str, most: int = 150) -> DataFrame:
    """Categories whose URL contains the seed, at most `most` in order; if none do, one made from the seed."""
    hits = known.where(F.col("url").contains(seed))
    none = hits.agg((F.count("*") == 0).alias("none")).where("none")
    made = none.select(F.lit(0).cast("long").alias("ordinal"), F.lit(seed).alias("url"), F.lit(seed).alias("label"))
    return hits.select("ordinal", "url", "label").orderBy("ordinal").limit(most).unionByName(made)


def category_text_filter(known: DataFrame, text: str, columns: tuple[str, ...] = ("label", "brand", "url")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return known.where(hit)


def merge_discoveries(sources: list[DataFrame], least: list[int]) -> DataFrame:
    """Categories (url, label) of several sources, first source wins; source k counts only if fewer than least[k] are there."""
    out = sources[0].withColumn("rank", F.lit(0))
    for k, more in enumerate(sources[1:], 1):
        short = out.agg((F.countDistinct("url") < least[k]).alias("short")).where("short").drop("short")
        out = out.unionByName(more.withColumn("rank", F.lit(k)).crossJoin(short))
    return first_wins(out, ["url"], ["rank", "label"])


def register_categories(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace on (site, url): the newest row of each."""
    both = stored.unionByName(incoming)
    rest = [c for c in both.columns if c not in ("site", "url")]
    return both.groupBy("site", "url").agg(F.max_by(F.struct(*rest), "discovered_at").alias("_last")).select("site", "url", "_last.*")


def cut_pages(pages: DataFrame, keys: list[str], page: str, least_new: str) -> DataFrame:
    """Pages up to the first that brought nothing new."""
    w = Window.partitionBy(*keys).orderBy(page)
    empty_before = F.sum(F.when(F.col(least_new) == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("_e", empty_before).where("_e = 0").drop("_e")


def cut_pages_after_two(pages: DataFrame, keys: list[str], page: str, least_new: str, most: int) -> DataFrame:
    """Pages up to the second of two in a row that brought nothing new, and at most `most` of them."""
    w = Window.partitionBy(*keys).orderBy(page)
    two = (F.col(least_new) == 0) & (F.lag(least_new).over(w) == 0)
    marked = pages.withColumns({"_two": F.coalesce(two, F.lit(False)).cast("int"), "_n": F.row_number().over(w)})
    over = F.sum("_two").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("_over", F.coalesce(over, F.lit(0))).where(f"_over = 0 and _n <= {most}").drop("_two", "_n", "_over")


def running_counters(steps: DataFrame, run: str, order: list[str], model: str) -> DataFrame:
    """A run's counters after each step: rows, new ones, and distinct models, told by a model's first step. `order` begins
    with a time and tells the steps of a run apart; a long run is scanned in ranges of it."""
    firsts = steps.groupBy(run, model).agg(F.min(F.struct(*order)).alias("_first")).select(run, model, "_first.*").withColumn("_is_first", F.lit(1))
    flagged = steps.join(firsts, [run, model, *order], "left")
    sums = {"products": F.lit(1), "new_products": F.col("is_new").cast("int"), "models": F.coalesce("_is_first", F.lit(0))}
    return totals_upto(flagged, [run], order, time_range(order[0]), sums).drop("_is_first")


def timing_estimate(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Elapsed and remaining seconds of jobs (started_at, completed_at, done, total), and when they should finish."""
    end = F.coalesce("completed_at", as_of)
    elapsed = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("started_at"), end))
    rest = F.when(F.col("completed_at").isNotNull(), F.lit(0.0)).when((F.col("done") > 0) & (F.col("total") >= F.col("done")), elapsed / F.col("done") * (F.col("total") - F.col("done")))
    out = jobs.withColumns({"elapsed_s": F.coalesce(elapsed, F.lit(0)), "remaining_s": F.round(rest).cast("long")})
    return out.withColumn("finish_at", F.coalesce("completed_at", F.timestamp_add("SECOND", F.col("remaining_s"), as_of)))


def dashboard(totals: DataFrame, categories: DataFrame, runs: DataFrame, job: DataFrame) -> DataFrame:
    """One row of single rows: totals, completion, last run and next due; while a job runs (done, total) its own progress
    stands for completion."""
    active = job.agg(F.max("done").alias("_done"), F.max("total").alias("_total"))
    out = totals.crossJoin(categories).crossJoin(runs).crossJoin(active)
    own = F.coalesce(F.col("_total") > 0, F.lit(False))
    out = out.withColumns({"total": F.when(own, F.col("_total")).otherwise(F.col("total")), "completed": F.when(own, F.coalesce("_done", F.lit(0))).otherwise(F.col("completed"))})
    return out.withColumn("completion_pct", F.bround(F.col("completed") / F.greatest(F.col("total"), F.lit(1)) * 100, 2)).drop("_done", "_total")


def distinct_urls(urls: DataFrame) -> DataFrame:
    """Requested URLs trimmed, without blanks and later repeats, in order."""
    some = urls.withColumn("url", F.trim("url")).where("url <> ''")
    return first_wins(some, ["url"], ["ordinal"]).orderBy("ordinal")


def first_seen(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(items, keys, order)
