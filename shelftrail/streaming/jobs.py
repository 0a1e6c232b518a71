"""Continuous forms of the batch operators, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import STORED_PRODUCTS, upsert_products
from ..shipping import ship_package
from .store import BucketStore, delete, numbered


def price_drop_alerts(items: DataFrame, threshold: float, keep: str | None = "90 days") -> DataFrame:
    """Alerts on a stream of (url, price, seen_at, ordinal) when a price falls by `threshold` percent or more: state is the
    last price of a url. Rows of one batch are put in time order first, as a micro-batch has none. With `keep` (as in
    "90 days") a url that the stream's own time has left so far behind is forgotten, so state does not grow with all urls
    there ever were, and rows later than that are left out."""
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).dropna(subset="price").sort_values(["seen_at", "ordinal"])
        before = rows["price"].shift()
        if len(rows) and state.exists:
            before.iloc[0] = state.get[0]
        drop = (before - rows["price"]) / before.where(before != 0) * 100
        alerts = rows.assign(last_price=before, drop_percent=drop.round(2))[(drop >= threshold).to_numpy()]
        if len(rows):
            state.update((float(rows["price"].iloc[-1]),))
            if keep_ms is not None:
                state.setTimeoutTimestamp(int(rows["_ms"].max()) + keep_ms)
        yield alerts[["url", "seen_at", "ordinal", "last_price", "price", "drop_percent"]]

    ship_package(items.sparkSession)
    if keep is not None:
        items = items.withColumn("seen_at", F.col("seen_at").cast("timestamp"))  # only such a column carries a watermark
    kind = items.schema["url"].dataType.simpleString()
    at = items.schema["seen_at"].dataType.simpleString()
    if keep is not None:
        items = items.withWatermark("seen_at", keep)
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    some = items.select("url", "price", "seen_at", "ordinal", F.unix_millis(F.col("seen_at").cast("timestamp")).alias("_ms"))
    return some.groupBy("url").applyInPandasWithState(
        each, f"url {kind}, seen_at {at}, ordinal long, last_price double, price double, drop_percent double", "last double", "append", timeout
    )


def rolling_counts(events: DataFrame, late: str = "1 hour", window: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Changes per type in sliding windows; rows later than `late` are left out, closed windows are final."""
    timed = events.withWatermark("changed_at", late)
    counted = timed.groupBy(F.window("changed_at", window, slide), "change_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "change_type", "n")


def run_progress(log: DataFrame, run: str = "site") -> DataFrame:
    """Pages, items and errors of each run so far (complete mode)."""
    return log.groupBy(run).agg(F.count("*").alias("pages"), F.sum("items").alias("items"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def first_seen(items: DataFrame, key: str = "url", at: str = "seen_at", within: str = "7 days") -> DataFrame:
    """The first row of each key that arrives within the watermark."""
    return items.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def upsert_stream(items: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch through a catalog upsert. `apply(batch, id)` must be idempotent by id: a batch may run again."""
    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_stream(items: DataFrame, root: str, advance: Callable[[DataFrame | None, DataFrame], DataFrame], mode: str = "append") -> StreamingQuery:
    """A table that each micro-batch moves on: snapshot n is `advance(snapshot n - 1, batch n)`, in a folder named by n.

    The batch number alone says what is read and written, so a batch that runs again after a failure, or in a new session,
    leaves the same state. Of older snapshots the last one stays, until the batch behind it is done.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{root}/batch={number - 1}") if number else None
        advance(stored, batch).write.mode("overwrite").parquet(f"{root}/batch={number}")
        delete(spark, f"{root}/batch={number - 2}")

    return items.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start()


def last_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot of `snapshot_stream` that is written to the end."""
    return spark.read.parquet(f"{root}/batch={max(numbered(spark, root, 'batch='))}")


def catalog_stream(products: DataFrame, root: str, as_of: Column, order: list[str]) -> StreamingQuery:
    """Products (as `upsert_products` takes them) into a catalog under `root`: per batch a snapshot, and the prices, changes
    and baselines it added. Batch n starts from the snapshot of batch n - 1 and overwrites only its own folders, so a batch
    that runs again after a failure leaves the same state. Snapshots older than that are deleted, what was added stays.
    For catalogs much larger than a batch see `catalog_merge_stream`."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{root}/products/batch={number - 1}") if number else spark.createDataFrame([], STORED_PRODUCTS)
        out = upsert_products(stored, batch, as_of, order)
        for name in ("products", "prices", "changes", "baselines"):
            getattr(out, name).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        delete(spark, f"{root}/products/batch={number - 2}")

    return upsert_stream(products, apply, f"{root}/checkpoint")


def product_stores(spark: SparkSession, root: str, buckets: int) -> tuple[BucketStore, BucketStore]:
    """The products of a catalog by sku, and who owns a product URL."""
    return BucketStore(spark, f"{root}/products", "sku", STORED_PRODUCTS, buckets), BucketStore(spark, f"{root}/owners", "product_url", "product_url string, sku string", buckets)


def merge_products(batch: DataFrame, number: int, root: str, as_of: Column, order: list[str], buckets: int) -> None:
    """Version `number` of a catalog in buckets: of its products and URL owners only the buckets with skus and URLs of the batch
    are read and written; prices, changes and baselines that the batch adds go into folders of its number."""
    spark = batch.sparkSession
    known, owners = product_stores(spark, root, buckets)
    batch = batch.persist()
    skus, urls = known.touched(batch), owners.touched(batch)
    owned = owners.read(number - 1, urls)
    out = upsert_products(known.read(number - 1, skus), batch, as_of, order, owned)
    for name in ("prices", "changes", "baselines"):
        getattr(out, name).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
    fresh = out.products.join(out.baselines.select("sku"), "sku", "left_semi").select("product_url", "sku")
    owners.write(number, owned.unionByName(fresh.where("product_url is not null")), urls)
    known.write(number, out.products, skus)
    batch.unpersist()


def catalog_merge_stream(products: DataFrame, root: str, as_of: Column, order: list[str], buckets: int = 256) -> StreamingQuery:
    """`catalog_stream` for a catalog in buckets: what a batch reads and writes follows the batch, not the catalog."""
    return upsert_stream(products, lambda batch, number: merge_products(batch, number, root, as_of, order, buckets), f"{root}/checkpoint")


def merged_catalog(spark: SparkSession, root: str, buckets: int = 256) -> DataFrame:
    """The products of the newest whole version."""
    known, _ = product_stores(spark, root, buckets)
    return known.read(known.last())


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in the session's memory: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What an append stream gives for all that is there now, as Parquet."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
