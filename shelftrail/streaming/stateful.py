"""Stateful streams by key, with state that event time bounds: price drops and first-seen rows.

State is in the RocksDB store, which `with_state_store` chooses for the streams started inside it. A key's rows of a
micro-batch meet in one call: what bounds them is the source's limit per trigger (`maxFilesPerTrigger`, `maxBytesPerTrigger`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship_package

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A key is forgotten when the stream's time has left its last row so far behind.
KEEP = "90 days"


@contextmanager
def with_state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; a stream that runs goes on with the store that it was started with."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


class PriceDrops(StatefulProcessor):
    """Alerts of a url; state is its last price and time, a timer forgets them."""

    def __init__(self, threshold: float, keep_ms: int):
        self.threshold, self.keep_ms = threshold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double, at long, ordinal long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).dropna(subset="price").sort_values(["at_us", "ordinal"])
        if not len(frame):
            return
        before = frame["price"].shift()
        known = self.last.get()
        if known is not None:
            self.handle.deleteTimer(known[1] // 1000 + self.keep_ms)
            if known[1] // 1000 + self.keep_ms > timerValues.getCurrentWatermarkInMs():  # timers fire after a batch's rows
                before.iloc[0] = known[0]
        drop = (before - frame["price"]) / before.where(before != 0) * 100
        newest = frame.iloc[-1]
        self.last.update((float(newest["price"]), int(newest["at_us"]), int(newest["ordinal"])))
        self.handle.registerTimer(int(newest["at_us"]) // 1000 + self.keep_ms)
        alerts = frame.assign(last_price=before, drop_percent=drop.round(2))[(drop >= self.threshold).to_numpy()]
        yield alerts[["url", "seen_at", "ordinal", "last_price", "price", "drop_percent"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """The first row of a key by (time, position): told when the stream's time has passed it, so that no earlier one can come;
    later rows of the key are left out until it has not been seen for as long as it is kept."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, ordinal long, told boolean")
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = newest = None
        for frame in rows:  # a frame at a time: nothing is held but the best row
            if len(frame):
                least, most = min(zip(frame["at_us"], frame["ordinal"], strict=True)), frame["at_us"].max()
                best, newest = min(best or least, least), max(newest or most, most)
        if best is None:
            return
        known, last = self.first.get(), self.newest.get()
        if last is not None and last[0] // 1000 + self.keep_ms + 1 <= timerValues.getCurrentWatermarkInMs():  # timers fire after a batch's rows
            if not known[2]:
                self.handle.deleteTimer(known[0] // 1000 + 1)
                yield self._told(key, known)
            self.handle.deleteTimer(last[0] // 1000 + self.keep_ms + 1)
            known = last = None
        if known is None or not known[2] and best < (known[0], known[1]):
            if known is not None:
                self.handle.deleteTimer(known[0] // 1000 + 1)
            self.first.update((int(best[0]), int(best[1]), False))
            self.handle.registerTimer(int(best[0]) // 1000 + 1)
        if last is None or newest > last[0]:
            if last is not None:
                self.handle.deleteTimer(last[0] // 1000 + self.keep_ms + 1)
            self.newest.update((int(newest),))
            self.handle.registerTimer(int(newest) // 1000 + self.keep_ms + 1)

    def _told(self, key: tuple, known: tuple) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "first_us": [known[0]], "ordinal": [known[1]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, last, due = self.first.get(), self.newest.get(), expiredTimerInfo.getExpiryTimeInMs()
        told = iter(())
        if known is not None and not known[2] and due >= known[0] // 1000 + 1:
            told = iter([self._told(key, known)])
            self.first.update((known[0], known[1], True))
        if last is not None and due >= last[0] // 1000 + self.keep_ms + 1:
            self.first.clear()
            self.newest.clear()
        return told

    def close(self) -> None:
        pass


def _timed(items: DataFrame, at: str, late: str) -> DataFrame:
    stamped = items.withColumns({at: F.col(at).cast("timestamp")}).withWatermark(at, late)
    return stamped.withColumn("at_us", F.unix_micros(at))


def price_drop_alerts(items: DataFrame, threshold: float, late: str = "1 hour", keep: str = KEEP) -> DataFrame:
    """Alerts on a stream of (url, price, seen_at, ordinal) when a price falls by `threshold` percent or more since the last
    price of its url. Rows later than `late` are left out; a url not seen for `keep` of the stream's own time is forgotten, so
    state holds one row per url of that span and no more."""
    ship_package(items.sparkSession)
    kind = items.schema["url"].dataType.simpleString()
    schema = f"url {kind}, seen_at timestamp, ordinal long, last_price double, price double, drop_percent double"
    some = _timed(items.select("url", "price", "seen_at", "ordinal"), "seen_at", late)
    return some.groupBy("url").transformWithStateInPandas(PriceDrops(threshold, _millis(keep)), schema, "Append", "EventTime")


def first_seen(items: DataFrame, key: str = "url", at: str = "seen_at", order: str = "ordinal", late: str = "1 hour", keep: str = KEEP) -> DataFrame:
    """(key, first_us, ordinal): the first row of each key by time, then position, of a stream that may be `late` out of order;
    a key not seen for `keep` may come as first again."""
    ship_package(items.sparkSession)
    kind = items.schema[key].dataType.simpleString()
    some = _timed(items.select(F.col(key).alias("key"), F.col(at).alias("seen_at"), F.col(order).cast("long").alias("ordinal")), "seen_at", late)
    out = some.groupBy("key").transformWithStateInPandas(FirstSeen(_millis(keep)), f"key {kind}, first_us long, ordinal long", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("first_us").alias(at), "ordinal")
