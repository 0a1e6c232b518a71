"""Deleting from tables that are stored by day: only the days that lose some of their rows are written again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.store import delete

DAY = "day"


def write_days(rows: DataFrame, at: str, path: str, mode: str = "append") -> None:
    """`rows` by the day of their time `at`."""
    rows.withColumn(DAY, F.to_date(at)).write.mode(mode).partitionBy(DAY).parquet(path)


def _rewrite(spark: SparkSession, path: str, day: dt.date, gone: Column) -> None:
    kept = spark.read.parquet(path).where((F.col(DAY) == F.lit(day)) & ~F.coalesce(gone, F.lit(False)))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def delete_rows(spark: SparkSession, path: str, gone: Column, days: Column | None = None) -> dict[dt.date, int]:
    """Delete the rows for which `gone` holds, of the days for which `days` holds; how many went, by day.

    A day that loses all rows is dropped, one that loses some is written again, no other is touched. What comes to the driver
    is one row per day. After a failure the same call finishes the work.
    """
    table = spark.read.parquet(path)
    if days is not None:
        table = table.where(days)
    lost = table.groupBy(DAY).agg(F.count("*").alias("n"), F.count_if(F.coalesce(gone, F.lit(False))).alias("lost")).where("lost > 0").collect()
    for r in lost:
        if r.lost < r.n:
            _rewrite(spark, path, r.day, gone)
        else:
            delete(spark, f"{path}/{DAY}={r.day}")
    return {r.day: r.lost for r in lost}


def purge_days(spark: SparkSession, path: str, at: str, cutoff: dt.datetime) -> dict[dt.date, int]:
    """Delete what is older than `cutoff`; how many rows went, by day. Whole days before it are counted from the files' own
    statistics and dropped unread, the day of the cutoff is the only one that is read and written."""
    table = spark.read.parquet(path)
    whole = {r.day: r["count"] for r in table.where(F.col(DAY) < F.lit(cutoff.date())).groupBy(DAY).count().collect()}
    gone = delete_rows(spark, path, F.col(at) < F.lit(cutoff), F.col(DAY) == F.lit(cutoff.date()))
    for day in whole:
        delete(spark, f"{path}/{DAY}={day}")
    return whole | gone


def delete_session(spark: SparkSession, path: str, session_id) -> int:
    """Delete a session's items from `items` as `save_session` writes them: the day that has them is found by column statistics."""
    return sum(delete_rows(spark, f"{path}/items", F.col("session_id") == F.lit(session_id)).values())
