"""Removing old data: every function returns what stays and how much went."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_DAYS = 99_999


def delete_session(sessions: DataFrame, items: DataFrame, session_id) -> tuple[DataFrame, DataFrame]:
    """Sessions and items without one session."""
    gone = sessions.where(F.col("session_id") == session_id).select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), items.join(gone, "session_id", "left_anti")


def retain_sessions(sessions: DataFrame, items: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and items not older than `days`, and the numbers removed; `ALL_DAYS` or more removes all."""
    old = F.lit(True) if days >= ALL_DAYS else F.col("ts") < as_of - F.expr(f"interval {days} days")
    kept = sessions.where(~F.coalesce(old, F.lit(False)))
    kept_items = items.join(kept.select("session_id"), "session_id", "left_semi")
    removed = counts({"sessions": sessions}).withColumnRenamed("rows", "before").crossJoin(kept.agg(F.count("*").alias("kept")))
    return kept, kept_items, removed.select("table", (F.col("before") - F.col("kept")).alias("removed"))


def purge_history(
    changes: DataFrame, prices: DataFrame, products: DataFrame, baselines: DataFrame, cutoff: Column | None, include_products: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Change log and price history from `cutoff` on (null cutoff: nothing stays). With products, those not updated since
    go too, and with them all their prices, events and baselines; the counts tell these apart as cascaded."""
    keep = lambda df, at: df.where(F.col(at) >= cutoff) if cutoff is not None else df.limit(0)
    tables = {"changes": (changes, keep(changes, "changed_at")), "prices": (prices, keep(prices, "recorded_at"))}
    stay = keep(products, "updated_at") if include_products else products
    left = {n: now.join(stay.select("product_id"), "product_id", "left_semi") if include_products else now for n, (_, now) in tables.items()}
    left |= {"products": stay, "baselines": baselines.join(stay.select("product_id"), "product_id", "left_semi") if include_products else baselines}
    rows = []
    for n, (was, now) in (tables | {"products": (products, stay), "baselines": (baselines, baselines)}).items():
        rows.append(was.agg(F.count("*").alias("was")).crossJoin(now.agg(F.count("*").alias("now"))).crossJoin(left[n].agg(F.count("*").alias("left"))).select(
            F.lit(n).alias("table"), (F.col("was") - F.col("now")).alias("removed"), (F.col("now") - F.col("left")).alias("cascaded")))
    return left, reduce(DataFrame.unionByName, rows)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows): what clearing all of them would remove."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()])
