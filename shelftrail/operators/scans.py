"""Scans along an order that one hot key does not hold up.

A window per key puts all rows of a key into one task. Here a key's rows are cut into ranges along the order, a range of a
key is what a task gets, and what earlier ranges leave behind comes from a scan of one summary row per key and range. So the
rows move once, and a key with a third of them is spread over as many tasks as it has ranges. Keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_HOURS = 24
_UPTO, _BEFORE = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)


def time_range(at: str | Column, hours: float = RANGE_HOURS) -> Column:
    """The number of the stretch of `hours` that a time falls into; no time comes before all."""
    micros = F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))
    return F.coalesce(F.floor(micros / int(hours * 3_600_000_000)).cast("long"), F.lit(-(1 << 62)))


def last_before(rows: DataFrame, keys: list[str], order: list[str], within: Column, value: Column, name: str) -> DataFrame:
    """`rows` with `name`: the last `value` that is not null of an earlier row of the same keys.

    `within`: the range of a row, a number that never falls along `order`.
    """
    ranged = rows.withColumns({"_range": within, "_value": value})
    known = F.when(F.col("_value").isNotNull(), F.struct(*order))
    ends = ranged.groupBy(*keys, "_range").agg(F.max_by("_value", known).alias("_end"))
    left = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(*_BEFORE))
    carried = ends.select(*keys, "_range", left.alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*_BEFORE)
    both = ranged.join(carried, [*keys, "_range"], "left")
    found = F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried"))
    return both.withColumn(name, found).select(*rows.columns, name)


def totals_upto(rows: DataFrame, keys: list[str], order: list[str], within: Column, sums: dict[str, Column]) -> DataFrame:
    """`rows` with running sums, the row itself included; `order` tells all rows of a key apart."""
    ranged = rows.withColumns({"_range": within} | {f"_{n}": v for n, v in sums.items()})
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*_BEFORE)
    carried = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*_UPTO)
    both = ranged.join(carried, [*keys, "_range"], "left")
    return both.withColumns({n: F.col(f"_before_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}).select(*rows.columns, *sums)
