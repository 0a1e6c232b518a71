"""Price history: previous prices, changes and drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.change import direction, price_difference
from .scans import RANGE_HOURS, last_before, time_range


def with_previous(history: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """`history` (product_id, price, recorded_at, ...) with the price of the row before, by time within the product.

    One shuffle on product_id. Where a product has several rows of one time, `ties` puts them in order; see
    `with_previous_strict` for a rule that needs none.
    """
    w = Window.partitionBy("product_id").orderBy("recorded_at", *ties)
    return history.withColumns({"old_price": F.lag("price").over(w), "previous_at": F.lag("recorded_at").over(w)}).where("previous_at is not null")


def price_steps(history: DataFrame, hours: float = RANGE_HOURS, combine: bool = True) -> DataFrame:
    """One row per product and time with its distinct prices and those of the time before: product_id, recorded_at, prices,
    previous_at, previous (arrays of price and its number of rows n, by price; null at a product's first time).

    The size follows the distinct prices, however many rows share a time. A product's times are scanned in ranges of
    `hours`; with `combine` rows that repeat a price at a time are counted before anything is brought together, which a
    history with one row per product and time can do without. Rows without a time are left out.
    """
    timed = history.where("recorded_at is not null").select("product_id", "price", "recorded_at", time_range("recorded_at", hours).alias("_range"))
    if combine:
        timed = timed.groupBy("product_id", "_range", "recorded_at", "price").agg(F.count("*").alias("n"))
    together = timed.repartition("product_id", "_range")
    if not combine:
        together = together.groupBy("product_id", "_range", "recorded_at", "price").agg(F.count("*").alias("n"))
    moments = together.groupBy("product_id", "_range", "recorded_at").agg(F.array_sort(F.collect_list(F.struct("price", "n"))).alias("prices"))
    before = F.struct(F.col("recorded_at").alias("previous_at"), F.col("prices").alias("previous"))
    seen = last_before(moments, ["product_id"], ["recorded_at"], F.col("_range"), before, "_before")
    return seen.select("product_id", "recorded_at", "prices", "_before.previous_at", "_before.previous")


def step_counts(steps: DataFrame) -> DataFrame:
    """Steps with the number of pairs of a row and a row of the time before: `changed` ones (null apart from any price), and
    of these `up` and `down`. One walk along the prices of both times in order; no pair is made."""
    side = lambda name, late: F.transform(name, lambda p: F.struct(p["price"].alias("price"), F.lit(late).alias("late"), p["n"].alias("n")))
    merged = F.array_sort(F.concat(side("previous", 0), side("prices", 1)))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("double").alias("price"), zero.alias("here"), zero.alias("priced"), zero.alias("same"), zero.alias("up"), zero.alias("even"))

    def walk(at: Column, p: Column) -> Column:
        alike = at["price"].eqNullSafe(p["price"].cast("double"))
        here = F.when(alike, at["here"]).otherwise(zero)  # rows of the time before at this price
        old, known = p["late"] == 0, p["price"].isNotNull()
        return F.struct(
            p["price"].cast("double").alias("price"), F.when(old, here + p["n"]).otherwise(here).alias("here"),
            F.when(old & known, at["priced"] + p["n"]).otherwise(at["priced"]).alias("priced"),
            F.when(old, at["same"]).otherwise(at["same"] + p["n"] * here).alias("same"),
            F.when(old | ~known, at["up"]).otherwise(at["up"] + p["n"] * (at["priced"] - here)).alias("up"),
            F.when(old | ~known, at["even"]).otherwise(at["even"] + p["n"] * here).alias("even"),
        )

    rows = lambda name: F.aggregate(name, zero, lambda total, p: total + p["n"])
    priced = lambda name: F.aggregate(name, zero, lambda total, p: total + F.when(p["price"].isNotNull(), p["n"]).otherwise(zero))
    told = steps.where("previous_at is not null").withColumn("_m", F.aggregate(merged, start, walk))
    return told.withColumns({
        "changed": rows("prices") * rows("previous") - F.col("_m.same"),
        "up": F.col("_m.up"), "down": priced("prices") * priced("previous") - F.col("_m.up") - F.col("_m.even"),
    }).drop("_m")


def with_previous_strict(history: DataFrame, hours: float = RANGE_HOURS) -> DataFrame:
    """`with_previous` by strictly earlier time: rows of equal time all look back to the time before, each row of which matches.

    The look-back itself is `price_steps`; rows are joined to it by product and time, so a hot product is spread as there.
    """
    steps = price_steps(history, hours, combine=False).where("previous_at is not null").drop("prices")
    each = F.flatten(F.transform("previous", lambda p: F.array_repeat(p["price"], p["n"].cast("int"))))
    seen = history.join(steps, ["product_id", "recorded_at"])
    return seen.select(*history.columns, F.explode(each).alias("old_price"), "previous_at")


def one_price_a_time(history: DataFrame, order: list[str]) -> DataFrame:
    """Of rows of one product and time the last by `order`: what is kept of a batch when it is written, so that no later
    look-back meets several. An aggregate, so rows that repeat combine before they move."""
    rest = [c for c in history.columns if c not in ("product_id", "recorded_at")]
    last = history.groupBy("product_id", "recorded_at").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*[F.col(c) if c not in rest else F.col(f"_last.`{c}`").alias(c) for c in history.columns])


def price_changes(history: DataFrame, strict: bool = True) -> DataFrame:
    """Rows whose price differs from the one before, null apart from any price, with difference and direction.

    The one before is the latest strictly earlier one; without `strict`, for histories with one row per time, the row before.
    """
    seen = with_previous_strict(history) if strict else with_previous(history)
    changed = seen.where(~F.col("price").eqNullSafe(F.col("old_price")))
    difference = price_difference(F.col("old_price"), F.col("price"))
    return changed.withColumn("difference", difference).withColumn("direction", direction(F.col("difference")))


def count_recent(changes: DataFrame, at: str, as_of: Column, hours: int = 24) -> DataFrame:
    return changes.agg(F.count_if(F.col(at) >= as_of - F.expr(f"interval {hours} hours")).alias("n"))


def count_recent_changes(history: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The number of price changes of the last `hours`, as `price_changes` has them, from steps alone: no pair of rows is made."""
    since = as_of - F.expr(f"interval {hours} hours")
    steps = price_steps(history, combine=False).where((F.col("recorded_at") >= since) & F.col("previous_at").isNotNull())
    return step_counts(steps).agg(F.coalesce(F.sum("changed"), F.lit(0)).alias("n"))


def price_drops(items: DataFrame, threshold: float, key: str = "url", order: tuple[str, ...] = ("seen_at", "ordinal"), hours: float = RANGE_HOURS) -> DataFrame:
    """Rows whose price fell by `threshold` percent or more since the last price of the same key: (.., last_price, drop_percent).
    `order` begins with a time, in ranges of `hours` of which a key's rows are dealt to tasks."""
    seen = last_before(items, [key], list(order), time_range(order[0], hours), F.col("price"), "last_price")
    down = F.try_divide(F.col("last_price") - F.col("price"), F.col("last_price")) * 100
    return seen.where(down >= threshold).withColumn("drop_percent", F.bround(down, 2))
