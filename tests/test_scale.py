"""Hot keys, ties and long lists: what a task holds stays bounded, and results equal the plain forms."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelftrail.operators import history, ranking, results, runs, scans


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


HISTORY = "product_id long, price double, recorded_at timestamp_ntz, event_id long"


def mixed(seed, n=400, hot=0.5):
    """A history where one product has half of the rows, some without price, some at equal times."""
    rng = random.Random(seed)
    return [(0 if rng.random() < hot else rng.randrange(1, 9), rng.choice([None, 1.0, 2.0, 3.5, 9.0]), at(rng.randrange(300)), i) for i in range(n)]


def strict_pairs(rows):
    out = []
    for p, price, t, i in rows:
        before = max((x[2] for x in rows if x[0] == p and x[2] < t), default=None)
        out += [(i, x[1]) for x in rows if before is not None and x[0] == p and x[2] == before]
    return out


def loose(pairs):
    return sorted(pairs, key=str)


@pytest.mark.parametrize("hours", [1, 24, 24 * 365])
def test_strict_look_back_for_any_range(spark, hours):
    rows = mixed(hours)
    got = history.with_previous_strict(spark.createDataFrame(rows, HISTORY), hours)
    assert loose((r.event_id, r.old_price) for r in got.collect()) == loose(strict_pairs(rows))


def test_steps_count_pairs_without_making_them(spark):
    rows = mixed(3)
    df, price = spark.createDataFrame(rows, HISTORY), {i: p for _, p, _, i in rows}
    when = {i: (p, t) for p, _, t, i in rows}
    want = Counter(), Counter(), Counter()
    for i, old in strict_pairs(rows):
        new = price[i]
        want[0][when[i]] += new != old
        want[1][when[i]] += new is not None and old is not None and new > old
        want[2][when[i]] += new is not None and old is not None and new < old
    for combine in (True, False):
        got = history.step_counts(history.price_steps(df, 24, combine)).collect()
        assert len(got) == len(want[0])
        for r in got:
            assert (r.changed, r.up, r.down) == tuple(w[r.product_id, r.recorded_at] for w in want)


def test_ties_stay_linear(spark):
    """3,000 rows of one product at two times: two steps whose sets hold the distinct prices, no row a pair."""
    rows = [(1, float(i % 700), at(i % 2), i) for i in range(3000)]
    df = spark.createDataFrame(rows, HISTORY)
    steps = history.price_steps(df).collect()
    assert len(steps) == 2 and sum(len(s.prices) + len(s.previous or []) for s in steps) <= 3 * 700
    counted = history.step_counts(history.price_steps(df)).first()
    odd, even = [p for _, p, t, _ in rows if t == at(1)], Counter(p for _, p, t, _ in rows if t == at(0))
    assert counted.changed == 1500 * 1500 - sum(even[p] for p in odd) and counted.up + counted.down == counted.changed
    assert history.price_steps(df.limit(0)).count() == 0
    untimed = spark.createDataFrame([(1, 1.0, None, 1), (1, 2.0, at(1), 2)], HISTORY)
    assert history.step_counts(history.price_steps(untimed)).count() == 0 and history.with_previous_strict(untimed).count() == 0


def test_one_price_a_time(spark):
    rows = [(1, 5.0, at(0), 1), (1, None, at(0), 2), (1, 7.0, at(1), 3), (1, 7.0, at(1), 3), (2, 1.0, at(0), 9)]
    got = history.one_price_a_time(spark.createDataFrame(rows, HISTORY), ["event_id"])
    assert got.columns == ["product_id", "price", "recorded_at", "event_id"]
    assert sorted((r.product_id, r.event_id, r.price) for r in got.collect()) == [(1, 2, None), (1, 3, 7.0), (2, 9, 1.0)]
    assert history.price_changes(got, strict=False).count() == history.price_changes(got, strict=True).count() == 1


@pytest.mark.parametrize("hours", [1, 24, 24 * 365])
def test_last_before_equals_a_window(spark, hours):
    df = spark.createDataFrame(mixed(hours + 1), HISTORY)
    w = Window.partitionBy("product_id").orderBy("recorded_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("last", F.last("price", ignorenulls=True).over(w))
    got = scans.last_before(df, ["product_id"], ["recorded_at", "event_id"], scans.time_range("recorded_at", hours), F.col("price"), "last")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_totals_equal_a_window(spark):
    df = spark.createDataFrame(mixed(5), HISTORY)
    w = Window.partitionBy("product_id").orderBy("recorded_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count("*").over(w), "s": F.coalesce(F.sum("price").over(w), F.lit(0.0))})
    got = scans.totals_upto(df, ["product_id"], ["recorded_at", "event_id"], scans.time_range("recorded_at"), {"n": F.lit(1), "s": F.col("price")})
    assert sorted((r.event_id, r.n, round(r.s, 6)) for r in got.collect()) == sorted((r.event_id, r.n, round(r.s, 6)) for r in want.collect())


def test_counters_equal_windows(spark):
    rng = random.Random(8)
    steps = spark.createDataFrame([(rng.randrange(3), at(i // 2), i, f"m{rng.randrange(9)}", rng.random() < 0.5) for i in range(200)], "run long, t timestamp_ntz, i long, model string, is_new boolean")
    got = sorted((r.i, r.products, r.new_products, r.models) for r in runs.running_counters(steps, "run", ["t", "i"], "model").collect())
    seen, want = {}, []
    for r in sorted(steps.collect(), key=lambda r: r.i):
        s = seen.setdefault(r.run, [0, 0, set()])
        s[0], s[1] = s[0] + 1, s[1] + r.is_new
        s[2].add(r.model)
        want.append((r.i, s[0], s[1], len(s[2])))
    assert got == want


def test_a_hot_product_is_spread(spark):
    """A product with all rows of 60 days: no task of the look-back's shuffle holds more than a few days of them."""
    df = spark.range(60 * 200).select(F.lit(1).cast("long").alias("product_id"), (F.col("id") % 7).cast("double").alias("price"), F.timestamp_micros(F.col("id") * 432_000_000).cast("timestamp_ntz").alias("recorded_at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        found = scans.last_before(df, ["product_id"], ["recorded_at"], scans.time_range("recorded_at"), F.col("price"), "last")
        held = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count("last").alias("known")).collect()
        assert sum(r.n for r in held) == 12_000 and sum(r.known for r in held) == 11_999 and max(r.n for r in held) <= 12_000 / 5
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- places ------------------------------------------------------------------------------------------------------------


@pytest.fixture
def whole_partitions(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_and_pages(spark, tmp_path, whole_partitions):
    rng = random.Random(4)
    values = [(i, rng.choice([None, 1, 1, 1, 2, 3, rng.randrange(50)])) for i in range(1000)]
    df = spark.createDataFrame(values, "id long, v long").repartition(6)
    listed = ranking.ranked(df, [F.desc_nulls_last("v"), F.asc("id")], str(tmp_path / "ranked"))
    want = [i for i, _ in sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    assert listed.total == 1000 and len(listed.starts) > 1 and listed.pages(30) == 34
    assert [r.id for r in listed.all().orderBy("position").collect()] == want
    assert [r.position for r in listed.all().orderBy("position").collect()] == list(range(1, 1001))
    for number, first in ((1, 0), (17, 480), (34, 990), (999, 990), (0, 0), (-3, 0)):
        page = listed.page(number, 30).orderBy("position").collect()
        assert [r.id for r in page] == want[first : first + 30] and [r.position for r in page] == list(range(first + 1, first + 1 + len(page)))
    parts = {r._part for r in listed.table.where(F.col("_part").isin([p for p, b, u in listed.starts if b < 510 and u >= 481])).select("_part").distinct().collect()}
    assert len(parts) <= 2


def test_pages_of_an_empty_list(spark, tmp_path):
    listed = ranking.ranked(spark.createDataFrame([], "id long"), [F.asc("id")], str(tmp_path / "none"))
    assert listed.total == 0 and listed.pages(10) == 1 and listed.page(3, 10).count() == 0 and listed.all().count() == 0


def test_deep_page_equals_page(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 13}", "s", "u", f"${i % 29}.00", "", "yes") for i in range(300)], "ordinal long, title string, site string, url string, original_formatted string, discounted_formatted string, stock_status string")
    listed = results.enrich(rows)
    for k, (number, size) in enumerate(((1, 50), (4, 50), (99, 40))):
        shallow = [(r.position, r.ordinal) for r in results.page(listed, number, size, "final-desc").orderBy("position").collect()]
        assert [(r.position, r.ordinal) for r in results.deep_page(listed, number, size, "final-desc", str(tmp_path / str(k))).orderBy("position").collect()] == shallow
