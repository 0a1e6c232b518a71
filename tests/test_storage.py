"""Tables in buckets and by day, partial counts, the search index, file heads, state streams and menus."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelftrail.operators import cards, catalog, day_tables, history, navigation, page_records, partials, product_pages, search_index, sessions
from shelftrail.sources import readers
from shelftrail.streaming import jobs, stateful, store


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


# --- buckets -----------------------------------------------------------------------------------------------------------


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


def test_bucket_store_writes_what_it_touches(spark, tmp_path):
    s = store.BucketStore(spark, str(tmp_path / "s"), "k", "k string, v int", 8)
    assert s.last() == -1 and s.read(-1).count() == 0
    first = keyed(spark, [(f"k{i}", i) for i in range(40)])
    s.write(0, first, s.touched(first))
    batch = keyed(spark, [("k3", 300)])
    touched = s.touched(batch)
    before = files(tmp_path)
    now = s.read(0, touched).join(batch.select("k"), "k", "left_anti").unionByName(batch)
    s.write(1, now, touched)
    assert len(touched) == 1 and {f for f in files(tmp_path) if "/data/v=1/" in f} and all(f"_bucket={touched[0]}" in f for f in files(tmp_path) if "/data/v=1/" in f)
    assert all(files(tmp_path)[f] == t for f, t in before.items())
    want = {(f"k{i}", i) for i in range(40)} - {("k3", 3)} | {("k3", 300)}
    assert {tuple(r) for r in s.read(1).collect()} == want and {tuple(r) for r in s.read(0).collect()} == {(f"k{i}", i) for i in range(40)}
    s.write(1, now, touched)  # again, as after a failure
    held = {x.k for x in now.collect()}
    assert {tuple(r) for r in s.read(1).collect()} == want and s.last() == 1
    s.write(2, s.read(1, touched).limit(0), touched)  # a bucket may become empty
    assert not any("/data/v=0/_bucket=%d" % touched[0] in f for f in files(tmp_path))
    assert {tuple(r) for r in s.read(2).collect()} == {r for r in want if r[0] not in held}
    with pytest.raises(ValueError, match="not named"):
        s.write(3, first, touched)
    assert s.last() == 2
    with pytest.raises(FileNotFoundError):
        s.read(7)


INCOMING = "ordinal long, sku string, product_url string, model_id long, title string, description string, price double, stock_status string"


def test_merge_stream_equals_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(n, f"S{rng.randrange(12)}", f"u/{rng.randrange(9)}", 1, f"t{n}", None, float(n // 7), "In Stock" if n % 4 else "sold out") for n in range(60)]
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    state = spark.createDataFrame([], catalog.STORED_PRODUCTS)
    for k in range(3):
        part = spark.createDataFrame(rows[20 * k : 20 * k + 20], INCOMING)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = spark.createDataFrame(catalog.upsert_products(state, part, now).products.collect(), catalog.STORED_PRODUCTS)
    stream = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "cat")
    jobs.catalog_merge_stream(stream, root, now, ["ordinal"], buckets=4).awaitTermination()
    got = lambda: sorted(map(tuple, jobs.merged_catalog(spark, root, 4).select(*state.columns).collect()), key=str)
    assert got() == sorted(map(tuple, state.collect()), key=str)
    last = spark.createDataFrame(rows[40:], INCOMING)
    jobs.merge_products(last, 2, root, now, ["ordinal"], 4)  # the last batch again
    assert got() == sorted(map(tuple, state.collect()), key=str)


def test_unfinished_snapshots_are_not_read(spark, tmp_path):
    root = str(tmp_path / "snap")
    keyed(spark, [("a", 1)]).write.parquet(f"{root}/batch=4")
    (tmp_path / "snap" / "batch=5").mkdir()
    (tmp_path / "snap" / "batch=5" / "part-0.parquet").write_bytes(b"half")
    assert jobs.last_snapshot(spark, root).collect()[0].v == 1


# --- days --------------------------------------------------------------------------------------------------------------


def test_purge_rewrites_one_day(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, at(i)) for i in range(24 * 6)] + [(999, None)], "i int, t timestamp_ntz")
    day_tables.write_days(rows, "t", path)
    before = files(tmp_path)
    gone = day_tables.purge_days(spark, path, "t", at(24 * 3 + 5))
    assert gone == {dt.date(2024, 1, d): 24 for d in (1, 2, 3)} | {dt.date(2024, 1, 4): 5}
    left = files(tmp_path)
    assert {r.i for r in spark.read.parquet(path).collect()} == {*range(24 * 3 + 5, 24 * 6), 999}
    kept = [f for f in before if any(f"day={d}" in f for d in ("2024-01-05", "2024-01-06", "__HIVE"))]
    assert kept and all(left[f] == before[f] for f in kept) and not any("day=2024-01-02" in f for f in left)
    assert day_tables.purge_days(spark, path, "t", at(24 * 3 + 5)) == {}
    assert day_tables.purge_days(spark, path, "t", at(24 * 4)) == {dt.date(2024, 1, 4): 19}  # a cut at midnight


def test_delete_rows_by_day(spark, tmp_path):
    path = str(tmp_path / "t")
    day_tables.write_days(spark.createDataFrame([(i % 5 if i < 48 else 7, at(i)) for i in range(72)], "s int, t timestamp_ntz"), "t", path)
    before = files(tmp_path)
    assert sum(day_tables.delete_rows(spark, path, F.col("s") == 7).values()) == 24
    assert day_tables.delete_rows(spark, path, F.col("s") == 7) == {}
    untouched = [f for f in before if "day=2024-01-03" not in f]
    assert all(files(tmp_path)[f] == before[f] for f in untouched) and spark.read.parquet(path).count() == 48
    assert sum(day_tables.delete_rows(spark, path, F.col("s") == 2).values()) == 10


def test_partials_add_up(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "p")
    rows = [(at(rng.randrange(24 * 9)), rng.choice("ab"), rng.randrange(4000), rng.random()) for _ in range(9000)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, site string, model int, v double")
    told = lambda x: partials.daily_partials(x, "t", ["site"], {"n": F.lit(1).cast("long"), "v": F.col("v")}, {"models": F.col("model")})
    partials.store_partials(told(df.where(F.col("t") < F.lit(at(24 * 6)))), path)
    before = files(tmp_path)
    partials.store_partials(told(df.where(F.col("t") >= F.lit(at(24 * 6)))), path)
    partials.store_partials(told(df.where(F.col("t") >= F.lit(at(24 * 8)))), path)  # a day again replaces itself
    assert all(files(tmp_path)[f] == t for f, t in before.items()) and len(partials.stored_days(spark, path)) == 9
    got = {r.site: r for r in partials.merged(spark.read.parquet(path), ["site"], ["n", "v"], ["models"], F.lit(dt.date(2024, 1, 3)), F.lit(dt.date(2024, 1, 8))).collect()}
    for site in "ab":
        inside = [r for r in rows if r[1] == site and at(48) <= r[0] < at(24 * 8)]
        exact = len({r[2] for r in inside})
        assert got[site].n == len(inside) and got[site].v == pytest.approx(sum(r[3] for r in inside))
        assert abs(got[site].models - exact) <= 5 * partials.ERROR * exact


# --- search ------------------------------------------------------------------------------------------------------------


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcÉé %_") for _ in range(rng.randint(0, 9)))
    rows = [(i, word() if i % 7 else None, word()) for i in range(400)]
    df = spark.createDataFrame(rows, "sku int, title string, url string")
    index = search_index.SearchIndex(spark, str(tmp_path / "i"), "sku", ("title", "url"), 4).build(df)
    for term in ("abc", "ABC", "cab", "éab", "ab", "a_c", "abca", "aab%b", "zzz", "", "b cc"):
        want = {r.sku for r in df.where(index.matches(term)).collect()}
        assert {r.sku for r in index.search(term).collect()} == want, term
    assert index.search("abc").columns == df.columns
    assert search_index.needed("Ab%cDe_fghi") == ["cde", "fgh", "ghi"] and search_index.needed("a_b%") == []
    assert 0 < index.candidates("abca").count() < 100 and index.candidates("ab") is None


# --- files -------------------------------------------------------------------------------------------------------------


def test_heads_read_the_beginning_alone(spark, tmp_path):
    folder = tmp_path / "img" / "deep"
    folder.mkdir(parents=True)
    (folder / "big.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 5_000_000)
    (tmp_path / "img" / "a b.gif").write_bytes(b"GIF89a")
    (tmp_path / "img" / "empty.jpg").write_bytes(b"")
    (tmp_path / "img" / "_SUCCESS").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: (r.size, r.format) for r in readers.image_heads(spark, str(tmp_path / "img")).collect()}
    assert got == {"big.png": (5_000_008, "PNG"), "a b.gif": (6, "GIF"), "empty.jpg": (0, None)}
    (tmp_path / "none").mkdir()
    assert readers.image_heads(spark, f"file://{tmp_path}/none").count() == 0
    assert {(r.format, r.processed, r.successful, r.failed) for r in readers.image_census(spark, str(tmp_path / "img")).collect()} == {("PNG", 1, 1, 0), ("GIF", 1, 1, 0), (None, 1, 0, 1)}


# --- state -------------------------------------------------------------------------------------------------------------

SEEN = "url string, price double, seen_at timestamp, ordinal long"


def stream_of(spark, tmp_path, parts):
    for part in parts:
        spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, stream, tmp_path):
    with stateful.with_state_store(spark):
        return jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect()


def test_state_drops_equal_batch(spark, tmp_path):
    rows = [("a" if n % 3 else "b", None if n % 17 == 5 else float(100 - 7 * (n % 11)), at(n), n) for n in range(60)]
    got = run(spark, stateful.price_drop_alerts(stream_of(spark, tmp_path, [rows[:20], rows[20:40], rows[40:]]), 10.0), tmp_path)
    want = history.price_drops(spark.createDataFrame(rows, SEEN), 10.0).collect()
    assert len(want) > 5 and sorted((r.ordinal, r.last_price) for r in got) == sorted((r.ordinal, r.last_price) for r in want)


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    parts = [[("a", 100.0, at(0), 1), ("b", 100.0, at(0), 2)], [("b", 99.0, at(30), 3)], [("c", 1.0, at(60), 4)], [("a", 10.0, at(61), 5), ("b", 10.0, at(61), 6)]]
    got = run(spark, stateful.price_drop_alerts(stream_of(spark, tmp_path, parts), 10.0, keep="48 hours"), tmp_path)
    assert [(r.url, r.last_price) for r in got] == [("b", 99.0)]  # a was last seen 60 hours before the stream's time


def test_first_seen_by_time_and_position(spark, tmp_path):
    parts = [[("a", 1.0, at(5), 9), ("a", 1.0, at(5), 3), ("b", 1.0, at(6), 4)], [("a", 1.0, at(4.5), 8), ("c", 1.0, at(7), 5)], [("d", 1.0, at(60), 6)], [("b", 1.0, at(61), 1)], [("e", 1.0, at(90), 7)]]
    got = run(spark, stateful.first_seen(stream_of(spark, tmp_path, parts), late="2 hours", keep="10 hours"), tmp_path)
    assert sorted((r.url, r.seen_at, r.ordinal) for r in got) == [("a", at(4.5), 8), ("b", at(6), 4), ("b", at(61), 1), ("c", at(7), 5), ("d", at(60), 6)]


# --- pages -------------------------------------------------------------------------------------------------------------


def test_links_that_share_one_card(spark):
    """10,000 product links in a list with one price: the list's text is read once and carried once."""
    html = "<div>" + "".join(f'<a href="/product/{i}">P {i}</a>' for i in range(10_000)) + "<p>In stock, from $5.00</p></div>"
    own = "<ul>" + "".join(f'<li><a href="/product/x{i}">X {i}</a><b>${i}.50</b><i>sold out</i></li>' for i in range(3)) + "</ul>"
    df = spark.createDataFrame([(1, "https://a.example/", html), (2, "https://a.example/", own)], "page_id long, url string, html string")
    raw = cards.card_rows(df, "links").where("page_id = 1")
    assert raw.where("stock_texts is not null").count() == 1 and raw.select("card").distinct().count() == 1
    got = cards.listing_items(df, "links").collect()
    assert {(r.price_value, r.stock_status) for r in got if r.page_id == 1} == {(5.0, "in_stock")} and len(got) == 10_003
    assert sorted((r.title, r.price_value, r.stock_status) for r in got if r.page_id == 2) == [(f"X {i}", i + 0.5, "out_of_stock") for i in range(3)]


def test_menu_brands(spark):
    menu = (
        '<div class="mobile-nav"><ul><li class="level0 samsung x"><ul class="level0"><li><ul class="sview-row"><li><a class="nlabel-f" href="/s/1">S  1</a><a class="nlabel-f" href="https://x/y">no</a></li></ul></ul></li>'
        '<li class="my-applestuff"><ul class="level0"><ul class="sview-row"><li><a class="nlabel-f" href="/a/1">A</a></ul></ul></li><li class="other"><ul class="level0"><ul class="sview-row"><a class="nlabel-f" href="/o">O</a></ul></ul></li></ul></div>'
        '<nav><a href="/replacement-parts/z">Z</a><a href="/s/1">again</a><a href="/product-category/w">W</a></nav>'
    )
    df = spark.createDataFrame([(1, "https://a.example/", menu), (2, None, None), (3, "https://a.example/", "")], "page_id long, url string, html string")
    got = {(r.url, r.label, r.brand) for r in navigation.category_menu(df).collect()}
    assert got == {
        ("https://a.example/s/1", "S 1", "Samsung"), ("https://a.example/a/1", "A", None),
        ("https://a.example/replacement-parts/z", "Z", "Unknown"), ("https://a.example/product-category/w", "W", "WooCommerce"),
    }


def test_second_schema(spark):
    rows = [("u1", "", "t", 10.0, 8.0, "$10", "$8", None), ("u2", "s", "t", 10.0, 0.0, "$10", "", None), ("u3", None, "t", None, None, None, None, "i")]
    second = spark.createDataFrame(rows, "url string, site string, title string, original double, discounted double, original_formatted string, discounted_formatted string, image_url string")
    got = {r.url: r for r in sessions.canonical_items(second, "d.example", "auto").collect()}
    assert (got["u1"].site, got["u1"].price_value, got["u1"].price_text) == ("d.example", 8.0, "$8") and (got["u2"].site, got["u2"].price_value, got["u2"].price_text) == ("s", 10.0, "$10")
    assert got["u3"].price_value is None and got["u3"].price_currency == "USD" and got["u3"].source == "auto"
    first = second.select("url", F.lit(1.0).alias("price_value"), F.lit("x").alias("brand"))
    assert sessions.supplier_items([first, sessions.canonical_items(second, "d", "auto")]).where("brand is null").count() == 3


def test_one_parse_gives_what_three_give(spark):
    menu = '<nav><a href="/replacement-parts/z">Z</a></nav><div class="mobile-nav"><li class="lg"><ul class="level0"><ul class="sview-row"><a class="nlabel-f" href="/l">L</a></ul></ul></li></div>'
    item = '<h1>T</h1><li class="item"><a href="/p/1">One</a><span class="price">$3.50</span><p class="stock">sold out</p></li><li class="item"><a href="/p/2" title="Two">2</a><img src="/i.png"></li>'
    rows = [(1, "https://a.example/x", f"<html>{item}{menu}</html>"), (2, "https://a.ca/y", menu), (3, None, None), (4, "https://a.example/z", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = page_records.parse_pages(df)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(page_records.listing_items(parsed, percent_off=10.0), cards.listing_items(df, percent_off=10.0)) and cards.listing_items(df).count() == 2
    assert same(page_records.product_rows(parsed), product_pages.product_rows(df)) and same(page_records.category_menu(parsed), navigation.category_menu(df))
    assert page_records.parse_pages(df.limit(0)).count() == 0
