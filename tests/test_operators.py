"""Catalog, history, results, pages, files and streams on small inline frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelftrail.operators import cards, catalog, changes, compare, history, pages, product_pages, results, retention, runs, sessions
from shelftrail.sources import readers, writers
from shelftrail.streaming import jobs


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


HISTORY = "product_id long, price double, recorded_at timestamp_ntz, event_id long"


def test_previous_price_with_and_without_ties(spark):
    rows = [(1, 10.0, at(0), 1), (1, 10.0, at(1), 2), (1, 8.0, at(2), 3), (1, None, at(3), 4), (2, 5.0, at(0), 5)]
    df = spark.createDataFrame(rows, HISTORY)
    for strict in (False, True):
        got = sorted((r.event_id, r.old_price, r.difference, r.direction) for r in history.price_changes(df, strict).collect())
        assert got == [(3, 10.0, -2.0, "down"), (4, 8.0, -8.0, "down")]
    tied = spark.createDataFrame([(1, 1.0, at(0), 1), (1, 2.0, at(1), 2), (1, 3.0, at(1), 3), (1, 4.0, at(2), 4)], HISTORY)
    got = sorted((r.event_id, r.old_price) for r in history.price_changes(tied, strict=True).collect())
    assert got == [(2, 1.0), (3, 1.0), (4, 2.0), (4, 3.0)]


def test_price_drops_look_back_within_a_batch(spark):
    df = spark.createDataFrame([("a", 100.0, at(0), 1), ("a", 91.0, at(1), 2), ("a", 80.0, at(2), 3), ("b", 1.0, at(0), 4), ("a", None, at(3), 5), ("a", 60.0, at(4), 6)], "url string, price double, seen_at timestamp_ntz, ordinal long")
    assert sorted((r.ordinal, r.last_price, r.drop_percent) for r in history.price_drops(df, 10.0).collect()) == [(3, 91.0, 12.09), (6, 80.0, 25.0)]


STORED = "sku string, product_url string, model_id long, title string, description string, price double, stock_status string, created_at timestamp_ntz, updated_at timestamp_ntz"
INCOMING = "ordinal long, sku string, product_url string, model_id long, title string, description string, price double, stock_status string"


def test_upsert_captures_changes(spark):
    stored = spark.createDataFrame([("A", "u/a", 1, "a", "old text", 10.0, "In Stock", at(0), at(0)), ("B", "u/b", 1, "b", "", 5.0, "yes", at(0), at(0)), ("C", "u/c", 2, "c", None, None, None, at(0), at(0))], STORED)
    batch = [
        (1, "A", "u/a", 9, "a2", "new text", 12.0, "Sold Out"), (2, "A", "u/a", 9, "a3", "later", 99.0, "x"), (3, "B", "u/b", 1, "b", "", None, " "),
        (4, "N", "u/n", 3, "n", None, 7.0, "In Stock"), (5, "M", "u/m", 3, "m", None, None, None), (6, "X", "u/a", 3, "x", None, 1.0, None), (7, "Y", "u/n", 3, "y", None, 1.0, None),
    ]
    out = catalog.upsert_products(stored, spark.createDataFrame(batch, INCOMING), F.lit("2024-02-01").cast("timestamp_ntz"))
    products = {r.sku: (r.model_id, r.title, r.price, r.updated_at == at(0)) for r in out.products.collect()}
    assert products == {"A": (1, "a2", 12.0, False), "B": (1, "b", None, False), "C": (2, "c", None, True), "N": (3, "n", 7.0, False), "M": (3, "m", None, False)}
    assert sorted((r.sku, r.price) for r in out.prices.collect()) == [("A", 12.0), ("N", 7.0)]
    events = sorted((r.sku, r.change_type, r.old_value, r.new_value) for r in out.changes.fillna("").collect())
    assert events == [("A", "description", "old text", "new text"), ("A", "stock", "In Stock", "Sold Out"), ("M", "new", "", "m"), ("N", "new", "", "n")]
    assert {r.sku for r in out.baselines.collect()} == {"M", "N"} and {r.sku for r in out.rejected.collect()} == {"X", "Y"}
    assert tuple(out.summary.first()[:3]) == (4, 2, 2)


def test_upsert_twice_logs_once(spark):
    batch = spark.createDataFrame([(1, "A", "u/a", 9, "a", "t", 12.0, "In Stock")], INCOMING)
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    once = catalog.upsert_products(spark.createDataFrame([], STORED), batch, now)
    twice = catalog.upsert_products(once.products, batch, now)
    assert once.changes.count() == 1 and twice.changes.count() == 0 and twice.prices.count() == 0 and twice.products.count() == 1


def test_catalog_stream_equals_batches(spark, tmp_path):
    rows = [(n, f"S{n % 5}", f"u/{n % 5}", 1, f"t{n}", None, float(n // 7), "In Stock" if n % 4 else "sold out") for n in range(45)]
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    state, logged = spark.createDataFrame([], STORED), 0
    for k in range(3):
        part = spark.createDataFrame(rows[15 * k : 15 * k + 15], INCOMING)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = catalog.upsert_products(state, part, now)
        state, logged = spark.createDataFrame(out.products.collect(), STORED), logged + out.changes.count()
    stream = spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.catalog_stream(stream, str(tmp_path / "cat"), now, ["ordinal"]).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "cat/products/batch=2")).select(*state.columns)
    assert sorted(got.collect()) == sorted(state.collect()) and spark.read.parquet(str(tmp_path / "cat/changes")).count() == logged > 5


def test_item_batch_makes_dimensions(spark):
    rows = [(1, "https://a/x-1", None, "t1", "", 1.0, "yes", "A > B > C", None, None), (2, "https://a/x-1/", " ", "t2", "", 2.0, "yes", "Z", None, None), (3, "https://a/y", "k 9", "t3", "", None, None, "", "L", None), (4, "https://a/z", None, "t4", "", 1.0, "no", "A > b > D", None, None)]
    schema = "o long, url string, sku string, title string, description string, price double, stock_status string, category_path string, label string, brand string"
    batch = catalog.item_batch(spark.createDataFrame(rows, schema), ["o"])
    assert sorted((r.sku, r.title) for r in batch.products.collect()) == [("K-9", "t3"), ("X-1", "t1"), ("Z", "t4")]
    assert sorted(r.name for r in batch.brands.collect()) == ["A", "L"] and sorted(r.name for r in batch.categories.collect()) == ["B", "L"] and batch.models.count() == 3
    new = catalog.upsert_products(spark.createDataFrame([], STORED), batch.products, F.lit("2024-02-01").cast("timestamp_ntz"), ["o"])
    assert new.summary.first().new == 3


def test_feed_fallback_only_when_empty(spark):
    feed = spark.createDataFrame([(1, "price")], "product_id long, change_type string")
    base = spark.createDataFrame([(2, "baseline"), (3, "baseline")], "product_id long, change_type string")
    assert [r.product_id for r in changes.feed_with_fallback(feed, base).collect()] == [1]
    assert changes.feed_with_fallback(feed.limit(0), base).count() == 2


def test_compare_priority(spark):
    sheet = spark.createDataFrame([(1, "iPhone 12 Pro LCD", "s1", "http://x/1", 1.0), (2, "iPhone 13 Pro", "s2", "", 2.0), (3, "Cable", "", "", 3.0), (4, "Cable", "", "", 4.0), (5, None, None, None, 5.0)], "ordinal long, title string, site string, url string, price double")
    rows = spark.createDataFrame([(1, "other", "s9", "HTTP://x/1"), (2, "iphone 13 pro", "S2", ""), (3, "cable", "s1", ""), (4, "iPhone 99 Pro", "s1", ""), (5, "nothing", None, None), (6, None, None, None)], "ordinal long, title string, site string, url string")
    got = {r.ordinal: r.cmp_price for r in compare.with_compare_price(rows, sheet).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 4.0, 4: 1.0, 5: None, 6: None}


def test_result_orders_and_filters(spark):
    rows = spark.createDataFrame(
        [(1, "Screen 10", "b.example", "https://b.example/1", "$20.00", "$15.00", "in stock"), (2, "Screen 9", "a.example", "https://a.example/2", "", "", None), (3, "screen 9", "c.example", "https://c.example/3", "$5.00", "", "sold out")],
        "ordinal long, title string, site string, url string, original_formatted string, discounted_formatted string, stock_status string",
    )
    listed = results.enrich(rows)
    order = lambda o: [r.ordinal for r in listed.orderBy(*results.order_columns(o)).collect()]
    assert order("final-asc") == [3, 1, 2] and order("final-desc") == [1, 3, 2] and order("title-asc") == [2, 3, 1] and order("source-desc") == [3, 1, 2] and order("discount-desc") == [1, 2, 3]
    assert [r.ordinal for r in results.price_filter(listed, 10.0, None).collect()] == [1]
    assert sorted(r.ordinal for r in results.price_filter(listed, None, 10.0).collect()) == [2, 3]
    assert sorted(r.ordinal for r in results.results(rows, results.ResultOptions(hide_duplicates=True)).collect()) == [1, 2]
    assert results.page(listed, 9, 2, "final-asc").count() == 1
    assert [r.ordinal for r in results.results(rows, results.with_preset("refurbished", include=[], exclude=["10"])).orderBy("ordinal").collect()] == [2, 3]


def test_run_and_session_helpers(spark):
    log = spark.createDataFrame([(1, 1, "running", None), (1, 2, None, 5), (1, 3, "completed", None)], "run long, at int, status string, n int")
    assert tuple(runs.latest_state(log, "run", ["at"], ["status", "n"]).first()) == (1, "completed", 5)
    last = spark.createDataFrame([(at(0),)], "last_run timestamp_ntz")
    assert runs.minutes_to_next(last, F.lit(at(2)).cast("timestamp_ntz"), 12).first().eta_minutes == 600
    assert runs.minutes_to_next(last, F.lit(at(20)).cast("timestamp_ntz"), 12).first().eta_minutes == 0
    none = runs.last_run(spark.createDataFrame([], "status string, started_at timestamp_ntz"))
    assert runs.minutes_to_next(none, F.lit(at(2)).cast("timestamp_ntz"), 12).first().eta_minutes == 0
    assert tuple(sessions.span_labels(spark.createDataFrame([], "ts timestamp_ntz")).first()) == ("Never", "N/A")
    empty = sessions.statistics(spark.createDataFrame([], "session_id long, ts timestamp_ntz"), spark.createDataFrame([], "price double, site string"), F.lit(at(0)).cast("timestamp_ntz")).first()
    assert empty.total_sessions == 0 and empty.avg_price == 0 and empty.success_rate == 0
    known = spark.createDataFrame([(1, "https://a/x", "X"), (2, "https://a/y", "Y")], "ordinal long, url string, label string")
    assert runs.seed_scope(known, "/x").count() == 1 and runs.seed_scope(known, "/zz").first().url == "/zz"
    a, b = (spark.createDataFrame([(u, lab) for u in us], "url string, label string") for us, lab in ((["1", "2"], "a"), (["2", "3"], "b")))
    assert {(r.url, r.label) for r in runs.merge_discoveries([a, b], [0, 5]).collect()} == {("1", "a"), ("2", "a"), ("3", "b")}
    assert runs.merge_discoveries([a, b], [0, 2]).count() == 2


def test_retention_cascades(spark):
    change = spark.createDataFrame([(1, at(0)), (1, at(9)), (2, at(9))], "product_id long, changed_at timestamp_ntz")
    price = change.withColumnRenamed("changed_at", "recorded_at")
    product = spark.createDataFrame([(1, at(0)), (2, at(9))], "product_id long, updated_at timestamp_ntz")
    left, gone = retention.purge_history(change, price, product, product.select("product_id"), F.lit(at(5)).cast("timestamp_ntz"), include_products=True)
    assert {r.table: (r.removed, r.cascaded) for r in gone.collect()} == {"changes": (1, 1), "prices": (1, 1), "products": (1, 0), "baselines": (0, 1)}
    assert left["prices"].count() == 1
    _, all_gone = retention.purge_history(change, price, product, product.select("product_id"), None)
    assert {r.table: r.removed for r in all_gone.collect()}["prices"] == 3


GENERIC = '<ul class="product-listing"><li class="item"><a href="/p/1">Lens&nbsp;A</a><span class="price">$1,200.00</span><p class="stock">Only 2 left</p><img data-src="/i.png"></li><li class="item"><span>no link</span></li></ul>'
LOOP = '<nav class="woocommerce-breadcrumb"><a>Home</a><a>Parts</a><a>Phones</a></nav><ul><li class="product"><a href="https://b.example/p/2"><h2 class="woocommerce-loop-product__title">Cell B</h2></a><span class="price"><del><span class="amount">$10.00</span></del> <ins><span class="amount">$8.00</span></ins></span></li></ul>'
LINKS = '<div><div><a href="/product/long-name"><img src="/x.png"></a><h6><a href="/product/long-name">Long Name Part</a></h6><b>$7.25</b></div></div>'


@pytest.mark.parametrize(
    ("layout", "html", "want"),
    [
        ("generic", GENERIC, ("https://a.example/p/1", "Lens A", 1200.0, "limited", "https://a.example/i.png", "")),
        ("loop", LOOP, ("https://b.example/p/2", "Cell B", 8.0, None, "", "Parts > Phones")),
        ("links", LINKS, ("https://a.example/product/long-name", "Long Name Part", 7.25, None, "https://a.example/x.png", "")),
    ],
)
def test_listing_layouts(spark, layout, html, want):
    df = spark.createDataFrame([(1, "https://a.example/list", html), (2, "https://a.example/none", None), (3, "https://a.example/odd", "<p>a < b")], "page_id long, url string, html string")
    got = cards.listing_items(df, layout).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.url, r.title, r.price_value, r.stock_status, r.image_url, r.category_path) == want


def test_deep_and_unclosed_pages(spark):
    deep = "<div>" * 10_000 + '<li class="item"><a href="/p/1">Deep</a><span class="price">$5.00</span></li>' + "</div>" * 10_000
    unclosed = '<ul><li class="item"><a href="/p/2">Two</a><p>$1' + "<p>x" * 10_000 + '<li class="item"><a href="/p/3">Three</a><span class="price">$3.00</span></ul>'
    df = spark.createDataFrame([(1, "https://a.example/", deep), (2, "https://a.example/", unclosed)], "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.price_value for r in cards.listing_items(df).collect()}
    assert got == {(1, "https://a.example/p/1"): 5.0, (2, "https://a.example/p/2"): None, (2, "https://a.example/p/3"): 3.0}
    tags = [(n.tag, n.text()) for n in cards.tree("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>q<div>r</div></span>").all()]
    assert tags == [("ul", "a b c d"), ("li", "a b c"), ("ul", "b c"), ("li", "b"), ("li", "c"), ("li", "d"), ("table", "1 2 3"), ("tr", "1 2"), ("td", "1"), ("td", "2"), ("tr", "3"), ("td", "3"), ("p", "q"), ("div", "r")]


def test_product_pages_without_anything(spark):
    df = spark.createDataFrame([(1, "https://a.ca/x", None), (2, None, ""), (3, "https://a.example/y", "<b data-price-amount='x'>$7.50</b><script type='application/ld+json'>{}</script>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in product_pages.product_rows(df).collect()}
    assert got[1].price_value is None and got[1].title == "" and got[1].price_currency == "CAD" and got[1].original_formatted == "" and got[1].price_text == "price_not_found_or_hidden"
    assert got[2].stock_status is None and got[3].price_value is None and got[3].url == "https://a.example/y"
    assert product_pages.product_rows(df.limit(0)).count() == 0


def test_nested_offers_and_flags(spark):
    offers = ['{"offers": {"availability": true, "price": 3}}', '{"offers": [{"price": "x"}, {"inStock": false, "price": "4.50"}]}', '{"offers": {"offers": [{"availability": "https://schema.org/PreOrder", "price": 9}]}}', '{"offers": {"available": "yes"}}', '{"name": " N "}']
    df = spark.createDataFrame([(i, o) for i, o in enumerate(offers)], "i int, v string").select("i", pages.product_facts(F.parse_json("v")).alias("x")).select("i", "x.*")
    got = {r.i: (r.price, r.stock_status) for r in df.collect()}
    assert got == {0: (3.0, "in_stock"), 1: (4.5, "out_of_stock"), 2: (9.0, "preorder"), 3: (None, "in_stock"), 4: (None, None)}


def test_unreadable_session_json(spark):
    df = spark.createDataFrame([(1, '["a", "b"]', '{"site": "s", "percent_off": 5, "category_urls": ["u"], "x": 1}'), (2, "oops", "{"), (3, None, None)], "session_id long, urls string, rules string")
    got = {r.session_id: r for r in sessions.with_json(df).collect()}
    assert got[1].urls == ["a", "b"] and got[1].rules.site == "s" and got[1].rules.percent_off == 5.0 and got[1].rules.category_urls == ["u"]
    assert got[2].urls == [] and got[2].rules is None and got[3].urls == [] and got[3].rules is None
    back = {r.session_id: r for r in sessions.with_json(sessions.as_json(sessions.with_json(df))).collect()}
    assert back == got


def test_structured_data_and_pages(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":" N ","offers":[{"price":"bad"},{"price":"12.00","priceCurrency":"USD","availability":"https://schema.org/InStock"}]}]}</script><script type="application/ld+json">not json</script>'
    df = spark.createDataFrame([(1, "https://a.example/x?p=1", html), (2, "https://a.example/y", None)], "page_id long, url string, html string")
    assert [tuple(r) for r in pages.jsonld_products(df).collect()] == [(1, "N", 12.0, "USD", "in_stock")]
    facts = {r.page_id: r for r in pages.page_facts(df).collect()}
    assert facts[1].kind == "product" and facts[1].canonical_url == "https://a.example/x?p=1" and facts[2].title == ""
    one = spark.createDataFrame([("<p>Checking your browser before accessing</p>", "<h1>A &amp; B</h1>", '<a rel="next" href="/x?p=5">', "showing 1 - 20 of 21", '{"loadMoreUrl": "\\/more?a=1"}')], "a string, b string, c string, d string, e string")
    base = F.lit("https://a.example/x?p=1")
    got = one.select(pages.is_challenge(F.col("a")), pages.page_title(F.col("b")), pages.next_page(F.col("c"), base), pages.has_more(F.col("d"), F.lit(3)), pages.load_more_urls(F.col("e"), base)).first()
    assert tuple(got) == (True, "A & B", "https://a.example/x?p=5", True, ["https://a.example/more?a=1"])


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('﻿Name , AMOUNT,Vendor\n"A ""x""","1,299.00",v\n,5,w\nB,free,\n', encoding="utf-8")
    sheet = readers.read_comparison_sheet(spark, str(tmp_path / "sheet.csv"))
    assert [(r.title, r.price, r.site, r.ok) for r in sheet.collect()] == [('A "x"', 1299.0, "v", True), (None, 5.0, "w", False), ("B", None, "", False)]
    rows = spark.createDataFrame([('a "q", b', "x\ny")], "t string, u string")
    writers.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"', multiLine=True).collect() == rows.collect()
    images = tmp_path / "img"
    images.mkdir()
    for name, start in (("a", b"\x89PNG\r\n\x1a\n"), ("b", b"\xff\xd8\xff\xe0"), ("c", b"RIFF\0\0\0\0WEBP"), ("d", b"GIF89a"), ("e", b"text")):
        (images / name).write_bytes(start + b"rest")
    assert {(r.format, r.processed, r.failed) for r in readers.image_census(spark, str(images)).collect()} == {("PNG", 1, 0), ("JPEG", 1, 0), ("WEBP", 1, 0), ("GIF", 1, 0), (None, 1, 1)}


def test_streams_equal_batches(spark, tmp_path):
    schema = "url string, price double, seen_at timestamp, ordinal long"
    rows = [("a" if n % 3 else "b", float(100 - 7 * (n % 11)), at(n), n) for n in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_to_table(jobs.price_drop_alerts(stream(), 10.0), str(tmp_path / "o1"), str(tmp_path / "c1"))
    want = history.price_drops(spark.createDataFrame(rows, schema), 10.0)
    assert got.count() > 5 and sorted((r.ordinal, r.last_price, r.drop_percent) for r in got.collect()) == sorted((r.ordinal, r.last_price, r.drop_percent) for r in want.collect())
    kept = jobs.run_to_table(jobs.price_drop_alerts(stream(), 10.0, keep="1 day"), str(tmp_path / "o4"), str(tmp_path / "c4"))
    assert sorted((r.ordinal, r.last_price) for r in kept.collect()) == sorted((r.ordinal, r.last_price) for r in want.collect())
    seen = jobs.run_to_table(jobs.first_seen(stream()), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r.url for r in seen.collect()) == ["a", "b"]
    log = stream().select(F.col("url").alias("site"), F.lit(2).alias("items"), F.lit(None).cast("string").alias("error"))
    done = jobs.run_to_end(jobs.run_progress(log), "progress", "complete", str(tmp_path / "c3"))
    assert {r.site: (r.pages, r["items"]) for r in done.collect()} == {"a": (40, 80), "b": (20, 40)}
