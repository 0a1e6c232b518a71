"""What the third round's findings named: each of these failed before."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  the queries register themselves
from shelftrail.plans.registry import ORACLES, QUERIES


def against_sql(spark, folder, name, tables):
    """The query's and its SQL's rows over tables written to a new folder."""
    import duckdb

    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    out = con.sql(ORACLES[name])
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*out.columns).collect()), key=str), sorted(out.fetchall(), key=str)


@pytest.mark.parametrize("name", ["page_title_canonical", "page_links", "discovery_merge"])
def test_quoted_entities_as_the_sql_has_them(spark, tmp_path, name):
    html = '<h1>A &quot;b&quot; "c" &amp;quot;</h1><a href="/th/1">the &quot;link&quot; "x"</a>'
    pages = spark.createDataFrame([(1, "https://a.example/x", html)], "page_id long, url string, html string")
    got, want = against_sql(spark, tmp_path, name, {"pages": pages})
    assert got == want and len(got) == 1


def lines(spark, n, price):
    """`n` line items, four to an order, and the five parts that they name."""
    i = F.col("id")
    line = spark.range(n).select(
        F.floor(i / 4).cast("long").alias("l_orderkey"), (i % 5).alias("l_partkey"), (i % 3).alias("l_suppkey"), (i % 4).cast("int").alias("l_linenumber"), price(i).cast("double").alias("l_extendedprice"),
        (i % 2 * 0.1).alias("l_discount"), F.lit("A").alias("l_returnflag"), F.when(i % 2 == 0, "F").otherwise("O").alias("l_linestatus"), F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    )
    part = spark.range(5).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), F.col("id")).alias("p_name"), F.lit("T").alias("p_type"))
    return {"lineitem": line, "part": part}


def test_last_page_of_a_list_of_more_than_a_thousand_pages(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "result_last_page", lines(spark, 120_000, lambda i: 99_001 + i * 0 + 20_000))
    assert got == want and got


def test_plain_pages_are_read_as_by_the_parser():
    from shelftrail.operators import cards

    def parsed(html):
        slow = cards._Tree()
        slow.feed(html)
        slow.close()
        return slow.done()

    said = lambda page: [(n.tag, n.attrs, n.text(), n.parent.tag) for n in page.all()]
    plain = '<UL><li Class="item">a &amp; b<li class="item"><a href="/p/1">x</a><br/><p>1<p>2<div>3</div></ul></b><table><tr><td>4<td>5</table>'
    for html in (plain, plain + "<!-- c -->d", "a < b", "<b x='1'>", "<script>1<2</script>", "", "<title>a<b></title>"):
        assert said(cards.tree(html)) == said(parsed(html))
    assert cards._Tree().plain(plain) and not cards._Tree().plain("a < b") and not cards._Tree().plain("<script>1</script>")


def test_small_files_are_dealt_to_all_cores(spark, tmp_path):
    from shelftrail.plans.tables import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "few"))
    out = spread(spark.read.parquet(str(tmp_path / "few")), "id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert out == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["grid_cards", "loop_cards", "link_cards"])
def test_a_brand_with_many_parts_takes_many_pages(spark, tmp_path, monkeypatch, name):
    from shelftrail.operators import cards

    seen = []
    rows = cards.listing_items
    monkeypatch.setattr(cards, "listing_items", lambda pages, *a: seen.append(pages.agg(F.count("*"), F.max(F.length("html"))).first()) or rows(pages, *a))
    i = F.col("id")
    part = spark.range(12_000).select(i.alias("p_partkey"), F.concat(F.lit("part "), i).alias("p_name"), F.concat(F.lit("B"), i % 3).alias("p_brand"), (i % 50).cast("int").alias("p_size"), (900.25 + i % 7).alias("p_retailprice"))
    got, want = against_sql(spark, tmp_path, name, {"part": part})
    assert len(got) == 12_000 and sorted(map(str, got)) == sorted(map(str, want)) and seen[0][0] == 9


def test_heads_of_all_orders_come_from_one_stored_table(spark, tmp_path):
    from shelftrail.operators import results

    rows = [(i, f"t {i % 5}", f"s{i % 3}", "u", f"${i % 7 + 1}.00", "" if i % 2 else "$1.00", "yes") for i in range(40)]
    listed = results.enrich(spark.createDataFrame(rows, "ordinal long, title string, site string, url string, original_formatted string, discounted_formatted string, stock_status string"))
    orders = ["final-asc", "title-desc", "discount-desc", "model-asc"]
    got = results.heads(listed, 6, orders, str(tmp_path / "heads"))
    want = [(o, r.position, r.ordinal) for o in orders for r in results.page(listed, 1, 6, o).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {f.rpartition("/")[0] for f in got.inputFiles()} == {f"file://{tmp_path}/heads"}  # the items themselves are not read again


def test_an_item_batch_reads_its_items_once(spark, tmp_path):
    from shelftrail.operators import catalog

    rows = [(i, f"https://a.example/p-{i % 4}/", None, f"t {i}", "", 1.0, "yes", "Apple > Phones > X", None, None) for i in range(12)]
    items = spark.createDataFrame(rows, "o long, url string, sku string, title string, description string, price double, stock_status string, category_path string, label string, brand string")
    stored, plain = catalog.item_batch(items, ["o"], str(tmp_path / "first")), catalog.item_batch(items, ["o"])
    for name in ("brands", "categories", "models", "products"):
        got = getattr(stored, name)
        assert sorted(map(str, got.collect())) == sorted(map(str, getattr(plain, name).select(*got.columns).collect()))
        assert {f.rpartition("/")[0] for f in got.inputFiles()} == {f"file://{tmp_path}/first"}


def test_items_of_sessions_carry_their_time(spark, tmp_path):
    from shelftrail.plans.tables import items

    for t, df in lines(spark, 40, lambda i: 10 + i).items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    held = spark.range(3).select(F.col("id").alias("session_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    got, want = items(spark, str(tmp_path), held), items(spark, str(tmp_path)).join(held, "session_id")
    assert got.count() == 12 and sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_micro_batch_is_several_files(spark, tmp_path, monkeypatch):
    from shelftrail.plans import page_queries

    monkeypatch.setattr(page_queries, "_FILE_ROWS", 5)
    monkeypatch.setattr(page_queries, "scratch", lambda spark, name: str(tmp_path / name))
    i = F.col("id")
    spark.range(60).select(i.alias("event_id"), F.timestamp_seconds(i * 60).cast("timestamp_ntz").alias("ts"), (i % 3).alias("user_id"), F.lit("view").alias("event_type"), i.cast("double").alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    assert page_queries._timed_stream(spark, str(tmp_path)).isStreaming
    assert len(list((tmp_path / "slices").glob("*.parquet"))) == 12  # three batches of twenty rows, four files each
