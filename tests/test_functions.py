"""Column expressions against tables of expected values."""

import pytest
from pyspark.sql import functions as F

from shelftrail.functions import change as C
from shelftrail.functions import money as M
from shelftrail.functions import stock as S
from shelftrail.functions import text as T
from shelftrail.functions import urls as U


def check(spark, make, cases, schema="v string"):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, (x, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    names = [c.split()[0] for c in schema.split(", ")]
    got = {r.i: r.out for r in df.select("i", make(*[F.col(n) for n in names]).alias("out")).collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(cases)] == [(x, w) for x, w in cases]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (M.parse_price, [("$1,299.50", 1299.5), ("1234.56", 1234.56), ("1,299", 1.0), ("$12.5", 12.0), ("Free", None), ("", None), (None, None)]),
        (M.parse_price_digits, [("$12.17", 12.17), ("$10 - $20", 1020.0), ("1.2.3", 0.0), ("", 0.0), (None, 0.0)]),
        (M.parse_price_local, [("1,299", 1299.0), ("12,5", 12.5), ("1.299,50", 1.2995), ("1,234,56", 1234.56), ("USD 1,234.50", 1234.5), ("-", None), ("abc", None), ("", None), (None, None), ("1.2.3", 12.3)]),
        (S.stock_status, [("In Stock", "in_stock"), ("low-stock", "limited"), ("Unavailable", "out_of_stock"), ("Only 3 left", "limited"), ("Ships in 5 days", "back_order"), ("Coming soon", "preorder"), ("discontinued", None), ("", None), (None, None), ("  not available ", "out_of_stock")]),
        (S.stock_state, [("out_of_stock", "out_of_stock"), ("back_order", "backorder"), ("preorder", "backorder"), ("limited", "limited"), ("unavailable", "in_stock"), ("already sold out", "in_stock"), (None, "")]),
        (lambda c: S.stock_state(c, out_first=True), [("unavailable", "out_of_stock"), ("in stock", "in_stock")]),
        (S.shown_status, [(None, "unknown"), ("In-Stock", "in_stock"), ("OUT OF STOCK", "out_of_stock"), ("only 4", "limited"), ("retired item", "discontinued"), ("weird!", "weird_")]),
        (lambda c: S.shown_label(S.shown_status(c)), [("in stock", "In Stock"), ("my own words", "My Own Words")]),
        (S.availability_status, [("https://schema.org/InStock", "in_stock"), ("http://schema.org/Discontinued", "discontinued"), ("sold out", "out_of_stock"), (None, None)]),
        (C.change_type, [("Price_Drop", "price"), ("stock_cost", "stock"), ("Qty", "stock"), ("copyright", "description"), ("new", "new"), (None, None)]),
        (T.slug, [("  LCD & Touch ", "lcd-touch"), ("---", "general"), ("", "general"), (None, "general")]),
        (T.normal_title, [("iPhone 12 Pro LCD Assembly (with Frame)", "iphone 12 pro"), (None, "")]),
        (T.model_key, [("iPhone 12 Pro LCD Assembly (with Frame)", "iphone pro"), ("galaxy s21 ultra", "galaxy s21"), ("plain words", "plain words")]),
        (T.clean_text, [(" a \n b\t", "a b"), (None, "")]),
        (T.truncate_value, [("x" * 501, "x" * 497 + "..."), (" y ", "y"), ("  ", None), (None, None)]),
        (T.is_meaningful, [("N/A", False), (" - ", False), ("tbd", False), ("ok", True), (None, False)]),
        (U.domain, [("https://www.a.example/x", "a.example"), ("not a url", ""), (None, "")]),
        (U.normal_url, [(" HTTP://A.example/x// ", "http://a.example/x"), (None, "")]),
        (U.next_page_url, [("https://a.example/c?p=2&x=1", "https://a.example/c?p=3&x=1"), ("https://a.example/c?page=9", "https://a.example/c?page=10"), ("https://a.example/c?p=x", None), ("https://a.example/c", None)]),
        (U.model_name, [("https://a.example/replacement-parts/apple/iphone-12-pro/", "iPhone 12 Pro"), ("https://a.example/shop/galaxy_s21.html", "Galaxy S21"), ("https://a.example/parts", "Parts"), ("https://a.example/tablet/ipad-9-wi-fi", "iPad 9 Wi\u2011Fi"), ("https://a.example/tablet/ipad-9-wifi.html", "iPad 9 Wi\u2011Fi"), ("nothing", "Nothing"), (None, "")]),
        (U.region_source, [("https://shop.ca/x", "S-CA"), ("https://shop.example/x", "S-US"), (None, "S")]),
        (M.host_currency, [("shop.ca", "CAD"), ("ca.shop.example", "CAD"), ("shop.example", "USD"), (None, "USD")]),
    ],
)
def test_one_column(spark, make, cases):
    check(spark, make, cases)


def test_money_rules(spark):
    rules = "p double, pct double, amt double"
    check(spark, M.apply_discount, [((100.0, 10.0, 5.0), 85.0), ((3.0, 0.0, 5.0), -2.0), ((None, 10.0, 5.0), None)], rules)
    check(spark, M.apply_discount_floor, [((3.0, 0.0, 5.0), 0.0), ((100.0, 10.0, 5.0), 85.0)], rules)
    check(spark, M.format_price, [((1234.5, None, "shop.ca"), "CA$1,234.50"), ((2.0, "usd", "shop.ca"), "$2.00"), ((None, None, None), "")], "p double, c string, h string")
    check(spark, M.discount_percent, [((100.0, 80.0), 20.0), ((0.0, 1.0), None), ((None, 1.0), None)], "o double, f double")
    check(spark, M.compare_delta_percent, [((10.0, 9.0, 8.0), 25.0), ((None, 9.0, 10.0), -10.0), ((1.0, 1.0, 0.0), None)], "o double, f double, c double")


def test_changes(spark):
    two = "o string, n string"
    check(spark, C.is_significant, [((None, "x"), True), (("In Stock", " in stock "), False), ((None, None), False), (("a", None), True)], two)
    check(spark, lambda o, n: C.is_meaningful_change(F.lit("stock"), o, n), [(("in_stock", "In Stock"), False), ((None, " "), False), (("a", None), True)], two)
    check(spark, lambda o, n: C.is_meaningful_change(F.lit("description"), o, n), [((" same ", "same"), False), (("Same", "same"), False), (("a", "b"), True)], two)
    check(spark, C.stock_badge, [(("sold out", "in stock"), "restocked"), (("yes", "oos"), "out"), (("yes", "preorder"), "backorder"), (("gone", None), "removed"), ((None, "some"), "added"), (("x", "y"), "updated")], two)
    check(spark, C.price_difference, [((1.0, 3.0), 2.0), ((None, 3.0), 3.0), ((2.0, None), -2.0), ((None, None), None)], "o double, n double")
    when = "k string, o string, n string, a int, b int"
    check(spark, C.is_first_fill, [(("stock", None, "x", 1, 2), True), (("new", None, "x", 1, 2), False), (("stock", "y", "x", 1, 2), False), (("stock", " ", "x", 3, 2), False), ((None, None, "x", 1, 2), False)], when)


def test_taxonomy_and_sku(spark):
    make = lambda p, lab, b: F.concat_ws("|", *[T.taxonomy(p, lab, b)[k] for k in ("brand", "category", "model")])
    cases = [(("Apple > iPhone Parts > iPhone 12", None, None), "Apple|iPhone Parts|iPhone 12"), (("A > B", None, None), "A|A|B"), (("A", None, None), "A|A|A"), (("", "L", None), "L|L|L"), (("A > B > C > D", "L", "X"), "X|B|D"), ((None, None, None), "General|General|General")]
    check(spark, make, cases, "p string, l string, b string")
    check(spark, T.derive_sku, [((" ab 1 ", None), "AB-1"), ((None, "https://h/y/abc-123.html"), "ABC-123-HTML"), (("", "https://h/y/z/"), "Z")], "s string, u string")
    check(spark, lambda e: F.array_join(T.compatibility_list(F.split(e, ";"), F.lit("m1")), ","), [("A; a ;;M1;b", "A,b")])
    order = [r.v for r in spark.createDataFrame([("item 10",), ("Item 9",), ("ítem 2",), ("item 09a",)], "v string").orderBy(T.natural_key(F.col("v"))).collect()]
    assert order == ["ítem 2", "Item 9", "item 09a", "item 10"]
