"""Queries over text, money, stock and URL columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import stock as K
from ..functions import text as T
from ..functions import urls as U
from ..operators import sessions as S
from ..operators.catalog import first_wins
from .registry import query
from .tables import table

_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
_DOMAIN = f"regexp_replace({_HOST}, '^www\\.', '')"


@query(f"SELECT page_id, {_HOST} AS host, {_DOMAIN} AS domain, regexp_replace(lower(trim(url)), '/+$', '') AS normal, CASE WHEN {_HOST} LIKE '%.ca' THEN 'S-CA' ELSE 'S-US' END AS region FROM pages")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.host(u).alias("host"), U.domain(u).alias("domain"), U.normal_url(u).alias("normal"), U.region_source(u).alias("region"))


@query(f"SELECT DISTINCT {_DOMAIN} AS host FROM pages WHERE {_DOMAIN} <> ''")
def site_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.site_options(table(spark, sf_dir, "pages"))


#: The last part of a path; a URL without a path has none.
_PART = r"regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/(?:.*/)?([^/]+)/*$', 1), '\.html?$', '')"


@query(f"SELECT page_id, CASE WHEN regexp_full_match({_PART}, '[a-z]?[0-9]+[a-z]?') THEN upper({_PART}) ELSE upper({_PART}[1]) || lower({_PART}[2:]) END AS model FROM pages")
def model_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.model_name(F.col("url")).alias("model"))


@query(f"""WITH m AS (SELECT page_id, CASE WHEN regexp_full_match({_PART}, '[a-z]?[0-9]+[a-z]?') THEN upper({_PART}) ELSE upper({_PART}[1]) || lower({_PART}[2:]) END AS model FROM pages)
SELECT model, 'S-US' AS source, min(page_id) AS page_id FROM m GROUP BY model""")
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").select(U.model_name(F.col("url")).alias("model"), U.region_source(F.col("url")).alias("source"), "page_id")
    return first_wins(named, ["model", "source"], ["page_id"])


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN regexp_replace(url, '([?&]page=)[0-9]+', '\1' || (CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS BIGINT) + 1)) END AS next FROM pages""")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.next_page_url(F.col("url")).alias("next"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\b(for|with|without|frame|lcd|assembly|screen|display|series|model|global|original|grade|version|and|the|a|an)\b', '', 'g'), '\s+', ' ', 'g'))"
_KEY = r"coalesce(nullif(array_to_string(regexp_extract_all({0}, '\b([a-z]{{1,3}}-?\d{{1,4}}[a-z]?)\b|\b(galaxy|iphone|ipad|a\d{{2}}|a0?\d{{1,2}}|xs?max|pro|max|mini|se|plus)\b'), ' '), ''), {0})"


@query(f"SELECT doc_id, length(norm) AS n_norm, md5(norm) AS norm_md5, md5({_KEY.format('norm')}) AS key_md5 FROM (SELECT doc_id, {_NORM.format('text')} AS norm FROM documents)")
def title_norm_model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = T.let(T.normal_title(F.col("text")), lambda n: F.struct(F.length(n).cast("long").alias("n_norm"), F.md5(n).alias("norm_md5"), F.md5(T.key_of_normal_title(n)).alias("key_md5")))
    return table(spark, sf_dir, "documents").select("doc_id", told.alias("told")).select("doc_id", "told.*")


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  CASE WHEN p_size > 25 THEN upper(replace(p_brand, '#', '-')) ELSE upper(regexp_replace(p_name, '[^A-Za-z0-9_-]+', '-', 'g')) END AS sku, p_brand || '/' || p_type || '/' || p_name AS path
FROM part""")
def slug_sku_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    url = F.concat(F.lit("https://shop.example/parts/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("/"))
    t = T.taxonomy(F.concat_ws(" > ", brand, "p_type", name), name, F.lit(None).cast("string"))
    sku = T.derive_sku(F.when(F.col("p_size") > 25, brand).otherwise(" "), url)
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat(name, F.lit(" & "), brand)).alias("slug"), sku.alias("sku"), F.concat_ws("/", t["brand"], t["category"], t["model"]).alias("path"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c, trim(text, E' ') AS t FROM documents)
SELECT doc_id, md5(c) AS clean_md5, md5(CASE WHEN length(t) > 500 THEN t[1:497] || '...' ELSE t END) AS cut_md5, lower(t) NOT IN ('', '-', '—', 'n/a', 'na', 'none', 'null', 'tbd', 'pending') AS meaningful FROM d""")
def text_clean_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(t)).alias("clean_md5"), F.md5(T.truncate_value(t)).alias("cut_md5"), T.is_meaningful(t).alias("meaningful"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_name ELSE p_type END AS identifier, CASE WHEN p_size % 3 = 0 THEN 'A' || (10 + p_size % 90) WHEN p_size % 3 = 1 THEN 'Snapdragon ' || p_size END AS chip FROM part""")
def identifier_chipset(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3
    ident = T.model_identifier(F.when(even, F.col("p_brand")), F.when(even, F.col("p_name")), F.array(F.lit(" "), F.col("p_type"), F.col("p_name")))
    details = F.when(third == 0, F.to_json(F.struct(F.concat(F.lit("A"), (10 + F.col("p_size") % 90).cast("string")).alias("chip"))))
    title = F.when(third == 1, F.concat(F.lit("Board for Snapdragon "), F.col("p_size").cast("string"), F.lit(" phones"))).otherwise(F.lit("Board"))
    return table(spark, sf_dir, "part").select("p_partkey", ident.alias("identifier"), T.chipset(details, F.lit("{}"), title).alias("chip"))


@query("SELECT p_partkey, lower(p_brand) || ',' || lower(p_type) AS compatible FROM part")
def compatibility_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array(F.col("p_brand"), F.lit(" "), F.upper("p_brand"), F.col("p_name"), F.concat(F.lit(" "), F.col("p_type")), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.array_join(T.compatibility_list(entries, F.upper("p_name")), ",")).alias("compatible"))


_L = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_P = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query(f"""SELECT {_L}, CAST({_P} AS DOUBLE) AS first_amount, CAST({_P} AS DOUBLE) AS digits, CAST({_P} AS DOUBLE) AS local_price,
  CAST(floor({_P}) AS DOUBLE) AS whole, CAST({_P} AS DOUBLE) AS decimal_comma FROM lineitem""")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    plain = F.replace(shown, F.lit(","), F.lit(""))
    return table(spark, sf_dir, "lineitem").select(
        *_L.split(", "), M.parse_price(F.concat(F.lit("now $"), shown, F.lit(" each"))).alias("first_amount"), M.parse_price_digits(F.concat(F.lit("$"), shown)).alias("digits"),
        M.parse_price_local(F.concat(F.lit("USD "), shown)).alias("local_price"), M.parse_price(F.split(plain, r"\.")[0]).alias("whole"), M.parse_price_local(F.replace(plain, F.lit("."), F.lit(","))).alias("decimal_comma"),
    )


@query(f"""WITH x AS (SELECT {_L}, CAST(l_extendedprice AS DOUBLE) AS p, l_discount * 100 AS pct, l_tax * 100 AS amt FROM lineitem)
SELECT {_L}, round_even(p * (1 - pct / 100) - amt + 1e-9, 2) AS ruled, round_even(greatest(0, greatest(0, p * (1 - pct / 100)) - 40000), 4) AS floored,
  round_even(p - floor(p * (1 - pct / 100)), 2) AS off, CASE WHEN p > 0 THEN round_even((p - floor(p * (1 - pct / 100))) / p * 100, 2) END AS off_percent FROM x""")
def discount_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pct, amt = F.col("l_extendedprice"), F.col("l_discount") * 100, F.col("l_tax") * 100
    after = F.floor(p * (1 - pct / 100)).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        *_L.split(", "), M.apply_discount(p, pct, amt).alias("ruled"), F.bround(M.apply_discount_floor(p, pct, F.lit(40000.0)), 4).alias("floored"),
        M.discount_amount(p, after).alias("off"), M.discount_percent(p, after).alias("off_percent"),
    )


@query(f"SELECT {_L}, CASE WHEN l_returnflag = 'A' THEN 'CA$' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'CA$' ELSE '$' END || format('{{:,.2f}}', CAST({_P} AS DOUBLE)) AS shown FROM lineitem")
def currency_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    currency = F.when(flag == "A", "cad").when(flag == "N", "USD")
    host = F.when(F.col("l_linestatus") == "F", "ca.shop.example").otherwise("shop.example")
    return table(spark, sf_dir, "lineitem").select(*_L.split(", "), M.format_price(F.col("l_extendedprice").cast("decimal(18,2)"), currency, host).alias("shown"))


_TEXTS = {
    "In Stock": ("in_stock", "in_stock", "in_stock"), "low-stock": ("limited", "low stock", "low_stock"), "Unavailable": ("out_of_stock", "in_stock", "unavailable"),
    "Only 3 left": ("limited", "only 3 left", "limited"), "Ships in 5 days": ("back_order", "ships in 5 days", "back_order"), "Coming soon": ("preorder", "coming soon", "preorder"),
    "discontinued": (None, "discontinued", "discontinued"), "already sold out": ("out_of_stock", "in_stock", "out_of_stock"), "back_order": ("back_order", "backorder", "back_order"),
    "https://schema.org/InStock": ("in_stock", "in_stock", "in_stock"),
}
_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS))


def _sql_value(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


def _by_text(k: int) -> str:
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {_sql_value(v[k])}" for i, v in enumerate(_TEXTS.values())) + " END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 10 {_CASES} END AS said, {_by_text(0)} AS status, {_by_text(1)} AS state, {_by_text(2)} AS shown, CASE WHEN o_orderkey % 10 = 9 THEN 'in_stock' ELSE {_by_text(0)} END AS availability FROM orders")
def stock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % len(_TEXTS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    s = F.col("said")
    return rows.select("o_orderkey", "said", K.stock_status(s).alias("status"), K.stock_state(s).alias("state"), K.shown_status(s).alias("shown"), K.availability_status(s).alias("availability"))
