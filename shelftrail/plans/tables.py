"""The driver's tables in the roles of the catalog: events are prices and changes, orders products or sessions, line items
listed items, customers models, nations categories, regions brands, part names titles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.catalog import snowflake


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores: a small file is read by a task or two, and pages made of its rows take long to parse. With a
    number of partitions, as without one Spark joins partitions of few bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query that writes and reads back: the shared checkpoint folder, or a local one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def newest(spark: SparkSession, sf_dir: str, name: str, column: str) -> Column:
    """The newest time of a table as a literal, so that bounds by it reach the scan."""
    at = table(spark, sf_dir, name).agg(F.max(column).cast("string")).first()[0]
    return F.lit(at).cast("timestamp_ntz")


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("product_id"), F.col("value").alias("price"), F.col("ts").alias("recorded_at"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a change from the product's last event type to this one."""
    w = Window.partitionBy("user_id").orderBy("ts")
    kind = F.when(F.col("event_type") == "view", "stock_status").when(F.col("event_type") == "click", "product_description").when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "error", "Pricing").otherwise("Qty")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("product_id"), kind.alias("change_type"), F.lag("event_type").over(w).alias("old_value"),
        F.col("event_type").alias("new_value"), F.col("ts").alias("changed_at"),
    )


CHANGE_LOG_SQL = """changes AS (
  SELECT event_id, user_id AS product_id,
         CASE event_type WHEN 'view' THEN 'stock_status' WHEN 'click' THEN 'product_description' WHEN 'signup' THEN 'new' WHEN 'error' THEN 'Pricing' ELSE 'Qty' END AS change_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS old_value, event_type AS new_value, ts AS changed_at
  FROM events
)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    stock = F.when(F.col("o_orderstatus") == "F", "In Stock").when(F.col("o_orderstatus") == "O", "sold_out").otherwise("Back-order")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("product_id"), F.col("o_orderkey").cast("string").alias("sku"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("https://shop.example/p/"), F.col("o_orderkey")).alias("url"), F.col("o_totalprice").alias("price"), stock.alias("stock_status"),
        F.col("o_custkey").alias("model_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, categories and brands."""
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_nationkey").alias("category_id"), F.col("c_name").alias("model"))
    categories = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_regionkey").alias("brand_id"), F.col("n_name").alias("category"))
    brands = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("brand_id"), F.col("r_name").alias("brand"))
    return models, categories, brands


PRODUCTS_SQL = """products AS (
  SELECT o_orderkey AS product_id, CAST(o_orderkey AS VARCHAR) AS sku, o_orderpriority AS title, 'https://shop.example/p/' || o_orderkey AS url, o_totalprice AS price,
         CASE o_orderstatus WHEN 'F' THEN 'In Stock' WHEN 'O' THEN 'sold_out' ELSE 'Back-order' END AS stock_status, o_custkey AS model_id,
         o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders
), catalog AS (
  SELECT p.*, c_name AS model, n_name AS category, r_name AS brand
  FROM products p JOIN customer ON c_custkey = model_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snowflake(products(spark, sf_dir), *dimensions(spark, sf_dir))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("note"))


def items(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """Line items as listings: the part's name is the title, the return flag the site, formatted prices beside numbers. With
    sessions `held` those of their items, and `ts`: the numbers are joined, the texts made of them behind that."""
    return listings(listed_lines(spark, sf_dir, held))


def listed_lines(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """What `listings` makes its columns of: numbers, flags, and the part's name and type."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"))
    line = table(spark, sf_dir, "lineitem")
    if held is not None:
        line = line.join(held.select(F.col("session_id").alias("l_orderkey"), "ts"), "l_orderkey")
    return line.join(part, "l_partkey")


def listings(lines: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    cut = (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,2)")
    return lines.select(
        F.col("l_orderkey").alias("session_id"), (((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.col("l_linenumber").alias("page"), "title", "kind", F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("seen_at"),
        F.concat(F.lit("site"), F.lower("l_returnflag"), F.lit(".example")).alias("site"),
        F.concat(F.lit("https://site"), F.lower("l_returnflag"), F.lit(".example/p/"), F.col("l_partkey")).alias("url"),
        F.concat(F.lit("$"), F.format_number(price, 2)).alias("original_formatted"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("$"), F.format_number(cut, 2))).otherwise("").alias("discounted_formatted"),
        F.when(F.col("l_linestatus") == "F", "In stock").otherwise("ships in 3 days").alias("stock_status"),
        *(["ts"] if "ts" in lines.columns else []),
    )


ITEMS_SQL = """items AS (
  SELECT l_orderkey AS session_id, ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS ordinal, l_linenumber AS page, p_name AS title, p_type AS kind,
         l_extendedprice AS price, l_shipdate AS seen_at, 'site' || lower(l_returnflag) || '.example' AS site,
         'https://site' || lower(l_returnflag) || '.example/p/' || l_partkey AS url, CAST(l_extendedprice AS DECIMAL(18,2)) AS original,
         CASE WHEN l_discount > 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))
              ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS final,
         CASE WHEN l_linestatus = 'F' THEN 'In stock' ELSE 'ships in 3 days' END AS stock_status
  FROM lineitem JOIN part ON p_partkey = l_partkey
)"""
