"""Reading sessions, logs, sheets, sitemaps and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import parse_price_local
from ..functions.text import blank_to_null
from ..shipping import ship_package
from .heads import FileHeads

LOG_SCHEMA = "ts string, level string, event string, message string, site string, url string, page int, items long, t_fetch_ms double, t_parse_ms double, t_db_ms double, cf_detected boolean, error string"
# Headers that a comparison sheet may use for each column.
SHEET_ALIASES = {
    "title": ["title", "name", "product", "product name", "product_name", "item", "description"],
    "price": ["price", "amount", "cost", "price_value", "final", "final price", "sale price"],
    "site": ["site", "source", "store", "vendor", "supplier"],
    "url": ["url", "link", "product url", "product_url"],
}
MAGIC = {"PNG": (1, "89504E47"), "JPEG": (1, "FFD8FF"), "GIF": (1, "47494638"), "WEBP": (9, "57454250")}


def event_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def event_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(path)


def comparison_sheet(raw: DataFrame) -> DataFrame:
    """title, price, site, url and `ok` from columns of any known header; rows without title or price are not ok."""
    names = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}

    def pick(kind: str) -> Column:
        found = [blank_to_null(F.col(f"`{names[a]}`").cast("string")) for a in SHEET_ALIASES[kind] if a in names]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = raw.select(pick("title").alias("title"), parse_price_local(pick("price")).alias("price"), *[F.coalesce(pick(k), F.lit("")).alias(k) for k in ("site", "url")])
    return out.withColumn("ok", F.col("title").isNotNull() & F.col("price").isNotNull())


def read_comparison_sheet(spark: SparkSession, path: str) -> DataFrame:
    return comparison_sheet(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("loc string").format("xml").option("rowTag", "url").load(path)


def image_format(content: Column, url: Column | None = None) -> Column:
    """By magic bytes, or else by the URL's extension."""
    out = F.lit(None).cast("string")
    if url is not None:
        ext = F.upper(F.regexp_extract(url, r"\.(png|jpe?g|webp|gif)(?:[?#]|$)", 1))
        out = F.when(ext == "JPG", "JPEG").otherwise(F.nullif(ext, F.lit("")))
    for name, (start, magic) in MAGIC.items():
        out = F.when(F.hex(F.substring(content, start, len(magic) // 2)) == magic, name).otherwise(out)
    return out


def image_heads(spark: SparkSession, path: str) -> DataFrame:
    """The files under `path` (path, size, error) with their image format; only the first bytes of each are read."""
    ship_package(spark)
    spark.dataSource.register(FileHeads)
    files = spark.read.format("file_heads").option("path", path).option("bytes", 12).load()
    return files.select("path", "size", "error", F.when(F.col("error").isNull(), image_format(F.col("head"))).alias("format"))


def image_census(spark: SparkSession, path: str) -> DataFrame:
    """Number of files by format: processed, successful (known format) and failed."""
    kinds = image_heads(spark, path).groupBy("format").agg(F.count("*").alias("processed"))
    known = F.col("format").isNotNull()
    return kinds.select("format", "processed", F.when(known, F.col("processed")).otherwise(0).alias("successful"), F.when(known, 0).otherwise(F.col("processed")).alias("failed"))
