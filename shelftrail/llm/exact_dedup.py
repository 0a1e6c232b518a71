"""Exact dedup by two-pass Bloom filtering.

Pass 1 streams only 8-byte text hashes into a segmented two-plane Bloom filter: the first plane takes every
hash, the second those that the first already had. Pass 2 probes the second plane: rows that miss it are unique
for certain and never shuffle; rows that hit are grouped by SHA-256, which settles them exactly. The filter has a
fixed largest size, so broadcasting it is safe; past the row count it was sized for, more rows shuffle and the
result stays the same.

Defined cases: a null text counts as empty; texts of white space alone equal the empty text; of rows that tie in
length and doc_id (repeated rows) exactly one stays; a null doc_id loses every tie; an empty table gives an empty
result; other columns are carried by `drop_copies` and ignored by `find_copies`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from . import _bloom
from ._common import ASCII_SPACE, materialise, whole_text


def normalised_digest(text):
    return F.sha2(F.regexp_replace(text, f"[{ASCII_SPACE}]+", ""), 256)


def _maybe_repeated(spark, plane: np.ndarray):
    ship_package(spark)
    shared = spark.sparkContext.broadcast(plane)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(_bloom.contains(shared.value, h.to_numpy(np.int64)))

    return probe


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id, n, sha, h, row`; the hash is of the digest, so equal texts have equal ones."""
    text = whole_text()
    made = docs.select("doc_id", F.char_length(text).alias("n"), F.unhex(normalised_digest(text)).alias("sha"))
    return made.select("doc_id", "n", "sha", F.xxhash64("sha").alias("h"), F.monotonically_increasing_id().alias("row"))


def find_copies(docs: DataFrame, max_filter_bits: int = _bloom.MAX_BITS) -> DataFrame:
    """One row per document: `doc_id, keep_id, group_size, kept, text_sha256`."""
    made = materialise(digests(docs), "digests")
    plane = _bloom.build(made, _bloom.segments_for(made.count(), max_filter_bits), repeated=True)
    flagged = made.withColumn("maybe", _maybe_repeated(docs.sparkSession, plane)("h"))
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    together = flagged.where("maybe").drop("maybe", "h")
    order = F.struct("n", (-F.col("doc_id")).alias("id"), (-F.col("row")).alias("row"))
    groups = together.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    settled = together.join(groups, "sha").select(
        "doc_id", (-F.col("best.id")).alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"), "sha"
    )
    return alone.unionByName(settled).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, max_filter_bits: int = _bloom.MAX_BITS) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns kept. Rows that are surely unique never shuffle."""
    made = materialise(digests(docs).select("h"), "hashes")
    plane = _bloom.build(made, _bloom.segments_for(made.count(), max_filter_bits), repeated=True)
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    keyed = docs.select(row.alias("_row")).withColumn("_sha", F.unhex(normalised_digest(text)))
    flagged = keyed.withColumn("_maybe", _maybe_repeated(docs.sparkSession, plane)(F.xxhash64("_sha")))
    order = F.struct(F.char_length(text), -F.col("_row.doc_id"))
    settled = flagged.where("_maybe").groupBy("_sha").agg(F.max_by("_row", order).alias("_row")).select("_row")
    return flagged.where(~F.col("_maybe")).select("_row").unionByName(settled).select("_row.*")
