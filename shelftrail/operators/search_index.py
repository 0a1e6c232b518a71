"""Substring search by trigrams: postings name the rows that can match, and only these are read and tested.

`postings` has one row per distinct trigram of a row's searched text, sorted by trigram, so that a query's trigrams are found by
the files' statistics; `rows` lies in hash buckets of the key. A search counts, per key, how many of the query's trigrams it
has, and holds the rows that have all of them against the query itself, so it finds what a scan would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
_BUCKET = "_bucket"


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none of a null or shorter one."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.length(low) - SIZE + 1), lambda i: F.substring(low, i, F.lit(SIZE)))
    return F.when(F.length(low) >= SIZE, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _marked(number: int, text: Column) -> Column:
    return F.transform(trigrams(text), lambda g: F.concat(F.lit(f"{number}:"), g))


def needed(query: str) -> list[str]:
    """The trigrams that any match of `%query%` has: those between its wildcards, as `%` and `_` stand for anything."""
    runs = re.split(r"[%_]|\\.", query.lower())
    return sorted({r[i : i + SIZE] for r in runs for i in range(len(r) - SIZE + 1)})


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    key: str
    columns: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame) -> SearchIndex:
        """Index `rows`, one per key, by the texts in `columns`; a trigram is told apart by column."""
        rows.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/rows")
        marked = F.flatten(F.array(*[_marked(i, F.col(c)) for i, c in enumerate(self.columns)]))
        postings = rows.select(self.key, F.explode(marked).alias("gram"))
        postings.repartitionByRange("gram", self.key).sortWithinPartitions("gram", self.key).write.mode("overwrite").parquet(f"{self.path}/postings")
        return self

    def matches(self, query: str) -> Column:
        return reduce(Column.__or__, [F.col(c).ilike(f"%{query}%") for c in self.columns])

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of rows with all of the query's trigrams in one column; None if it has none, so that any row may match."""
        grams = needed(query)
        if not grams:
            return None
        wanted = [f"{i}:{g}" for i in range(len(self.columns)) for g in grams]
        found = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(wanted))
        per = found.groupBy(self.key, F.substring_index("gram", ":", 1).alias("column")).agg(F.count("*").alias("n"))
        return per.where(F.col("n") == len(grams)).select(self.key).distinct()

    def search(self, query: str) -> DataFrame:
        """The rows that have `query` in one of the columns, in any case."""
        rows, keys = self.spark.read.parquet(f"{self.path}/rows"), self.candidates(query)
        if keys is not None:
            held = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # no more than there are buckets
            rows = rows.where(F.col(_BUCKET).isin(held)).join(keys, self.key, "left_semi")
        return rows.where(self.matches(query)).drop(_BUCKET)
