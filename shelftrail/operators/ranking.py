"""Places in a long ordered list, and pages of it from anywhere.

The list is written once, dealt by ranges of its order and sorted inside each; a row's place is the number of rows of the
partitions before its own plus its place there. Only those numbers, one per partition, come to the driver, and a page is
read from the one or two partitions that hold it, whatever its number.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: `monotonically_increasing_id` counts the rows of a partition in its lower bits.
_PLACE_BITS = 33


@dataclass(frozen=True)
class RankedList:
    """`table`: the rows with `_part` and `_at`; `starts`: of each partition, rows before it and rows up to its end."""

    table: DataFrame
    starts: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return self.starts[-1][2] if self.starts else 0

    def pages(self, size: int) -> int:
        return max(1, -(-self.total // size))

    def places(self, first: int, last: int, name: str = "position") -> DataFrame:
        """The rows in the places `first` to `last` (from 1), with their place."""
        held = [(part, before) for part, before, upto in self.starts if before < last and upto >= first]
        part, at = F.col("_part"), F.col("_at")
        before = F.lit(0).cast("long")
        for number, n in held:  # a page touches one partition or two
            before = F.when(part == number, F.lit(n).cast("long")).otherwise(before)
        some = self.table.where(part.isin([number for number, _ in held])).withColumn(name, before + at + 1)
        return some.where(F.col(name).between(first, last)).drop("_part", "_at")

    def page(self, number: int, size: int, name: str = "position") -> DataFrame:
        """A page by its number; beyond the end it is the last page, below 1 the first."""
        number = min(max(1, number), self.pages(size))
        return self.places((number - 1) * size + 1, number * size, name)

    def all(self, name: str = "position") -> DataFrame:
        """Every row with its place."""
        spark = self.table.sparkSession
        starts = spark.createDataFrame([(part, before) for part, before, _ in self.starts], "_part long, _before long")
        both = self.table.join(F.broadcast(starts), "_part")  # one row per partition
        return both.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def ranked(rows: DataFrame, order: list[Column], path: str) -> RankedList:
    """`rows` in `order`, written to the new folder `path`. Rows that `order` does not tell apart stand in any order, and those
    in one partition: end it with a column that does."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.col("_mark")
    marked = spread.withColumn("_mark", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright(mark, _PLACE_BITS), "_at": mark.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))})
    marked.drop("_mark").write.parquet(path)
    table = rows.sparkSession.read.parquet(path)
    counts = table.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    ends = list(accumulate(r.n for r in counts))
    return RankedList(table, tuple((r._part, end - r.n, end) for r, end in zip(counts, ends, strict=True)))
