"""Vectors as the operators on `embeddings` take them: the usable rows, their dimension, and batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ..shipping import map_arrow


def is_whole(vector: Column) -> Column:
    """Not null, not empty, and no entry null or non-finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, finite), F.lit(False))


def whole_vectors(df: DataFrame, *columns: str, vector: str = "embedding") -> DataFrame:
    """`columns` and `vec` (array of float or double) of the rows with a whole vector, other columns left out."""
    kind = df.schema[vector].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
    vec = F.col(f"`{vector}`") if plain else F.col(f"`{vector}`").cast("array<double>")
    return df.select(*[F.col(f"`{c}`") for c in columns], vec.alias("vec")).where(is_whole(F.col("vec")))


def of_dimension(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the most frequent vector length (of several, the smallest), and that length; 0 without rows."""
    top = df.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top.d if top else 0
    return df.where(F.size("vec") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls, all lists of length `d`, as a float64 matrix."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def mean_vector(df: DataFrame, d: int) -> np.ndarray:
    """The mean of `vec` over all rows: a sum per task, added per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d), 0
        for b in batches:
            total, n = total + matrix(b.column(0), d).sum(axis=0), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total), pa.array(np.full(d, n, np.int64))], names=["place", "total", "n"])

    rows = map_arrow(df.select("vec"), run, "place int, total double, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = np.zeros(d)
    for r in rows:  # one row per dimension
        out[r.place] = r.total / r.n
    return out
