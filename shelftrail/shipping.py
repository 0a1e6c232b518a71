"""Python code on executors: the package travels with the application, as `spark-submit --py-files` would send it."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of text that a task has at hand as Python objects at one time; a longer text is there alone.
PIECE_BYTES = 4 << 20

Batches = Iterator[pa.RecordBatch]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers of this application import `shelftrail`, wherever they run. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def in_pieces(batches: Batches, column: int = 0, most: int = PIECE_BYTES) -> Batches:
    """The batches cut into slices of up to `most` bytes in a string or binary column, of one row at least."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(size[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return freed memory to the machine: idle workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call keeps its own counsel
        return


def map_arrow(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """`df.mapInArrow` with this package at hand; a task's memory goes back when it ends."""
    ship_package(df.sparkSession)

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
