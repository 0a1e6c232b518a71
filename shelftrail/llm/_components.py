"""Connected components of a link table by alternating large-star and small-star steps.

Links never leave Spark: each step is one aggregation and one join, its result a written table, and only a count and a
checksum come to the driver to tell when nothing changes any more. A node with very many neighbours is spread by
Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, materialise

#: Links of a file of a round's table: many small files cost more than their rows.
FILE_LINKS = 1 << 20


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def connected_components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long), a table written to `scratch` if there is one; a component
    is its smallest node."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    last = Scratch(links.sparkSession)
    edges = last.write(edges, "links")
    state = _state(edges)
    while True:
        files = 1 + 2 * state[0] // FILE_LINKS  # a step has no more links than the one before, but for one to each least neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = last.write(large.coalesce(files), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        step = Scratch(links.sparkSession)
        edges = step.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "links")
        last.clear()
        last, now = step, _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    out = materialise(out, "components") if scratch is None else scratch.write(out, "components")
    last.clear()
    return out
