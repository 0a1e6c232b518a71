"""Approximate nearest neighbours by randomly rotated one-bit codes.

The index holds, for every row, the packed signs of its rotated distance from the centre (the mean of all rows), with two
correction scalars: that distance's length and the code's alignment with it. A search estimates inner products of queries
and rows from popcounts, divided by the alignment. The error of such an estimate is that of a random direction: `sigmas`
times sqrt(1 - alignment^2) / alignment / sqrt(d - 1) of the lengths bounds it but for a chance that falls as a normal
distribution's tail, and what rounding the query costs is added in full. A row is reranked by its exact distance unless
the lower bound of its distance lies above the k-th nearest found so far.

Queries go to the tasks in groups of about `GROUP`, each group one pass over the index; a task holds the k nearest of each
query of a group and nothing else, whatever it reads, and hands over k rows a query. No pair of a query and a row is ever a
row of a table, and vectors are never shuffled.

Defined cases: rows take no part whose id is null, or whose vector is null, empty, zero, or holds null or non-finite
entries, or is not as long as most; a repeated row is found as often as it is there, but a row is never found by a query
of its id; of queries with one id the one with the smallest vector counts; ties go to the smaller vec_id; a table without
queries or rows gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _codes
from ._common import Scratch, materialise
from ._vectors import matrix, mean_vector, of_dimension, whole_vectors

K = 10
#: Bounds are so many standard deviations wide: one estimate in 30,000 lies beyond on one side.
SIGMAS = 4.0
#: Queries of a pass, about; they are broadcast with their bit planes (d = 64: 1 KB a query).
GROUP = 4_096
#: Pairs of a query and a row that a task looks at together, and pairs reranked together.
PAIRS, RERANKED = 1 << 20, 1 << 16
SCHEMA = "query_id long, rank int, vec_id long, score double"
NOBODY = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Index:
    """`table`: vec_id, vec, code, length, align of every row."""

    table: DataFrame
    d: int
    centre: np.ndarray
    seed: int


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part, but for their length."""
    rows = whole_vectors(embeddings, "vec_id").where("vec_id is not null").select(F.col("vec_id").cast("long"), "vec")
    return rows.where(F.exists("vec", lambda c: c != 0))


def build_index(rows: DataFrame, scratch: Scratch, seed: int = _codes.SEED) -> Index:
    """The index of `usable` rows, every one of them, as a written table. Nothing but the centre is fitted, on all rows."""
    rows, d = of_dimension(rows)
    centre = mean_vector(rows, d)
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = _codes.rotation(d, seed)
        for b in batches:
            code, length, align = _codes.encode(matrix(b.column(1), d) - centre, turn)
            code = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(length), pa.array(align)], names=["vec_id", "vec", "code", "length", "align"])

    coded = map_arrow(rows, run, f"vec_id long, vec {kind}, code binary, length double, align double")
    return Index(scratch.write(coded, "codes"), d, centre, seed)


class Found:
    """The k nearest rows of each query of a group so far."""

    def __init__(self, queries: int, k: int):
        self.score, self.ids = np.full((queries, k), np.inf), np.full((queries, k), NOBODY)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        held = np.unique(query)
        query = np.concatenate([query, np.repeat(held, k)])
        score, ids = np.concatenate([score, self.score[held].ravel()]), np.concatenate([ids, self.ids[held].ravel()])
        order = np.lexsort((ids, score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < k
        self.score[query[best], place[best]], self.ids[query[best], place[best]] = score[best], ids[best]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _pass(index: Index, ids: np.ndarray, vectors: np.ndarray, k: int, sigmas: float) -> DataFrame:
    """(query_id, vec_id, score): of each task the k nearest rows of each query."""
    d, seed, centre = index.d, index.seed, index.centre
    shared = index.table.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors = shared.value
        q = _codes.queries(query_vectors - centre, _codes.rotation(d, seed))
        found, chunk, most = Found(len(query_ids), k), 64, max(1, PAIRS // len(query_ids))
        for b in batches:
            row_ids, rows = b.column(0).to_numpy(), matrix(b.column(1), d)
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(len(rows), -1)
            length, align = b.column(3).to_numpy(), b.column(4).to_numpy()
            at = 0
            while at < len(rows):
                part = slice(at, at + min(chunk, most))
                at, chunk = part.stop, min(2 * chunk, most)  # the first rows soon give a k-th nearest
                o, a = length[part], align[part]
                with np.errstate(over="ignore", invalid="ignore"):
                    dot = _codes.dots(codes[part], q)
                    spread = sigmas * np.sqrt(np.maximum(1 - a * a, 0)) / np.sqrt(max(1, d - 1))
                    inner = o / a * (dot + q.length[:, None] * (spread + _codes.SLACK) + q.error[:, None])
                    low = o * o + (q.length**2)[:, None] - 2 * inner
                    wanted = ~(low > (found.worst() ** 2)[:, None]) & (query_ids[:, None] != row_ids[part])
                query, row = np.nonzero(wanted)
                for i in range(0, len(query), RERANKED):
                    x, y = query[i : i + RERANKED], row[i : i + RERANKED] + part.start
                    score = distances(rows[y], query_vectors[x])
                    near = score <= found.worst()[x]
                    found.add(x[near], score[near], row_ids[y[near]])
        query, place = np.nonzero(found.ids != NOBODY)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[query]), pa.array(found.ids[query, place]), pa.array(found.score[query, place])], names=["query_id", "vec_id", "score"]
        )

    return map_arrow(index.table.select("vec_id", "vec", "code", "length", "align"), run, "query_id long, vec_id long, score double")


def in_groups(queries: DataFrame, group: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """`queries` (vec_id, vec, ...), a written table, in groups of about `group` by a hash of the id: ids, vectors and rows."""
    groups = -(-queries.count() // group)
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).orderBy("vec_id").collect()
        if rows:
            yield np.array([r.vec_id for r in rows], np.int64), np.array([r.vec for r in rows], np.float64), rows


def search(index: Index, queries: DataFrame, scratch: Scratch, k: int = K, sigmas: float = SIGMAS, group: int = GROUP) -> DataFrame:
    """The k nearest rows of each of `queries` (vec_id, vec, as `usable` gives them): query_id, rank, vec_id, score; written."""
    spark = index.table.sparkSession
    some = queries.where(F.size("vec") == index.d).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    parts = []
    for ids, vectors, _ in in_groups(scratch.write(some, "queries"), group):
        ranked = _pass(index, ids, vectors, k, sigmas).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
        parts.append(materialise(ranked.select("query_id", "rank", "vec_id", "score"), "nearest"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = K, sigmas: float = SIGMAS) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by `every`."""
    scratch = Scratch(embeddings.sparkSession)
    rows = usable(embeddings)
    out = search(build_index(rows, scratch), rows.where(F.col("vec_id") % every == 0), scratch, k, sigmas)
    scratch.clear()
    return out
