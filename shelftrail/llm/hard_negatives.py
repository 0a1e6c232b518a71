"""Hard-negative mining on rotated one-bit codes with bounds that always hold.

A row is an integer vector, floor(`SCALE` * x). Beside its code stand its length and the code's alignment a with it: the
row is length * (a * code + rest), and the rest, of length sqrt(1 - a^2), is orthogonal to the code. So by Cauchy-Schwarz
its inner product with an anchor lies within sqrt(1 - a^2) * sqrt(|anchor|^2 - (anchor . code)^2) of a * (anchor . code), the
popcount estimate; what rounding the anchor to bit planes costs is bounded in full as well. No chance is involved: a row
whose interval does not reach what is asked for is left out for certain, and all others are scored in integers.

Two passes over the coded table follow, each for anchors in groups: the first keeps an anchor's best rows of its own label,
the second, for each anchor and positive, the best rows of other labels inside the positive's window of scores. A task
holds a fixed number of rows for each of these and hands over no more; pairs are never rows of a table.

Defined cases: rows take no part whose id or label is null, or whose vector is null, empty, holds null or non-finite
entries, is not as long as most, or is so long that a score might not fit a long; repeated rows count as often as they
are there, but never for an anchor of their id; of anchors with one id the smallest vector, then label, counts; ties go to
the smaller vec_id; an anchor without rows of its label, or a positive whose window is empty, gives no row; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import _codes
from ._common import Scratch, materialise
from ._vectors import matrix, of_dimension, whole_vectors
from .nearest import GROUP, PAIRS, in_groups

SCALE = 256
#: A positive's window, in percent of its score.
LOW, HIGH = 30, 90
POSITIVES, NEGATIVES = 5, 10
#: From this share of a block's pairs on, a block is scored as a matrix product and not pair by pair.
DENSE = 0.1
#: Sums of products below this are exact in floating point; |x| of a row stays below the root of 2^62, so scores fit a long.
EXACT, LONGEST = 2.0**52, 2.0**62
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
NOBODY, NOTHING = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def labelled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, but for their length; vec holds whole numbers."""
    rows = whole_vectors(embeddings, "vec_id", "label").where("vec_id is not null and label is not null")
    whole = F.transform("vec", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    square = F.aggregate("vec", F.lit(0.0), lambda total, c: total + c * c)
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("vec")).where(square < LONGEST)


def build_codes(rows: DataFrame, scratch: Scratch, seed: int = _codes.SEED) -> tuple[DataFrame, int]:
    """The coded table of `labelled` rows (vec_id, label, vec, code, length, align), written, and the dimension."""
    rows, d = of_dimension(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = _codes.rotation(d, seed)
        for b in batches:
            code, length, align = _codes.encode(matrix(b.column(2), d), turn)
            code = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, code, pa.array(length), pa.array(align)], names=["vec_id", "label", "vec", "code", "length", "align"])

    coded = map_arrow(rows.select("vec_id", "label", "vec"), run, "vec_id long, label long, vec array<double>, code binary, length double, align double")
    return scratch.write(coded, "codes"), d


class Best:
    """The k best rows of each slot so far: highest score first, then smallest id."""

    def __init__(self, slots: int, k: int):
        self.score, self.ids = np.full((slots, k), NOTHING), np.full((slots, k), NOBODY)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        near = score >= self.worst()[slot]
        slot, score, ids = slot[near], score[near], ids[near]
        held = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(held, k)])
        score, ids = np.concatenate([score, self.score[held].ravel()]), np.concatenate([ids, self.ids[held].ravel()])
        order = np.lexsort((ids, -np.maximum(score, -NOBODY), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = place < k
        self.score[slot[best], place[best]], self.ids[slot[best], place[best]] = score[best], ids[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.ids != NOBODY)
        return slot, self.ids[slot, place], self.score[slot, place]


class Rows:
    """A batch of coded rows."""

    def __init__(self, b: pa.RecordBatch, d: int):
        self.ids, self.labels, self.vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), d)
        self.codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(b.num_rows, -1)
        self.length, self.align = b.column(4).to_numpy(), b.column(5).to_numpy()


def interval(rows: Rows, part: np.ndarray, q: _codes.Queries) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows): bounds of the inner products, whatever the vectors are."""
    a, o = rows.align[part], rows.length[part]
    dot = _codes.dots(rows.codes[part], q)
    nearest_zero = np.maximum(np.abs(dot) - q.error[:, None], 0)  # |anchor . code| is at least this
    rest = np.sqrt(np.maximum(1 - a * a, 0)) * np.sqrt(np.maximum((q.length**2)[:, None] - nearest_zero**2, 0))
    room = o * (rest + a * q.error[:, None] + _codes.SLACK * q.length[:, None])
    middle = o * a * dot
    return middle - room, middle + room


def scores(a: np.ndarray, b: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """Exact inner products of pairs of rows of whole numbers."""
    x, y = a[rows_a], b[rows_b]
    reach = np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    if reach.max(initial=0) < EXACT:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))


def surviving(rows: Rows, part: np.ndarray, anchors: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The wanted pairs of `anchors` and the rows `part`, with their exact scores, a bounded number at a time."""
    query, row = np.nonzero(wanted)
    if not len(query):
        return
    block = rows.vectors[part]
    if len(query) > DENSE * wanted.size and np.abs(anchors).max() * np.abs(block).max() * block.shape[1] < EXACT:
        yield query, part[row], (anchors @ block.T)[query, row].astype(np.int64)
        return
    for i in range(0, len(query), 1 << 16):
        x, y = query[i : i + (1 << 16)], row[i : i + (1 << 16)]
        yield x, part[y], scores(anchors, block, x, y)


def _parts(rows: Rows, queries: int) -> Iterator[np.ndarray]:
    most = max(1, PAIRS // max(1, queries))
    for at in range(0, len(rows.ids), most):
        yield np.arange(at, min(at + most, len(rows.ids)))


def _positives(table: DataFrame, d: int, seed: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(anchor_id, positive_id, score): of each task the k best rows of each anchor's label."""
    shared = table.sparkSession.sparkContext.broadcast((ids, labels, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, anchors = shared.value
        q, best = _codes.queries(anchors, _codes.rotation(d, seed)), Best(len(anchor_ids), k)
        of_label = {label: np.flatnonzero(anchor_labels == label) for label in np.unique(anchor_labels).tolist()}
        for b in batches:
            rows = Rows(b, d)
            for label in np.unique(rows.labels).tolist():
                if (mine := of_label.get(label)) is None:
                    continue
                own = np.flatnonzero(rows.labels == label)
                most = max(1, PAIRS // len(mine))
                for at in range(0, len(own), most):
                    part = own[at : at + most]
                    _, high = interval(rows, part, q[mine])
                    wanted = (high >= best.worst()[mine][:, None]) & (anchor_ids[mine][:, None] != rows.ids[part])
                    for x, y, score in surviving(rows, part, anchors[mine], wanted):
                        best.add(mine[x], score, rows.ids[y])
        slot, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(anchor_ids[slot]), pa.array(found), pa.array(score)], names=["anchor_id", "positive_id", "score"])

    return map_arrow(table.select("vec_id", "label", "vec", "code", "length", "align"), run, "anchor_id long, positive_id long, score long")


def _negatives(table: DataFrame, d: int, seed: int, anchors: tuple, pairs: tuple, k: int) -> DataFrame:
    """(pair, negative_id, score): of each task the k best rows in the window of each pair of an anchor and a positive.
    pairs: the place of the anchor, in order, and the least and greatest score."""
    shared = table.sparkSession.sparkContext.broadcast((anchors, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (anchor_ids, anchor_labels, vectors), (anchor, least, greatest) = shared.value
        q, best = _codes.queries(vectors, _codes.rotation(d, seed)), Best(len(anchor), k)
        ceiling = np.full(len(anchor_ids), -np.inf)
        np.maximum.at(ceiling, anchor, greatest)
        first = np.searchsorted(anchor, np.arange(len(anchor_ids) + 1))
        for b in batches:
            rows = Rows(b, d)
            for part in _parts(rows, len(anchor_ids)):
                floor = np.full(len(anchor_ids), np.inf)  # below this no pair of the anchor takes a row any more
                np.minimum.at(floor, anchor, np.maximum(best.worst(), least))
                low, high = interval(rows, part, q)
                wanted = (anchor_labels[:, None] != rows.labels[part]) & (high >= floor[:, None]) & (low <= ceiling[:, None])
                for x, y, score in surviving(rows, part, vectors, wanted):
                    for turn in range(int(np.diff(first).max(initial=0))):  # an anchor's first pair, second pair, ...
                        slot = first[x] + turn
                        has = np.flatnonzero(slot < first[x + 1])
                        slot, s = slot[has], score[has]
                        inside = (s >= least[slot]) & (s <= greatest[slot])
                        best.add(slot[inside], s[inside], rows.ids[y[has[inside]]])
        slot, found, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(found), pa.array(score)], names=["pair", "negative_id", "score"])

    return map_arrow(table.select("vec_id", "label", "vec", "code", "length", "align"), run, "pair long, negative_id long, score long")


def _first(rows: DataFrame, key: str, id_column: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), id_column)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group: int = GROUP
) -> DataFrame:
    """Of `embeddings` (vec_id, label, embedding), for each row whose vec_id is divisible by `anchor_every` and each of its
    `positives` best rows of its label, the `negatives` best rows of other labels with `low` to `high` percent of the
    positive's score: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    scratch, parts = Scratch(spark), []
    table, d = build_codes(labelled(embeddings), scratch)
    anchors = table.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("row")).select("vec_id", "row.*")
    for ids, vectors, rows in in_groups(scratch.write(anchors, "anchors"), group):
        labels = np.array([r.label for r in rows], np.int64)
        found = _first(_positives(table, d, _codes.SEED, ids, labels, vectors, positives), "anchor_id", "positive_id", positives)
        # at most `positives` rows an anchor of the group
        pairs = sorted((r.anchor_id, r.rank, r.positive_id, r.score) for r in found.collect())
        if not pairs:
            continue
        at = np.searchsorted(ids, np.array([p[0] for p in pairs], np.int64))
        least, greatest = (np.array([f(p[3]) for p in pairs], np.int64) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
        named = spark.createDataFrame([(i, a, p, s) for i, (a, _, p, s) in enumerate(pairs)], "pair long, anchor_id long, positive_id long, positive_score long")
        best = _first(_negatives(table, d, _codes.SEED, (ids, labels, vectors), (at, least, greatest), negatives), "pair", "negative_id", negatives)
        out = best.join(F.broadcast(named), "pair").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
        parts.append(materialise(out, "negatives"))
    scratch.clear()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)
