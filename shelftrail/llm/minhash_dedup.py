"""Near-duplicate documents by circulant MinHash.

Two permutations make a whole signature: the first scatters a document's shingles over a circle of `CIRCLE` places,
the second gives each place a rank, and coordinate k is the smallest rank at the places moved back by k. A shingle's
ranks for all coordinates are then one run of memory, and a signature is the minimum over runs. Bands of coordinates
are joined on equality; every link is confirmed on the full shingle sets.

Nothing forms all pairs of a bucket. Documents with equal sets are one class from the start. In a bucket each member
is first compared with one centre, components of the confirmed links are found, and this is repeated with new centres.
Members of buckets that still hold more than one component are then joined exactly by prefix filter: two sets that
are similar enough share one of their rarest shingles, as many as the threshold leaves room for. The place of a shingle in
a set says up to which size a partner can still be similar enough, so the smaller set of a pair is filed under its shingle
and each size class that is left, and the larger one looks only there: texts on one template that are less alike than the
threshold meet at no key, however many they are. Only members outside a shingle's largest component look for partners, so
no link that could join two components is left out and a large group of copies is never held against itself.

Defined cases: a null or empty text has an empty set and links with nothing, not even other empty texts; a text with
fewer words than a shingle is one shingle; rows that share a doc_id are one document; a null doc_id is its own,
unlinked document; an empty table gives an empty result; other columns are ignored by `near_components` and carried by
`drop_near_copies`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow
from ._common import Scratch, carried, materialise
from ._components import connected_components
from ._shingles import mix, shingle_sets

CIRCLE_BITS = 22
CIRCLE = 1 << CIRCLE_BITS
#: At similarity 0.8 all bands miss a pair with probability (1 - 0.8**5)**40 = 1.2e-7.
BANDS, ROWS = 40, 5
CENTRE_ROUNDS = 2
#: Classes of set sizes between a size and the largest that may still be similar to it.
SIZE_CLASSES = 4

_ranks: dict[int, np.ndarray] = {}


def _runs(coordinates: int) -> np.ndarray:
    """Row p holds the ranks of the places p, p - 1, ... (in memory order reversed) of one shingle at place p."""
    if coordinates not in _ranks:
        second = np.random.default_rng(7).permutation(CIRCLE).astype(np.uint32)
        around = np.concatenate([second[CIRCLE - coordinates + 1 :], second])
        _ranks[coordinates] = np.lib.stride_tricks.sliding_window_view(around, coordinates)
    return _ranks[coordinates]


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    runs = _runs(coordinates)
    places = ((shingles * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    out = np.full(coordinates, CIRCLE, np.uint32)
    for i in range(0, len(places), 1024):
        np.minimum(out, runs[places[i : i + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    powers = np.multiply.accumulate(np.full(rows, 0x9E3779B97F4A7C15, np.uint64))
    mixed = (sig.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * powers
    return mix(mixed.sum(axis=1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.arange(bands, dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle_words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), fa and fb (128 bits of the set), keys (one per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, 1):
            n, fa, fb, keys = [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), shingle_words):
                n.append(len(s))
                fa.append(mix(s).sum(dtype=np.uint64))
                fb.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                keys.append(band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(fa, np.uint64).view(np.int64)), pa.array(np.array(fb, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n", "fa", "fb", "keys"],
            )

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, fa long, fb long, keys array<long>"
    )


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(rep, s): sorted distinct shingle hashes as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, 1):
            sets = [s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), shingle_words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["rep", "s"])

    return map_arrow(docs.select("doc_id", "text"), run, "rep long, s binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_raw, last = None, None
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = x.as_py(), y.as_py()
                if x != last_raw:
                    last_raw, last = x, np.frombuffer(x, np.uint64)
                other = np.frombuffer(y, np.uint64)
                both = np.concatenate([last, other])
                both.sort(kind="stable")  # two sorted runs: merged in one pass
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            if keep:
                yield b.select([0, 1]).take(pa.array(keep))

    left, right = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _open_buckets(buckets: DataFrame, component: DataFrame | None) -> DataFrame:
    """Bucket members with their component so far, of the buckets that hold more than one."""
    if component is None:
        return buckets.withColumn("comp", F.col("rep"))
    known = buckets.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("comp", F.coalesce("component", "rep")).drop("component")
    apart = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return known.join(apart, "key")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def _centre_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member with the centre of its bucket: the smallest document, in later turns the one with the smallest hash."""
    order = F.lit(0).cast("long") if turn == 0 else F.xxhash64(F.lit(turn), "rep")
    first = F.min(F.struct(order.alias("order"), F.col("rep"), F.col("comp"), F.col("n")))
    centre = members.groupBy("key").agg(first.alias("c")).select("key", F.col("c.rep").alias("rep2"), F.col("c.comp").alias("comp2"), F.col("c.n").alias("n2"))
    return _pairs(members.join(centre, "key").where(f"comp <> comp2 and {_FITS.format(percent)}"))


_FITS = "100 * least(n, n2) >= {0} * greatest(n, n2)"


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components among `members` (rep, comp, n) that can be similar enough, by exact prefix filter."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one set at a time: an output batch is as large as its set
                h = np.frombuffer(b.column(3)[i].as_py(), np.uint64).view(np.int64)
                same = pa.array(np.full(len(h), i))
                yield pa.RecordBatch.from_arrays([*(c.take(same) for c in b.columns[:3]), pa.array(h)], names=["rep", "comp", "n", "h"])

    whole = members.join(sets, "rep").select("rep", "comp", "n", "s")
    shingles = scratch.write(map_arrow(whole, spread, "rep long, comp long, n long, h long"), "shingles")
    common = shingles.groupBy("h").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    # shingles of one document or component sort first and join nothing, but they use up prefix places
    ranked = shingles.join(common, "h").groupBy("rep", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h", (F.col("x") < F.col("y")).alias("shared")))).alias("s"))
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ranked.select("rep", "comp", "n", F.posexplode(F.slice("s", 1, size.cast("int"))).alias("at", "t"))
    # sets of sizes n and m need percent / (100 + percent) * (n + m) shingles in common, all from the first common one on
    reach = F.expr(f"least(({100 + percent} * (n - at)) div {percent} - n, (100 * n) div {percent})")
    prefix = prefix.where("t.shared").select("rep", "comp", "n", "t.h", reach.alias("reach")).where(f"100 * reach >= {percent} * n")
    prefix = scratch.write(prefix, "prefixes")
    largest = prefix.groupBy("h", "comp").count().groupBy("h").agg(F.max_by("comp", F.struct("count", "comp")).alias("largest"), F.count("*").alias("comps"))
    largest = largest.where("comps > 1").select("h", "largest")
    those = prefix.join(largest, "h").withColumn("seeks", F.col("comp") != F.col("largest")).drop("largest")

    def size_class(n: str) -> F.Column:
        return F.floor(F.log(F.col(n).cast("double")) * (SIZE_CLASSES / math.log(100 / percent))).cast("int")

    larger = those.withColumn("class", size_class("n"))
    smaller = those.where("reach >= n").withColumn("class", F.explode(F.sequence(size_class("n"), size_class("reach"))))
    smaller = smaller.select("h", "class", *[F.col(c).alias(f"{c}2") for c in ("rep", "comp", "n", "reach", "seeks")])
    fits = "comp <> comp2 and n2 <= n and n <= reach2 and n2 <= reach and (n2 < n or rep2 < rep)"
    asked = larger.where("seeks").join(smaller, ["h", "class"]).where(fits)
    answered = larger.where("not seeks").join(smaller.where("seeks2"), ["h", "class"]).where(fits)
    return _pairs(asked.unionByName(answered))


def near_classes(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id; a written table, all tables behind it are deleted."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, shingle_words, bands, rows), "prints")
    classes = prints.where("n > 0 and doc_id is not null").groupBy("fa", "fb", "n").agg(
        F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")
    )
    classes = scratch.write(classes, "classes")
    members = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = scratch.write(members.join(shared, "key"), "buckets")
    active = buckets.select(F.col("rep").alias("doc_id")).distinct()
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(active, "doc_id", "left_semi")
    sets = scratch.write(_sets(some, shingle_words), "sets")

    tested = links = component = None
    for turn in range(CENTRE_ROUNDS + 1):
        open_ = _open_buckets(buckets, component)
        if turn < CENTRE_ROUNDS:
            pairs = _centre_pairs(open_, turn, percent)
        else:
            left = scratch.write(open_.groupBy("rep").agg(F.min("comp").alias("comp"), F.min("n").alias("n")), "left")
            pairs = _prefix_pairs(left, sets, percent, scratch)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, "pairs")
        if not pairs.isEmpty():
            found = scratch.write(_confirmed(pairs, sets, percent), "found")
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = found if links is None else links.unionByName(found)
            component = connected_components(links, scratch)

    out = prints.select("doc_id", "n", "fa", "fb").join(classes.select("fa", "fb", "n", "rep"), ["fa", "fb", "n"], "left")
    if component is not None:
        out = out.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "near_classes")
    scratch.clear()
    return out


def near_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept."""
    out = near_classes(docs, shingle_words, percent)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents that are not the smallest of their component."""
    gone = near_classes(docs, shingle_words, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*carried(docs))
