"""Benchmark decontamination: word n-grams seed, Smith-Waterman decides.

Every n-gram of a benchmark item is a seed, however many documents hold it: one that is everywhere may be all that edits
have left of a passage that is everywhere. One pass over the text finds the seeds and cuts out windows of words around
them, as wide as the items of the seed's length class are long; a long run of seeds is cut into windows that overlap.

Windows and items that share a seed are joined by it, if it is one of few items: that makes a few rows for a seed found. A
seed of more than `HOT_ITEMS` items joins together with a rare word. A score of `threshold` takes that share of an item's words
at least, so a window that reaches it holds one of the item's rarest words, of which as many count as the threshold leaves
room for: without them too few words would be left. How rare a word is, is counted over the windows with such seeds. So
documents and items that have a common phrase in common and nothing else never meet, and no other pair is lost.

A pair scores by local alignment on words: `MATCH` for equal words, less `MISMATCH` and `GAP` for edits, over the score of
the whole item, so 1.0 is a verbatim copy. Pairs without enough words are not aligned; those that are, are aligned together
by as many as `CELLS` bounds.

The corpus is only ever filtered against Bloom filters of bounded size; which seed belongs to which item is an ordinary
join, whatever the size of the benchmark. Words are compared in lower case without ASCII punctuation.

Defined cases: null texts are empty and neither leak nor are leaked; items of fewer words than a seed are not searched
for; repeated items are reported each; repeated documents are one per doc_id; rows without an id are left out; an empty
table on either side gives an empty result; a very long text is as many windows of bounded width; other columns are ignored
by `find_leaks` and carried by `drop_leaks`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow
from . import _bloom
from ._common import Scratch, carried, materialise
from ._shingles import shingle_sequences

#: Words of a seed. Short, so that a copy in which every fifth word was edited still has some.
SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, 1, 1
#: Chance alignments of common words reach a third on the tables here; half an item, or all of it with a third of its words edited, counts.
THRESHOLD = 0.5
#: Cells of the rows that pairs take while they are aligned together; a pair alone may have more.
CELLS = 1 << 19
#: A seed of more items than that joins together with one of an item's rarest words.
HOT_ITEMS = 4
#: A window's seeds span so many times what the items of a class reach, at most.
SPAN = 4
#: Items are classed by length: up to this many words, up to this many times more, and so on.
CLASS_WORDS = 32

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """UTF-8 in lower case with a space for everything in ASCII that is neither a letter nor a digit."""
    return (text or "").lower().encode("utf-8").translate(_SPACED)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window, words as numbers; all pairs at once, row by row."""
    q = np.full((len(items), max(map(len, items))), -1, np.int64)
    t = np.full((len(items), max(map(len, windows))), -2, np.int64)
    for i, (a, b) in enumerate(zip(items, windows, strict=True)):
        q[i, : len(a)], t[i, : len(b)] = a, b
    above = np.zeros((len(items), t.shape[1] + 1), np.int64)
    best = np.zeros(len(items), np.int64)
    slope = GAP * np.arange(t.shape[1])
    for k in range(q.shape[1]):
        row = np.maximum(above[:, :-1] + np.where(t == q[:, k : k + 1], MATCH, -MISMATCH), above[:, 1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps along the window
        above[:, 1:] = row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def reachable(item: list[str], window: list[str], seed_words: int, threshold: float) -> list[str]:
    """The words of the window that the item can reach from the seeds they share, with as much room for insertions as it is
    long; none if they share no seed or too few words."""
    places: dict[tuple, list[int]] = {}
    for i in range(len(item) - seed_words + 1):
        places.setdefault(tuple(item[i : i + seed_words]), []).append(i)
    known, n = set(item), len(item)
    low = high = None
    for here, word in enumerate(window):
        if word in known and (at := places.get(tuple(window[here : here + seed_words]))):
            low = here - at[-1] if low is None else min(low, here - at[-1])
            high = here - at[0] if high is None else max(high, here - at[0])
    if low is None:
        return []
    part = window[max(0, low - n) : high + 2 * n + seed_words]
    held = set(part)
    return part if sum(w in held for w in item) >= threshold * n - 1e-9 else []


def _scores(seed_words: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (doc_id, item, wanted, words): (doc_id, item, score) of the pairs that are worth aligning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, 3):
            pairs = []
            for i, (wanted, words) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                part = reachable(wanted.split(), words.split(), seed_words, threshold)
                if part:
                    pairs.append((i, wanted.split(), part))
            pairs.sort(key=lambda p: (len(p[2]), len(p[1])))
            score, at = np.zeros(len(pairs)), 0
            while at < len(pairs):
                end = at + 1
                while end < len(pairs) and (end + 1 - at) * len(pairs[end][2]) <= CELLS:  # the last is the widest
                    end += 1
                part, ids = pairs[at:end], {}
                number = lambda ws, ids=ids: np.array([ids.setdefault(w, len(ids)) for w in ws], np.int64)
                got = align([number(x) for _, x, _ in part], [number(y) for _, _, y in part])
                score[at:end] = [s / (MATCH * len(x)) for s, (_, x, _) in zip(got.tolist(), part, strict=True)]
                at = end
            rows = pa.array([i for i, _, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(score)], names=["doc_id", "item", "score"])

    return run


def item_seeds(benchmark: DataFrame, seed_words: int) -> DataFrame:
    """(item_id, words, h): the words of each item and the hashes of its n-grams, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches, 1):
            texts = [plain(t) for t in b.column(1).to_pylist()]
            out = {"item_id": [], "words": [], "h": []}
            for i, t, s in zip(b.column(0).to_pylist(), texts, shingle_sequences(texts, seed_words), strict=True):
                words = t.split()
                if len(words) >= seed_words:
                    out["item_id"].append(i)
                    out["words"].append(b" ".join(words).decode("utf-8"))
                    out["h"].append(s.view(np.int64).tolist())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item_id", pa.int64()), ("words", pa.string()), ("h", pa.list_(pa.int64()))]))

    some = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(some, run, "item_id long, words string, h array<long>")


def _pieces(at: np.ndarray, reach: np.ndarray, seed_words: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Which of the seeds at the places `at` a window has, its first word and its last + 1: overlapping windows are one, up to a span."""
    ends = np.maximum.accumulate(at + seed_words + reach)
    first = np.minimum.accumulate((at - reach)[::-1])[::-1]  # a later seed may reach further back
    for part in np.split(np.arange(len(at)), np.flatnonzero(first[1:] > ends[:-1]) + 1):
        turn = (at[part] - at[part[0]]) // (SPAN * int(reach[part].max()))
        for own in np.split(part, np.flatnonzero(np.diff(turn)) + 1):
            yield own, max(0, int((at[own] - reach[own]).min())), int((at[own] + seed_words + reach[own]).max())


def _windows(docs: DataFrame, planes: list[tuple[int, np.ndarray]], seed_words: int) -> DataFrame:
    """(doc_id, words, h): runs of words around seeds, and these. planes: how many words items of a class reach, and their seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("words", pa.string()), ("h", pa.list_(pa.int64()))])
        for b in in_pieces(batches, 1):
            texts = [plain(t) for t in b.column(1).to_pylist()]
            out = {f.name: [] for f in schema}
            for doc_id, t, s in zip(b.column(0).to_pylist(), texts, shingle_sequences(texts, seed_words), strict=True):
                reach = np.zeros(len(s), np.int64)
                for around, plane in shared.value:  # from the shortest items to the longest
                    reach[_bloom.contains(plane, s)] = around
                at = np.flatnonzero(reach)
                if not len(at):
                    continue
                words = t.split()
                for own, start, end in _pieces(at, reach[at], seed_words):
                    out["doc_id"].append(doc_id)
                    out["words"].append(b" ".join(words[start:end]).decode("utf-8"))
                    out["h"].append(np.unique(s[at[own]]).view(np.int64).tolist())
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(some, run, "doc_id long, words string, h array<long>")


def rarest_words(items: DataFrame, seen: DataFrame, threshold: float) -> DataFrame:
    """(item, w): of the words of `items` (item, words), rarest in `seen` (w, df) first, as many as it takes that all others
    together, repeats counted, are less than `threshold` of them."""
    each = items.select("item", F.split("words", " ").alias("ws")).select("item", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    ranked = each.groupBy("item", "n", "w").agg(F.count("*").alias("times")).join(seen, "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    before = F.sum("times").over(Window.partitionBy("item").orderBy("df", "w").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("left", F.col("n") - F.coalesce(before, F.lit(0))).where(F.col("left") >= threshold * F.col("n") - 1e-9).select("item", "w")


def _meetings(windows: DataFrame, items: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(window, item) of all pairs that share a seed and can reach the threshold."""
    hit = windows.select("window", F.explode("h").alias("h"))
    seeds = scratch.write(items.select("item", F.explode(F.array_distinct("h")).alias("h")), "seeds")
    hot = seeds.groupBy("h").agg(F.count("*").alias("items")).where(F.col("items") > HOT_ITEMS).select("h")
    met = hit.join(seeds.join(hot, "h", "left_anti"), "h").select("window", "item")
    if hot.isEmpty():
        return met.distinct()
    hot = scratch.write(hot, "hot_seeds")
    found = scratch.write(hit.join(hot, "h").groupBy("window").agg(F.collect_list("h").alias("hs")), "hot_windows")  # of a window's own seeds
    said = found.join(windows.select("window", F.array_distinct(F.split("words", " ")).alias("ws")), "window")
    said = scratch.write(said, "hot_words")
    rare = rarest_words(items, said.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df")), threshold)
    keys = seeds.join(hot, "h").join(rare, "item").select("h", "w", "item")
    asked = said.select("window", "hs", F.explode("ws").alias("w")).join(rare.select("w").distinct(), "w", "left_semi").select("window", "w", F.explode("hs").alias("h"))
    return met.unionByName(asked.join(keys, ["h", "w"]).select("window", "item")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, score) for every document and item with a passage that scores `threshold` or more; a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    named = scratch.write(item_seeds(benchmark, seed_words), "items")
    items = named.groupBy("words").agg(F.min("item_id").alias("item"), F.first("h").alias("h"))
    kind = F.ceil(F.greatest(F.lit(0.0), F.log2(F.size("h") / CLASS_WORDS)) / 2).cast("int")  # each class is up to four times as long
    items = scratch.write(items.withColumns({"n": F.size("h"), "kind": kind}), "item_classes")
    seeds = items.select("kind", F.explode("h").alias("h"))
    kinds = items.groupBy("kind").agg(F.sum("n").alias("seeds"), F.max("n").alias("longest")).orderBy("kind").collect()  # one row per power of four
    if not kinds:
        scratch.clear()
        return spark.createDataFrame([], "doc_id long, item_id long, score double")
    most = _bloom.MAX_BITS // len(kinds)
    planes = [(k.longest + seed_words, _bloom.build(seeds.where(F.col("kind") == k.kind), _bloom.segments_for(k.seeds, most))) for k in kinds]
    windows = scratch.write(_windows(texts, planes, seed_words).withColumn("window", F.monotonically_increasing_id()), "windows")
    pairs = _meetings(windows, items, threshold, scratch)
    pairs = pairs.join(windows.select("window", "doc_id", "words"), "window").join(items.select("item", F.col("words").alias("wanted")), "item")
    scored = map_arrow(pairs.select("doc_id", "item", "wanted", "words"), _scores(seed_words, threshold), "doc_id long, item long, score double")
    best = scored.where(F.col("score") >= threshold).groupBy("doc_id", "item").agg(F.max("score").alias("score"))
    same = named.select("item_id", "words").join(items.select("words", "item"), "words").select("item", "item_id").distinct()
    out = materialise(best.join(same, "item").select("doc_id", "item_id", "score"), "leaks")
    scratch.clear()
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage, all columns kept."""
    leaked = find_leaks(docs, benchmark, threshold).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*carried(docs))
