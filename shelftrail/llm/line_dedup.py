"""Line dedup across documents with DataFrame functions only.

Lines are exploded with their positions; a line's key (ends stripped, A-Z lower-cased) is hashed twice, to 128 bits in
all. Distinct (key, document) pairs are counted per key, each step combined before it moves, so a line on every page is
one row per task. Keys of `least_docs` documents or more keep their lines in the smallest doc_id that holds them; the
positions of all others go back to their documents, whose text is put together again from the lines at all other positions.
Only hashes and positions are exploded and shuffled, and each text moves once, whole.

Defined cases: a null or empty text is one empty line; keys shorter than `min_chars` never count; rows with the same
doc_id are one document, whose rows all keep their lines; a row without a doc_id keeps all its lines and holds none
for others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, ascii_lower_key, hash_pair, materialise, whole_text

MIN_CHARS = 10
#: A key is repeated from so many documents on.
LEAST_DOCS = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, a, b): place and key hashes of each line that counts; a row is known by its id and text."""
    texts = docs.where("doc_id is not null").select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))  # once a text, below the explode
    lines = texts.select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("key")).where(F.char_length("key") >= min_chars)
    a, b = hash_pair(ascii_lower_key(F.col("key")))
    return keys.select("doc_id", "text_hash", "pos", a.alias("a"), b.alias("b"))


def repeated_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(a, b, n_docs, first_id) of the keys that at least `least_docs` documents hold."""
    held = lines.select("a", "b", "doc_id").distinct()
    counted = held.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"))
    return counted.where(F.col("n_docs") >= least_docs)


def _without(lines: Column, gone: Column) -> Column:
    """The lines at the places that are not in `gone`, in order; one hash lookup a line."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(kept, lambda p: F.get(lines, p))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of `docs`: `doc_id, n_lines, n_dropped, text` with the dropped lines left out."""
    lines = materialise(keyed_lines(docs, min_chars), "line_keys")
    drops = lines.join(repeated_keys(lines, least_docs).select("a", "b", "first_id"), ["a", "b"]).where("doc_id > first_id")
    drops = drops.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    cut = texts.join(drops, ["doc_id", "text_hash"], "left").select("doc_id", "text", _lines(F.col("text")).alias("lines"), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines"), F.col("gone")), "\n"))
    return cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text")
    )
