"""Quality by hierarchical empirical Bayes.

A logistic model, fitted on a bounded sample of labelled rows, gives each document its own evidence from the whole text:
how far its byte trigrams speak for good text, as log-odds learned on one half of the sample and shrunken toward none, and
surface features; the model itself is fitted on the other half, so it trusts trigrams as far as they hold on rows that
they were not learned on. Hosts (`source`) and paths (`source` and `lang`) get posteriors of their share of good documents: sums
over all documents by grouped aggregation, shrunk toward the level above by a Beta prior whose strength comes from how
much the groups really differ (method of moments). A document's score adds what its path says about the prior to what
its text says; a path with few documents says what its host says, a small host what the corpus says.

Defined cases: a null text is empty and scored as such; a null source or lang is the empty name; without labels every
document scores a half and stays; of repeated labels the largest counts and null labels none; rows that share a doc_id
are scored each for themselves; an empty table gives an empty result; other columns are ignored by `score_quality` and
carried by `drop_low_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow, ship_package
from ._common import carried, hash_sample, materialise
from ._linear import fit_logistic, linear, logit, sigmoid

#: The model is fitted on at most so many labelled rows, chosen by a hash of doc_id.
FIT_ROWS = 20_000
#: Trigrams fall into so many classes; a class is worth so many trigrams of the average text beforehand.
TRIGRAMS, TRIGRAM_PRIOR = 1 << 14, 50.0
#: Up to so many paths are sent to every executor to score full rows; beyond, rejected ids are joined instead.
BROADCAST_PATHS = 100_000
THRESHOLD = 0.5
_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = b"0123456789"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()|")


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8")
    words = raw.split()
    size, n = len(raw) + 1, len(words) + 1

    def count(some: bytes) -> int:
        return len(raw) - len(raw.translate(None, some))

    return [
        float(np.log(n)),
        count(_SYMBOLS) / size,
        count(_UPPER) / (count(_LETTERS) + 1),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n,
        len(raw) / n,
        count(b".,") / n,
        raw.count(b"\n") / n,
        count(_DIGITS) / size,
    ]


#: The surface features and the trigrams' log-odds.
N_FEATURES = len(features("")) + 1


def trigrams(text: str | None) -> np.ndarray:
    """The class of each byte trigram of a text, ASCII letters in lower case and digits as one."""
    raw = np.frombuffer((text or "").encode("utf-8").lower().translate(_ONE_DIGIT), np.uint8).astype(np.uint32)
    mixed = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(18)).astype(np.int64)  # the top bits: TRIGRAMS classes


_ONE_DIGIT = bytes.maketrans(_DIGITS, b"0" * 10)


def learn_trigrams(sample: DataFrame) -> np.ndarray:
    """Log-odds of each trigram class from `sample` (text, quality), of as many rows as the caller bounds it to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, TRIGRAMS), np.int64)
        for b in in_pieces(batches):
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(good > 0)] += np.bincount(trigrams(t), minlength=TRIGRAMS)
        some = np.argwhere(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1]), pa.array(seen[tuple(some.T)])], names=["good", "k", "n"])

    counts = np.zeros((2, TRIGRAMS))
    found = map_arrow(sample.select("text", "quality"), count, "good long, k long, n long").groupBy("good", "k").agg(F.sum("n").alias("n"))
    for r in found.collect():  # two rows a class at most
        counts[r.good, r.k] = r.n
    total = counts.sum()
    if not counts.sum(axis=1).all():
        return np.zeros(TRIGRAMS)
    usual = counts.sum(axis=0) / total
    share = (counts + TRIGRAM_PRIOR * usual + 1e-9) / (counts.sum(axis=1, keepdims=True) + TRIGRAM_PRIOR)
    return np.log(share[1] / share[0])


def with_features(docs: DataFrame, columns: list[str], odds: np.ndarray) -> DataFrame:
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: [*features(x), float(odds[k].mean()) if len(k := trigrams(x)) else 0.0])

    return docs.select(*columns, measured(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("features"))


def _place(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """At most `fit_rows` labelled documents, by a hash of doc_id, in two halves: doc_id, quality, learn."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = hash_sample(known, "doc_id", fit_rows)
    return materialise(chosen.withColumn("learn", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(2)) == 0), "labelled")


def fit(measured: DataFrame, known: DataFrame) -> list[float]:
    """`known` is bounded by `labelled`; rows that share a doc_id all count."""
    rows = measured.select("doc_id", "features").join(F.broadcast(known), "doc_id").select("features", "quality").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), N_FEATURES)
    return fit_logistic(x, (rows["quality"].to_numpy(float) > 0).astype(float))


def _strength(groups: DataFrame, mean: F.Column) -> float:
    """Prior rows that a group is worth, from the spread of group means around `mean` beyond sampling noise."""
    rate = F.col("good") / F.col("n")
    total, spread, noise = groups.agg(
        F.sum("n"), F.sum(F.col("n") * (rate - mean) ** 2), F.sum(F.greatest(mean * (1 - mean), F.lit(1e-6)))
    ).first()
    if not total:
        return 1.0
    between = max(1e-9, (spread - noise) / total)
    return float(min(1e6, max(1.0, noise / total / between)))


def path_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(source, lang, host_posterior, path_posterior) and the corpus mean, from `source, lang, p`."""
    paths = materialise(scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    mean = float(good / n) if n else 0.5
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k = _strength(hosts, F.lit(mean))
    hosts = hosts.select("source", ((F.col("good") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    paths = paths.join(hosts, "source")
    k = _strength(paths, F.col("host_posterior"))
    posterior = (F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)
    return materialise(paths.select("source", "lang", "host_posterior", posterior.alias("path_posterior")), "posteriors"), mean


def _scored(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[DataFrame, np.ndarray, list[float], DataFrame, float]:
    places = docs.withColumns({"source": _place("source"), "lang": _place("lang")})
    known = labelled(docs, labels, fit_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known.where("learn")), "doc_id")
    trigram_odds = learn_trigrams(texts)
    measured = materialise(with_features(places, ["doc_id", "source", "lang"], trigram_odds), "features")
    model = fit(measured, known.where("not learn"))
    scored = measured.withColumn("odds", linear("features", model)).withColumn("p", sigmoid(F.col("odds")))
    return scored, trigram_odds, model, *path_posteriors(scored)


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, text_score, host_posterior, path_posterior, score, kept."""
    scored, _, _, posteriors, mean = _scored(docs, labels, fit_rows)
    out = scored.join(posteriors, ["source", "lang"])
    score = sigmoid(F.col("odds") + logit(F.col("path_posterior")) - logit(F.lit(mean)))
    out = out.select("doc_id", F.col("p").alias("text_score"), "host_posterior", "path_posterior", score.alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)


def drop_low_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the documents that score below `threshold`, all columns kept."""
    scored, trigram_odds, model, posteriors, mean = _scored(docs, labels, fit_rows)
    score = sigmoid(F.col("odds") + logit(F.col("path_posterior")) - logit(F.lit(mean)))
    if posteriors.count() <= BROADCAST_PATHS:
        posteriors = F.broadcast(posteriors)
    row = F.struct(*carried(docs)).alias("row")
    again = with_features(docs, [row, "text", _place("source").alias("source"), _place("lang").alias("lang")], trigram_odds)
    again = again.withColumn("odds", linear("features", model)).join(posteriors, ["source", "lang"])
    return again.where(score >= threshold).select("row.*")
