"""Toxicity by weak supervision.

Voters say toxic (+1), clean (-1) or nothing (0). Four need no labels and read different things: a fixed word list, the
same words behind changed spellings (digits and signs for letters, letters drawn out), hostile phrases, and somebody
addressed with a word that follows a form of "you are" and an article. The others are lexicons and word-stem lists
induced from labelled rows, and patterns over the hits. A generative label model learns how far each voter can be trusted
without labels: from the second moments of the votes over all training rows, a voter's accuracy is the median over triplets of voters
of sqrt(E_ij E_ik / E_jk), and what a pair agrees on beyond the product of their accuracies is their correlation, by
which both lose weight. The posterior of the votes is the label on which a linear classifier over hit counts is trained.

No label of a held-out row (crc32 of doc_id as text, modulo 5, is 0) is read, and no score uses labels, lang, source or
doc_id. Lexicons and classifier are fitted on bounded samples of training rows; moments are summed over all of them.

Near copies in the sample of labelled rows, told by MinHash over the shingles of whole texts, count as one row there: a row is
left out if its signature agrees with that of a row of its label with a smaller doc_id. Unrelated texts stay, however long.

Defined cases: a null or empty text has no hits and is scored as such; without labels only the fixed voters vote; of
repeated labels the largest counts and null labels none; a null doc_id is held out; repeated rows are scored each for
themselves; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow
from ._common import hash_sample, materialise
from ._linear import fit_logistic, linear, sigmoid
from ._shingles import shingle_sets
from .minhash_dedup import BANDS, ROWS, band_keys, signature

#: Lexicons are induced from at most so many toxic and clean labelled training rows, by a hash of doc_id.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 12_000
#: The classifier is trained on at most so many training rows.
FIT_ROWS = 20_000
#: A word or stem enters a lexicon from so many toxic rows on, and so large a share of them, if it is so precise.
SUPPORT, SHARE, PRECISION = 6, 0.01, 0.95
#: The lexicons hold so many terms at most.
LEXICON = 5_000
#: Lengths of stems, and how many distinct words of a text on one stem are told apart.
STEMS, SHARING = (3, 4, 5, 6, 7), 3
#: Texts whose signatures over whole texts agree in so large a share of coordinates are near copies, by shingles of so many words.
ALIKE, SHINGLE_WORDS = 0.8, 5
PARTS = 4
#: Fixed values of the voters without labels, chosen here: insults of four languages, hostile phrases, who is addressed how.
INSULTS = [
    "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless",
    "abschaum", "dummkopf", "trottel", "vollidiot", "abruti", "connard", "crétin", "imbécile", "basura", "estúpido", "idiota", "imbécil", "inútil",
]
HOSTILE = ["shut up", "go to hell", "get lost", "hate you", "kill yourself", "drop dead", "halt die klappe", "ta gueule", "ferme la", "cállate", "vete a la mierda"]
ADDRESSED = r"(?:you are|you're|you|du bist|tu es|vous êtes|eres) (?:such )?(?:a|an|ein|eine|un|une|una) (?:total |complete |absolute )?([^\W\d_]+)"
SIGNS = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_SIGNED = re.compile(r"[\d@$!*]")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_EDGE = "\"'().,:;!?-"
#: Changed spellings are looked for in words of up to so many characters.
SPELLED_CHARS = 24
_HOSTILE = re.compile("|".join(rf"\b{p}\b" for p in HOSTILE))
_ADDRESSED = re.compile(ADDRESSED)
#: Voters without labels.
FIXED = 4


def _spelled(text: str) -> int:
    """Different words that become an insult when signs are read as letters and drawn-out letters as one."""
    found, drawn = 0, _DRAWN.search(text) is not None
    for token in set(text.split()):
        if len(token) > SPELLED_CHARS or token.isalpha() and not drawn:
            continue
        w = token.strip(_EDGE)
        if _SIGNED.search(w) and not w.isdigit():
            if "*" in w:
                like = re.compile(".".join(map(re.escape, w.split("*"))))
                found += 2 * w.count("*") <= len(w) and any(map(like.fullmatch, INSULTS))
            else:
                found += w.translate(SIGNS) in _INSULTS
        elif drawn and _DRAWN.search(w):
            found += re.sub(r"(\w)\1+", r"\1", w) in _SHORT
    return found


_INSULTS = frozenset(INSULTS)
_SHORT = frozenset(re.sub(r"(\w)\1+", r"\1", w) for w in INSULTS)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _terms(text: str | None) -> set[str]:
    """Distinct words; stems with a `~`, or with as many as distinct words share the stem, up to `SHARING`."""
    words = _words(text)
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return words | {s + "~" * n for s, most in stems.items() for n in range(1, min(most, SHARING) + 1)}


def _induce(sample: DataFrame) -> list[tuple[str, int]]:
    """(word or stem, toxic rows) that mark toxic rows in `sample` (text, toxic)."""

    def run(toxic_only: bool, wanted: set[str] | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                terms, toxic = [], []
                for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    got = _terms(t) if wanted is None else _terms(t) & wanted
                    terms.extend(got)
                    toxic.extend([x] * len(got))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])

        rows = sample.where("toxic = 1") if toxic_only else sample.where("toxic = 0")
        return map_arrow(rows.select("text", "toxic"), each, "term string, toxic int").groupBy("term").agg(F.count("*").alias("n"))

    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1):
        return []
    often = {r.term: r.n for r in run(True, None).where(F.col("n") >= max(SUPPORT, SHARE * n[1])).orderBy(F.desc("n"), "term").limit(2 * LEXICON).collect()}
    clean = {r.term: r.n for r in run(False, set(often)).collect()}
    good = [(t, k) for t, k in often.items() if k / (k + clean.get(t, 0)) >= PRECISION]
    return sorted(good, key=lambda x: (-x[1], x[0]))[:LEXICON]


class Voters:
    """Which lists a text hits. Induced terms are dealt over `PARTS` word lists and as many stem lists, so they can disagree."""

    def __init__(self, induced: list[tuple[str, int]]):
        self.list_of: dict[str, int] = {w: 0 for w in INSULTS}
        for rank, (term, _) in enumerate(induced):
            if term not in self.list_of:
                self.list_of[term] = FIXED + rank % PARTS + PARTS * term.endswith("~")
        self.stems = {t.rstrip("~") for t in self.list_of if t.endswith("~")}

    def hits(self, text: str | None) -> list[int]:
        low = (text or "").lower()
        words, known = set(_WORD.findall(low)), self.stems
        stems = Counter(s for w in words for k in STEMS if len(w) > k and (s := w[:k]) in known)
        found = [0] * (FIXED + 2 * PARTS)
        for t in self.list_of.keys() & words:
            found[self.list_of[t]] += 1
        found[1] = _spelled(low)
        found[2] = len(_HOSTILE.findall(low))
        found[3] = sum(w in _INSULTS or w in self.list_of for w in _ADDRESSED.findall(low))
        for s, most in stems.items():
            for n in range(1, min(most, SHARING) + 1):
                if (i := self.list_of.get(s + "~" * n)) is not None:
                    found[i] += 1
        return [*found, len(words)]


#: Hit counts before the number of words, and votes: one of each list, then the patterns.
N_LISTS = FIXED + 2 * PARTS
N_VOTES = N_LISTS + 4


def votes(h: Column) -> Column:
    """Votes from the hit counts. Lists can only say toxic; patterns over all of them also say clean."""
    lists = [F.when(h[i] > 0, 1).otherwise(0) for i in range(N_LISTS)]
    add = lambda some: sum(some[1:], some[0])
    total, kinds = add([h[i] for i in range(N_LISTS)]), add(lists)
    words = add([h[i] for i in [*range(FIXED), *range(FIXED, FIXED + PARTS)]])
    stems = add([h[i] for i in range(FIXED + PARTS, N_LISTS)])
    patterns = [
        F.when(words > 0, 1).otherwise(-1),
        F.when(stems > 0, 1).otherwise(-1),
        F.when(kinds >= 2, 1).otherwise(-1),
        F.when(total * 200 > h[N_LISTS], 1).when(total == 0, -1).otherwise(0),
    ]
    return F.array(*lists, *patterns)


def label_model(moments: np.ndarray, means: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Log-odds (intercept, weight of each vote) from second moments and means of votes in {-1, 0, 1}."""
    n = len(means)
    # votes as deviations: what is left of agreement when voters are independent given the label
    balance = max(1e-3, 4 * prior * (1 - prior))
    cov = moments - np.outer(means, means)
    accuracy = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        found = [np.sqrt(abs(cov[i, j] * cov[i, k] / cov[j, k])) for j, k in combinations(others, 2) if abs(cov[j, k]) > 1e-9]
        accuracy[i] = np.median(found) if found else 0.0
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    accuracy = np.minimum(accuracy, 0.98 * spread)  # E[vote label] in units where the label has variance 1
    left = cov - np.outer(accuracy, accuracy)
    np.fill_diagonal(left, 0)
    correlation = np.clip(left / np.outer(spread, spread), -0.95, 0.95)
    crowd = 1 + np.maximum(correlation, 0).sum(axis=1)
    noise = np.maximum(spread**2 - accuracy**2, 1e-4 * spread**2 + 1e-9)
    weight = accuracy / noise / crowd * 2 / np.sqrt(balance)
    # the threshold between the two class means of the weighted vote, moved by the prior
    shift = np.sqrt(balance)
    toxic, clean = means + accuracy * 2 * (1 - prior) / shift, means - accuracy * 2 * prior / shift
    return float(np.log(prior / (1 - prior)) - weight @ (toxic + clean) / 2), weight


def first_of_copies(sample: DataFrame) -> DataFrame:
    """The rows (doc_id, text, toxic) of a written sample of bounded size without near copies of rows of the same label, which
    would count as support of their words. Only signatures come to the driver: 800 bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            sets = shingle_sets(b.column(0).to_pylist(), SHINGLE_WORDS)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())], names=["doc_id", "toxic", "sig"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(sample.select("text", "doc_id", "toxic"), run, f"doc_id {id_type}, toxic int, sig binary").collect()
    kept, buckets = [], {}
    for r in sorted(rows, key=lambda r: (r.toxic, r.doc_id)):
        sig = np.frombuffer(r.sig, np.uint32)
        keys = [(r.toxic, k, h) for k, h in enumerate(band_keys(sig, BANDS, ROWS).tolist())] if len(sig) else [(r.toxic, -1, 0)]
        near = {i for key in keys for i in buckets.get(key, ())}
        if any(not len(sig) or (kept[i][1] == sig).mean() >= ALIKE for i in near):
            continue
        for key in keys:
            buckets.setdefault(key, []).append(len(kept))
        kept.append((r.doc_id, sig))
    ids = sample.sparkSession.createDataFrame([(i,) for i, _ in kept], f"doc_id {id_type}")
    return materialise(sample.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "toxic"), "sample")


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, induce: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Without `induce` only the fixed voters vote."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = known.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    parts = [hash_sample(known.where(f"toxic = {x}"), "doc_id", n) for x, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = materialise(parts[0].unionByName(parts[1]), "chosen")  # at most TOXIC_ROWS + CLEAN_ROWS
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = first_of_copies(materialise(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = min(0.5, max(0.01, n.get(1, 0) / max(1, sum(n.values()))))

    voters = spark.sparkContext.broadcast(Voters(_induce(sample) if induce else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            hits = [voters.value.hits(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", "h"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    hit = map_arrow(docs.select(F.col("text").cast("string"), "doc_id"), run, f"doc_id {id_type}, h array<int>")
    hit = materialise(hit.withColumn("held_out", held_out()).withColumn("v", votes(F.col("h"))), "votes")

    train = hit.where("not held_out")
    pairs = [(i, j) for i in range(N_VOTES) for j in range(i, N_VOTES)]
    row = train.agg(
        F.count("*"), *[F.sum(F.col("v")[i]) for i in range(N_VOTES)], *[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs]
    ).first()
    total = max(1, row[0])
    means = np.array([x or 0 for x in row[1 : 1 + N_VOTES]], float) / total
    moments = np.zeros((N_VOTES, N_VOTES))
    for (i, j), x in zip(pairs, row[1 + N_VOTES :], strict=True):
        moments[i, j] = moments[j, i] = (x or 0) / total
    intercept, weight = label_model(moments, means, prior)

    words = F.col("h")[N_LISTS] + 1
    counts = [F.log1p(F.col("h")[i].cast("double")) for i in range(N_LISTS)]
    density = sum((F.col("h")[i] for i in range(1, N_LISTS)), F.col("h")[0]) / words
    featured = hit.withColumn("features", F.array(*counts, density, *[F.col("v")[i].cast("double") for i in range(N_LISTS, N_VOTES)]))
    posterior = sigmoid(F.lit(intercept) + sum((F.col("v")[i] * float(weight[i]) for i in range(1, N_VOTES)), F.col("v")[0] * float(weight[0])))
    fit = hash_sample(featured.where("not held_out"), "doc_id", fit_rows).select("features", posterior.alias("p")).toPandas()
    x = np.array(fit["features"].tolist(), float).reshape(len(fit), 1 + N_VOTES)
    model = fit_logistic(x, fit["p"].to_numpy(float))
    out = featured.select("doc_id", "held_out", sigmoid(linear("features", model)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
