"""Quality, toxicity and the pipeline: held-out accuracy, defined cases, and the stages one after another."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelftrail.llm import quality, toxicity
from shelftrail.llm._common import materialise
from shelftrail.llm._linear import fit_logistic
from shelftrail.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def test_logistic_recovers_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert fit_logistic(x, y) == pytest.approx([1, 2, -1], abs=0.25)
    assert fit_logistic(np.zeros((0, 3)), np.zeros(0)) == [0, 0, 0, 0]


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum", "grolk" + rng.choice(["en", "ig", "er"])])
        text = " ".join(words) + "."
        if not good:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text, "en", rng.choice(["a", "b", f"c{i % 50}"]), len(text)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(8)
    docs, labels = corpus(rng, 1500)
    docs += [(9000, None, None, None, None), (9001, "", "en", "a", 0), (9001, "", "en", "a", 0), (9002, "fine words " * 20_000, "en", "new", 1), (None, "idiot moron", "en", "a", 1)]
    labels += [(1, None, None), (1, labels[0][1], labels[0][2]), (None, 1, 1), (424242, 0, 0)]
    return spark.createDataFrame(docs, SCHEMA).repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), docs


def test_quality_separates_and_keeps_columns(spark, made):
    docs, labels, rows = made
    docs = docs.withColumns({"features": F.lit(1), "p": F.lit("x"), "row": F.lit(2)})
    got = quality.score_quality(docs, labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    shouted = {r[0]: "!!" in (r[1] or "") for r in rows}
    known = got[got.doc_id < 9000]
    assert (known.kept != known.doc_id.map(shouted)).mean() > 0.99
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(got.kept.sum())
    by_ids = quality.BROADCAST_PATHS
    quality.BROADCAST_PATHS = 0
    try:
        assert quality.drop_low_quality(docs.where("doc_id is not null"), labels).count() == int(got[got.doc_id.notna()].kept.sum())
    finally:
        quality.BROADCAST_PATHS = by_ids


@pytest.mark.parametrize("shared", [None, 10**9])
def test_quality_judges_rows_alike_beyond_the_path_bound(spark, made, monkeypatch, shared):
    docs, labels, _ = made
    docs = docs.withColumn("doc_id", F.when(F.length("text") % 2 == 0, F.lit(shared)).otherwise(F.col("doc_id")).cast("long"))
    columns = ["doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text")]
    want = sorted(map(str, quality.drop_low_quality(docs, labels).select(*columns).collect()))
    monkeypatch.setattr(quality, "BROADCAST_PATHS", 0)
    got = sorted(map(str, quality.drop_low_quality(docs, labels).select(*columns).collect()))
    assert got == want and 0 < len(got) < docs.count()


def test_quality_posteriors_shrink_by_size(spark):
    rows = [("big", "en", 0.9)] * 900 + [("big", "de", 0.5)] * 300 + [("tiny", "en", 0.1)] * 2 + [(f"h{i}", "en", 0.2 + 0.6 * (i % 2)) for i in range(40) for _ in range(50)]
    posteriors, mean = quality.path_posteriors(spark.createDataFrame(rows, "source string, lang string, p double"))
    by = {(r.source, r.lang): r for r in posteriors.collect()}
    assert abs(by["big", "en"].path_posterior - 0.9) < 0.02  # many documents: its own share
    assert 0.1 < by["tiny", "en"].path_posterior < mean  # two documents: pulled toward the corpus
    assert mean == pytest.approx(np.mean([p for *_, p in rows]))


def test_quality_equals_the_formulas(spark, made):
    """Scores worked out again in numpy from the operator's features: fit, shrunken hosts and paths, and their sum."""
    docs, labels, rows = made
    got = quality.score_quality(docs, labels).toPandas()
    known = {r.doc_id: (r.quality, r.learn) for r in quality.labelled(docs, labels, 20_000).collect()}
    assert set(known) == {r.doc_id for r in labels.where("quality is not null and doc_id is not null").collect()} - {424242} and {x for _, x in known.values()} == {True, False}
    ids = [r[0] for r in rows]
    counts = [np.full(quality.TRIGRAMS, 0.0), np.full(quality.TRIGRAMS, 0.0)]
    for i, t, *_ in rows:
        if i in known and known[i][1]:
            for k in quality.trigrams(t):
                counts[known[i][0] > 0][k] += 1
    usual = (counts[0] + counts[1]) / (counts[0].sum() + counts[1].sum())
    share = [(c + quality.TRIGRAM_PRIOR * usual + 1e-9) / (c.sum() + quality.TRIGRAM_PRIOR) for c in counts]
    speak = np.log(share[1] / share[0])
    feats = np.array([[*quality.features(t), speak[quality.trigrams(t)].mean() if len(t or "") > 2 else 0.0] for _, t, *_ in rows])
    have = np.array([i in known and not known[i][1] for i in ids])
    model = fit_logistic(feats[have], np.array([float(known[i][0] > 0) for i, h in zip(ids, have, strict=True) if h]))
    odds = model[0] + feats @ np.array(model[1:])
    p = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
    host, path = [r[3] or "" for r in rows], [(r[3] or "", r[2] or "") for r in rows]

    def shrunk(keys, prior):
        n, good = {}, {}
        for k, x in zip(keys, p, strict=True):
            n[k], good[k] = n.get(k, 0) + 1, good.get(k, 0.0) + x
        spread = sum(n[k] * (good[k] / n[k] - prior(k)) ** 2 for k in n)
        noise = sum(max(prior(k) * (1 - prior(k)), 1e-6) for k in n)
        between = max(1e-9, (spread - noise) / sum(n.values()))
        strength = min(1e6, max(1.0, noise / sum(n.values()) / between))
        return {k: (good[k] + strength * prior(k)) / (n[k] + strength) for k in n}

    mean = p.mean()
    hosts = shrunk(host, lambda k: mean)
    paths = shrunk(path, lambda k: hosts[k[0]])
    logit = lambda x: np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4)))
    score = 1 / (1 + np.exp(-np.clip(odds + np.array([logit(paths[k]) for k in path]) - logit(mean), -35, 35)))
    np.testing.assert_allclose(np.sort(got["score"].to_numpy()), np.sort(score), rtol=1e-6, atol=1e-9)


def test_models_without_labels_or_rows(spark, made):
    docs, labels, rows = made
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(docs, none).select(F.round("score", 6).alias("score")).collect()} == {0.5}
    assert quality.drop_low_quality(docs, none).count() == len(rows)
    assert quality.score_quality(docs.limit(0), labels).count() == 0 and toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    got = toxicity.score_toxicity(docs, none).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark, made):
    docs, labels, rows = made
    bare = docs.withColumns({"h": F.lit(1), "v": F.lit(2), "features": F.lit("f"), "toxic": F.lit(0)})
    got = toxicity.score_toxicity(bare, labels).toPandas()
    assert len(got) == len(rows) and set(got.predicted) == {0, 1} and ((got.score >= 0.5) == (got.predicted == 1)).all()
    for r in got[got.doc_id.notna()].itertuples():
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 5 == 0)
    truth = {r[0]: any(w in (r[1] or "").lower() for w in ("idiot", "moron", "scum", "grolk")) for r in rows}
    known = got[(got.doc_id < 9000) & got.held_out]
    assert (known.predicted == known.doc_id.map(truth)).mean() > 0.97


def test_toxicity_by_fixed_voters_alone(spark, made):
    docs, labels, rows = made
    got = toxicity.score_toxicity(docs, labels, induce=False).toPandas()
    truth = {r[0]: not {"idiot", "moron", "scum"}.isdisjoint(re.findall("[a-z]+", (r[1] or "").lower())) for r in rows}
    known = got[(got.doc_id < 9000) & got.held_out]
    toxic = known.doc_id.map(truth)
    assert (known.predicted == toxic).mean() > 0.97 and known[toxic].predicted.mean() > 0.9


def test_toxicity_voters_read_spellings_phrases_and_addresses():
    hits = lambda x: toxicity.Voters([]).hits(x)[: toxicity.FIXED]
    assert hits("you st*pid, 1d10t!!! moooron") == [0, 3, 0, 0] and hits("You are such a clown") == [1, 0, 0, 1]
    assert hits("Shut up. Ta gueule!") == [0, 0, 2, 0] and hits("10% of $5 are 2000!! $***$ **** 42") == [0, 0, 0, 0]
    assert hits(None) == hits("") == [0, 0, 0, 0] and hits("x" * 100_000 + "1") == [0, 0, 0, 0]


def test_toxicity_counts_near_copies_once(spark):
    """A hot source that begins all texts alike still gives support; copies of one text do not."""
    head = "one header of the source in eight words "
    rng = random.Random(3)
    say = lambda: " ".join("".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(30))
    docs = [(i, head + say() + (" grolk" if i % 2 else ""), int(i % 2)) for i in range(200)]
    copy = "zugzug " + say()
    docs += [(1000 + i, copy + f" {i}", 1) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in docs], "doc_id long, quality int, toxic int")
    clean = spark.createDataFrame([(5000, "grolk alone"), (5001, "zugzug alone"), (5002, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df.unionByName(clean), labels).where("doc_id >= 5000").collect()}
    assert got == {5000: 1, 5001: 0, 5002: 0}


def plain_copies(sample):
    """Texts of a label without those alike at 0.8 by five-word shingles with one of a smaller id."""
    kept = []
    for i, text, toxic in sorted(sample, key=lambda r: (r[2], r[0])):
        w = text.lower().split()
        shingles = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if not any(t == toxic and (s == shingles if not shingles else len(s & shingles) >= 0.8 * len(s | shingles)) for _, _, t, s in kept):
            kept.append((i, text, toxic, shingles))
    return [(text, toxic) for _, text, toxic, _ in kept]


def plain_toxicity(docs, labels):
    """The method of the docstring for a small table, a loop at a time: doc_id -> score."""
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    known = {i: int(t > 0) for i, _, t in labels if not held[i]}
    sample = plain_copies([(i, t or "", known[i]) for i, t in docs if i in known])
    words = lambda t: set(re.findall(r"[^\W\d_]+", (t or "").lower()))

    def terms(t):
        out, stems = set(words(t)), {}
        for w in words(t):
            for k in toxicity.STEMS:
                if len(w) > k:
                    stems.setdefault(w[:k], set()).add(w)
        return out | {s + "~" * n for s, ws in stems.items() for n in range(1, min(len(ws), toxicity.SHARING) + 1)}

    counts = [{}, {}]
    for t, toxic in sample:
        for x in terms(t):
            counts[toxic][x] = counts[toxic].get(x, 0) + 1
    n_toxic = sum(t for _, t in sample)
    often = {x: k for x, k in counts[1].items() if k >= max(toxicity.SUPPORT, toxicity.SHARE * n_toxic)}
    good = sorted((x for x, k in often.items() if k / (k + counts[0].get(x, 0)) >= toxicity.PRECISION), key=lambda x: (-often[x], x))
    place = {}
    for rank, x in enumerate(good):
        if x not in toxicity.INSULTS:
            place[x] = toxicity.FIXED + rank % toxicity.PARTS + toxicity.PARTS * x.endswith("~")
    fixed, n = toxicity.Voters([]), toxicity.N_LISTS
    hits = {}
    for i, t in docs:
        row = [0] * n
        row[:4] = fixed.hits(t)[:4]  # told by their own test
        row[3] = sum(w in toxicity.INSULTS or w in place for w in re.findall(toxicity.ADDRESSED, (t or "").lower()))
        for x in terms(t):
            if x in place:
                row[place[x]] += 1
        hits[i] = row, len(words(t))

    def votes(row, n_words):
        said = [int(h > 0) for h in row]
        by_word, by_stem, total = sum(row[:8]), sum(row[8:]), sum(row)
        return [*said, 1 if by_word else -1, 1 if by_stem else -1, 1 if sum(said) >= 2 else -1, 1 if total * 200 > n_words else -1 if total == 0 else 0]

    v = {i: np.array(votes(*h), float) for i, h in hits.items()}
    train = np.array([v[i] for i, _ in docs if not held[i]])
    cov = train.T @ train / len(train) - np.outer(train.mean(0), train.mean(0))
    prior = min(0.5, max(0.01, sum(known.values()) / len(known)))
    m, spread = len(cov), np.sqrt(np.maximum(np.diag(cov), 1e-12))
    accuracy = np.zeros(m)
    for i in range(m):
        triples = [math.sqrt(abs(cov[i][j] * cov[i][k] / cov[j][k])) for j in range(m) for k in range(j + 1, m) if i not in (j, k) and abs(cov[j][k]) > 1e-9]
        accuracy[i] = min(float(np.median(triples)) if triples else 0.0, 0.98 * spread[i])
    crowd = [1 + sum(max(0.0, min(0.95, (cov[i][j] - accuracy[i] * accuracy[j]) / spread[i] / spread[j])) for j in range(m) if j != i) for i in range(m)]
    balance = max(1e-3, 4 * prior * (1 - prior))
    weight = [2 * accuracy[i] / max(spread[i] ** 2 - accuracy[i] ** 2, 1e-4 * spread[i] ** 2 + 1e-9) / crowd[i] / math.sqrt(balance) for i in range(m)]
    middle = [2 * train.mean(0)[i] + accuracy[i] * (2 * (1 - prior) - 2 * prior) / math.sqrt(balance) for i in range(m)]
    odds = lambda x: math.log(prior / (1 - prior)) - sum(w * c for w, c in zip(weight, middle, strict=True)) / 2 + sum(w * a for w, a in zip(weight, x, strict=True))
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    features = {i: [*np.log1p(h), sum(h) / (k + 1), *v[i][n:]] for i, (h, k) in hits.items()}
    x = np.array([features[i] for i, _ in docs if not held[i]])
    y = np.array([squash(odds(v[i])) for i, _ in docs if not held[i]])
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge, w = np.diag([1e-3] + [1.0] * (z.shape[1] - 1)), np.zeros(z.shape[1])
    for _ in range(200):  # Newton's steps to the optimum of the penalised likelihood
        p = squash(z @ w)
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
    return {i: float(squash(np.concatenate([[1.0], (np.array(f) - mean) / scale]) @ w)) for i, f in features.items()}


def test_toxicity_equals_brute_force(spark):
    docs, labels = corpus(random.Random(12), 900)
    docs += [(5000, None, None, None, None), (5001, "", None, None, 0), (5002, "You are an absolute grolken, shut up", None, None, 9), (5003, "1d10t", None, None, 5)]
    want = plain_toxicity([(i, t) for i, t, *_ in docs], labels)
    tables = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(*tables).collect()}
    assert set(got) == set(want) and 0.02 < np.mean([s >= 0.5 for s in want.values()]) < 0.5
    assert max(abs(got[i] - want[i]) for i in want) < 1e-5


@pytest.mark.parametrize("words", [200, 4000])
def test_toxicity_sample_keeps_unrelated_texts(spark, words):
    """Texts over one vocabulary are no copies, however long; copies with a few words changed count once."""
    rng = random.Random(words)
    say = lambda: [f"v{''.join(rng.choice('abcdefgh') for _ in range(3))}" for _ in range(words)]
    texts = [say() for _ in range(60)]
    copies = [[w if k % 97 else f"c{i}" for k, w in enumerate(texts[0])] for i in range(20)]
    rows = [(i, " ".join(t), i % 2) for i, t in enumerate(texts)] + [(1000 + i, " ".join(t), 0) for i, t in enumerate(copies)] + [(2000 + i, "", 0) for i in range(5)]
    kept = toxicity.first_of_copies(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3))
    assert kept.count() == 61 and kept.where("text = ''").count() == 1


def test_toxicity_does_not_read_held_out_labels(spark, made):
    docs, labels, _ = made
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    order = lambda d, s: [tuple(r) for r in toxicity.score_toxicity(d, s).select("doc_id", F.round("score", 9)).orderBy("doc_id", "score").collect()]
    moved = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("elsewhere")})
    assert order(docs, labels) == order(moved, flipped)


def test_label_model_trusts_good_voters():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(40_000) < 0.3, 1, -1)
    votes = np.stack([np.where(rng.random(len(y)) < a, y, -y) for a in (0.95, 0.8, 0.6, 0.9)], axis=1)
    votes = np.hstack([votes, votes[:, 2:3]])  # a copied bad voter
    b, w = toxicity.label_model(votes.T @ votes / len(y), votes.mean(axis=0), 0.3)
    assert w[0] > w[1] > w[2] and ((b + votes @ w > 0) == (y > 0)).mean() > 0.93


def test_pipeline_stages_and_bruteforce(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, at, SF), f"test-{name}")
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in (at, out))
        assert after.items() <= before.items()
        seen[name] = before, after
        at = out
    kept = {r.doc_id for r in QUERIES["op6_quality"](spark, SF).where("kept").collect()}
    assert set(seen["quality"][1]) == kept
    before, after = seen["exact_dedup"]
    strip = lambda t: "".join(t.split(" ")).translate({ord(c): None for c in "\t\n\x0b\x0c\r"})
    assert len(after) == len({strip(t) for t in before.values()}) == len({strip(t) for t in after.values()})
    before, after = seen["near_dedup"]

    def sets(texts, k=5):
        for i, t in sorted(texts.items()):
            w = t.encode().lower().split()
            yield i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()

    have, comp = dict(sets(before)), {i: i for i in before}
    ids = sorted(have)

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    where = {}
    for i in ids:
        for g in have[i]:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for held in where.values() for n, a in enumerate(held) for b in held[n + 1 :]}
    for a, b in pairs:
        shared = len(have[a] & have[b])
        if 100 * shared >= 80 * (len(have[a]) + len(have[b]) - shared):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if root(i) == i}
    before, after = seen["decontaminate"]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in before.items() if any(b in t for b in bench)}
    assert whole and not whole & set(after) and len(before) - len(after) <= len(whole) + 5
    last = {r.doc_id for r in corpus_pipeline.encode_stage(spark, at, SF).collect()}
    assert last == set(after)
