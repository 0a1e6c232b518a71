"""Tokens, licences, decontamination and quotes against brute force."""

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelftrail.llm import bpe, chat_quotes, decontaminate, license_scan, token_counts

SCHEMA = "doc_id long, text string"


@lru_cache(maxsize=1)
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference():
    return library()


PIECES = ["a", "the", "'", "'re", "'ll", " ", "  ", "\n", "\t", " \n", "é", "ß", "1", "23", "!", "...", "日本", "😀", "\x85", "\xa0", "²", "ing", "S", "'s", "<|endoftext|>", "x" * 30]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.sampled_from([1, 2, 3, 7, 1024]), st.sampled_from([2, 5, 256]))
def test_bpe_tree_equals_library(pieces, leaf, long):
    text = "".join(pieces)
    enc = bpe.encoder()
    want = library().encode_ordinary(text)
    was = bpe.LEAF_CHARS, bpe.LONG_BYTES
    bpe.LEAF_CHARS, bpe.LONG_BYTES = leaf, long
    enc.known.clear()
    try:
        ids = enc.encode(text)
    finally:
        bpe.LEAF_CHARS, bpe.LONG_BYTES = was
    assert ids.tolist() == want
    assert enc.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 4000, "a" * 9000, " " * 9000, "\n" * 3000 + "x", "éß" * 3000, "word " * 5000])
def test_bpe_very_long(reference, text):
    assert bpe.encoder().encode(text).tolist() == reference.encode_ordinary(text)


RULES = ["-", "=", "_", ".", "*", "#", "/", "\u00a0", "\u2014", "\u00af", "\ufffd", "\u00c3\u00c2"]


@pytest.mark.parametrize("rule", RULES)
def test_bpe_runs_longer_than_any_token(reference, rule):
    enc = bpe.encoder()
    for n in range(1, 601):
        for text in (rule * n, "a " + rule * n + " b"):
            assert enc.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_words_around_the_longest_tokens(reference):
    enc, rng = bpe.encoder(), random.Random(8)
    long = [t.decode() for t in enc.ranks if len(t) > 20]
    for t in long:
        for text in (t + t, t + t[: len(t) // 2], t[1:] + t, "x" + t + "y", t + rng.choice(long), rng.choice(long) + t[:-1]):
            assert enc.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_runs_of_every_long_token(reference):
    enc, rng = bpe.encoder(), random.Random(9)
    long = [t for t in enc.ranks if len(t) > 24]
    assert len(long) > 20
    for sign in {t.decode()[-1] for t in long}:
        for n in range(1, 301):
            assert enc.encode(sign * n).tolist() == reference.encode_ordinary(sign * n)
    for t in (t.decode() for t in long):
        for text in (t + t, "a" + t + "b", t + t[:-1] + "x"):
            assert enc.encode(text).tolist() == reference.encode_ordinary(text)
    for _ in range(300):
        text = "".join(rng.choice(["-", "=", "_", "*", "a", " ", "\u00a0"]) * rng.randint(1, 70) for _ in range(6))
        assert enc.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_search_ends_when_ranks_do_not_fit():
    enc = bpe.BytePairEncoder({bytes([i]): i for i in range(256)} | {b"aba": 300}, public_tokenizers.PATTERN)
    assert enc.encode("aab").tolist() == [97, 97, 98] and enc.encode("ababab").tolist() == list(b"ababab")


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 50_000)
    enc = bpe.BytePairEncoder(bpe.encoder().ranks, public_tokenizers.PATTERN)
    for i in range(3000):
        enc.encode(f"q{i}w{i * 7919}z")
    assert len(enc.known) * bpe.TOKEN_BYTES < 60_000 and len(enc.checked) * bpe.PAIR_BYTES < 60_000


TEXTS = [(1, None), (2, ""), (3, "The end's near."), (3, "The end's near."), (4, "日本語 <|endoftext|> é"), (None, "x"), (5, "many words " * 3000)]


def test_bpe_rows(spark, reference):
    df = spark.createDataFrame(TEXTS, SCHEMA).withColumns({"_text": F.lit(1), "n_tokens": F.lit(2)})
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, ["doc_id"]).collect()), key=str)
    want = []
    for i, t in TEXTS:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = bpe.encode_texts(df, ["doc_id"]).where("doc_id = 4").first()
    assert whole.ids == reference.encode_ordinary(TEXTS[4][1]) and whole.decoded.decode() == TEXTS[4][1]
    assert bpe.encode_digests(df.limit(0), ["doc_id"]).count() == 0


def test_token_files_by_any_block_size(spark, tmp_path):
    rng = random.Random(1)
    lengths = [0, 0, 5, 1, 900, 0, 3, 7000, 0]
    flat = []
    for n in lengths:
        flat += [rng.randrange(50_000) for _ in range(n)] + [token_counts.END_OF_DOCUMENT]
    (tmp_path / "a.bin").write_bytes(np.array(flat, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([1, 2, token_counts.END_OF_DOCUMENT, 4, 5, 6], "<u2").tobytes() + b"\x00")
    (tmp_path / "c.bin").write_bytes(b"")
    for block in (2, 4, 64, 1 << 20):
        got = token_counts.count_tokens(spark, str(tmp_path), block).collect()
        by = {name: [r.n_tokens for r in sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.ordinal)] for name in ("a.bin", "b.bin", "c.bin")}
        assert by == {"a.bin": lengths, "b.bin": [2, 3], "c.bin": []}


def test_token_files_of_four_bytes_over_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "TASK_BYTES", 1 << 12)
    rng, end = random.Random(2), 70_000
    lengths = [rng.choice([0, 3, 40, 900]) for _ in range(200)]
    flat = np.concatenate([np.append(np.array([rng.choice([0, 1, 4464, 65_536, 69_999]) for _ in range(n)]), end) for n in lengths])
    (tmp_path / "a b.bin").write_bytes(flat.astype("<u4").tobytes())
    whole = tmp_path / "a b.bin"
    assert token_counts.scan_blocks(spark, str(tmp_path), end, 64).select("block").distinct().count() == -(-whole.stat().st_size // 64)
    assert token_counts.scan_blocks(spark, str(tmp_path), end, 64).rdd.getNumPartitions() > 20
    got = token_counts.count_tokens(spark, str(tmp_path), 64, end).orderBy("ordinal").collect()
    assert [r.n_tokens for r in got] == lengths
    monkeypatch.setattr(token_counts, "_opens", lambda path: False)  # a store that only Spark reads
    assert [r.n_tokens for r in token_counts.count_tokens(spark, str(tmp_path), 64, end).orderBy("ordinal").collect()] == lengths


def test_token_files_in_many_records(spark, reference, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "RECORD_BYTES", 64)
    monkeypatch.setattr(token_counts, "RECORDS_PER_FILE", 2)
    texts = [(i, "word " * (i % 40)) for i in range(3000)]
    spark.createDataFrame(texts, SCHEMA).repartition(2).write.parquet(str(tmp_path / "d"))
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == [(i, len(reference.encode_ordinary(t))) for i, t in texts]


def test_token_counts_rows(spark, reference, tmp_path):
    df = spark.createDataFrame(TEXTS, SCHEMA).withColumns({"part": F.lit(1), "at": F.lit(2), "path": F.lit("p")}).repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.document_token_counts(back).collect()), key=str)
    assert got == sorted([(i, len(reference.encode_ordinary(t or ""))) for i, t in TEXTS], key=str)
    back.limit(0).write.parquet(str(tmp_path / "e"))
    assert token_counts.document_token_counts(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_token_counts_stand_when_cores_change(spark, reference, tmp_path):
    texts = [(i, "word " * (i % 17)) for i in range(400)]
    spark.createDataFrame(texts, SCHEMA).repartition(8).write.parquet(str(tmp_path / "d"))
    counts = token_counts.document_token_counts(spark.read.parquet(str(tmp_path / "d")))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # what more or fewer executors do to a scan's splits
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = sorted((r.doc_id, r.n_tokens) for r in counts.collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == [(i, len(reference.encode_ordinary(t))) for i, t in texts]


def brute_license(text):
    words = license_scan.words_of(text or "")
    found, places = set(), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        found |= {label} if at else set()
    base, best = sorted(found), 1.0 if found else 0.0
    for label, notices in license_scan.TEMPLATES.items():
        for n in notices:
            want, size = set(license_scan.words_of(n)), license_scan.span(n)
            share = max((len(want & set(words[i : i + size])) for i in range(len(words))), default=0) / len(want)
            if share >= license_scan.THRESHOLD - 1e-9:
                found.add(label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(found)), round(best, 9)


def test_license_notices_are_found_however_wrapped(spark):
    texts, want = [], []
    for label, notices in license_scan.TEMPLATES.items():
        for n in notices:
            words = n.split()
            for at in range(1, len(words)):
                texts.append("# Head\n#\n# " + " ".join(words[:at]) + "\n#   " + " ".join(words[at:]) + "\n\ncode")
                want.append(label)
            texts += ["\n".join(words), "\n * ".join(["/*", *words])]
            want += [label, label]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(spark.createDataFrame([*enumerate(texts)], SCHEMA)).collect()}
    assert all(label in got[i] for i, label in enumerate(want))


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(2)
    notices = [n for ns in license_scan.TEMPLATES.values() for n in ns]
    texts = [None, "", "cc by cc BY cc-by", "cccby cc  by", "All Rights\nReserved.", "CCé BY", "general public, license"]
    for n in notices:
        w = n.split()
        for _ in range(6):
            k = [x for x in w if rng.random() > rng.choice([0, 0.1, 0.3])] + [rng.choice(["foo", "the", "license", "2.0"]) for _ in range(rng.randint(0, 5))]
            rng.shuffle(k)
            texts.append("Some text.\n" + " ".join(k) + "\nmore " * rng.randint(0, 2))
    texts.append("word " * 4_000 + notices[0])
    texts += ["\u212aind of \u0130tem CC BY", "word " * 30 + " ".join(rng.sample(notices[0].split() * 40, 200))]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[2])], SCHEMA).withColumns({"row": F.lit(1), "tokens": F.lit("t"), "label": F.lit("l")})
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license_scan.scan(df).fillna(-1).collect())
    want = sorted(tuple(-1 if x is None else x for x in (i, *brute_license(t))) for i, t in [*enumerate(texts), (0, texts[2])])
    assert got == want
    assert license_scan.scan(df.limit(0)).count() == 0


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else -decontaminate.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - decontaminate.GAP, h[i][j - 1] - decontaminate.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_textbook():
    rng = random.Random(4)
    pairs = [([rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(1, 15))]) for _ in range(60)]
    got = decontaminate.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [slow_align(a, b) for a, b in pairs]


def test_decontamination_finds_copies_edits_and_nothing_else(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    common = [word() for _ in range(30)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [say(rng.randint(20, 40)) for _ in range(12)]
    docs, want = [], set()
    for d in range(300):
        text = say(rng.randint(0, 200))
        if d % 3 == 0:
            k = 0 if d % 2 else rng.randrange(len(items))  # item 0 is in a sixth of all documents
            copy = [word() if d % 4 == 0 and n % 6 == 5 else w for n, w in enumerate(items[k])]
            at = rng.randint(0, len(text))
            text = text[:at] + [w.upper() + rng.choice(["", ",", "."]) for w in copy] + text[at:]
            want.add((d, k))
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, ""), (None, " ".join(items[1]))]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"item_id": F.lit(5), "window": F.lit("w"), "h": F.lit(0)})
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, ""), (52, "two words"), (None, "x y z w")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    words = lambda t: decontaminate.plain(t).decode().split()
    by_doc = dict(docs)
    for r in got.collect()[:20]:
        assert r.score == pytest.approx(slow_align(items[r.item_id], words(by_doc[r.doc_id])) / (2 * len(items[r.item_id])))
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len({d for d, _ in want})
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_decontamination_equals_aligning_everything(spark):
    """All documents with all items by the textbook: what reaches the threshold is found, if edits left it three words in a row."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(n) for n in (3, 8, 12, 20, 45, 150)] + [say(12)]
    items.append(items[1])
    docs = []
    for d in range(240):
        text = say(rng.randint(0, 60))
        w = items[rng.randrange(len(items))]
        a = rng.randrange(len(w))
        part = [rng.choice(vocabulary) if rng.random() < 0.12 else x for x in w[a : a + rng.randint(1, len(w))] if rng.random() > 0.08]
        at = rng.randint(0, len(text))
        docs.append(text[:at] + part + text[at:])
    want = {}
    for d, text in enumerate(docs):
        grams = {tuple(text[i : i + 3]) for i in range(len(text) - 2)}
        for k, item in enumerate(items):
            score = slow_align(item, text) / (2 * len(item))
            if score >= decontaminate.THRESHOLD and any(tuple(item[i : i + 3]) in grams for i in range(len(item) - 2)):
                want[d, k] = score
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], SCHEMA).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(df, bench).collect()}
    assert len(want) > 30 and set(got) == set(want)
    assert all(got[k] == pytest.approx(s) for k, s in want.items())
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == len(docs) - len({d for d, _ in want})


def test_decontamination_windows_follow_each_item(spark):
    """One long item does not widen the windows around the seeds of short ones."""
    short, long = [f"s{i}" for i in range(8)], [f"l{i}" for i in range(5000)]
    filler = [f"x{i}" for i in range(20_000)]
    docs = spark.createDataFrame([(0, " ".join(filler + short + filler)), (1, " ".join(filler + long[:4000] + filler))], SCHEMA)
    bench = spark.createDataFrame([(0, " ".join(short)), (1, " ".join(long))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 0), (1, 1)}
    seeds = decontaminate.item_seeds(bench, 3).select(F.explode("h").alias("h"), F.size("h").alias("n"))
    planes = [(11, decontaminate._bloom.build(seeds.where("n < 100"), 1)), (5001, decontaminate._bloom.build(seeds.where("n > 100"), 8))]
    sizes = {r.doc_id: r.n for r in decontaminate._windows(docs, planes, 3).groupBy("doc_id").agg(F.max(F.size(F.split("words", " "))).alias("n")).collect()}
    assert sizes[0] < 100 and sizes[1] > 4000


@pytest.mark.parametrize(("verbatim", "edited"), [(0, 9), (0, 300), (3, 20), (40, 200)])
def test_decontamination_finds_one_edit_in_many_documents(spark, verbatim, edited):
    item = [f"w{i}" for i in range(20)]
    copy = [f"new{i}" if i % 5 == 4 else w for i, w in enumerate(item)]
    texts = [["before", *item, "after"]] * verbatim + [["before", *copy, "after"]] * edited + [["before", *item[:3], "after"]] * 50
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.score for r in decontaminate.find_leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == set(range(verbatim + edited))
    for d, score in got.items():
        assert score == pytest.approx(slow_align(item, texts[d]) / (2 * len(item)))


def test_decontamination_of_a_common_seed(spark):
    """Documents and items that share three common words and nothing else never meet."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(F.lit("d"), F.col("id") * 31 + i)), " "), F.lit(" one of the "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(F.lit("e"), F.col("id") * 31 + i)), " ")).alias("text"))
    bench = docs.where("doc_id < 150").select(F.col("doc_id").alias("item_id"), F.regexp_replace("text", r"\b([de]\d)", "x$1").alias("text"))
    assert decontaminate.find_leaks(docs, bench).count() == 0
    seen = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    rare = decontaminate.rarest_words(bench.select(F.col("item_id").alias("item"), F.col("text").alias("words")), seen, 0.5)
    assert rare.where("w in ('one', 'of', 'the')").count() == 0 and rare.groupBy("item").count().where("count <> 17").count() == 0
    mixed = docs.withColumn("text", F.when(F.col("doc_id") < 20, F.regexp_replace("text", r"\b([de]\d)", "x$1")).otherwise(F.col("text")))
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(mixed, bench).collect()} == {(i, i, 1.0) for i in range(20)}


@pytest.mark.parametrize("hot", [0, 1, 10**9])
def test_decontamination_is_the_same_for_any_bound_of_hot_seeds(spark, monkeypatch, hot):
    monkeypatch.setattr(decontaminate, "HOT_ITEMS", hot)
    test_decontamination_equals_aligning_everything(spark)


def test_decontamination_of_a_very_long_document(spark):
    """A text with an item's seeds every few words is cut into windows of bounded width, and the copy in it is found."""
    item = [f"w{i}" for i in range(30)]
    text = []
    for i in range(4000):
        text += [*item[i % 28 : i % 28 + 3], f"z{i}", f"y{i}"]
    text[9001:9001] = item
    docs = spark.createDataFrame([(0, " ".join(text)), (1, " ".join(text[:9000]))], SCHEMA)
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[0, 5] == 1.0
    spans = [b - a for _, a, b in decontaminate._pieces(np.arange(0, 100_000, 5), np.full(20_000, 33), 3)]
    assert max(spans) <= (decontaminate.SPAN + 2) * 33 + 3 and len(spans) < 900


def test_alignments_are_bounded():
    """Pairs aligned together take a bounded number of cells, however wide one of them is."""
    seen, plain_align = [], decontaminate.align
    decontaminate.align = lambda a, b: seen.append(len(b) * max(map(len, b))) or plain_align(a, b)
    try:
        item = " ".join(f"w{i}" for i in range(9))
        words = [item] * 300 + [item + " x" * 20_000 + " " + item]
        batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array([1] * 301), pa.array([item] * 301), pa.array(words)], names=["doc_id", "item", "wanted", "words"])
        got = [s for b in decontaminate._scores(3, 0.5)(iter([batch])) for s in b.column(2).to_pylist()]
    finally:
        decontaminate.align = plain_align
    assert got == [1.0] * 301 and max(seen) <= decontaminate.CELLS


def test_quote_parsing():
    own, passages = chat_quotes.parse("> > a\n> > b\n> c\nmine\n>> d\n\nlast")
    assert own == "mine\n\nlast" and passages == [(2, "a\nb"), (1, "c"), (2, "d")]
    assert chat_quotes.parse(None) == ("", [])


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "Hello  there"), (1, 1, "assistant", "> hello there\nHi"), (1, 2, "user", "> > Hello there\n> Hi\nThanks"), (1, 3, "user", "> nobody said this\nWhat?"),
        (2, 0, "user", "> Thanks\nfrom afar"), (2, 1, "user", None), (2, 2, "user", "> from afar\nok"), (2, 2, "user", "> from afar\nok"), (3, 0, "user", "Hi"), (None, 1, "user", "x"), (3, None, "user", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"up": F.lit(1), "depth": F.lit("d"), "quoted": F.lit(2)})
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn, r.thread_conv, r.thread_turn, r.depth, r.levels, r.text) for r in chat_quotes.link_quotes(df, far_words=1).collect()}
    assert got == {
        (1, 0): (None, None, 1, 0, 0, 0, "Hello  there"), (1, 1): (1, 0, 1, 0, 1, 1, "Hi"), (1, 2): (1, 1, 1, 0, 2, 2, "Thanks"), (1, 3): (None, None, 1, 3, 0, 1, "What?"),
        (2, 0): (1, 2, 1, 0, 3, 1, "from afar"), (2, 1): (None, None, 2, 1, 0, 0, ""), (2, 2): (2, 0, 1, 0, 4, 1, "ok"), (3, 0): (None, None, 3, 0, 0, 0, "Hi"),
    }
    assert chat_quotes.link_quotes(df).count() == 9 and chat_quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_belong_to_the_latest_earlier_message(spark):
    """Over the borders of chunks of turns too, and never to a later one."""
    chunk = chat_quotes.CHUNK_TURNS
    said = {0: "Thanks", 3: "Thanks", chunk - 1: "Thanks", chunk + 5: "Thanks", 5 * chunk: "Thanks", -4: "Thanks"}
    asked = [-3, 1, 2, 4, chunk - 1, chunk, chunk + 4, chunk + 6, 3 * chunk, 5 * chunk, 5 * chunk + 1]
    rows = [(1, t, "user", x) for t, x in said.items()] + [(1, t, "assistant", "> thanks\nreply") for t in asked] + [(2, t, "user", "> Thanks\nfrom afar") for t in (0, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in chat_quotes.link_quotes(df, far_words=1).where("text in ('reply', 'from afar')").collect()}
    want = {(1, t): (1, max(x for x in said if x < t)) for t in asked}
    assert got == want | {(2, 0): (1, -4), (2, 9): (1, -4)}


def test_quotes_of_parts_of_messages(spark):
    texts = [
        (1, 0, "First paragraph\ngoes on.\n\nSecond one here.\nAnd a last line."), (1, 1, "> Second one here.\nA reply to a line"), (1, 2, "> first paragraph\n> goes on.\nA reply to a paragraph"),
        (1, 3, "> A reply to a line\nyes\nindeed\n> nobody wrote this\nno"), (1, 4, "> > A reply to a line\n> yes\n> indeed\n> > nobody wrote this\n> no\nall of it"),
        (1, 5, "> > A reply to a line\n> yes\n> indeed\nonly the first"), (1, 6, "> > only the first\n> lost message\nby the grandparent"), (1, 7, "> goes on.\n>\n> Second one here.\nover a border"),
        (1, 8, "> > only the first\n> \nan empty parent"), (2, 0, "> And a last line.\nfrom afar"), (2, 1, "yes"), (2, 2, "> yes\nok"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in texts], "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn) for r in chat_quotes.link_quotes(df, far_words=1).collect()}
    none = (None, None)
    assert got == {
        (1, 0): none, (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 1), (1, 4): (1, 3), (1, 5): (1, 3), (1, 6): (1, 5), (1, 7): (1, 0), (1, 8): none, (2, 0): (1, 0), (2, 1): none, (2, 2): (2, 1),
    }


def test_short_or_common_quotes_stay_in_their_conversation(spark):
    long, other = "this is a passage of ten words that one said", "and this is another passage of words that two said"
    rows = [
        (1, 0, "ok"), (1, 1, long), (1, 2, other), (2, 0, other), (3, 0, "> ok\nshort"), (3, 1, f"> {long}\nunique"), (3, 2, f"> {other}\ncommon"), (3, 3, "ok"), (3, 4, "> ok\nat home"),
        (0, 0, f"> {long}\nbefore it was said"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn int, role string, text string")
    got = {r.text: (r.parent_conv, r.parent_turn) for r in chat_quotes.link_quotes(df).where("n_quotes > 0").collect()}
    assert got == {"short": (None, None), "unique": (1, 1), "common": (None, None), "at home": (3, 3), "before it was said": (None, None)}


def test_quotes_of_a_long_thread_come_back(spark):
    rows = [(1, t, "user", f"message number {t}") for t in range(70)]
    df = chat_quotes.with_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.turn, r.depth, r.parent_turn, r.text) for r in chat_quotes.link_quotes(df).fillna(-1).collect())
    assert got == [(t, t, t - 1, f"message number {t}") for t in range(70)]
    assert re.match("> > message number 0\n> message number 1\n", df.where("turn = 2").first().text)
