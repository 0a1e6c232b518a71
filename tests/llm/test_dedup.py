"""Exact, near and line dedup against brute force, on rows with every kind of trouble."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shelftrail.llm import _bloom, exact_dedup, line_dedup, minhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def messy_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É", "é", "日本", "the", "of"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    out = [None, "", "  \n\t", "one", "One", "one two", "ONE two", "long line of words here\nshort\nlong line of words here", "x" * 200_000]
    for t in base:
        out += [t, t, t.upper(), "  " + t.replace(" ", "\n")]
        w = t.split()
        for _ in range(3):
            k = w[:]
            for _ in range(max(1, len(k) // 25)):
                k[rng.randrange(len(k))] = rng.choice(words)
            out.append(" ".join(k))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def messy(spark):
    rows = rows_of(messy_texts())
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_exact_matches_brute_force(messy):
    rows, df = messy
    norm = {i: (t or "").translate({ord(c): None for c in SPACE}) for i, t, *_ in rows}
    size = {i: len(t or "") for i, t, *_ in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    want = {}
    for t, ids in groups.items():
        keep = min(ids, key=lambda i: (-size[i], i))
        for i in ids:
            want[i] = (keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest())
    for bits in (_bloom.MAX_BITS, _bloom.SEGMENT_BITS):  # also with a filter far too small
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.find_copies(df, bits).collect()}
        assert got == want


def test_exact_keeps_one_of_repeated_rows_and_all_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "a b", "y"), (2, "ab ", "z"), (3, None, None), (4, "", "q")], "doc_id long, text string, sha string")
    df = df.withColumns({"h": F.lit(1), "maybe": F.lit(True), "row": F.lit("r")})
    got = exact_dedup.find_copies(df)
    assert got.count() == 6 and got.where("kept").count() == 2 and {r.group_size for r in got.collect()} == {4, 2}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == 2
    assert {r.doc_id for r in kept.collect()} == {1, 3}
    assert exact_dedup.find_copies(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_matches_brute_force(messy, k):
    rows, df = messy
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(df, shingle_words=k).collect()}
    assert got == brute_components(rows, k)


def test_near_open_buckets_are_settled_exactly(spark):
    """A chain of edits: neighbours link, ends do not, and most share buckets with many others."""
    rng = random.Random(5)
    w = [f"v{i}" for i in range(120)]
    texts = [" ".join(w)]
    for _ in range(120):
        w = w[:]
        for _ in range(rng.choice([1, 2, 6])):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = rows_of(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(spark.createDataFrame(rows, SCHEMA), shingle_words=2).collect()}
    assert got == brute_components(rows, 2)


def forms(n, seed=11, words=170, fields=30):
    """Filled-in forms on one template: alike at 0.7, so near many bands and above no threshold; every tenth has a copy with one more word."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(words)]
    at = set(rng.sample(range(words), fields))
    texts = []
    for i in range(n):
        w = [f"f{i}x{k}" if k in at else x for k, x in enumerate(template)]
        texts.append(" ".join(w + ["more"] if i % 10 == 1 else w))
        if i % 10 == 1:
            texts.append(" ".join(w))
    return texts


def test_near_forms_on_one_template(spark):
    rows = rows_of(forms(300))
    a, b = shingles(rows[0][1], 1), shingles(rows[5][1], 1)
    assert 0.65 < len(a & b) / len(a | b) < 0.75
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_components(spark.createDataFrame(rows, SCHEMA), shingle_words=1).collect()}
    assert got == brute_components(rows, 1)


def test_near_prefix_join_of_forms_makes_no_pairs(spark):
    """What the exact join writes for a family below the threshold does not grow with pairs of its members."""
    from shelftrail.llm._common import Scratch

    rows = rows_of([t for t in forms(2000) if not t.endswith("more")])
    df, scratch = spark.createDataFrame(rows, SCHEMA), Scratch(spark)
    sets = minhash_dedup._sets(df, 1).cache()
    members = df.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("comp"), F.lit(170).cast("long").alias("n"))
    assert minhash_dedup._prefix_pairs(members, sets, 80, scratch).count() == 0
    scratch.clear()


def test_near_leaves_no_tables_behind(spark, messy, tmp_path, monkeypatch):
    from shelftrail.llm import _common

    _, df = messy
    monkeypatch.setattr(_common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert minhash_dedup.near_components(df, shingle_words=2).count() > 0
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["near_classes"]


def test_near_defined_cases(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (1, "a b c", 2), (2, "A b c", 3), (2, "A b c", 3), (3, None, 4), (4, "", 5)], "doc_id long, text string, n long").withColumns({"rep": F.lit(0), "keys": F.lit("k")})
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_components(df, shingle_words=2).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True)], key=str)
    dotted = minhash_dedup.drop_near_copies(df.withColumn("a.b", F.lit(1)), 2)
    assert dotted.columns == [*df.columns, "a.b"] and dotted.count() == 4
    kept = minhash_dedup.drop_near_copies(df, 2)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]
    assert minhash_dedup.near_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_lines_match_brute_force(messy, least):
    rows, df = messy
    lines = {i: (t or "").split("\n") for i, t, *_ in rows}
    key = lambda x: x.strip(SPACE).translate({i: i + 32 for i in range(65, 91)})
    first, holders = {}, {}
    for i in sorted(lines):
        for x in lines[i]:
            if len(key(x)) >= 10:
                first.setdefault(key(x), i)
                holders.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(holders.get(key(x), ())) >= least and first[key(x)] != i
    want = {i: (len(ls), sum(gone(i, x) for x in ls), "\n".join(x for x in ls if not gone(i, x))) for i, ls in lines.items()}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df, least_docs=least).collect()} == want


def test_lines_of_very_long_documents(spark):
    """Every second of 200,000 lines is dropped, in time that grows with their number."""
    lines = [f"a line that stands in both {i}" if i % 2 else f"a line of its own {i}" for i in range(200_000)]
    other = [x for x in lines if "both" in x]
    df = spark.createDataFrame([(1, "\n".join(other)), (2, "\n".join(lines)), (3, "once more the same\n" * 200_000), (4, "once more the same")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.monotonic() - began < 60
    assert got[2].n_dropped == 100_000 and got[2].text == "\n".join(x for x in lines if "own" in x)
    assert got[1].n_dropped == 0 and got[3].n_dropped == 0 and got[4].n_dropped == 1 and got[4].text == ""


def test_hash_pairs_are_independent(spark):
    """Two keys whose first hashes are equal could be told apart by the second: it does not follow from the first."""
    from shelftrail.llm._common import hash_pair

    a, b = hash_pair(F.col("k"))
    r = spark.createDataFrame([("some key",)], "k string").select(a.alias("a"), b.alias("b"), F.xxhash64("k", F.lit(1)).alias("chained")).first()
    assert len({r.a, r.b, r.chained}) == 3


def test_lines_defined_cases(spark):
    line = "  A line that is long enough "
    df = spark.createDataFrame([(5, line), (5, line), (7, line.lower() + "\n\nend"), (None, line), (8, None), (9, "ÉCLAIR AU CHOCOLAT"), (10, "éclair au chocolat")], "doc_id long, text string")
    df = df.withColumns({"lines": F.lit(1), "drops": F.lit("x"), "a": F.lit(0)})
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    want = [(5, 1, 0, line), (5, 1, 0, line), (7, 3, 1, "\nend"), (None, 1, 0, line), (8, 1, 0, ""), (9, 1, 0, "ÉCLAIR AU CHOCOLAT"), (10, 1, 0, "éclair au chocolat")]
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
