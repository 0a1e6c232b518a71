"""The shared parts: components, Bloom filter, samples, signatures and text keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelftrail.llm import _bloom, _common, _shingles, minhash_dedup
from shelftrail.llm._components import connected_components


@pytest.mark.parametrize(("nodes", "links"), [(60, 45), (200, 150), (40, 39)])
def test_components_equal_union_find(spark, nodes, links):
    rng = random.Random(nodes)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)]
    if links == nodes - 1:
        edges = [(i, i + 1) for i in range(links)]  # a path: the most rounds
    up = list(range(nodes))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_bloom_never_misses(spark):
    rng = np.random.default_rng(2)
    once, twice = rng.integers(-(2**63), 2**63 - 1, 3000), rng.integers(-(2**63), 2**63 - 1, 500)
    rows = [(int(h),) for h in [*once, *twice, *twice, *[twice[0]] * 300]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "h long").repartition(5)
    plane = _bloom.build(df, _bloom.segments_for(len(rows)), repeated=True)
    assert _bloom.contains(plane, twice).all() and _bloom.contains(plane, once).mean() < 0.01
    assert _bloom.contains(_bloom.build(df, 1), once).all()
    assert _bloom.segments_for(10**12) * _bloom.SEGMENT_BITS == _bloom.MAX_BITS
    assert not _bloom.build(df.limit(0), 1).any()


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("x", F.col("k") % 7)
    a = [r.k for r in _common.hash_sample(df, "k", 300).collect()]
    assert len(a) <= 300 and len(a) > 250 and len(set(a)) == len(a)
    assert sorted(a) == sorted(r.k for r in _common.hash_sample(df.repartition(3), "k", 300).collect())
    assert _common.hash_sample(df.limit(20), "k", 300).count() == 20


def test_signature_is_circulant_and_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40, dtype=np.uint64)])
    k = 200
    second = np.random.default_rng(7).permutation(minhash_dedup.CIRCLE)
    places = ((a * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - minhash_dedup.CIRCLE_BITS)).astype(np.int64)
    want = [second[(places - (k - 1 - j)) % minhash_dedup.CIRCLE].min() for j in range(k)]
    assert minhash_dedup.signature(a, k).tolist() == want
    same = (minhash_dedup.signature(a, k) == minhash_dedup.signature(b, k)).mean()
    assert same == pytest.approx(360 / 440, abs=0.1)


def test_shingles_follow_their_words():
    texts = ["One two  three", "one\tTWO three", "two one three", "", None, "single", "é É", "x " * 5000]
    a, b, c, empty, null, single, accents, many = _shingles.shingle_sets(texts, 2)
    assert (a == b).all() and len(a) == 2 and len(np.intersect1d(a, c)) == 0
    assert len(empty) == len(null) == 0 and len(single) == 1 and len(accents) == 1 and len(many) == 1
    assert [len(s) for s in _shingles.shingle_sequences(["a b c d e f", "a b"], 5)] == [2, 1]


def test_key_folds_ascii_only(spark):
    words = ["ABC", "abc", "É", "é", "ß", "ẞ", "K", "k", "K", "İ", "日本", "Ãé", "ãé"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64(_common.ascii_lower_key(F.col("w"))).alias("k")).collect()
    low = lambda s: s.translate({i: i + 32 for i in range(65, 91)})
    for x in rows:
        for y in rows:
            assert (x.k == y.k) == (low(x.w) == low(y.w))
