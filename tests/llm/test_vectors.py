"""Whitening, nearest neighbours and hard negatives against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelftrail.llm import _codes, hard_negatives, nearest, whitening
from shelftrail.llm._common import Scratch
from shelftrail.llm._vectors import of_dimension

BAD = [None, [], [None, 1.0, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]


def frame(spark, rows, schema="vec_id long, label int, embedding array<double>", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clustered(rng, n, d, centres=6, noise=0.6):
    """Rows around a few centres, some of them repeated."""
    at = rng.standard_normal((centres, d))[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, d))
    at[n // 2 : n // 2 + 5] = at[0]
    return at.astype(np.float32)


# --- codes -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("d", [1, 3, 64, 100])
def test_popcounts_estimate_inner_products(d):
    rng = np.random.default_rng(d)
    turn = _codes.rotation(d)
    assert np.abs(turn @ turn.T - np.eye(d)).max() < 1e-12 and (turn == _codes.rotation(d)).all()
    rows, asked = rng.standard_normal((50, d)), rng.standard_normal((9, d)) * 3
    codes, length, align = _codes.encode(rows, turn)
    q = _codes.queries(asked, turn)
    signs = np.where(rows @ turn.T > 0, 1, -1) / math.sqrt(d)
    exact = (asked @ turn.T) @ signs.T
    assert (np.abs(_codes.dots(codes, q) - exact) <= q.error[:, None] + 1e-9).all()
    assert np.allclose(align * length, (signs * (rows @ turn.T)).sum(axis=1))


def test_code_of_a_zero_row():
    codes, length, align = _codes.encode(np.zeros((1, 5)), _codes.rotation(5))
    assert codes.shape == (1, 1) and length[0] == 0 and align[0] == 1


# --- op12 ------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, every, k):
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        x = min(v for i, v in rows if i == q)
        found = sorted((math.dist(x, v), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize(("n", "d", "k"), [(400, 64, 10), (120, 7, 5), (6, 3, 10)])
def test_nearest_equals_brute_force(spark, n, d, k):
    x = clustered(np.random.default_rng(n), n, d)
    rows = [(i, v) for i, v in enumerate(x.astype(float).tolist()) if any(v)]
    df = frame(spark, [(i, 0, v) for i, v in rows])
    got = [tuple(r) for r in nearest.nearest_neighbours(df, every=20, k=k).orderBy("query_id", "rank").collect()]
    want = brute_nearest(rows, 20, k)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_nearest_in_groups_of_queries(spark):
    x = clustered(np.random.default_rng(5), 300, 16)
    df = frame(spark, [(i, 0, v) for i, v in enumerate(x.astype(float).tolist())])
    scratch, rows = Scratch(spark), nearest.usable(df)
    index = nearest.build_index(rows, scratch)
    whole = {tuple(r) for r in nearest.search(index, rows, scratch, k=3).collect()}
    parts = {tuple(r) for r in nearest.search(index, rows, scratch, k=3, group=70).collect()}
    assert whole == parts and len(whole) == 900


def test_nearest_recall_with_narrow_bounds(spark):
    """With bounds of one deviation instead of four some neighbours go, but not many."""
    x = clustered(np.random.default_rng(9), 1500, 32, noise=1.0)
    rows = list(enumerate(x.astype(float).tolist()))
    df = frame(spark, [(i, 0, v) for i, v in rows])
    want = {w[:1] + w[2:3] for w in brute_nearest(rows, 50, 10)}
    got = {(r.query_id, r.vec_id) for r in nearest.nearest_neighbours(df, every=50, sigmas=1.0).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_nearest_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0, 0.0, 0.0]), (100, 1, [1.0, 0.0, 0.0, 0.0]), (100, 1, [0.0, 9.0, 0.0, 0.0]), (7, None, [1.0, 1.0, 0.0, 0.0]), (7, 2, [1.0, 1.0, 0.0, 0.0])]
    rows += [(1000 + i, 0, v) for i, v in enumerate(BAD)] + [(200, 0, [0.0] * 4), (None, 0, [1.0, 0.0, 0.0, 0.0])]
    df = frame(spark, rows).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("a.b", F.lit(0))
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest_neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100), (0, 2, 7), (0, 3, 7), (0, 4, 100), (100, 1, 7), (100, 2, 7), (100, 3, 0)]
    assert nearest.nearest_neighbours(df.limit(0)).count() == 0
    assert nearest.nearest_neighbours(df.where("vec_id = 7")).count() == 0
    assert nearest.nearest_neighbours(df.where("vec_id = 0")).count() == 0


# --- op13 ------------------------------------------------------------------------------------------------------------


def brute_mine(rows, every):
    out = []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    whole = [(i, label, [math.floor(256 * c) for c in v]) for i, label, v in rows]
    for q in sorted({i for i, *_ in whole if i % every == 0}):
        x, label = min((v, label) for i, label, v in whole if i == q)
        scored = sorted((-dot(x, v), i, other) for i, other, v in whole if i != q)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            inside = [(-t[0], t[1]) for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(q, p, r + 1, i, -s, score) for r, (score, i) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("n", "d", "scale"), [(400, 64, 0.2), (150, 5, 1.0), (90, 3, 1e6)])
def test_negatives_equal_brute_force(spark, n, d, scale):
    rng = np.random.default_rng(n)
    x = clustered(rng, n, d) * np.float32(scale)
    rows = [(i, int(label), v) for i, (label, v) in enumerate(zip(rng.integers(0, 4, n), x.astype(float).tolist(), strict=True))]
    got = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), anchor_every=15).collect())
    assert got == brute_mine(rows, 15)
    grouped = sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows), anchor_every=15, group=4).collect())
    assert grouped == got


def test_interval_always_holds():
    rng = np.random.default_rng(1)
    for d in (2, 9, 64):
        rows, asked = np.floor(256 * rng.standard_normal((200, d))), np.floor(256 * rng.standard_normal((20, d)))
        asked[0], rows[0] = rows[1], 0
        turn = _codes.rotation(d)
        coded = hard_negatives.Rows.__new__(hard_negatives.Rows)
        coded.codes, coded.length, coded.align = _codes.encode(rows, turn)
        low, high = hard_negatives.interval(coded, np.arange(200), _codes.queries(asked, turn))
        assert (low <= asked @ rows.T).all() and (asked @ rows.T <= high).all()
        assert (high - low <= 2.0001 * np.outer(np.linalg.norm(asked, axis=1), coded.length) + 1e-6).all()


def test_negatives_odd_rows(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    rows = [(0, 1, e), (1, 1, e), (2, 1, e), (2, 1, e), (3, 2, [0.5, 1.0, 0.0, 0.0]), (4, 2, [0.5, 1.0, 0.0, 0.0]), (5, None, [0.5, 0.0, 0.0, 0.0]), (6, 2, [-1.0, 0.0, 0.0, 0.0])]
    rows += [(100, 3, e), (200, 4, [0.0] * 4), (300, 4, [0.0] * 4), (400, 9, [1e30] * 4), (None, 1, e)] + [(1000 + i, 1, v) for i, v in enumerate(BAD)]
    df = frame(spark, rows).withColumn("score", F.lit("x")).withColumn("anchor_id", F.lit(1)).withColumn("a.b", F.lit(0))
    taken = [r for r in rows if r[0] is not None and r[1] is not None and r[2] not in BAD and not any(c is not None and c > 1e9 for c in r[2])]
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == brute_mine(taken, 100)
    assert {g[:2] for g in got} >= {(0, 1), (0, 2), (200, 300)} and not [g for g in got if g[0] == 100]
    assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.where("vec_id = 1")).count() == 0


# --- op11 ------------------------------------------------------------------------------------------------------------


def check_whitening(got, rows, components=16):
    """`got` against integers and an SVD of the centred fit list; rows: (vec_id, vector)."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fitted = sorted({tuple(v) for v in x.values()})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fitted])
    _, singular, right = np.linalg.svd(centred, full_matrices=True)
    e = np.zeros(len(sums))
    e[: len(singular)] = np.where(singular > 1e-11 * max(singular[0], 1e-300), singular, 0) ** 2 / n
    k = min(components, len(sums))
    assert len(got) == k * len(x)
    by = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for i, v in x.items():
        for c in range(1, k + 1):
            r = by[i, c]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert r.identity_error < 1e-6
            assert r.explained == pytest.approx(e[c - 1] / e.sum() if e.sum() else 0.0, rel=1e-6, abs=1e-18)
            if e[c - 1] == 0:
                assert r.whitened is None
                continue
            want = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)]) @ right[c - 1]) / math.sqrt(e[c - 1])
            sign = signs.setdefault(c, 1 if abs(want) < 1e-3 or r.whitened * want > 0 else -1) if abs(want) >= 1e-3 else signs.get(c, 1)
            assert abs(r.whitened) == pytest.approx(abs(want), abs=2e-5) if abs(want) < 1e-3 else r.whitened == pytest.approx(sign * want, rel=1e-5, abs=1e-5)
    return by


@pytest.mark.parametrize(("n", "d"), [(300, 24), (40, 5)])
def test_whitening_equals_svd(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, d)) * np.linspace(1, 6, d)
    x[n // 2 : n // 2 + 7] = x[0]
    rows = list(enumerate(x.tolist()))
    got = whitening.whiten(frame(spark, [(i, 0, v) for i, v in rows])).collect()
    by = check_whitening(got, rows)
    assert by[0, 1].whitened == by[n // 2, 1].whitened and by[0, 1].n == n - 7


def test_whitening_of_ill_conditioned_rows(spark):
    """Two directions differ by ten powers of ten in length, so the Gram matrix alone would lose one."""
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 200))
    rows = list(enumerate(np.column_stack([a * 1e8, a * 1e8 + b / 8, b * 3 - a]).tolist()))
    whole = np.array([[math.floor(64 * c) for c in v] for _, v in rows], float)
    got = whitening.whiten(frame(spark, [(i, 0, v) for i, v in rows])).collect()
    singular = np.linalg.svd(whole - whole.mean(axis=0), compute_uv=False)
    assert singular[0] / singular[-1] > 1e9
    assert {r.component for r in got if r.whitened is not None} == {1, 2, 3}
    for r in got:
        assert r.identity_error < 1e-4 and r.explained == pytest.approx(singular[r.component - 1] ** 2 / (singular**2).sum(), rel=1e-4)


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]] * 3, [[float(i), 5.0, 2.0 * i] for i in range(9)], [[float(i), float(i * i), -1.0] for i in range(2)]])
def test_whitening_where_directions_are_empty(spark, rows):
    rows = list(enumerate(rows))
    check_whitening(whitening.whiten(frame(spark, [(i, 0, v) for i, v in rows])).collect(), rows)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, 0, v) for i, v in enumerate(rng.standard_normal((30, 4)).tolist())]
    bad = [(1000 + i, 0, v) for i, v in enumerate(BAD)] + [(2000, 0, [1e30, 0.0, 0.0, 0.0])]
    df = frame(spark, good + bad).withColumn("n", F.lit("x")).withColumn("x", F.lit(1)).withColumn("a.b", F.lit(0))
    check_whitening(whitening.whiten(df).collect(), [(i, v) for i, _, v in good])
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 1000 and vec_id < 1005")).count() == 0
    anonymous = whitening.whiten(frame(spark, [(None, 0, [1.0, 2.0]), (1, 0, [3.0, 1.0])])).collect()
    assert sorted(str(r.vec_id) for r in anonymous) == ["1", "1", "None", "None"]


def test_whitening_passes_and_lists(spark):
    """The first factor is shifted, and the passes end when the rows are orthonormal."""
    x = np.random.default_rng(3).standard_normal((500, 8))
    x[1] = x[0]
    rows, d = of_dimension(whitening.usable(frame(spark, [(i, 0, v) for i, v in enumerate(x.tolist())])))
    model, listed = whitening.fit(rows, d, Scratch(spark))
    assert listed.count() == model.n == 499 and model.passes == 2
    assert whitening.deviations(np.array([[2**45, -(2**45)]]), 10**6, np.zeros(2, np.int64), np.zeros(2, np.int64)) == [None]
    assert whitening.deviations(np.array([[2**20, 1]]), 2 * 10**3, np.zeros(2, np.int64), np.array([1, 0])) == [(2**20 * 2000 - 1) ** 2 + 2000**2]
