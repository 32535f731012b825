import numpy as np
import pytest

from conftest import rows
from tidemark.llm import neighbours as N


def clustered(n, dims, seed=0, hot=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dims))
    of = np.where(rng.random(n) < hot, 0, rng.integers(0, len(centres), n))
    return (centres[of] + 0.35 * rng.normal(size=(n, dims))).astype(np.float32)


def table(spark, x):
    return spark.createDataFrame([(f"{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, vector array<float>")


def brute(x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :k]
    return {(f"{i:05d}", f"{j:05d}") for i, r in enumerate(order) for j in r}


@pytest.mark.parametrize("block", [4096, 40])
def test_recall(spark, block):
    x = clustered(700, 32)
    got = set(rows(N.nearest(N.usable(table(spark, x), "id", "vector", 32), 32, 5, block=block), "id", "other"))
    want = brute(x, 5)
    assert len(got & want) / len(want) >= 0.9


def test_grid_loses_nothing(spark):
    """Cutting crowded buckets into cells gives the same pairs as not cutting them."""
    v = N.usable(table(spark, clustered(400, 16, 1, 0.6)), "id", "vector", 16)
    cols = ("id", "other", "similarity", "place")
    assert rows(N.nearest(v, 16, 5, block=25), *cols) == rows(N.nearest(v, 16, 5, block=100_000), *cols)


def test_exact(spark):
    x = clustered(300, 16, 2)
    v = N.usable(table(spark, x), "id", "vector", 16)
    got = rows(N.exact_nearest(v.where("id < '00020'"), v, 16, 5, block=64), "id", "other")
    assert set(got) == {p for p in brute(x, 5) if p[0] < "00020"}


@pytest.mark.parametrize("scaled", [False, True])
def test_ties_go_to_smaller_ids(spark, scaled):
    """More equal cosines than are kept in single precision: copies, and vectors that differ by a factor only."""
    x = clustered(300, 16, 3, 0.0)
    at = np.random.default_rng(4).permutation(300)
    x[at[:120]] = x[at[0]]
    x[at[120:140]] = x[at[120]]
    if scaled:
        x[at[:140]] *= np.random.default_rng(5).uniform(0.5, 2, (140, 1)).astype(np.float32).round(1)
    v = N.usable(table(spark, x), "id", "vector", 16).orderBy("id", ascending=False)
    want = brute(x, 5)
    tied = {f"{i:05d}" for i in at[:140]}
    for got in (N.nearest(v, 16, 5), N.nearest(v, 16, 5, block=40)):
        got = rows(got, "id", "other", "similarity", "place")
        assert {r[:2] for r in got if r[0] in tied} == {p for p in want if p[0] in tied}
        assert all([r[3] for r in got if r[0] == i] and sorted(r[3] for r in got if r[0] == i) == list(range(1, 6)) for i in tied)
        assert len({r[:2] for r in got} & want) / len(want) >= 0.9
    assert set(rows(N.exact_nearest(v, v, 16, 5, block=64), "id", "other")) == want


@pytest.mark.parametrize("noise", [0.0, 1e-7])
def test_equal_single_precision_cosines(noise):
    """Cosines that single precision can't tell apart are ranked in double precision, then by id, whatever their number."""
    rng = np.random.default_rng(6)
    x = N._unit(np.ones((400, 8)) + noise * rng.normal(size=(400, 8)))
    ids = rng.permutation(400)
    every = np.arange(400)
    q, o, _ = N._compare(x, ids, every[:50], every[50:], 5)[0]
    exact = np.round(np.einsum("ik,jk->ij", x[:50], x[50:]), 12)
    order = np.lexsort((np.broadcast_to(ids[50:], exact.shape), -exact), axis=1)[:, :5]
    assert {(i, 50 + j) for i, r in enumerate(order.tolist()) for j in r} <= set(zip(q.tolist(), o.tolist(), strict=True))


def test_dirty_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 0.0]), ("b", 1, [1.0, 0.1]), ("c", 1, [nan, 1.0]), ("d", 1, None), ("e", 1, [1.0]), (None, 1, [1.0, 1.0]), ("f", 1, [2.0, 0.2]), ("g", 1, [None, 1.0]), ("b", 0, [0.0, 1.0]), ("h", 1, [2.0, 0.2])], "id string, n bigint, vector array<float>")
    v = N.usable(df, "id", "vector", 2, "n")
    assert rows(v, "id") == [("b",), ("f",), ("h",)]
    got = rows(N.nearest(v, 2, 1), "id", "other", "similarity")
    assert got == [("b", "f", 1.0), ("f", "b", 1.0), ("h", "b", 1.0)]
    assert N.nearest(v.limit(0), 2).count() == 0
    assert N.nearest(v.limit(1), 2).count() == 0


def test_probing_order():
    sets = N.perturbations(4, 6)
    assert sets[0] == (0,) and len(set(sets)) == 6
    for s in sets:
        assert not any(7 - j in s for j in s)
    x = np.random.default_rng(0).normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    keys = N.bucket_keys(x, 4, 2, 3, 2.0)
    assert (keys == np.concatenate([N.bucket_keys(x[i : i + 1], 4, 2, 3, 2.0) for i in range(50)])).all()
