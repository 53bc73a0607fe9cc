"""Cap filters: decoding against brute force, small tiles against matrices, recall at growing sizes, cases."""

import numpy as np
import pytest

from veristrata.llm import embedding_dedup as E


def units(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_decoding_against_brute_force():
    rng = np.random.default_rng(1)
    for dim, words, size in ((16, 64, 40), (7, 80, 5), (1, 64, 20), (2, 64, 30)):
        code = E.CapCode(dim, words, size)
        x = units(rng, 12, dim)
        for row, got in zip(zip(*code.products(x), strict=True), code.decode(x), strict=True):
            sums = row[0][:, None] + row[1][None, :]
            least = min(code.threshold, np.sort(sums.ravel())[-E.LEAST])
            want = np.flatnonzero(sums.ravel() >= code.threshold)
            assert set(want) <= set(got) and got.size >= min(E.LEAST, sums.size) and (sums.ravel()[got] >= least).all()


@pytest.mark.parametrize("n", [2_000, 50_000, 1_000_000])
def test_recall_near_the_bound(n):
    rng = np.random.default_rng(n)
    dim, pairs = 32, 300
    code = E.CapCode(dim, E.code_words(n), E.list_size(n))
    x, r = units(rng, pairs, dim), rng.normal(size=(pairs, dim))
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    shared = [np.intersect1d(a, b).size > 0 for a, b in zip(code.decode(x), code.decode(y), strict=True)]
    assert np.mean(shared) >= 0.97


def test_small_tiles_equal_matrices():
    rng = np.random.default_rng(5)
    for _ in range(20):
        m = int(rng.integers(2, 20))
        x = units(rng, 1, 8) + rng.normal(size=(m, 8)) * 0.1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = [np.unique(rng.integers(0, 40, 6)) for _ in range(m)]
        lists = [np.unique(np.r_[v, 30]).astype(np.int64) for v in lists]
        adds, forest = E._tile(30, None, np.ones(m, np.int64), x, lists, 0.95)
        one, two = E.small_tiles(np.full(m, 30), np.array([0]), np.array([m]), x, lists, 0.95)
        got = np.zeros(m, np.int64)
        np.add.at(got, one, 1)
        np.add.at(got, two, 1)
        assert (got == adds).all()
        assert len(list(E._spanning(one, two))) == len(forest)


def test_cases(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=6)
    rows = [(1, a.tolist(), "x", 1), (1, a.tolist(), "x", 1), (2, (a * 3).tolist(), "x", 1), (3, [1.0, None], "x", 1), (4, [1e300, 1e300], "x", 1), (5, [1e300, 1e300 * 0.99], "x", 1), (6, [-0.0, 1.0], "x", 1), (7, [0.0, 1.0], "x", 1), (8, [1.0], "x", 1), (9, [2.0], "x", 1)]
    schema = "vec_id long, embedding array<double>, node string, weight int"
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 8, False)]
    assert E.embedding_dedup(spark.createDataFrame([], schema)).collect() == []


def test_one_group_of_near_copies(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=16)
    rows = [(k, (a + rng.normal(size=16) * 0.02).tolist()) for k in range(700)] + [(1000 + k, rng.normal(size=16).tolist()) for k in range(300)]
    got = {r.vec_id: r for r in E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array([np.float32(v).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert all(got[i].n_links == linked[k] for k, (i, _) in enumerate(rows[:700]))
    assert {got[k].component_id for k in range(700)} == {0}
