"""Operator 11 against a dense eigendecomposition, and its defined cases."""

import math

import numpy as np
import pytest

from conftest import SF001
from glossa.llm import catalog, whitening


def _rows(vectors):
    return [(i, v) for i, v in enumerate(vectors)]


def _check(got, vectors, identity=1e-9):
    """Every value of the contract, from a dense solution over the distinct integer vectors."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    wide = max(map(len, x.values()), default=0)
    x = {i: v + (0,) * (wide - len(v)) for i, v in x.items()}
    fit = np.array(sorted(set(x.values())), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    a = fit - sums / n
    e, w = np.linalg.eigh(a.T @ a / n)
    e, w = e[::-1], w[:, ::-1]
    rank = min(4, int((e > e[0] * 1e-12).sum()))
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, rank + 1))
    for k in range(1, rank + 1):
        rows = by[k]
        assert sorted(r["vec_id"] for r in rows) == sorted(x)
        want = np.array([(np.array(x[r["vec_id"]]) - sums / n) @ w[:, k - 1] / math.sqrt(e[k - 1]) for r in rows])
        have = np.array([r["whitened"] for r in rows])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        for r in rows:
            assert r["n"] == n and r["identity_error"] <= identity
            exact = sum((n * c - int(s)) ** 2 for c, s in zip(x[r["vec_id"]], sums))
            assert r["deviation"] == (exact if exact < 1 << 63 else None)
            assert abs(r["explained"] - e[k - 1] / e.sum()) < 1e-9


def test_whole_table_equals_dense_solution(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    got = catalog.QUERIES["op11_shifted_cholesky"](spark, SF001)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(got.collect(), [(r["vec_id"], r["embedding"]) for r in table])


@pytest.mark.parametrize("scales", [[1.0] * 6, [300.0, 40.0, 5.0, 1.0, 0.2, 0.05], [1e4, 1e3, 1e2, 10.0, 1.0, 0.0]])
def test_badly_conditioned_and_constant_columns(spark, scales):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(400, 6)) * np.array(scales) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = _rows(mixed.tolist())
    _check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = _rows([None, [1.0, None, 2.0], [nan, 1.0, 1.0], [1.0, inf, 0.0], [], [0.5], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [-0.3, 0.0, -0.0], [2.0, 1.0, 0.7]])
    df = spark.createDataFrame([(i, v, "own", 3) for i, v in rows], "vec_id long, embedding array<double>, n string, x int")
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "embedding", "n", "x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    plain = whitening.whiten(df.select("vec_id", "embedding")).collect()
    _check(plain, rows)
    assert whitening.whiten(df.filter("vec_id = 6")).count() == 0  # one vector: no variance
    assert whitening.whiten(df.filter("false")).count() == 0
    assert whitening.whiten(df.filter("vec_id < 4")).count() == 0


def test_large_entries_stay_exact(spark):
    rows = _rows([[1e9, 0.0], [-1e9, 1.0], [5e8, 3.0], [1e300, 0.0]])
    got = whitening.whiten(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).collect()
    fit = [[math.floor(256 * c) for c in v] for _, v in rows[:3]]
    sums = [sum(c) for c in zip(*fit)]
    for r in got:
        exact = sum((3 * c - s) ** 2 for c, s in zip(fit[r["vec_id"]], sums))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() > 0


def test_triangular_solve():
    rng = np.random.default_rng(0)
    r = np.triu(rng.normal(size=(7, 7))) + 4 * np.eye(7)
    a = rng.normal(size=(20, 7))
    assert np.allclose(whitening.solve_rows(a, r) @ r, a)
