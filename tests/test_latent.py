"""Truncated factors of sparse matrices against numpy."""

import numpy as np

from quillspark.operators import latent


def sparse(n, m, k, seed):
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(n, k)))[0], np.linalg.qr(rng.normal(size=(m, k)))[0]
    a = u * np.geomspace(50, 10, k) @ v.T
    a[rng.random((n, m)) < 0.3] = 0
    return a


def cells(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), f"t{y}", float(a[x, y])) for x, y in zip(i, j, strict=True)], "row long, col string, w double")


def test_factors(spark, monkeypatch):
    monkeypatch.setattr(latent, "BLOCK", 40)
    a = sparse(150, 90, 6, 1)
    found = latent.factor(cells(spark, a), k=6, extra=10, rounds=7)  # 4 rounds leave 2.3e-3: the rest of this matrix is flat
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(found.values, s[:6], rtol=1e-3)
    left = np.array([r["v"] for r in found.rows.orderBy("id").collect()])
    right = {r["key"]: r["v"] for r in found.cols.collect()}
    right = np.array([right[f"t{j}"] for j in range(90)])
    assert np.linalg.norm(left @ left.T - u[:, :6] @ u[:, :6].T, 2) < 1e-3
    assert np.linalg.norm(right @ right.T - vt[:6].T @ vt[:6], 2) < 1e-3
    assert np.allclose(left * found.values @ right.T, u[:, :6] * s[:6] @ vt[:6], atol=1e-2)
    rows = np.array([r["v"] for r in latent.embedded(found).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(rows, axis=1), 1)
    again = {r["id"]: r["v"] for r in latent.folded(found, cells(spark, a).where("row < 5")).collect()}
    assert all(np.allclose(again[i], rows[i], atol=1e-2) for i in range(5))


def test_narrow_matrices(spark):
    assert latent.factor(spark.createDataFrame([], "row long, col string, w double")) is None
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "b", 3.0), (3, None, 1.0), (None, "a", 1.0), (4, "a", None), (5, "a", 0.0), (6, "b", float("nan"))]
    found = latent.factor(spark.createDataFrame(rows, "row long, col string, w double"))
    assert np.allclose(found.values, [3, 2]) and {r["id"] for r in found.rows.collect()} == {1, 2}
    one = latent.factor(spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (1, "b", 2.0), (2, "b", 2.0)], "row long, col string, w double"))
    assert np.allclose(one.values, [4])
