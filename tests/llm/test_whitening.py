"""Whitening against numpy's eigenvectors, exact integers, and odd rows."""

from decimal import Decimal

import numpy as np
import pytest
from conftest import DATA

from atlasframe.llm import queries, whitening


def brute(vectors, k):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    far = [sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, far, c @ u / np.sqrt(e), e / np.trace(v)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")


def test_query_equals_numpy(spark, vectors):
    rows = vectors.orderBy("vec_id").collect()
    n, far, y, share = brute([r["embedding"] for r in rows], 8)
    got = queries.op11_whitening(spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    found = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(found) == 8 * len(rows)
    own = np.array([[found[r["vec_id"], k + 1]["whitened"] for k in range(8)] for r in rows])
    assert np.abs(own * np.sign((own * y).sum(0)) - y).max() < 1e-9
    assert np.allclose([found[rows[0]["vec_id"], k + 1]["explained"] for k in range(8)], share, rtol=1e-12)
    assert {r["deviation"] for r in found.values()} == set(far) and {r["n"] for r in found.values()} == {n}
    assert len({r["identity_error"] for r in found.values()}) == 1 and next(iter(found.values()))["identity_error"] < 1e-10


@pytest.mark.parametrize(("d", "k", "values"), [(3, 8, [5, 2, 1]), (40, 3, [9.0, 8.999999, 8.99] + [3.0] * 37), (30, 4, [7.0] * 6 + [1.0] * 24), (12, 5, [4.0, 3.0] + [0.0] * 10), (90, 6, list(range(90, 0, -1))), (1, 1, [2.0])])
def test_solver_on_known_spectra(d, k, values):
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    a = q * np.array(values, float) @ q.T
    e, u = whitening.jacobi_davidson(lambda v: a @ v, d, k)
    want = np.sort(np.array(values, float))[::-1][:k]
    assert np.allclose(e, want, atol=1e-13 * want[0])
    assert np.abs(a @ u - u * e).max() < 1e-12 * want[0] and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12


def test_minres_solves_indefinite_systems():
    r = np.random.default_rng(3)
    a = r.normal(size=(20, 20))
    a, b = a + a.T, r.normal(size=(20, 4))
    b[:, 3] = 0
    assert np.allclose(a @ whitening.minres(lambda v: a @ v, b, 60, 1e-14), b, atol=1e-8)


def test_products_are_the_covariance(spark, vectors):
    made = whitening.blocks(vectors.repartition(5))
    x = np.floor(1024 * np.array([r["embedding"] for r in vectors.collect()], dtype=float)) + 100_000
    v = np.cov(x.T, bias=True)
    u = np.random.default_rng(1).normal(size=(made.d, 3))
    assert np.allclose(made.covariance_times(u), v @ u, rtol=1e-11, atol=1e-6) and made.n == len(x)
    assert list(made.sums) == x.sum(0).astype(int).tolist()


def test_small_blocks_and_other_partitions_give_the_same(spark, vectors, monkeypatch):
    sort = lambda df: np.array([r["whitened"] for r in df.orderBy("vec_id", "component").collect()]).reshape(-1, 2)
    a = sort(whitening.whiten(vectors, 2))
    monkeypatch.setattr(whitening, "BLOCK", 640)
    b = sort(whitening.whiten(vectors.repartition(11), 2))
    assert np.abs(a * np.sign((a * b).sum(0)) - b).max() < 1e-9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [2.0, 1.0, -0.5]), (2, [2.0, 1.0, -0.5]), (None, [0.0, 3.0, 2.5]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, nan, 2.0]), (6, [inf, 1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [5.0, -3.0, 40.0])]
    df = spark.createDataFrame([(*r, "a", 1, [1]) for r in rows], "vec_id long, embedding array<double>, x string, m int, ids array<int>")
    got = whitening.whiten(df, 8).collect()
    kept = [v for _, v in rows if v and len(v) == 3 and all(c is not None and abs(c) < inf for c in v)]
    n, far, y, share = brute(kept, 8)
    assert len(got) == 5 * 3 and {r["deviation"] for r in got} == {Decimal(f) for f in far}
    assert sorted(r["component"] for r in got if r["vec_id"] is None) == [1, 2, 3]
    assert np.allclose(sorted(abs(r["whitened"]) for r in got if r["component"] == 1), sorted(np.abs(y[:, 0])))
    wide = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1e9]), (3, [4.0, -1e9])], "vec_id long, embedding array<double>")
    # Beyond a long, and exact; the component below rounding of the first has no row.
    large = whitening.whiten(wide).collect()
    assert {r["deviation"] for r in large} == {Decimal(f) for f in brute([[1.0, 2.0], [3.0, 1e9], [4.0, -1e9]], 1)[1]} and {r["component"] for r in large} == {1}
    assert whitening.whiten(df.where("vec_id > 2 and vec_id < 7")).count() == 0 and whitening.whiten(df.where("false")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0  # no variance, no component
    line = spark.createDataFrame([(str(i), [1.0 * i, 2.0]) for i in range(4)], "vec_id string, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))


def test_a_fit_transforms_other_vectors(spark, vectors):
    made = whitening.blocks(vectors)
    model = whitening.fit(made, 3)
    there = {r["vec_id"]: r["whitened"] for r in model.transform(vectors).collect()}
    want = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(vectors, 3).collect()}
    sign = np.sign([want[i, k + 1] * there[i][k] for i in [min(there)] for k in range(3)])
    assert all(np.allclose(np.array(y) * sign, [want[i, k + 1] for k in range(3)], atol=1e-9) for i, y in there.items())
    moved = model.transform(spark.createDataFrame([("a", [0.0] * made.d), ("b", None), ("c", [1.0])], "vec_id string, embedding array<double>")).collect()
    assert [r["vec_id"] for r in moved] == ["a"]
