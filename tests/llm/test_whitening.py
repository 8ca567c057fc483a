import numpy as np
import pytest

from chronoplex.llm import whitening as W

VECS = "vec_id long, embedding array<double>, label int, key string, component int, n long"


def bidiagonal(a, b):
    return np.diag(a) + np.diag(b, 1)


def cases():
    rng = np.random.default_rng(0)
    yield "random", rng.normal(size=20), rng.normal(size=19)
    yield "graded", 10.0 ** -np.arange(0, 12), 10.0 ** -np.arange(0.5, 11)
    yield "equal", np.ones(12), np.zeros(11)
    yield "toeplitz", np.full(40, 2.0), np.ones(39)
    yield "two equal blocks", np.tile([3.0, 2.0, 1.0], 2), np.array([1, 1, 0, 1, 1.0])
    yield "one", np.array([2.0]), np.zeros(0)


@pytest.mark.parametrize("name,a,b", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
def test_qd_values_and_twisted_vectors(name, a, b):
    values = W.dqds(a * a, b * b)
    want = np.linalg.svd(bidiagonal(a, b), compute_uv=False)
    assert np.allclose(np.sqrt(values), want, rtol=1e-9 if name == "random" else 1e-12, atol=0 if name != "graded" else 1e-22)
    z = W.twisted(a * a, b * b, values)
    t = bidiagonal(np.abs(a), np.abs(b))
    assert np.abs(z.T @ z - np.eye(len(a))).max() < 1e-13
    assert np.abs(t.T @ (t @ z) - z * values).max() < 1e-12 * values[0]


def test_bidiagonalise():
    a = np.random.default_rng(1).normal(size=(9, 9))
    q, e, v = W.bidiagonalise(a)
    assert np.allclose(v.T @ v, np.eye(9)) and np.allclose((a @ v).T @ (a @ v), bidiagonal(q, e).T @ bidiagonal(q, e))


@pytest.mark.parametrize("shape", ["full", "dependent", "constant column", "few rows", "repeated values"])
def test_directions(shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 10)) * 5.0 ** -np.arange(10)
    if shape == "dependent":
        x[:, 3] = x[:, 1] - x[:, 7]
    elif shape == "constant column":
        x[:, 4] = 0
    elif shape == "few rows":
        x = x[:4]
    elif shape == "repeated values":
        x = np.vstack([np.eye(10), -np.eye(10)] * 3) * [1] * 10
    values, v = W.directions(W.triangle(x))
    want, vectors = np.linalg.eigh(x.T @ x)
    want = want[::-1]
    rank = np.linalg.matrix_rank(x)
    assert len(values) == rank and np.allclose(values, want[:rank], rtol=1e-8)
    assert np.abs(v.T @ v - np.eye(rank)).max() < 1e-12
    assert np.abs(x.T @ (x @ v) - v * values).max() < 1e-11 * values[0]


def brute(vectors, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)) + 1_000_000
    centred = x - x.mean(axis=0)
    values, v = np.linalg.eigh(centred.T @ centred / len(x))
    values, v = values[::-1][:components], v[:, ::-1][:, :components]
    total = [[int(c) for c in r] for r in x]
    n, sums = len(x), [sum(c) for c in zip(*total)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in total]
    return centred @ v / np.sqrt(values), values / np.trace(centred.T @ centred / len(x)), deviation


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).tolist()
    bad = [None, [], [1.0, None, *[0.0] * 10], [float("nan")] * 12, [1.0, float("-inf"), *[0.0] * 10], [1.0] * 11]
    ids = [*range(690), None, None, *[3] * 8]
    rows = [(i, v, 1, "k", 9, 9) for i, v in zip(ids, good)] + [(5000, b, 1, "k", 9, 9) for b in bad]
    df = spark.createDataFrame(rows, VECS).repartition(7)
    got = W.whiten(df, components=5).toPandas()
    want, share, deviation = brute(good, 5)
    assert len(got) == 700 * 5 and set(got.n) == {700} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    one = got[got.vec_id.between(0, 689) & (got.vec_id != 3)].sort_values(["vec_id", "component"])
    mine = one.whitened.to_numpy().reshape(-1, 5)
    other = want[[i for i in range(690) if i != 3]]
    assert np.allclose(np.abs(mine), np.abs(other), atol=1e-7) and np.allclose(np.abs((mine * other).mean(axis=0)), (other * other).mean(axis=0))
    assert np.allclose(one.explained.to_numpy().reshape(-1, 5)[0], share)
    assert [int(x) for x in one[one.component == 1].deviation] == [deviation[i] for i in range(690) if i != 3]
    assert got.vec_id.isna().sum() == 10 and (got.vec_id == 3).sum() == 45


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1, "k", 1, 1)], [(i, [1.0, 2.0], 1, "k", 1, 1) for i in range(5)], [(1, None, 1, "k", 1, 1)]])
def test_nothing_to_whiten(spark, rows):
    got = W.whiten(spark.createDataFrame(rows, VECS))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
