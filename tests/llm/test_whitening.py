import math

import numpy as np
import pytest

from lodestone.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int, component string, token string"


def frame(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash", None) for i, v in data], SCHEMA)


def drawn(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, row) for i, row in enumerate((rng.standard_normal((n, d)) * np.linspace(3, 0.5, d)).astype(np.float32).tolist())]


def brute(data, k):
    """n, deviations, values, axes, whitened of the contract by a full decomposition in long doubles and Python integers."""
    x = [[math.floor(64 * np.float64(c)) + 1_000_000 for c in v] for _, v in data]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    c = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, dev, values, values / values.sum(), c @ axes[:, :k] / np.sqrt(values[:k])


@pytest.mark.parametrize(("n", "d"), [(400, 64), (300, 3), (500, 200), (40, 50)])
def test_components_equal_a_full_decomposition(spark, n, d):
    """More dimensions than the basis of a round holds, fewer than 32, and fewer rows than dimensions."""
    data = drawn(n, d)
    rank = min(32, d, n - 1)
    found = wh.whiten(frame(spark, data)).toPandas()
    many, dev, values, explained, whitened = brute(data, rank)
    assert len(found) == n * rank and set(found["n"]) == {many} and sorted(set(found["component"])) == list(range(1, rank + 1))
    assert found.groupby("vec_id")["deviation"].first().tolist() == dev
    own = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((own * whitened).sum(0))
    assert np.abs(own * sign - whitened).max() < 1e-7
    assert np.allclose(found.groupby("component")["explained"].first(), explained[:rank], rtol=1e-10)
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9 and found["residual"].max() < 1e-9
    assert np.abs(own.T @ own / n - np.eye(rank)).max() < 1e-9


def test_rows_left_out_and_repeats(spark):
    good = drawn(60, 5, 3)
    odd = [(900, None), (901, []), (902, [1, None, 2, 3, 4]), (903, [1, float("nan"), 2, 3, 4]), (904, [float("inf"), 0, 0, 0, 0]), (905, [1.0] * 4), (906, [1e30, 0, 0, 0, 0])]
    found = wh.whiten(frame(spark, good[:30] + odd + good[30:] + good[:2] + [(None, good[7][1])])).toPandas()
    assert len(found) == 63 * 5 and set(found["n"]) == {63} and found["vec_id"].isna().sum() == 5
    same = found[found["vec_id"] == 0]
    assert len(same) == 10 and same.groupby("component")["whitened"].std().max() < 1e-12
    many, dev, *_ = brute([*good, *good[:2], (None, good[7][1])], 5)
    assert found.groupby("vec_id")["deviation"].first().tolist() == dev[:60]


@pytest.mark.parametrize("data", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_tables_without_variance_give_nothing(spark, data):
    assert wh.whiten(frame(spark, data)).collect() == []


def test_hot_vector_and_flat_directions(spark):
    """A third of the rows is one vector; one dimension is constant and one repeats another, so two components are left out."""
    data = [(i, [*v, 7.0, v[0]]) for i, v in drawn(90, 6, 5)]
    data += [(1000 + i, data[0][1]) for i in range(45)]
    found = wh.whiten(frame(spark, data)).toPandas()
    assert sorted(set(found["component"])) == list(range(1, 7)) and found["identity_error"][0] < 1e-9
    assert found[found["vec_id"] >= 1000].groupby("component")["whitened"].std().max() < 1e-12


def test_lobpcg_needs_few_products_and_stands_equal_eigenvalues():
    d = 300
    values = np.concatenate([[50, 50, 50], 10 * 0.9 ** np.arange(d - 3)])
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))[0]
    a, calls = (q * values) @ q.T, []

    def times(b):
        calls.append(b.shape[1])
        assert b.shape[1] <= 2 * (8 + wh.GUARDS)
        return a @ b

    got, axes, norms = wh.lobpcg(times, d, 8)
    assert np.allclose(got, values[:8], rtol=1e-12) and norms.max() < 1e-10 * 50 and len(calls) < 60
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12


def test_deviation_beyond_64_bits_is_null():
    sums = np.array([0, 0])
    assert wh.Centre(10**9, sums).deviations(np.array([[10**6, 0], [3, 4]])) == [None, 25 * 10**18 if 25 * 10**18 < 2**63 else None]
    assert wh.Centre(2, np.array([3, 1])).deviations(np.array([[1, 1], [2, 0]])) == [2, 2]
