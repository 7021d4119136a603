import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import derivatives, series
from lodestone.plans import market

ORDER = ["ts", "event_id"]


def explicit(values):
    """The features from explicit matrices."""
    v = np.asarray(values, float)
    x = 2 * (v - v.min()) / (v.max() - v.min()) - 1 if v.max() > v.min() else np.full_like(v, -1.0)
    s = np.sqrt(np.maximum(0, 1 - x * x))
    g, d = np.outer(x, x) - np.outer(s, s), np.outer(s, x) - np.outer(x, s)
    h = len(v) // 2
    mean = lambda m: float(m.mean()) if m.size else None
    out = {
        "diagonal_mean": mean(np.diag(g)), "diagonal_std": float(np.diag(g).std()), "upper_left_mean": mean(g[:h, :h]), "lower_right_mean": mean(g[h:, h:]),
        "gaf_sum_mean": mean(g), "gaf_sum_std": float(g.std()), "gaf_diff_mean": mean(d), "gaf_diff_std": float(d.std()), "trend_score": mean(g) - mean(d),
        "symmetry": float(np.abs(g - g.T).mean()), "recent_strength": mean(g[-10:, -10:]), "historical_strength": mean(g[:10, :10]),
    }
    return out | {"momentum": out["recent_strength"] - out["historical_strength"]}


def frame(spark, data):
    rows = [(k, i, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, ts long, event_id long, value double")


def test_closed_form_equals_matrices(spark):
    rng = np.random.default_rng(42)
    data = {"sine": np.sin(np.linspace(0, 10, 100)), "noise": rng.normal(size=50), "const": [42.0] * 100, "short": rng.normal(size=10), "ramp": [1, 2, 3, 4, 5], "one": [42.0], "walk": rng.normal(size=140).cumsum()}
    got = {r.symbol: r for r in series.gaf_features(frame(spark, data), 100, "symbol", ORDER, digits=None).collect()}
    for k, vs in data.items():
        for name, want in explicit(vs[-100:]).items():
            assert got[k][name] == (None if want is None else pytest.approx(want, abs=1e-7)), (k, name)


def test_nulls_and_empty(spark):
    bars = frame(spark, {"a": [1, 2, 4]}).unionByName(spark.createDataFrame([("a", 9, 9, None)], "symbol string, ts long, event_id long, value double"))
    assert series.gaf_features(bars, 100, "symbol", ORDER).first().n_bars == 3
    assert series.gaf_features(frame(spark, {}), 100, "symbol", ORDER).count() == 0


@pytest.mark.parametrize("size", [64, 224])
def test_images(size):
    rng = np.random.default_rng(1)
    for v in (np.sin(np.linspace(0, 10, 100)), rng.normal(size=50), np.full(100, 42.0), rng.normal(size=10), [42.0]):
        image = series.gaf_image(np.asarray(v), size)
        assert image.shape == (size, size, 3) and image.dtype == np.uint8
    assert 100 < series.gaf_image(np.full(100, 42.0), size).mean() < 200
    noisy = series.gaf_image(np.sin(np.linspace(0, 10, 100)) + 0.1 * rng.normal(size=100), size)
    assert not np.array_equal(noisy[..., 0], noisy[..., 1]) and not np.array_equal(noisy[..., 0], noisy[..., 2])


def test_image_query_equals_numpy(spark, sf):
    bars = pd.read_parquet(f"{sf}/events.parquet").sort_values(["ts", "event_id"])
    got = {(r.symbol, r.channel): r for r in market.gaf_rgb_stats(spark, sf).collect()}
    for k, own in bars.groupby("event_type"):
        image = series.gaf_image(own["value"].to_numpy()[-100:], 64)
        for c in range(3):
            r = got[k, c]
            assert (r.low, r.high) == (image[..., c].min(), image[..., c].max()) and r.mean == pytest.approx(image[..., c].mean(), abs=1e-5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=2, max_size=12), st.integers(2, 20))
def test_resize_keeps_corners_and_range(v, size):
    m = np.outer(v, v)
    r = series.resize(m, size)
    assert r.shape == (size, size) and r.min() >= m.min() - 1e-12 and r.max() <= m.max() + 1e-12
    assert r[0, 0] == pytest.approx(m[0, 0]) and r[-1, -1] == pytest.approx(m[-1, -1])


def test_weighted_rate(spark):
    rows = [("a", 0.01, 100.0), ("a", 0.03, 300.0), ("a", -0.02, 100.0), ("b", 0.02, None), ("c", 0.04, 0.0), ("c", 0.0, 0.0), ("d", None, 5.0)]
    got = {r.s: r.rate for r in derivatives.weighted_rate(spark.createDataFrame(rows, "s string, rate double, oi double"), "s", "rate", "oi").collect()}
    assert got == {"a": pytest.approx(0.016), "b": 0.02, "c": 0.04}


def test_payloads(spark):
    body = '{"code":"0","data":[{"time":1700000000000,"longRatio":"60","longShortRatio":"1.5"},{"longRatio":"1"},{"time":1700000000000,"longRatio":"x"}]}'
    raw = spark.createDataFrame([(1, body), (2, '{"code":"-1","data":[]}'), (3, "no json"), (4, None)], "k int, body string")
    assert [tuple(r)[2:] for r in derivatives.ratio_rows(raw, "k", "body").collect()] == [(60.0, 50.0, 1.5)]
    assert derivatives.funding_rows(raw, "k", "body").count() == 0
