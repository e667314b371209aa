"""Filters, variable steps and clipped folds as scans: equal to stepping, whatever the length."""


import numpy as np
import pandas as pd
import pytest

from trajmill import TrajectorySpec
from trajmill.functions import linalg as L
from trajmill.operators import bias as B, fitting as fit, prediction as pred
from trajmill.plans.segments import plan_layout


def stepped_filter(a, h, q, r, p0, count):
    covariances, gains, p = [], [], p0
    for k in range(count):
        p = a @ covariances[-1] @ a.T + q if k else p0
        gains.append(p @ h.T @ np.linalg.pinv(h @ p @ h.T + r))
        covariances.append((np.eye(len(a)) - gains[-1] @ h) @ p)
    return np.array(gains), np.array(covariances)


@pytest.mark.parametrize("n, m", [(1, 1), (2, 1), (3, 2)])
def test_gains_at_any_step(n, m):
    rng = np.random.default_rng(n)
    a, h = rng.normal(size=(n, n)) * 0.6, rng.normal(size=(m, n))
    for drift, noise in ((a, 0.1), (np.eye(n), 0.1), (a, 0.0)):
        scan = L.RiccatiScan(drift, h, np.eye(n) * 0.01, np.eye(m) * noise, np.eye(n))
        gains, covariances = stepped_filter(drift, h, np.eye(n) * 0.01, np.eye(m) * noise, np.eye(n), 1500)
        index = np.concatenate([np.arange(70), np.arange(1000, 1300), np.arange(30), [1499, 0]])
        got, after = scan.at(index)
        assert np.allclose(got, gains[index], atol=1e-9) and np.allclose(after, covariances[index], rtol=1e-8, atol=1e-9)
    assert scan.at(np.zeros(0, int))[0].shape == (0, n, m)


def test_singular_noise_is_stepped():
    a, h = np.diag([0.9, 0.5]), np.array([[1.0, 0.0], [1.0, 0.0]])  # two channels say the same, both without noise
    scan = L.RiccatiScan(a, h, np.eye(2) * 0.01, np.zeros((2, 2)), np.eye(2))
    gains, covariances = stepped_filter(a, h, np.eye(2) * 0.01, np.zeros((2, 2)), np.eye(2), 3000)
    index = np.array([2999, 5, 0, 2000])
    got, after = scan.at(index)
    assert not scan.regular and np.allclose(got, gains[index]) and np.allclose(after, covariances[index])
    assert len(scan.kept) <= 1 + 3000 // scan.STRIDE


def test_unobserved_mode_keeps_memory_flat():
    scan = L.RiccatiScan(np.eye(2), np.array([[1.0, 0.0]]), np.eye(2) * 1e-3, np.eye(1) * 0.1, np.eye(2))
    for low in range(0, 1_000_000, 100_000):
        _, after = scan.at(np.arange(low, low + 1000))
        assert np.allclose(after[:, 1, 1], 1.0 + 1e-3 * np.arange(low, low + 1000))  # grows for ever
    assert len(scan.maps) <= 21 and len(scan.kept) == 1


def test_varying_scan_and_products():
    rng = np.random.default_rng(4)
    m, f, first = rng.normal(size=(1003, 2, 2)) * 0.7, rng.normal(size=(1003, 2)), rng.random(1003) < 0.01
    first[0] = True
    want = f.copy()
    for k in np.flatnonzero(~first):
        want[k] += m[k] @ want[k - 1]
    assert np.allclose(L.varying_scan(m, f, first), want)
    product = np.eye(2)
    for one in m[:77]:
        product = one @ product
    assert np.allclose(L.chain_product(m[:77]), product)
    dts = rng.choice([0.1, 2.0, 30.0], 50)
    a, b = L.hold_steps(-m[0] @ m[0].T, f[:2], dts)
    for k in range(50):
        x, y = L.hold_step(-m[0] @ m[0].T, f[:2], dts[k])
        assert np.allclose(a[k], x) and np.allclose(b[k], y)


def long_case(spark, n):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"c": ["long"] * n + ["b"] * 40, "t": [*np.arange(float(n)), *np.arange(40.0)], "y": rng.normal(size=n + 40), "z": 0.0})
    return spark.createDataFrame(frame), frame


def test_filter_with_an_unobserved_mode_split_and_whole(spark):
    df, frame = long_case(spark, 900)
    spec = TrajectorySpec(case="c", time="t", states=("y", "z"))
    model = fit.LinearModel("dmdc", ["y", "z"], [], np.array([[0.9, 0.0], [0.1, 1.0]]), np.zeros((2, 0)), np.zeros(2))
    h = np.array([[1.0, 0.0]])
    options = dict(q=np.eye(2) * 0.01, r=np.eye(1) * 0.1)
    whole = pred.kalman_filter(df, spec, model, ["y"], h, **options).toPandas().sort_values(["c", "t"]).reset_index(drop=True)
    split = pred.kalman_filter(df, spec, model, ["y"], h, layout=plan_layout(df, ["c"], "t", 100), **options)
    pd.testing.assert_frame_equal(split.toPandas().sort_values(["c", "t"]).reset_index(drop=True), whole)
    gains, covariances = stepped_filter(model.a, h, options["q"], options["r"], np.eye(2), 900)
    x = np.zeros(2)
    mine = whole[whole.c == "long"]
    for k, y in enumerate(mine.y):
        x = model.a @ x if k else x
        x = x + gains[k] @ (np.array([y]) - h @ x)
        assert np.allclose([mine.est_y.iloc[k], mine.est_z.iloc[k]], x) and np.isclose(mine.covariance_trace.iloc[k], np.trace(covariances[k]))


def test_bias_maps_compose():
    rng = np.random.default_rng(1)
    for rate in (0.0, 0.01, 0.3, 1.0):
        for step in (0.01, 0.25, 50.0):
            rules = B.BiasRules(learning_rate=rate, max_step=step, max_abs_bias=2.0)
            made, residuals = B.BiasMap(rules), rng.normal(0.3, 2.0, 400)
            for x in residuals:
                made.update(x)
            assert len(made.corners) <= 8 * 2.0 / step + 16
            for start in np.linspace(-2, 2, 17):
                bias = start
                for x in residuals:
                    bias = B._moved(bias, x, rules)
                assert np.isclose(made(start), bias)


def test_one_pass_gives_all_segment_starts(spark, monkeypatch):
    """Segments that never forget their start are no further passes."""
    n = 300
    rows = [(float(t), 0.0, t, float(t), float(t), 1.0, "x", 0.0, 0.0, 0.001 * (t % 7), 0.001) for t in range(n)]
    names = "time origin_time origin_row_index target_time matched_time forecast_horizon_s state measured_value predicted_value residual abs_residual".split()
    df = spark.createDataFrame(pd.DataFrame(rows, columns=names))
    trust = spark.createDataFrame([], "time double, trust_score double, n_warning_alerts int, n_critical_alerts int")
    alerts = spark.createDataFrame([], "time double, severity string, code string")
    rules = B.BiasRules(learning_rate=0.001, max_step=1.0)
    written = []
    settle = B.settle
    monkeypatch.setattr(B, "settle", lambda df: written.append(df) or settle(df))
    split = B.bias_events(df, alerts, trust, rules=rules, target_rows=20).orderBy("time").toPandas()
    assert len(written) == 2  # the judged rows, and the starts
    bias = 0.0
    for got, row in zip(split.new_bias, rows):
        bias = B._moved(bias, row[9], rules)
        assert np.isclose(got, bias)
