"""Analytic recovery, invariance to partitioning and agreement with plain NumPy loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajmill import TrajectorySpec
from trajmill.functions import linalg as L
from trajmill.operators import fitting as fit, metrics as M, prediction as pred
from trajmill.plans.segments import plan_layout

A = np.array([[0.9, 0.1], [-0.05, 0.85]])
B = np.array([[0.2], [-0.1]])
SPEC = TrajectorySpec(case="c", time="t", states=("x1", "x2"), inputs=("u1",))


def simulate(case, n, seed, noise=0.0, dt=None):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=n)
    x = np.zeros((n, 2))
    x[0] = (1.0, -0.5)
    for k in range(n - 1):
        x[k + 1] = A @ x[k] + B[:, 0] * u[k]
    x += noise * rng.normal(size=x.shape)
    t = np.arange(n, dtype=float) if dt is None else np.cumsum(rng.uniform(*dt, n))
    return pd.DataFrame({"c": case, "t": t, "x1": x[:, 0], "x2": x[:, 1], "u1": u})


@pytest.fixture(scope="module")
def exact(spark):
    return spark.createDataFrame(pd.concat([simulate("a", 200, 0), simulate("b", 40, 1), simulate("z", 9, 2)])).repartition(5).cache()


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.createDataFrame(pd.concat([simulate("a", 200, 3, 0.1), simulate("b", 40, 4, 0.1), simulate("z", 9, 5, 0.1)])).cache()


def stacked(df):
    rows = df.toPandas().sort_values(["c", "t"])
    x0, u, x1 = [], [], []
    for _, g in rows.groupby("c"):
        x, v = g[["x1", "x2"]].to_numpy(), g[["u1"]].to_numpy()
        x0.append(x[:-1]), u.append(v[:-1]), x1.append(x[1:])
    return np.vstack(x0), np.vstack(u), np.vstack(x1)


def test_recovers_known_system(exact):
    factor = fit.fit_transitions(exact, SPEC)
    assert factor.rows == 199 + 39 + 8
    for options in ({}, {"center": True, "scale": True}):
        model = fit.fit_dmdc(factor, SPEC, **options)
        assert np.allclose(model.a, A, atol=1e-10) and np.allclose(model.b, B, atol=1e-10)
    cut = fit.fit_transitions(exact, SPEC, plan_layout(exact, ["c"], "t", 20))
    assert cut.rows == factor.rows and np.allclose(fit.fit_dmdc(cut, SPEC).a, A, atol=1e-10)


def test_matches_direct_solutions(noisy):
    x0, u, x1 = stacked(noisy)
    factor = fit.fit_transitions(noisy, SPEC)
    omega = np.column_stack([x0, u])
    direct = np.linalg.lstsq(omega, x1, rcond=None)[0].T
    model = fit.fit_dmdc(factor, SPEC)
    assert np.allclose(np.column_stack([model.a, model.b]), direct, atol=1e-10)
    assert np.isclose(model.metadata["one_step_rmse"], np.sqrt(np.mean((x1 - omega @ direct.T) ** 2)))
    ridge = fit.fit_ridge(factor, SPEC, alpha=0.5)
    damped = np.linalg.solve(omega.T @ omega + 0.5 * np.eye(3), omega.T @ x1).T
    assert np.allclose(np.column_stack([ridge.a, ridge.b]), damped, atol=1e-10)
    assert np.allclose(factor.means(["x1", "u1"]), [x0[:, 0].mean(), u.mean()])
    assert np.allclose(factor.stds(["x1", "u1"]), [x0[:, 0].std(), u.std()])
    masked = fit.fit_graph(factor, SPEC, [("x1", "x1"), ("x2", "x2"), ("x1", "x2")])
    assert masked.a[0, 1] == 0.0 and masked.a[1, 0] != 0.0
    assert fit.allowed_mask(["a", "b", "c"], fit.ring_edges(["a", "b", "c"], False, True)).sum() == 3


def test_per_case_and_leave_one_out(noisy, spark):
    table = fit.case_factors(noisy, SPEC)
    models = {r["c"]: r for r in fit.models_per_case(table, SPEC, dt=1.0).collect()}
    for case in ("a", "b", "z"):
        alone = fit.fit_dmdc(fit.fit_transitions(noisy.where(F.col("c") == case), SPEC), SPEC)
        assert np.allclose(models[case]["a"], alone.a, atol=1e-10)
        assert np.isclose(models[case]["growth_rate"], np.log(np.abs(np.linalg.eigvals(alone.a))).max())
    held = {r["c"]: r for r in fit.leave_one_out_factors(table, "c", fan_in=2).collect()}
    rest = fit.fit_dmdc(fit.fit_transitions(noisy.where("c <> 'a'"), SPEC), SPEC)
    factor = fit.Factor(fit.transition_columns(SPEC), np.array(held["a"]["r"]).reshape(-1, held["a"]["p"]), held["a"]["n_rows"])
    assert np.allclose(fit.fit_dmdc(factor, SPEC).a, rest.a, atol=1e-9)


def test_every_case_left_out_in_a_deep_tree(spark):
    rng = np.random.default_rng(12)
    rows = [(c if c else None, rng.normal(size=3 + c % 4)) for c in range(29)]
    df = spark.createDataFrame([(c, float(t), float(x)) for c, xs in rows for t, x in enumerate(xs)], "c int, t double, x1 double")
    spec = TrajectorySpec(case="c", time="t", states=("x1",))
    table = fit.case_factors(df.repartition(5), spec).cache()
    held = fit.leave_one_out_factors(table, "c", fan_in=3)
    assert held.schema["c"].dataType.simpleString() == "int"
    got = {r.c: np.asarray(r.r).reshape(-1, r.p) for r in held.collect()}
    sums = {c: np.array([[(xs[:-1] ** 2).sum(), (xs[:-1] * xs[1:]).sum()]]) for c, xs in rows}
    total = sum(sums.values())
    assert set(got) == {c for c, _ in rows}
    for c, r in got.items():
        assert np.allclose([(r[:, 1] ** 2).sum(), (r[:, 1] * r[:, 2]).sum()], (total - sums[c])[0])
    alone = fit.leave_one_out_factors(table.where("c = 5"), "c").collect()
    assert len(alone) == 1 and alone[0]["n_rows"] == 0 and fit.leave_one_out_factors(table.where("c = 99"), "c").count() == 0


def test_adaptive_exact_on_euler_data(spark):
    t = np.cumsum(np.linspace(0.05, 0.15, 80))
    u, x = np.sin(0.3 * t), np.ones(80)
    for k in range(79):
        x[k + 1] = x[k] + (t[k + 1] - t[k]) * (-0.7 * x[k] + 0.4 * u[k])
    df = spark.createDataFrame(pd.DataFrame({"c": "a", "t": t, "x": x, "u": u}))
    model = fit.fit_adaptive(df, TrajectorySpec(case="c", time="t", states=("x",), inputs=("u",)), alpha=0.0)
    assert np.isclose(model.a[0, 0], -0.7) and np.isclose(model.b[0, 0], 0.4)
    assert np.isclose(model.dt, np.median(np.diff(t)))


def test_pod_curve_and_reduced_fit(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6)) + 450
    names = [f"s{i}" for i in range(6)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(c="a", t=np.arange(120.0)))
    snapshots = fit.fit_snapshots(df, names)
    pod = fit.fit_pod(snapshots, names)
    assert np.allclose(pod.singular_values, np.linalg.svd(x - x.mean(0), compute_uv=False))
    curve = fit.reconstruction_curve(snapshots, pod)
    assert (np.diff(curve["rmse"]) < 0).all() and curve["rmse"].iloc[-1] < 1e-10
    three = pod.truncated(3)
    got = pred.pod_inverse(pred.pod_transform(df, three), three).toPandas()
    err = np.sqrt(np.mean((got[[f"rec_{c}" for c in names]].to_numpy() - got[names].to_numpy()) ** 2))
    assert np.isclose(err, curve["rmse"].iloc[2])
    spec = TrajectorySpec(case="c", time="t", states=tuple(names))
    steps = fit.fit_transitions(df, spec)
    model = fit.fit_pod_dmdc(steps, snapshots, spec, pod_rank=3)
    modal = (x - x.mean(0)) @ three.modes
    assert np.allclose(model.a, np.linalg.lstsq(modal[:-1], modal[1:], rcond=None)[0].T, atol=1e-8)
    ridge = fit.fit_pod_ridge(steps, snapshots, spec, pod_rank=3)
    centred0, centred1 = modal[:-1] - modal[:-1].mean(0), modal[1:] - modal[1:].mean(0)
    assert np.allclose(ridge.a, np.linalg.solve(centred0.T @ centred0 + np.eye(3), centred0.T @ centred1).T, atol=1e-8)
    ranking = fit.sensor_ranking(pod.truncated(2))
    assert ranking["selected"].sum() == 2 and ranking["pivot_magnitude"].notna().sum() == 2


@pytest.mark.parametrize("target", [None, 15])
def test_rollout_and_filter_match_loops(noisy, target):
    model = fit.fit_dmdc(fit.fit_transitions(noisy, SPEC), SPEC, center=True)
    layout = plan_layout(noisy, ["c"], "t", target)
    assert layout.split is (target is not None)
    got = pred.rollout(noisy, SPEC, model, layout=layout).toPandas().sort_values(["c", "t"])
    filtered = pred.kalman_filter(noisy, SPEC, model, ["x1"], np.array([[1.0, 0.0]]), q=np.eye(2) * 1e-3,
                                  r=np.eye(1) * 1e-2, layout=layout).toPandas().sort_values(["c", "t"])
    for case, g in noisy.toPandas().sort_values(["c", "t"]).groupby("c"):
        x = g[["x1", "x2"]].to_numpy()
        u = g["u1"].to_numpy()
        want, est = [x[0]], []
        for k in range(len(g) - 1):
            want.append(model.a @ want[-1] + model.b[:, 0] * u[k] + model.offset)
        assert np.allclose(got[got.c == case][["pred_x1", "pred_x2"]], want, atol=1e-9)
        s, p, h = np.zeros(2), np.eye(2), np.array([[1.0, 0.0]])
        for k in range(len(g)):
            if k:
                s = model.a @ s + model.b[:, 0] * u[k] + model.offset
                p = model.a @ p @ model.a.T + np.eye(2) * 1e-3
            gain = p @ h.T @ np.linalg.pinv(h @ p @ h.T + 1e-2)
            innovation = x[k, 0] - (h @ s)[0]
            s, p = s + gain[:, 0] * innovation, (np.eye(2) - gain @ h) @ p
            est.append([*s, np.trace(p), abs(innovation)])
        mine = filtered[filtered.c == case][["est_x1", "est_x2", "covariance_trace", "innovation_norm"]]
        assert np.allclose(mine, est, atol=1e-9)


@pytest.mark.parametrize("target", [None, 15])
def test_continuous_rollout_and_forecast(spark, target):
    frame = simulate("a", 60, 8, 0.0, (0.1, 0.4))
    df = spark.createDataFrame(frame)
    model = fit.fit_adaptive(df, SPEC)
    layout = plan_layout(df, ["c"], "t", target)
    got = pred.rollout(df, SPEC, model, layout=layout).toPandas().sort_values("t")
    want = [frame[["x1", "x2"]].to_numpy()[0]]
    for k in range(59):
        a, b = L.hold_step(model.a, model.b, frame.t[k + 1] - frame.t[k])
        want.append(a @ want[-1] + b[:, 0] * frame.u1[k])
    assert np.allclose(got[["pred_x1", "pred_x2"]], want)
    first = pred.forecast(df.orderBy("t").limit(1), model, "t", (0.5,)).toPandas()
    a, b = L.hold_step(model.a, model.b, 0.5)
    assert np.allclose(first["predicted_value"], a @ want[0] + b[:, 0] * frame.u1[0])


def test_discrete_forecast_takes_whole_steps(exact):
    model = fit.fit_dmdc(fit.fit_transitions(exact, SPEC), SPEC)
    rows = pred.forecast(exact.where("c = 'z' and t = 0"), model, "t", (2.5,), dt=1.0).toPandas()
    x, u = np.array([1.0, -0.5]), exact.where("c = 'z' and t = 0").first()["u1"]
    for _ in range(3):
        x = A @ x + B[:, 0] * u
    assert np.allclose(rows["predicted_value"], x) and (rows["effective_horizon_s"] == 3.0).all()


def test_sensors_reconstruct_two_modes(spark):
    t = np.linspace(0, 3, 20)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "s": np.sin(t), "k": np.cos(t)}))
    pod = fit.fit_pod(fit.fit_snapshots(df, ["s", "k"]), ["s", "k"])
    order = fit.sensor_ranking(pod)["sensor_index"].tolist()
    got = pred.reconstruct_from_sensors(df, pod, order[:2]).toPandas()
    assert np.allclose(got["rec_s"], got["s"], atol=1e-10) and np.allclose(got["rec_k"], got["k"], atol=1e-10)


def test_wide_maps_agree_with_column_expressions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = [f"s{i}" for i in range(20)]
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(30, 20)), columns=names).assign(id=range(30)))
    pod = fit.fit_pod(fit.fit_snapshots(df, names), names, rank=5)
    chosen = fit.sensor_ranking(pod)["sensor_index"].tolist()[:5]
    got = []
    for most in (512, 0):
        monkeypatch.setattr(pred, "MOST_TERMS", most)
        out = pred.reconstruct_from_sensors(pred.pod_inverse(pred.pod_transform(df, pod), pod, "low_"), pod, chosen)
        got.append(out.toPandas().sort_values("id"))
        errors = M.error_by_column(out, {c: f"rec_{c}" for c in names}).toPandas().set_index("column")
        few = M.error_by_column(out, {c: f"rec_{c}" for c in names[:3]}).toPandas().set_index("column")
        assert np.allclose(errors.loc[names[:3], few.columns], few.loc[names[:3]])
    columns = [f"{p}_{c}" for p in ("low", "rec") for c in names]
    assert np.allclose(got[0][columns], got[1][columns])


def test_rank_rule():
    s = np.array([10.0, 1.0, 1e-20])
    assert [L.pick_rank(s, r) for r in (None, "full", "auto", 1, 99, 0.5, 1.0)] == [3, 3, 2, 1, 3, 1, 2]
