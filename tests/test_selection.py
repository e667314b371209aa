import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajmill import TrajectorySpec
from trajmill.operators import fitting as fit, metrics as M, prediction as pred, selection as sel, shaping as S, trees as TR

SPEC = TrajectorySpec(case="c", time="t", states=("x1", "x2"), inputs=("u1",))


@pytest.fixture(scope="module")
def cases(spark):
    frames = []
    for i, gain in enumerate((0.82, 0.90, 0.97, 0.88)):
        x, u = np.zeros((12, 2)), np.full(12, 0.03 * i)
        x[0] = (1.0 + i, 0.5)
        for k in range(11):
            x[k + 1] = (gain * x[k, 0] + u[k], 0.1 * x[k, 0] + 0.8 * x[k, 1])
        frames.append(pd.DataFrame({"c": f"run{i}", "t": np.arange(12.0), "x1": x[:, 0], "x2": x[:, 1], "u1": u}))
    return spark.createDataFrame(pd.concat(frames)).cache()


def test_compare_recommend_bootstrap(cases):
    labelled = S.split_by_fraction(cases, "c", 0.7).cache()
    assert {r["c"]: r["split"] for r in labelled.select("c", "split").distinct().collect()} == {
        "run0": "train", "run1": "train", "run2": "train", "run3": "test"}
    table, scores = sel.compare_models(labelled, SPEC, ["persistence", "mean", "dmdc", "ridge_dmdc", "adaptive", "pod_dmdc", "pod_ml"])
    rows = table.toPandas()
    assert len(rows) == 7 and rows["test_rmse"].is_monotonic_increasing
    train = labelled.where("split = 'train'")
    model = fit.fit_dmdc(fit.fit_transitions(train, SPEC), SPEC)
    alone = pred.rollout(labelled.where("split = 'test'"), SPEC, model).toPandas()
    want = np.sqrt(np.mean((alone[["x1", "x2"]].to_numpy() - alone[["pred_x1", "pred_x2"]].to_numpy()) ** 2))
    assert np.isclose(rows.set_index("model_name").loc["dmdc", "test_rmse"], want)
    best = sel.recommend(table).first()
    assert best["recommendation_status"] == "ok"
    ci = sel.bootstrap_ci(sel.errors_by(scores, "split", "c"), ["model_name", "split"], "rmse", n=50).toPandas()
    assert ((ci.ci_low <= ci["mean"] + 1e-12) & (ci["mean"] <= ci.ci_high + 1e-12)).all() and len(ci) == 14


def test_bootstrap_spans_what_resampling_spans(spark):
    rng = np.random.default_rng(21)
    frame = pd.DataFrame({"g": rng.choice(["a", "b"], 600), "v": rng.exponential(2.0, 600)})
    frame.loc[0, "g"], frame.loc[1, "v"] = None, np.nan
    got = {r.g: r for r in sel.bootstrap_ci(spark.createDataFrame(frame).repartition(4), ["g"], "v", n=400).collect()}
    again = {r.g: r for r in sel.bootstrap_ci(spark.createDataFrame(frame).repartition(4), ["g"], "v", n=400).collect()}
    for g in ("a", "b"):
        v = frame[frame.g == g].v.dropna().to_numpy()
        means = np.array([rng.choice(v, len(v)).mean() for _ in range(4000)])
        width = np.percentile(means, 97.5) - np.percentile(means, 2.5)
        assert got[g].n == len(v) and np.isclose(got[g]["mean"], v.mean()) and got[g] == again[g]
        assert abs(got[g].ci_low - np.percentile(means, 2.5)) < 0.2 * width and abs(got[g].ci_high - np.percentile(means, 97.5)) < 0.2 * width
    assert got[None].n == 1 and got[None].ci_low == got[None].ci_high
    whole = sel.bootstrap_ci(spark.createDataFrame(frame), [], "v", n=100).collect()
    assert len(whole) == 1 and whole[0].n == 599
    assert sel.bootstrap_ci(spark.createDataFrame(frame).limit(0), ["g"], "v").collect() == []


def test_bootstrap_covers_the_mean(spark):
    """Of intervals at 90 % over many samples about that share holds the true mean."""
    rng = np.random.default_rng(33)
    frame = pd.DataFrame({"g": np.repeat(np.arange(300), 60), "v": rng.normal(5.0, 1.0, 18_000)})
    rows = sel.bootstrap_ci(spark.createDataFrame(frame), ["g"], "v", n=200, confidence=0.9).collect()
    assert 0.83 < np.mean([r.ci_low <= 5.0 <= r.ci_high for r in rows]) < 0.95


def test_sweep_reports_failures(cases):
    labelled = S.split_by_fraction(cases, "c", 0.7).cache()
    sweep = sel.rank_delay_sweep(labelled, SPEC, models=("dmdc", "pod_dmdc"), pod_ranks=(2,), dmdc_ranks=(1, None), delays=(1, 2)).toPandas()
    assert len(sweep) == 8 and (sweep.status == "ok").all()
    assert sweep[sweep.status == "ok"].test_rmse.is_monotonic_increasing
    assert sweep.run_name.iloc[0].startswith("run_00")


def test_leave_one_out(cases):
    got = {r["c"]: r for r in sel.leave_one_out_scores(cases, SPEC).collect()}
    rest = fit.fit_dmdc(fit.fit_transitions(cases.where("c <> 'run1'"), SPEC), SPEC)
    steps = pred.one_step_table(cases.where("c = 'run1'"), SPEC, rest)
    assert np.isclose(got["run1"]["test_rmse"], M.one_step_rmse(steps, SPEC).first()["one_step_rmse"])
    assert len(got) == 4


def test_recommendation_filters(spark):
    table = spark.createDataFrame([("a", 0.1, "potentially_unstable"), ("b", 0.2, "stable"), ("n", None, "stable")],
                                  "model_name string, test_rmse double, stability_status string")
    assert sel.recommend(table).first()["model_name"] == "b"
    fallback = sel.recommend(table.where("model_name = 'a'")).first()
    assert fallback["model_name"] == "a" and fallback["used_fallback"]
    assert sel.recommend(table.where("model_name = 'n'")).first()["recommendation_status"] == "no_finite_error"
    assert sel.recommend(table.where("false")).first()["recommendation_status"] == "no_candidates"
    assert sel.recommend(table, "other").first()["recommendation_status"] == "missing_error_column"


def test_horizon_and_case_errors(cases):
    model = fit.fit_dmdc(fit.fit_transitions(cases, SPEC), SPEC)
    rolled = pred.rollout(cases, SPEC, model).cache()
    levels = M.evaluate_trajectories(rolled, SPEC).toPandas()
    assert (levels.level == "pooled").sum() == 1 and len(levels) == 5
    tail = M.horizon_errors(rolled, SPEC, (1, 5, 20)).toPandas()
    assert set(tail.horizon) == {1, 5} and len(tail) == 8
    frame = rolled.where("c = 'run2'").toPandas().sort_values("t").iloc[5:]
    want = np.sqrt(np.mean((frame[["x1", "x2"]].to_numpy() - frame[["pred_x1", "pred_x2"]].to_numpy()) ** 2))
    assert np.isclose(tail[(tail.c == "run2") & (tail.horizon == 5)].tail_rmse.iloc[0], want)


@pytest.mark.parametrize("kind, trees", [("random_forest", 7), ("gradient_boosting", 4)])
def test_flat_trees_equal_spark_step_by_step(spark, cases, kind, trees):
    from pyspark.ml.feature import VectorAssembler

    pod = fit.fit_pod(fit.fit_snapshots(cases, SPEC.states), SPEC.states, rank=2)
    steps = S.transitions(cases, SPEC)
    ensembles = TR.train_ensembles(steps, SPEC, pod, model_type=kind, trees=trees, seed=3)
    model = TR.TreeModel("pod_ml", list(SPEC.states), list(SPEC.inputs), pod, [TR.flatten(m) for m in ensembles])
    rolled = TR.rollout_trees(cases.repartition(5), SPEC, model).toPandas().sort_values(["c", "t"])
    frame = cases.toPandas().sort_values(["c", "t"])
    modal = [g[list(SPEC.states)].to_numpy(float)[:1] for _, g in frame.groupby("c")]
    modal = (np.concatenate(modal) - pod.mean) / pod.spread @ pod.modes
    assemble = VectorAssembler(inputCols=["a1", "a2", *SPEC.inputs], outputCol="features")
    for k in range(5):
        got = rolled[rolled._k == k][[f"pred_{s}" for s in SPEC.states]].to_numpy()
        assert np.allclose(got, modal @ pod.modes.T * pod.spread + pod.mean)
        u = frame.groupby("c").nth(k)[list(SPEC.inputs)].to_numpy(float)
        table = pd.DataFrame(np.column_stack([modal, u]), columns=["a1", "a2", *SPEC.inputs]).assign(row=range(len(modal)))
        features = assemble.transform(spark.createDataFrame(table))
        for m in ensembles:
            features = m.transform(features)
        modal = features.orderBy("row").select("pred_a1", "pred_a2").toPandas().to_numpy()
    assert len(rolled) == len(frame) and TR.rollout_trees(cases, SPEC, model, steps=3).count() == 4 * frame.c.nunique()
    one = TR.predict_next_trees(cases, SPEC, model).toPandas().sort_values(["c", "t"])
    first, second = rolled[rolled._k == 0], rolled[rolled._k == 1]
    assert len(one) == len(frame) and np.allclose(one[one.t.isin(first.t)].groupby("c").nth(0)["pred_x1"], second["pred_x1"])


def test_trees_without_case_and_null_case(spark):
    rows = [(c, float(t), 0.1 * t + (c or 0), float(t % 3)) for c in (1, 2, None) for t in range(12)]
    df = spark.createDataFrame(rows, "c int, t double, x double, u double")
    spec = TrajectorySpec(case="c", time="t", states=("x",), inputs=("u",))
    pod = fit.fit_pod(fit.fit_snapshots(df, ["x"]), ["x"], rank=1)
    model = TR.fit_tree_model(S.transitions(df, spec), spec, pod, trees=3)
    got = TR.rollout_trees(df, spec, model)
    assert got.count() == 36 and got.where("c is null").count() == 12 and got.where("pred_x is null").count() == 0
    alone = TrajectorySpec(time="t", states=("x",), inputs=("u",))
    part = df.where("c = 2").drop("c")
    want = [r.pred_x for r in got.where("c = 2").orderBy("t").collect()]
    assert np.allclose([r.pred_x for r in TR.rollout_trees(part, alone, model).orderBy("t").collect()], want)


def test_trees_by_name(cases):
    df = cases.withColumn("split", F.when(F.col("c") == "run1", "test").otherwise("train"))
    table, scores = sel.compare_models(df, SPEC, ["persistence", "dmdc", "pod_ml_rf"], pod_rank=2, trees=3)
    rows = {r.model_name: r for r in table.collect()}
    assert set(rows) == {"persistence", "dmdc", "pod_ml_rf"} and rows["pod_ml_rf"].test_rmse > 0
    assert rows["pod_ml_rf"].stability_status == "not_applicable" and rows["persistence"].stability_status == "baseline"
    swept = sel.rank_delay_sweep(df, SPEC, models=("dmdc", "pod_ml_gb"), pod_ranks=(1, 2), delays=(1, 2), trees=2).collect()
    assert len(swept) == 8 and all(r.status == "ok" and r.test_rmse is not None and r.newest_test_rmse is not None for r in swept)


def test_stability_and_delay_names():
    model = fit.LinearModel("dmdc", ["a"], [], np.array([[1.0]]), np.zeros((1, 0)), np.zeros(1))
    assert M.stability(model)["status"] == "marginal"
    assert len(M.eigenvalue_table(np.eye(3))) == 3
    assert sel.parse_rank("0.9") == 0.9 and sel.parse_rank("3") == 3 and sel.parse_rank("full") is None
