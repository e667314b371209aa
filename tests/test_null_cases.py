"""Rows of a null case and tied times survive in every layout; merges have bounded fan-in."""

import numpy as np
from pyspark.sql import functions as F

from trajmill import TrajectorySpec
from trajmill.operators import fitting as fit, monitoring as mon, prediction as pred, quality as Q, selection as sel, shaping as S
from trajmill.streaming import buffer as BUF

SPEC = TrajectorySpec(case="c", time="time", states=("x",))


def table(spark):
    rows = [(c, float(i // 2), float((i * 7 + j) % 5)) for j, c in enumerate(["a", None, "b"]) for i in range(40)]
    return spark.createDataFrame(rows, "c string, time double, x double")


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_resampling_is_equal_in_both_layouts(spark):
    plain = rows(S.resample_linear(table(spark), SPEC, 0.5))
    assert plain == rows(S.resample_linear(table(spark), SPEC, 0.5, target_rows=7))
    assert sum(r[0] is None for r in plain) == 39


def test_live_checks_and_buffer_keep_null_cases(spark):
    log = table(spark).withColumns({"_stream_row_index": F.xxhash64("c", "time", "x"), "_stream_source": F.lit("s"), "_received_utc": F.lit("u")})
    for target in (None, 7):
        checked = BUF.check_table(log, SPEC, target)
        assert checked.count() == 120 and checked.where("c is null").count() == 40
    kept = BUF.trim(log, SPEC, max_samples=5)
    assert kept.where("c is null").count() == 5
    assert BUF.buffer_summary(log, SPEC).where("c is null").first()["median_dt"] is not None


def test_persistence_keeps_null_cases(spark):
    assert pred.rollout_persistence(table(spark), SPEC).where("c is null").count() == 40


def test_missing_times_are_no_duplicates(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0),
                                ("n", float("nan"), 1.0), ("n", float("nan"), 1.0), ("n", 2.0, 1.0)], "c string, time double, x double")
    problems = {r["case_id"]: r["problems"] for r in Q.case_quality(df, SPEC).collect()}
    assert problems == {"a": "", "b": "nonmonotonic_or_duplicate_time", "n": ""}


def test_merge_tree_has_bounded_fan_in(spark):
    partial = fit.merge_tree_level(spark.range(0, 1000, 1, 1000), F.spark_partition_id())
    sizes = [r["count"] for r in partial.groupBy("_g").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= fit.FAN_IN and len(sizes) == -(-1000 // fit.FAN_IN)
    df = table(spark).repartition(50).withColumn("y", F.col("x") * 2 + F.col("time"))
    one = fit.factors(df, ["x", "y"]).collect()
    assert len(one) == 1 and one[0]["n_rows"] == 120
    r = np.array(one[0]["r"]).reshape(-1, 3)
    x = np.array([[1.0, a, b] for a, b in df.select("x", "y").collect()])
    assert np.allclose(r.T @ r, x.T @ x)
    keyed = fit.factors(df, ["x", "y"], ["c"]).collect()
    assert sorted((str(k["c"]), k["n_rows"]) for k in keyed) == [("None", 40), ("a", 40), ("b", 40)]


def test_trust_without_estimates(spark):
    alerts = spark.createDataFrame([(1.0, "warning"), (2.0, "critical"), (None, "warning")], "time double, severity string")
    got = {r["time"]: round(r["trust_score"], 9) for r in mon.trust_timeline(alerts).collect()}
    assert got == {1.0: 0.9, 2.0: 0.65, None: 0.9}
    assert [tuple(r) for r in mon.trust_timeline(alerts.limit(0)).collect()] == [(None, 1.0, 0, 0)]


def test_bootstrap_of_a_metric(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("t"), (F.col("id") % 7 + F.col("id") % 3 - 1).cast("double").alias("p"))
    row = sel.bootstrap_metric(df, [], "t", "p", "rmse", n=100).first()
    assert row["ci_low"] <= row["mean"] <= row["ci_high"] and abs(row["mean"] - (2 / 3) ** 0.5) < 0.01


def test_baselines_and_delays_are_swept(spark):
    base = np.array([[0.9, 0.1], [-0.2, 0.8]])
    data = []
    for c in range(6):
        x = np.array([1.0 + c, -1.0])
        for k in range(12):
            data.append((f"r{c}", float(k), *x.tolist()))
            x = base @ x
    spec = TrajectorySpec(case="c", time="time", states=("x1", "x2"))
    labelled = S.split_by_fraction(spark.createDataFrame(data, "c string, time double, x1 double, x2 double"), "c", 0.5)
    out = sel.rank_delay_sweep(labelled, spec, models=("dmdc", "persistence", "mean", "pod_dmdc"), pod_ranks=(2,), delays=(1, 2)).toPandas()
    assert len(out) == 8 and (out.status == "ok").all()
    one = out[(out.n_delays == 1)].set_index("model")
    assert np.allclose(one.test_rmse, one.newest_test_rmse) and one.loc["dmdc", "test_rmse"] < 1e-8
    plain = pred.rollout_persistence(labelled.where("split = 'test'"), spec).toPandas()
    want = np.sqrt(np.mean((plain[["x1", "x2"]].to_numpy() - plain[["pred_x1", "pred_x2"]].to_numpy()) ** 2))
    assert np.isclose(one.loc["persistence", "test_rmse"], want)
