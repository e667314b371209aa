import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajmill.operators import bias as B, monitoring as mon

RESIDUALS = ("origin_time double, origin_row_index bigint, forecast_horizon_s double, effective_horizon_s double, "
             "target_time double, matched_time double, time_error_s double, state string, measured_value double, "
             "predicted_value double, residual double, abs_residual double")
ALERTS = ("time double, severity string, code string, state string, value double, threshold double, message string, "
          "suggested_action string")
TRUST = "time double, trust_score double, n_warning_alerts int, n_critical_alerts int"


def residual_rows(values, state="x1", horizon=0.2, t0=1.0):
    return [(t0 + i - 0.2, i, horizon, horizon, t0 + i, t0 + i, 0.0, state, v, 0.0, v, abs(v)) for i, v in enumerate(values)]


def test_residual_of_a_known_forecast(spark):
    clean = spark.createDataFrame([(0.0, 1.0), (0.2, 1.1), (0.4, 1.2)], "time double, x1 double")
    forecasts = spark.createDataFrame([(0.0, 0, 0.2, "x1", 1.05), (0.0, 0, 9.0, "x1", 1.0), (0.0, 0, 0.2, "zz", 1.0)],
                                      "origin_time double, origin_row_index bigint, forecast_horizon_s double, state string, predicted_value double")
    rows = mon.forecast_residuals(clean, forecasts, [], "time", ["x1"]).collect()
    assert len(rows) == 1 and np.isclose(rows[0]["residual"], 0.05) and rows[0]["matched_time"] == 0.2


def test_earlier_measurement_wins_a_tie(spark):
    clean = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "time double, x1 double")
    forecasts = spark.createDataFrame([(0.0, 1.5, "x1", 0.0)], "origin_time double, forecast_horizon_s double, state string, predicted_value double")
    row = mon.forecast_residuals(clean, forecasts, [], "time", ["x1"], tolerance=0.5).first()
    assert row["matched_time"] == 1.0 and row["residual"] == 10.0
    twice = spark.createDataFrame([(1.0, 7.0, 5), (1.0, 8.0, 3), (1.0, 1.0, 9)], "time double, x1 double, _stream_row_index bigint")
    assert mon.forecast_residuals(twice, forecasts, [], "time", ["x1"], tolerance=0.5).first()["measured_value"] == 8.0


def test_alerts_and_trust(spark):
    residuals = spark.createDataFrame(residual_rows([1.0, 6.0, -11.0]), RESIDUALS)
    clean = spark.createDataFrame([(1.0, 5.0), (2.0, 50.0)], "time double, q double")
    warnings = spark.createDataFrame([("DUPLICATE_LIVE_TIME", "m", "a")], "code string, message string, suggested_action string")
    estimates = spark.createDataFrame([(float(t), t, 3.0 * t, 100.0 * t) for t in range(5)],
                                      "origin_time double, origin_row_index bigint, covariance_trace double, x1 double")
    innovations = spark.createDataFrame([(1.0, 1, "x1", 7.0, 7.5), (1.0, 1, "x2", 1.0, 7.5)],
                                        "origin_time double, origin_row_index bigint, measurement string, innovation double, innovation_norm double")
    alerts = mon.build_alerts(residuals=residuals, clean=clean, warnings=warnings, estimates=estimates, innovations=innovations,
                              time="time", states=["x1"], operating_ranges={"q": (0, 10)}, innovation_norm_threshold=7.0,
                              covariance_trace_threshold=11.0, max_abs_value=350.0).cache()
    got = {(r["code"], r["severity"], r["time"]) for r in alerts.collect()}
    assert got == {("FORECAST_RESIDUAL_HIGH", "warning", 2.0), ("FORECAST_RESIDUAL_HIGH", "critical", 3.0),
                   ("KALMAN_INNOVATION_HIGH", "warning", 1.0), ("KALMAN_INNOVATION_NORM_HIGH", "warning", 1.0),
                   ("STATE_ESTIMATE_UNCERTAINTY_HIGH", "warning", 4.0), ("STATE_ESTIMATE_MAGNITUDE_HIGH", "critical", 4.0),
                   ("OPERATING_CONDITION_OUT_OF_RANGE", "warning", 2.0), ("BUFFER_DUPLICATE_LIVE_TIME", "warning", None)}
    ticks = estimates.select("origin_time").unionByName(spark.createDataFrame([(None,)], "origin_time double"))
    for target in (None, 2):
        trust = {r["time"]: r["trust_score"] for r in mon.trust_timeline(alerts, ticks, target_rows=target).collect()}
        assert {k: round(v, 9) for k, v in trust.items()} == {0.0: 1.0, 1.0: 0.8, 2.0: 0.6, 3.0: 0.35, 4.0: 0.0, None: 0.9}
    assert mon.summarize_monitoring(alerts, residuals, mon.trust_timeline(alerts, ticks)).first()["n_critical_alerts"] == 2


def test_bounded_bias(spark):
    residuals = spark.createDataFrame(residual_rows([2.0, 3.0, 4.0]), RESIDUALS)
    rules = B.BiasRules(learning_rate=0.5, max_step=0.4, max_abs_bias=0.7)
    empty_alerts, empty_trust = spark.createDataFrame([], ALERTS), spark.createDataFrame([], TRUST)
    events = B.bias_events(residuals, empty_alerts, empty_trust, rules=rules).orderBy("time").collect()
    assert [round(e["new_bias"], 9) for e in events] == [0.4, 0.7, 0.7]
    assert list(events[0].asDict()) == B.EVENT_COLUMNS


def test_low_trust_and_blocking_alerts(spark):
    residuals = spark.createDataFrame(residual_rows([50.0, 50.0, 50.0, 50.0, 50.0]), RESIDUALS)
    trust = spark.createDataFrame([(1.0, 0.2, 0, 0), (2.0, 0.9, 0, 0)], TRUST)
    alerts = spark.createDataFrame([(4.0, "Critical", "X", None, None, None, "", ""), (5.0, "warning", "OPERATING_CONDITION_OUT_OF_RANGE", None, None, None, "", "")], ALERTS)
    rules = B.BiasRules(learning_rate=1.0, max_step=0.25, max_abs_bias=0.4, clip_residual=1.0)
    events = B.bias_events(residuals, alerts, trust, rules=rules).orderBy("time").collect()
    assert [e["accepted"] for e in events] == [False, True, True, False, False]
    assert [e["rejection_reason"] for e in events] == ["trust_score_below_threshold", "accepted", "accepted",
                                                       "blocked_by_alert_severity_critical", "outside_training_or_operating_envelope"]
    assert [round(e["new_bias"], 9) for e in events] == [0.0, 0.25, 0.4, 0.4, 0.4]
    assert events[1]["residual_used"] == 1.0 and events[0]["residual_used"] is None


def test_corrections_do_not_leak_the_future(spark):
    events = spark.createDataFrame([(1.5, 1.0, 0.2, 0, "x1", 2.0, True), (0.5, 0.0, 0.2, 0, "x1", 9.0, False)],
                                   "time double, origin_time double, forecast_horizon_s double, origin_row_index bigint, state string, new_bias double, accepted boolean")
    forecasts = spark.createDataFrame([(float(t), 0.2, "x1", 10.0) for t in range(3)],
                                      "origin_time double, forecast_horizon_s double, state string, predicted_value double")
    for method, key in (("horizon_state_bias", "x1@0.2s"), ("state_bias", "x1")):
        rows = B.apply_bias(forecasts, events, method=method).orderBy("origin_time").collect()
        assert [r["applied_bias"] for r in rows] == [0.0, 0.0, 2.0] and rows[2]["bias_corrected_predicted_value"] == 12.0
        assert rows[0]["bias_key"] == key


@pytest.mark.parametrize("rate", [0.5, 0.01])
def test_hot_key_in_segments_equals_one_fold(spark, rate):
    rng = np.random.default_rng(2)
    rows = residual_rows(rng.normal(1.0, 3.0, 200).tolist()) + residual_rows(rng.normal(size=15).tolist(), "x2")
    residuals = spark.createDataFrame(rows, RESIDUALS)
    trust = spark.createDataFrame([(float(t), 0.5 if 60 < t < 120 else 0.9, 0, 0) for t in range(0, 200, 5)], TRUST)
    alerts, rules = spark.createDataFrame([], ALERTS), B.BiasRules(learning_rate=rate)
    got, want = (B.bias_events(residuals, alerts, trust, rules=rules, target_rows=n).orderBy("state", "time").toPandas() for n in (25, None))
    pd.testing.assert_frame_equal(got, want)
    bias = 0.0
    for r in want[want.state == "x1"].itertuples():
        if r.accepted:
            bias = float(np.clip(bias + np.clip(rate * (np.clip(r.raw_residual, -20, 20) - bias), -0.25, 0.25), -10, 10))
        assert np.isclose(bias, r.new_bias)
    assert (~want.accepted).sum() > 30


def test_adaptation_chain(spark):
    n = 60
    clean = spark.createDataFrame([(float(t), 5.0 + 0.01 * t) for t in range(n)], "time double, x1 double")
    forecasts = clean.select(F.col("time").alias("origin_time"), F.lit(0).cast("bigint").alias("origin_row_index"),
                             F.lit(2.0).alias("forecast_horizon_s"), F.lit(2.0).alias("effective_horizon_s"),
                             (F.col("time") + 2.0).alias("target_time"), F.lit("x1").alias("state"), (F.col("x1") - 2.0).alias("predicted_value"))
    tables = B.run_adaptation(clean, forecasts, forecasts, [], "time", ["x1"], rules=B.BiasRules(learning_rate=0.2))
    row = tables["comparison"].first()
    assert row["mean_abs_residual_improvement"] > 1.0 and row["n_raw"] == n - 2
    assert tables["by_state"].first()["n_accepted"] == n - 2 and tables["by_horizon"].count() == 1
    assert tables["bias_state"].columns[3] == "bias_value" and tables["bias_horizon"].count() == n - 2
