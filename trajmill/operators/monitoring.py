"""Forecast residuals, alerts and the trust score of live runs.

All functions take and return DataFrames and work over finished logs or inside foreachBatch. ``keys``
name the run or case columns; an empty list means the table is one run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trajmill.operators.quality import time_steps, percentiles
from trajmill.operators.shaping import asof_backward, nearest_match
from trajmill.plans.segments import join_null_safe, plan_layout, with_running
from trajmill.spec import TrajectorySpec

ALERT_COLUMNS = ["time", "severity", "code", "state", "value", "threshold", "message", "suggested_action"]


def match_tolerance(clean: DataFrame, keys: list[str], time: str, target_rows: int | None = None) -> DataFrame:
    """Default tolerance per run: 0.55 of the median positive step; 1e-9 where there is no step."""
    spec = TrajectorySpec(time=time, states=(), case=keys[0] if keys else None)
    if len(keys) > 1:
        raise ValueError("give at most one run column")
    steps = time_steps(clean, spec, target_rows)
    return percentiles(steps, keys, "dt", {"_median": 0.5}, target_rows).select(
        *keys, (F.col("_median") * 0.55).alias("_tolerance"))


def forecast_residuals(clean: DataFrame, forecasts: DataFrame, keys: list[str], time: str, measurements: list[str], *,
                       tolerance: float | None = None, predicted: str = "predicted_value",
                       extra: tuple[str, ...] = (), order: tuple[str, ...] = (),
                       target_rows: int | None = None) -> DataFrame:
    """Match each forecast with the nearest later measurement and take measured minus predicted.

    Matches farther away than the tolerance (inclusive) leave no row; of two equally near
    measurements the earlier one counts, and of measurements at one time the first in ``order`` (the
    arrival number where the log has one).
    """
    if not order and "_stream_row_index" in clean.columns:
        order = ("_stream_row_index",)
    rows = forecasts
    if "target_time" not in rows.columns:
        rows = rows.withColumn("target_time", F.col("origin_time") + F.col("forecast_horizon_s"))
    wanted = [m for m in measurements if m in clean.columns]
    rows = rows.where(F.col("target_time").isNotNull() & F.col("state").isin(wanted))
    if tolerance is None:
        limits = match_tolerance(clean, keys, time, target_rows)
        rows = join_null_safe(rows, limits, list(keys))
        rows = rows.withColumn("_tolerance", F.coalesce(F.col("_tolerance"), F.lit(1e-9)))
    else:
        rows = rows.withColumn("_tolerance", F.lit(float(tolerance)))
    measured = clean.select(*keys, F.col(time).alias("matched_time"), *order, *[F.col(m).alias(f"_m_{m}") for m in wanted])
    hit = nearest_match(rows, measured, keys, "target_time", "matched_time", [f"_m_{m}" for m in wanted],
                        F.col("_tolerance"), target_rows, order)
    value = F.coalesce(*[F.when(F.col("state") == m, F.col(f"_m_{m}").cast("double")) for m in wanted]) if wanted else F.lit(None)
    carried = [c if c in rows.columns else F.lit(None).alias(c) for c in
               ("origin_time", "origin_row_index", "forecast_horizon_s", "effective_horizon_s")]
    out = hit.select(*keys, *carried, "target_time", "matched_time", "time_error_s", "state",
                     value.alias("measured_value"), F.col(predicted).alias("predicted_value"), *extra)
    residual = F.col("measured_value") - F.col("predicted_value")
    return out.withColumns({"residual": residual, "abs_residual": F.abs(residual)})


def _alerts(rows: DataFrame, keys: list[str], code, *, time, severity, state, value, threshold, message, action) -> DataFrame:
    as_col = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return rows.select(*keys, as_col(time, "double").alias("time"), as_col(severity, "string").alias("severity"),
                       as_col(code, "string").alias("code"), as_col(state, "string").alias("state"),
                       as_col(value, "double").alias("value"), as_col(threshold, "double").alias("threshold"),
                       as_col(message, "string").alias("message"), as_col(action, "string").alias("suggested_action"))


def _graded(value: Column, threshold: float) -> Column:
    return F.when(value > 2.0 * threshold, "critical").otherwise("warning")


def alerts_residual_high(residuals: DataFrame, keys=(), threshold: float = 5.0) -> DataFrame:
    v = F.col("abs_residual")
    return _alerts(residuals.where(v > threshold), list(keys), "FORECAST_RESIDUAL_HIGH", time=F.col("matched_time"),
                   severity=_graded(v, threshold), state=F.col("state"), value=v, threshold=threshold,
                   message=F.concat(F.lit("Forecast of "), F.col("state"), F.lit(" is off by more than the limit.")),
                   action="Look for sensor drift, a new operating regime or a diverging model.")


def alerts_innovation_high(innovations: DataFrame, keys=(), threshold: float = 5.0) -> DataFrame:
    v = F.abs("innovation")
    return _alerts(innovations.where(v > threshold), list(keys), "KALMAN_INNOVATION_HIGH", time=F.col("origin_time"),
                   severity=_graded(v, threshold), state=F.col("measurement"), value=v, threshold=threshold,
                   message=F.concat(F.lit("Measurement "), F.col("measurement"), F.lit(" disagrees with the filter.")),
                   action="Check the noise settings and the sensor.")


def alerts_innovation_norm(innovations: DataFrame, keys=(), threshold: float | None = None) -> DataFrame | None:
    """One row per sample (its channels share the norm)."""
    if threshold is None:
        return None
    per_sample = innovations.groupBy(*keys, "origin_row_index").agg(
        F.min("origin_time").alias("origin_time"), F.first("innovation_norm", ignorenulls=True).alias("innovation_norm"))
    v = F.col("innovation_norm")
    return _alerts(per_sample.where(v > threshold), list(keys), "KALMAN_INNOVATION_NORM_HIGH", time=F.col("origin_time"),
                   severity="warning", state=None, value=v, threshold=threshold,
                   message="The innovation of all channels together is above the limit.",
                   action="See which channels contribute most.")


def alerts_uncertainty(estimates: DataFrame, keys=(), threshold: float | None = None) -> DataFrame | None:
    if threshold is None:
        return None
    v = F.col("covariance_trace")
    return _alerts(estimates.where(v > threshold), list(keys), "STATE_ESTIMATE_UNCERTAINTY_HIGH", time=F.col("origin_time"),
                   severity="warning", state=None, value=v, threshold=threshold,
                   message="The covariance trace of the estimate is above the limit.",
                   action="Measure more channels, or tune the noise settings, before using long forecasts.")


def alerts_magnitude(estimates: DataFrame, states: list[str], keys=(), bound: float | None = None) -> DataFrame | None:
    if bound is None:
        return None
    cells = F.array(*[F.struct(F.lit(s).alias("_s"), F.abs(F.col(s).try_cast("double")).alias("_v")) for s in states])
    long = estimates.select(*keys, "origin_time", F.inline(cells)).where(F.col("_v") > bound)
    return _alerts(long, list(keys), "STATE_ESTIMATE_MAGNITUDE_HIGH", time=F.col("origin_time"), severity="critical",
                   state=F.col("_s"), value=F.col("_v"), threshold=bound,
                   message=F.concat(F.lit("Estimate of "), F.col("_s"), F.lit(" is above its bound.")),
                   action="Check scaling, units and the stability of the model.")


def alerts_operating_range(clean: DataFrame, time: str | None, ranges: dict[str, tuple[float, float]], keys=()) -> DataFrame | None:
    known = {c: b for c, b in (ranges or {}).items() if c in clean.columns}
    if not known:
        return None
    cells = F.array(*[F.struct(F.lit(c).alias("_s"), F.col(c).cast("double").alias("_v"), F.lit(float(lo)).alias("_lo"),
                               F.lit(float(hi)).alias("_hi")) for c, (lo, hi) in known.items()])
    base = clean.select(*keys, (F.col(time) if time else F.lit(None)).cast("double").alias("_t"), F.inline(cells))
    outside = base.where((F.col("_v") < F.col("_lo")) | (F.col("_v") > F.col("_hi")))
    return _alerts(outside, list(keys), "OPERATING_CONDITION_OUT_OF_RANGE", time=F.col("_t"), severity="warning",
                   state=F.col("_s"), value=F.col("_v"), threshold=None,
                   message=F.concat(F.col("_s"), F.lit(" is outside its configured range.")),
                   action="Treat forecasts as extrapolation, or train on this regime too.")


def alerts_buffer(warnings: DataFrame, keys=()) -> DataFrame:
    return _alerts(warnings, list(keys), F.concat(F.lit("BUFFER_"), F.col("code")), time=None, severity="warning",
                   state=None, value=None, threshold=None, message=F.col("message"), action=F.col("suggested_action"))


def build_alerts(*, keys=(), residuals: DataFrame | None = None, innovations: DataFrame | None = None,
                 estimates: DataFrame | None = None, clean: DataFrame | None = None, warnings: DataFrame | None = None,
                 time: str | None = None, states: list[str] = (), residual_threshold: float = 5.0,
                 innovation_threshold: float = 5.0, innovation_norm_threshold: float | None = None,
                 covariance_trace_threshold: float | None = None, max_abs_value: float | None = None,
                 operating_ranges: dict | None = None) -> DataFrame:
    """All alerts of a run in one table."""
    keys = list(keys)
    parts = [
        residuals is not None and alerts_residual_high(residuals, keys, residual_threshold),
        innovations is not None and alerts_innovation_high(innovations, keys, innovation_threshold),
        innovations is not None and alerts_innovation_norm(innovations, keys, innovation_norm_threshold),
        estimates is not None and alerts_uncertainty(estimates, keys, covariance_trace_threshold),
        estimates is not None and alerts_magnitude(estimates, list(states), keys, max_abs_value),
        clean is not None and alerts_operating_range(clean, time, operating_ranges, keys),
        warnings is not None and alerts_buffer(warnings, keys),
    ]
    parts = [p for p in parts if isinstance(p, DataFrame)]
    if not parts:
        raise ValueError("no monitoring signal given")
    return reduce(lambda a, b: a.unionByName(b), parts)


def trust_timeline(alerts: DataFrame, ticks: DataFrame | None = None, keys=(), time: str = "origin_time", *,
                   warning_penalty: float = 0.10, critical_penalty: float = 0.25,
                   target_rows: int | None = None) -> DataFrame:
    """Trust at each tick: 1 minus penalties for all alerts up to that time, never below 0.

    ``ticks`` are the estimates of the run; without them the alerts are the ticks, and without alerts
    either there is one row of full trust (for a table without keys). A
    tick without a time counts the alerts without a time. Alerts are counted per time and summed up
    before the ticks look up their time, so neither many alerts nor many ticks at one time pile up.
    """
    keys = list(keys)
    if ticks is None or ticks.isEmpty():
        if not keys and alerts.isEmpty():
            return alerts.sparkSession.createDataFrame(
                [(None, 1.0, 0, 0)], "time double, trust_score double, n_warning_alerts int, n_critical_alerts int")
        ticks = alerts.select(*keys, F.col("time").alias(time))
    by = [*keys, "_timeless"]
    moment = {"_timeless": F.col("time").isNull(), "_at": F.coalesce(F.col("time"), F.lit(0.0))}
    asked = ticks.select(*keys, F.col(time).cast("double").alias("time")).withColumns(moment)
    counted = alerts.groupBy(*keys, F.col("time").cast("double").alias("time")).agg(
        F.count_if(F.col("severity") == "warning").alias("_w"), F.count_if(F.col("severity") == "critical").alias("_c"))
    counted = counted.withColumns(moment).select(*by, F.col("_at").alias("_since"), "_w", "_c")
    layout = plan_layout(counted, by, "_since", target_rows)
    counts = ["n_warning_alerts", "n_critical_alerts"]
    so_far = with_running(counted, layout, ["_since"], total=dict(zip(counts, (F.col("_w"), F.col("_c")))))
    seen = asof_backward(asked, so_far.drop("_w", "_c"), by, "_at", "_since", counts, slack=0.0, target_rows=target_rows)
    seen = seen.fillna(0, counts)
    score = 1.0 - F.col("n_warning_alerts") * warning_penalty - F.col("n_critical_alerts") * critical_penalty
    return seen.select(*keys, "time", F.greatest(F.lit(0.0), score).alias("trust_score"),
                       *[F.col(c).cast("int").alias(c) for c in counts])


def summarize_monitoring(alerts: DataFrame, residuals: DataFrame, trust: DataFrame, keys=()) -> DataFrame:
    """Counts and the final trust score per run."""
    keys = list(keys)
    sides = [
        alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_alerts"),
                                  F.count_if(F.col("severity") == "warning").alias("n_warning_alerts"),
                                  F.count_if(F.col("severity") == "critical").alias("n_critical_alerts")),
        residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_residual_rows"), F.avg("abs_residual").alias("mean_abs_residual"),
                                     F.max("abs_residual").alias("max_abs_residual")),
    ]
    out = trust.groupBy(*keys).agg(F.max_by("trust_score", "time").alias("final_trust_score"))
    for side in sides:
        out = join_null_safe(out, side, keys)
    counts = ["n_alerts", "n_warning_alerts", "n_critical_alerts", "n_residual_rows"]
    return out.fillna(0, counts).fillna(1.0, ["final_trust_score"])
