"""Bounded, auditable bias correction of forecasts."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.operators import monitoring as mon
from trajmill.operators.shaping import asof_backward, flags_at_time
from trajmill.plans.segments import SEGMENT, ordered_partitions, plan_layout
from trajmill.session import settle

EVENT_COLUMNS = [
    "time", "origin_time", "origin_row_index", "target_time", "matched_time", "forecast_horizon_s", "state",
    "measured_value", "raw_predicted_value", "raw_residual", "abs_raw_residual", "old_bias", "new_bias", "delta_bias",
    "residual_used", "trust_score", "accepted", "rejection_reason"]
ORDER = ["matched_time", "origin_time", "state", "forecast_horizon_s", "origin_row_index"]


@dataclass(frozen=True)
class BiasRules:
    """How fast and how far a bias may move, and when a residual may move it."""

    method: str = "horizon_state_bias"
    learning_rate: float = 0.01
    max_abs_bias: float = 10.0
    max_step: float = 0.25
    min_trust: float = 0.70
    clip_residual: float | None = 20.0
    blocked_severities: tuple[str, ...] = ("critical",)
    skip_outside_envelope: bool = True

    def __post_init__(self):
        if self.method not in ("state_bias", "horizon_state_bias"):
            raise ValueError(f"unknown bias method: {self.method!r}")
        for name in ("learning_rate", "min_trust"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")

    def key(self, keys) -> list[str]:
        return [*keys, "state", *(["forecast_horizon_s"] if self.method == "horizon_state_bias" else [])]


def lookup_trust(rows: DataFrame, trust: DataFrame, keys: list[str], time: str, target_rows: int | None = None) -> DataFrame:
    """Add the latest trust score at or before ``time``; before the first one the first counts, without any 1.0."""
    scores = trust.where(F.col("trust_score").isNotNull() & F.col("time").isNotNull()).select(*keys, "time", "trust_score")
    first = scores.groupBy(*keys).agg(F.min_by("trust_score", "time").alias("trust_score"))
    early = first.select(*keys, F.lit(float("-inf")).alias("time"), "trust_score")
    known = scores.unionByName(early).withColumnsRenamed({"time": "_trust_time"})
    found = asof_backward(rows, known, keys, time, "_trust_time", ["trust_score"], target_rows=target_rows)
    return found.withColumn("trust_score", F.coalesce("trust_score", F.lit(1.0)))


def update_decision(rows: DataFrame, alerts: DataFrame, keys: list[str], rules: BiasRules, time: str = "matched_time",
                    target_rows: int | None = None) -> DataFrame:
    """Add ``rejection_reason``; null means the residual may move the bias."""
    severity = F.lower("severity")
    blocked = sorted({s.lower() for s in rules.blocked_severities})
    flags = {f"_sev_{s}": severity == s for s in blocked}
    if rules.skip_outside_envelope:
        flags["_envelope"] = F.col("code") == "OPERATING_CONDITION_OUT_OF_RANGE"
    flagged = flags_at_time(rows, alerts.select(*keys, F.col("time").alias("_alert_time"), "severity", "code"), keys, time,
                            "_alert_time", flags, target_rows=target_rows) if flags else rows
    reason = F.when(F.col("trust_score") < rules.min_trust, "trust_score_below_threshold")
    if rules.skip_outside_envelope:
        reason = reason.when(F.col("_envelope"), "outside_training_or_operating_envelope")
    if blocked:
        hit = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_sev_{s}"), F.lit(s)) for s in blocked])), "+")
        reason = reason.when(hit != "", F.concat(F.lit("blocked_by_alert_severity_"), hit))
    return flagged.withColumn("rejection_reason", reason).drop(*flags)


def _moved(bias: float, residual: float, rules: BiasRules) -> float:
    step = rules.learning_rate * (residual - bias)
    step = min(max(step, -rules.max_step), rules.max_step)
    return min(max(bias + step, -rules.max_abs_bias), rules.max_abs_bias)


class BiasMap:
    """What a run of accepted updates makes of any starting bias: a rising piecewise-linear function, kept as its corners.

    One update moves a bias by at most ``max_step`` towards a residual and clips it, which has at most six corners. Such
    functions are closed under composition, so a run is one function. An update that adds corners also draws the results
    together, by up to twice the step, and one that adds none leaves the number as it is: a run has a few times max_abs_bias / max_step
    corners, and only two of one value as soon as its start no longer matters.
    """

    def __init__(self, rules: BiasRules, corners: list[float] | None = None, values: list[float] | None = None):
        self.rules = rules
        bound = float(rules.max_abs_bias)
        self.corners, self.values = corners or [-bound, bound], values or [-bound, bound]

    def update(self, residual: float) -> None:
        """Compose with one more accepted residual."""
        values, rules = self.values, self.rules
        if values[0] == values[-1]:
            self.corners, self.values = [self.corners[0], self.corners[-1]], [_moved(values[0], residual, rules)] * 2
            return
        for bend in _bends(residual, rules):
            if values[0] < bend < values[-1]:
                i = bisect_left(values, bend)
                if values[i] != bend:
                    share = (bend - values[i - 1]) / (values[i] - values[i - 1])
                    self.corners.insert(i, self.corners[i - 1] + share * (self.corners[i] - self.corners[i - 1]))
                    values.insert(i, bend)
        self.values = values = [_moved(v, residual, rules) for v in values]
        if len(values) > 8:  # corners inside a flat stretch say nothing
            keep = [i for i in range(len(values)) if i in (0, len(values) - 1) or not values[i - 1] == values[i] == values[i + 1]]
            self.corners, self.values = [self.corners[i] for i in keep], [values[i] for i in keep]

    def __call__(self, start: float) -> float:
        return float(np.interp(start, self.corners, self.values))


def _bends(residual: float, rules: BiasRules) -> list[float]:
    """Where one update changes its slope."""
    rate, step, bound = rules.learning_rate, rules.max_step, rules.max_abs_bias
    if rate == 0.0:
        return []
    low, high = residual - step / rate, residual + step / rate
    bends = {low, high, bound - step, step - bound}
    if rate < 1.0:
        bends |= {(bound - rate * residual) / (1.0 - rate), (-bound - rate * residual) / (1.0 - rate)}
    return sorted(bends)


def bias_events(residuals: DataFrame, alerts: DataFrame, trust: DataFrame, keys: list[str] = (),
                rules: BiasRules = BiasRules(), target_rows: int | None = None) -> DataFrame:
    """Audit log of every accepted or skipped update, 18 columns besides the keys.

    The bias of a key is an ordered fold with clipping. It runs as a stream over sorted partitions.
    A hot key is cut into time segments, and each segment is summarised by the function that it is of its start
    (``BiasMap``); one pass over the hot rows gives all functions, and following them gives every start.
    """
    keys, key = list(keys), rules.key(keys)
    judged = update_decision(lookup_trust(residuals, trust, keys, "matched_time", target_rows), alerts, keys, rules,
                             target_rows=target_rows)
    used = F.col("residual") if rules.clip_residual is None else F.greatest(
        F.lit(-abs(rules.clip_residual)), F.least(F.lit(abs(rules.clip_residual)), F.col("residual")))
    rows = judged.withColumns({"_used": used, "_ok": F.col("rejection_reason").isNull()})
    rows = settle(rows)  # the joins above are not repeated by the passes below
    layout = plan_layout(rows, key, "matched_time", target_rows)
    runs = [*key, SEGMENT]
    ordered = ordered_partitions(rows, layout, ORDER)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    starts = _segment_starts(ordered, layout, rules, runs, kinds)
    if starts is not None:
        ordered = ordered_partitions(layout.join_carry(layout.assign(rows), starts).drop(SEGMENT), layout, ORDER)
    seeded = starts is not None
    columns = [c for c in ordered.columns if c != "_start"]

    def fold(frames):
        last, bias = None, 0.0
        for frame in frames:
            used, ok = frame["_used"].to_numpy(float).tolist(), frame["_ok"].to_numpy(bool)
            start = frame["_start"].to_numpy(float) if seeded else np.zeros(len(frame))
            begins = np.flatnonzero(_changes(frame, runs, last))
            opening = dict(zip(begins.tolist(), np.nan_to_num(start[begins]).tolist()))
            new = np.empty(len(frame))
            old = np.empty(len(frame))
            # A bias only changes at accepted rows: those are folded, the others repeat what stands.
            stops = np.union1d(np.flatnonzero(ok), begins).tolist()
            at = 0
            for i in stops:
                old[at: i + 1], new[at:i] = bias, bias
                if i in opening:
                    bias = opening[i]
                    old[i] = bias
                if ok[i]:
                    bias = _moved(bias, used[i], rules)
                new[i], at = bias, i + 1
            old[at:], new[at:] = bias, bias
            if len(frame):
                last = _identity(frame, runs, len(frame) - 1)
            yield frame[columns].assign(_old=old, _new=new)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", _old double, _new double"
    done = ordered.mapInPandas(fold, schema)
    return done.select(
        *keys, F.col("matched_time").alias("time"), "origin_time", "origin_row_index", "target_time", "matched_time",
        "forecast_horizon_s", "state", "measured_value", F.col("predicted_value").alias("raw_predicted_value"),
        F.col("residual").alias("raw_residual"), F.col("abs_residual").alias("abs_raw_residual"),
        F.col("_old").alias("old_bias"), F.col("_new").alias("new_bias"),
        (F.col("_new") - F.col("_old")).alias("delta_bias"), F.when(F.col("_ok"), F.col("_used")).alias("residual_used"),
        "trust_score", F.col("_ok").alias("accepted"),
        F.coalesce("rejection_reason", F.lit("accepted")).alias("rejection_reason"))


def _identity(frame: pd.DataFrame, runs: list[str], row: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (frame[k].iat[row] for k in runs))


def _changes(frame: pd.DataFrame, runs: list[str], last) -> np.ndarray:
    change = np.zeros(len(frame), bool)
    for k in runs:
        codes, _ = pd.factorize(frame[k].to_numpy(), use_na_sentinel=False)
        change[1:] |= codes[1:] != codes[:-1]
    if len(frame):
        change[0] = last is None or _identity(frame, runs, 0) != last
    return change


def _segment_starts(ordered: DataFrame, layout, rules: BiasRules, runs: list[str], kinds: dict) -> DataFrame | None:
    """Start value of every segment of the hot keys, from one pass over their rows."""
    if not layout.split:
        return None

    def summarise(frames):
        last, made = None, None
        for frame in frames:
            used, ok = frame["_used"].to_numpy(float).tolist(), frame["_ok"].to_numpy(bool)
            begins = set(np.flatnonzero(_changes(frame, runs, last)).tolist())
            out = []
            for i in sorted(begins.union(np.flatnonzero(ok).tolist())):
                if i in begins:
                    if last is not None:
                        out.append((*last, made.corners, made.values))
                    last, made = _identity(frame, runs, i), BiasMap(rules)
                if ok[i]:
                    made.update(used[i])
            yield pd.DataFrame(out, columns=[*runs, "_corners", "_values"])
        if last is not None:
            yield pd.DataFrame([(*last, made.corners, made.values)], columns=[*runs, "_corners", "_values"])

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(SEGMENT).reset_index(drop=True)
        bias, starts = 0.0, []
        for corners, values in zip(frame["_corners"], frame["_values"]):
            starts.append(bias)
            bias = BiasMap(rules, list(corners), list(values))(bias)
        return frame[runs].assign(_start=starts)

    names = ", ".join(f"`{k}` {kinds[k]}" for k in runs)
    slim = layout.hot_rows(ordered).select(*dict.fromkeys([*runs, *ORDER]), "_used", "_ok")
    maps = slim.mapInPandas(summarise, f"{names}, _corners array<double>, _values array<double>")
    # At most 8,192 segments exist in all; those of one key meet in one small task.
    return settle(maps.groupBy(*runs[:-1]).applyInPandas(follow, f"{names}, _start double"))


def _format_number(c: Column) -> Column:
    whole = c == F.floor(c)
    return F.when(whole, F.floor(c).cast("string")).otherwise(F.round(c, 6).cast("string"))


def apply_bias(forecasts: DataFrame, events: DataFrame, keys: list[str] = (), method: str = "horizon_state_bias",
               target_rows: int | None = None) -> DataFrame:
    """Correct each forecast by the bias accepted at or before its origin; later residuals never leak in."""
    keys = list(keys)
    by = BiasRules(method=method).key(keys)
    history = events.where(F.col("accepted") & F.col("time").isNotNull()).select(
        *by, F.col("time").alias("_bias_time"), F.col("new_bias").alias("_bias"),
        F.struct("origin_time", "forecast_horizon_s", "origin_row_index").alias("_seq"))
    found = asof_backward(forecasts, history, by, "origin_time", "_bias_time", ["_bias"], order=("_seq",), target_rows=target_rows)
    bias = F.coalesce("_bias", F.lit(0.0))
    raw = F.col("predicted_value").cast("double")
    name = F.col("state") if method == "state_bias" else F.when(
        F.col("forecast_horizon_s").isNull(), F.col("state")).otherwise(
        F.concat("state", F.lit("@"), _format_number(F.col("forecast_horizon_s")), F.lit("s")))
    return found.withColumns({"raw_predicted_value": raw, "applied_bias": bias,
                              "bias_corrected_predicted_value": raw + bias, "bias_key": name}).drop("_bias")


def bias_state_timeseries(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    return events.select(*keys, "time", "state", "forecast_horizon_s", F.col("new_bias").alias("bias_value"),
                         "residual_used", "trust_score", F.col("accepted").alias("update_allowed"),
                         F.col("rejection_reason").alias("reason_if_skipped"))


def bias_horizon_timeseries(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    return events.select(*keys, "time", "forecast_horizon_s", "state", F.col("new_bias").alias("bias_value"),
                         "residual_used", F.col("accepted").alias("update_allowed"),
                         F.col("rejection_reason").alias("reason_if_skipped"))


def summarize_bias_by_state(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts, mean over horizons of the last accepted bias, and sizes, per state."""
    keys = list(keys)
    rank = F.struct("time", "origin_time", "forecast_horizon_s", "origin_row_index")
    per_horizon = events.groupBy(*keys, "state", "forecast_horizon_s").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("ok"),
        F.max_by("new_bias", F.when(F.col("accepted"), rank)).alias("_last"), F.max(F.abs("new_bias")).alias("_max"),
        F.sum("abs_raw_residual").alias("_sum"), F.count("abs_raw_residual").alias("_cnt"))
    return per_horizon.groupBy(*keys, "state").agg(
        F.sum("n").alias("n_events"), F.sum("ok").alias("n_accepted"), F.sum(F.col("n") - F.col("ok")).alias("n_skipped"),
        F.coalesce(F.avg(F.when(F.col("ok") > 0, F.col("_last"))), F.lit(0.0)).alias("final_bias_mean"),
        F.max("_max").alias("max_abs_bias"), (F.sum("_sum") / F.sum("_cnt")).alias("mean_abs_raw_residual"),
    ).orderBy(F.col("max_abs_bias").desc(), "state")


def summarize_bias_by_horizon(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    return events.groupBy(*keys, "forecast_horizon_s").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_skipped"), F.avg(F.abs("new_bias")).alias("mean_abs_bias"),
        F.avg("abs_raw_residual").alias("mean_abs_raw_residual")).orderBy("forecast_horizon_s")


def compare_errors(raw: DataFrame, corrected: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Residual sizes before and after correction per state and horizon (null-safe full outer join)."""
    by = [*keys, "state", "forecast_horizon_s"]

    def side(df, value, name, count):
        return df.groupBy(*by).agg(F.avg(value).alias(f"{name}_mean_abs_residual"), F.max(value).alias(f"{name}_max_abs_residual"),
                                   F.count(value).alias(count))

    left = side(raw, "abs_residual", "raw", "n_raw")
    right = side(corrected, "abs_bias_corrected_residual", "corrected", "n_corrected").withColumnsRenamed({c: f"_{c}" for c in by})
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    joined = left.join(right, on, "full_outer")
    return joined.select(
        *[F.coalesce(c, f"_{c}").alias(c) for c in by], "raw_mean_abs_residual", "raw_max_abs_residual", "n_raw",
        "corrected_mean_abs_residual", "corrected_max_abs_residual", "n_corrected",
        (F.col("raw_mean_abs_residual") - F.col("corrected_mean_abs_residual")).alias("mean_abs_residual_improvement"),
        (F.col("raw_max_abs_residual") - F.col("corrected_max_abs_residual")).alias("max_abs_residual_improvement"))


def corrected_residuals(clean: DataFrame, corrected: DataFrame, keys: list[str], time: str, measurements: list[str],
                        tolerance: float | None = None, target_rows: int | None = None) -> DataFrame:
    """Match corrected forecasts again; both residuals stand side by side."""
    matched = mon.forecast_residuals(clean, corrected, keys, time, measurements, tolerance=tolerance,
                                     predicted="bias_corrected_predicted_value",
                                     extra=("raw_predicted_value", "applied_bias"), target_rows=target_rows)
    renamed = matched.withColumnsRenamed({"predicted_value": "bias_corrected_predicted_value",
                                          "residual": "bias_corrected_residual", "abs_residual": "abs_bias_corrected_residual"})
    return renamed.withColumn("raw_residual", F.col("measured_value") - F.col("raw_predicted_value"))


def run_adaptation(clean: DataFrame, forecasts: DataFrame, ticks: DataFrame, keys: list[str], time: str,
                   measurements: list[str], *, rules: BiasRules = BiasRules(), tolerance: float | None = None,
                   alert_options: dict | None = None, tick_time: str = "origin_time") -> dict[str, DataFrame]:
    """Residuals -> alerts -> trust -> bias events -> corrected forecasts -> comparison, as one chain of tables."""
    # Matching is used by every later table: written once to the shared folder, not repeated.
    residuals = settle(mon.forecast_residuals(clean, forecasts, keys, time, measurements, tolerance=tolerance))
    alerts = mon.build_alerts(keys=keys, residuals=residuals, clean=clean, time=time, **(alert_options or {}))
    trust = mon.trust_timeline(alerts, ticks, keys, tick_time)
    events = settle(bias_events(residuals, alerts, trust, keys, rules))
    corrected = apply_bias(forecasts, events, keys, rules.method)
    again = corrected_residuals(clean, corrected, keys, time, measurements, tolerance)
    return {"residuals": residuals, "alerts": alerts, "trust": trust, "events": events,
            "bias_state": bias_state_timeseries(events, keys), "bias_horizon": bias_horizon_timeseries(events, keys),
            "corrected_forecasts": corrected, "corrected_residuals": again,
            "by_state": summarize_bias_by_state(events, keys), "by_horizon": summarize_bias_by_horizon(events, keys),
            "comparison": compare_errors(residuals, again, keys)}
