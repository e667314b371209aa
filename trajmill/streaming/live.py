"""Live runs: ingestion, forecasts, filtering and bias on streams."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajmill.functions import linalg as L
from trajmill.operators.fitting import LinearModel, measurement_matrix
from trajmill.operators.prediction import DEFAULT_HORIZONS, forecast, innovations_long
from trajmill.session import shared_folder
from trajmill.sources.archive import write_together
from trajmill.spec import TrajectorySpec
from trajmill.streaming.buffer import (
    BACKWARDS, BUCKET, CASE, REPEATED, SEQ, bucketed, buffer_warnings, case_runs, check_stream, clean_rows, dealt, gather, in_order, latest_rows, packed,
    unpacked)
from trajmill.streaming.inputs import run_until_done


def ingest(stream: DataFrame, spec: TrajectorySpec, root: str, run_id: str, checkpoint: str, *,
           model: LinearModel | None = None, horizons=DEFAULT_HORIZONS, dt: float | None = None,
           newest_only: bool = False, remember_seconds: float = 3600.0, timeout: float | None = None):
    """Read, check and archive a stream: raw rows, clean rows, warnings and (with a model) forecasts.

    Every table of an epoch is a write of its own in the run's archive, so a repeated epoch replaces
    itself. ``newest_only`` forecasts from the newest clean row of each batch instead of all rows.
    """
    checked = check_stream(stream, spec, remember_seconds)

    def tables(batch: DataFrame):
        clean = clean_rows(batch)
        yield batch.drop("_code"), "raw_stream", spec.time
        yield clean, "cleaned_stream", spec.time
        yield buffer_warnings(batch, spec.keys), "warnings", None
        if model is not None:
            rows = latest_rows(clean, spec) if newest_only else clean
            yield forecast(rows, model, spec.time, horizons, dt=dt, keys=spec.keys, row_index=SEQ, received="_received_utc"), "forecasts", "origin_time"

    sink = _archiving(stream, tables, root, run_id)
    return run_until_done(checked, sink, checkpoint, timeout=timeout)


def _archiving(stream: DataFrame, tables, root: str, run_id: str):
    """What a run does with an epoch: its rows are written once, and its tables made from there in the caller's session.

    So the state moves on once per epoch. A stream's own session has no adaptive plans; there each task would write a file for each of its hours, as
    the rebalancing of ``write_records`` is left out. Each epoch takes the place of the one before.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/epoch-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(batch.schema).parquet(path)
        write_together(list(tables(rows)), root, run_id, f"epoch-{epoch:08d}")
    return sink


class _PODKalman(StatefulProcessor):
    """Modal states of the cases of a bucket and how many rows each has filtered; a case's first row starts from the pseudo-inverse.

    Gains and covariances depend on the number of the row only (``RiccatiScan``), so a case's state is one vector and one number, and the rows of
    all cases of a micro-batch are one scan over their matrices.
    """

    def __init__(self, given: list[str], model: LinearModel, measurements: list[str], q: float, r: float, p0: float):
        self.given = given
        pod = model.pod
        chosen = [pod.states.index(c) for c in measurements]
        self.model, self.measurements = model, measurements
        self.h, self.shift = measurement_matrix(pod, chosen), pod.mean[chosen]
        k = pod.rank
        self.schedule = L.RiccatiScan(model.a, self.h, np.eye(k) * q, np.eye(len(chosen)) * r, np.eye(k) * p0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "cases binary")

    def handleInputRows(self, key, rows, timerValues):
        frames, order = in_order(rows, self.given)
        whole = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in {*self.measurements, *self.model.inputs, "_code", CASE} & set(self.given)}
        if "_code" in whole:  # rows with a problem in their values pass without an estimate
            order = order[[code is None or pd.isna(code) or code in (BACKWARDS, REPEATED) for code in whole["_code"][order]]]
        out = np.full((sum(map(len, frames)), len(self.columns()) - 1), np.nan)
        started = np.zeros(len(out), bool)
        if len(order):
            modes = [f"a{i + 1}" for i in range(self.model.pod.rank)]
            held = self.state.get()
            cases = unpacked(held[0]) if held is not None else pd.DataFrame({"case": [], "rows": [], **{c: [] for c in modes}})
            # Only the rows to filter are dealt to cases, so a case begins with its first sound row.
            place, case, rank, names = case_runs(whole[CASE][order], np.arange(len(order)), pd.Index(cases["case"], dtype=object))
            order, added = order[place], len(names) - len(cases)
            count = np.append(cases["rows"], np.zeros(added)).astype(np.int64)
            before = np.vstack([cases[modes].to_numpy(float), np.zeros((added, len(modes)))])
            y = np.column_stack([whole[c][order].astype(float) for c in self.measurements]) - self.shift
            u = np.column_stack([whole[c][order].astype(float) for c in self.model.inputs]) if self.model.inputs else np.zeros((len(order), 0))
            out[order], x = self._filter(y, u, before[case], count[case], rank)
            started[order] = count[case] + rank == 0
            end = np.append(case[1:] != case[:-1], True)
            before[case[end]] = x[end]
            count += np.bincount(case, minlength=len(names))
            self.state.update((packed(pd.DataFrame({"case": names, "rows": count, **dict(zip(modes, before.T))})),))
        for (frame, values), (_, flags) in zip(dealt(out, frames), dealt(started, frames)):
            estimates = pd.DataFrame(values, columns=self.columns()[:-1]).assign(initialized_from_measurement=flags)
            yield pd.concat([frame.drop(columns=[c for c in frame.columns if c in estimates.columns]), estimates], axis=1)

    def _filter(self, y: np.ndarray, u: np.ndarray, before: np.ndarray, count: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output columns and modal states of rows that lie case after case; ``before`` and ``count`` are the state of a row's case."""
        m, pod, h = self.model, self.model.pod, self.h
        numbers = count + rank
        steps, at = np.unique(numbers, return_inverse=True)
        gains, covariances = (part[at] for part in self.schedule.at(steps))
        drive = u @ m.b.T + m.offset
        keep = np.eye(pod.rank) - gains @ h
        forcing = np.einsum("kij,kj->ki", keep, drive) + np.einsum("kij,kj->ki", gains, y)
        first = rank == 0
        new, on = np.flatnonzero(numbers == 0), np.flatnonzero(first & (count > 0))
        opening = y[new] @ np.linalg.pinv(h).T
        forcing[new] = opening + np.einsum("kij,kj->ki", gains[new], y[new] - opening @ h.T)
        carried = before[on] @ m.a.T
        forcing[on] += np.einsum("kij,kj->ki", keep[on], carried)
        x = L.varying_scan(keep @ m.a, forcing, first)
        prior = np.empty_like(x)
        prior[1:] = x[:-1] @ m.a.T + drive[1:]
        prior[new], prior[on] = opening, carried + drive[on]
        innovation = y - prior @ h.T
        full = x @ pod.decoder().T + pod.mean
        variances = np.diagonal(covariances, axis1=1, axis2=2)
        return np.column_stack([full, x, variances.sum(axis=1), np.linalg.norm(innovation, axis=1), innovation, variances]), x

    def columns(self) -> list[str]:
        k = range(1, self.model.pod.rank + 1)
        return [*[f"est_{c}" for c in self.model.pod.states], *[f"a{i}" for i in k], "covariance_trace", "innovation_norm",
                *[f"innovation_{c}" for c in self.measurements], *[f"var_a{i}" for i in k], "initialized_from_measurement"]

    def close(self) -> None:
        pass


def estimate_stream(clean: DataFrame, spec: TrajectorySpec, model: LinearModel, measurements: list[str], *,
                    process_noise: float = 1e-6, measurement_noise: float = 1e-3, initial_covariance: float = 1.0,
                    carry: list[str] = ()) -> DataFrame:
    """Filter every row of a stream into full states, with the state of every case kept by bucket.

    Rows are taken in the order of their arrival number. Where the rows carry ``_code`` those with a problem in their values pass without an estimate.
    ``carry`` names further columns to keep.
    """
    for name, value in (("process_noise", process_noise), ("measurement_noise", measurement_noise),
                        ("initial_covariance", initial_covariance)):
        if not value > 0:
            raise ValueError(f"{name} must be positive")
    keep = list(dict.fromkeys([*spec.keys, spec.time, *measurements, *model.inputs, SEQ, "_received_utc", *carry]))
    keyed = bucketed(clean.select(*keep), spec.case)
    processor = _PODKalman(keyed.columns, model, list(measurements), process_noise, measurement_noise, initial_covariance)
    fields = [*[f for f in keyed.schema.fields if f.name not in processor.columns()],
              *[T.StructField(c, T.BooleanType() if c.startswith("initialized") else T.DoubleType()) for c in processor.columns()]]
    out = keyed.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType(fields), outputMode="Append", timeMode="None")
    return out.drop(CASE, BUCKET)


def run_estimation(stream: DataFrame, spec: TrajectorySpec, root: str, run_id: str, checkpoint: str, model: LinearModel,
                   measurements: list[str], *, horizons=None, dt: float | None = None, process_noise: float = 1e-6,
                   measurement_noise: float = 1e-3, initial_covariance: float = 1.0, remember_seconds: float = 3600.0, **limits):
    """Read, check, filter and archive a stream as one run: two chained stateful operators, one query.

    The stream holds the measured states and the inputs only; the model's other states are estimated. Tables of each epoch: raw_stream,
    cleaned_stream, warnings, state_estimates, modal_estimates, estimate_covariance, kalman_innovations and, with ``horizons``, forecasts from
    the filtered states. A repeated epoch replaces itself. ``limits`` go to ``run_until_done``.
    """
    measured = spec.with_states(measurements)
    checked = check_stream(stream, measured, remember_seconds)
    given = list(checked.columns)
    estimated = estimate_stream(checked, measured, model, measurements, process_noise=process_noise, measurement_noise=measurement_noise,
                                initial_covariance=initial_covariance, carry=given)
    pod = model.pod
    modal = [f"a{i + 1}" for i in range(pod.rank)]
    about = [*spec.keys, spec.time, SEQ, "_received_utc"]

    def tables(batch: DataFrame):
        clean = clean_rows(batch)
        yield batch.select(*[c for c in given if c != "_code"]), "raw_stream", spec.time
        yield clean.select(*[c for c in given if c != "_code"]), "cleaned_stream", spec.time
        yield buffer_warnings(batch, spec.keys), "warnings", None
        yield clean.select(*about, *[F.col(f"est_{c}").alias(c) for c in pod.states], "initialized_from_measurement"), "state_estimates", spec.time
        yield clean.select(*about, *modal), "modal_estimates", spec.time
        yield clean.select(*about, "covariance_trace", *[f"var_{c}" for c in modal]), "estimate_covariance", spec.time
        rows = clean.withColumn("origin_row_index", F.col(SEQ))
        yield innovations_long(rows, spec.keys, spec.time, list(measurements)), "kalman_innovations", "origin_time"
        if horizons is not None:
            yield forecast_estimates(clean, model, spec, horizons, dt), "forecasts", "origin_time"

    return run_until_done(estimated, _archiving(stream, tables, root, run_id), checkpoint, **limits)


def forecast_estimates(estimates: DataFrame, model: LinearModel, spec: TrajectorySpec, horizons=DEFAULT_HORIZONS,
                       dt: float | None = None) -> DataFrame:
    """Forecasts from filtered states instead of raw measurements."""
    full = model.pod.states if model.pod is not None else model.states
    renamed = estimates.drop(*[c for c in full if c in estimates.columns]).withColumnsRenamed({f"est_{c}": c for c in full})
    return forecast(renamed, model, spec.time, horizons, dt=dt, keys=spec.keys, row_index=SEQ, received="_received_utc",
                    origin_type="pod_kalman_filtered_state")


class _BiasFold(StatefulProcessor):
    """Current bias of one key; residuals of a batch are folded in event order."""

    def __init__(self, columns: list[str], rules):
        self.columns, self.rules = columns, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bias", "value double")

    def handleInputRows(self, key, rows, timerValues):
        from trajmill.operators.bias import ORDER, _moved

        frame = gather(rows, self.columns)
        frame = frame.sort_values([c for c in ORDER if c in frame.columns], kind="stable").reset_index(drop=True)
        limit = self.rules.clip_residual
        used = frame["residual"] if limit is None else frame["residual"].clip(-abs(limit), abs(limit))
        bias = self.state.get()[0] if self.state.exists() else 0.0
        moved = np.full(len(frame), np.nan)  # a bias changes at accepted rows only
        for i in np.flatnonzero(frame["accepted"].to_numpy(bool)):
            moved[i] = bias = _moved(bias, float(used.iat[i]), self.rules)
        new = pd.Series(moved).ffill().fillna(self.state.get()[0] if self.state.exists() else 0.0)
        old = new.shift(1, fill_value=self.state.get()[0] if self.state.exists() else 0.0)
        self.state.update((float(bias),))
        yield frame.assign(old_bias=old.to_numpy(), new_bias=new.to_numpy())

    def close(self) -> None:
        pass


def bias_stream(decided: DataFrame, keys: list[str], rules) -> DataFrame:
    """Bias updates on a stream of residuals that carry ``accepted``; one keyed state per state and horizon."""
    schema = T.StructType([*decided.schema.fields, T.StructField("old_bias", T.DoubleType()), T.StructField("new_bias", T.DoubleType())])
    return decided.groupBy(*rules.key(keys)).transformWithStateInPandas(
        statefulProcessor=_BiasFold(decided.columns, rules), outputStructType=schema, outputMode="Append", timeMode="None")


class _NearestMatch(StatefulProcessor):
    """Open forecasts of one run and channel, and the measurements that one of them may still be nearest to.

    A forecast leaves by a timer, when the watermark has passed its target and the tolerance; a measurement is forgotten when no open or coming
    target reaches it.
    """

    LISTS = ("m_at", "m_value", "f_at", "f_value", "f_origin", "f_horizon")

    def __init__(self, given: list[str], keys: list[str], tolerance: float):
        self.given, self.keys, self.tolerance = given, keys, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", ", ".join(f"{c} array<double>" for c in self.LISTS))

    def _load(self) -> dict[str, np.ndarray]:
        held = self.state.get() if self.state.exists() else [[]] * len(self.LISTS)
        return {c: np.asarray(v, float) for c, v in zip(self.LISTS, held)}

    def _store(self, held: dict[str, np.ndarray], watermark: float) -> None:
        useful = held["m_at"] >= min(watermark, held["f_at"].min(initial=np.inf)) - self.tolerance
        held["m_at"], held["m_value"] = held["m_at"][useful], held["m_value"][useful]
        self.state.update(tuple(held[c].tolist() for c in self.LISTS))
        if len(held["f_at"]):
            self.handle.registerTimer(max(int((held["f_at"].min() + self.tolerance) * 1000) + 1, int(watermark * 1000) + 1))

    def handleInputRows(self, key, rows, timerValues):
        held = self._load()
        for frame in rows:
            frame.columns = self.given
            asks = frame["_asks"].to_numpy(bool)
            for mine, names in ((~asks, ("m_at", "m_value")), (asks, ("f_at", "f_value", "f_origin", "f_horizon"))):
                for name, column in zip(names, ("_at", "_value", "origin_time", "forecast_horizon_s")):
                    held[name] = np.concatenate([held[name], frame[column].to_numpy(float)[mine]])
        self._store(held, timerValues.getCurrentWatermarkInMs() / 1000.0)
        yield pd.DataFrame(columns=self.names())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, watermark = self._load(), timerValues.getCurrentWatermarkInMs() / 1000.0
        ripe = held["f_at"] + self.tolerance < watermark
        target = held["f_at"][ripe]
        order = np.argsort(held["m_at"], kind="stable")
        at, value = held["m_at"][order], held["m_value"][order]
        if len(at) and len(target):
            after = np.searchsorted(at, target)
            low, high = np.maximum(after - 1, 0), np.minimum(after, len(at) - 1)
            near = np.where(np.abs(at[low] - target) <= np.abs(at[high] - target), low, high)  # the earlier of two equally near
            near = np.searchsorted(at, at[near])  # the first that came of equal times
            hit = np.abs(at[near] - target) <= self.tolerance
            out = {c: held[c][ripe][hit] for c in ("f_origin", "f_horizon", "f_at", "f_value")}
            yield pd.DataFrame(dict(zip(self.names(), [
                *[[k] * int(hit.sum()) for k in key], out["f_origin"], out["f_horizon"], out["f_at"], at[near][hit], value[near][hit],
                out["f_value"], value[near][hit] - out["f_value"]])))
        else:
            yield pd.DataFrame(columns=self.names())
        for name in ("f_at", "f_value", "f_origin", "f_horizon"):
            held[name] = held[name][~ripe]
        self._store(held, watermark)

    def names(self) -> list[str]:
        return [*self.keys, "origin_time", "forecast_horizon_s", "_target", "_matched", "measured_value", "predicted_value", "residual"]

    def close(self) -> None:
        pass


def residual_stream(clean: DataFrame, forecasts: DataFrame, keys: list[str], time_ts: str, target_ts: str,
                    measurements: list[str], tolerance_seconds: float, max_delay: str = "10 minutes") -> DataFrame:
    """Match forecasts with measurements of a stream: the nearest one within the tolerance, of equally near ones the earlier.

    Both sides carry event-time columns and meet in one keyed state per run and channel, which holds open targets and recent measurements
    only. A forecast leaves, or is dropped without a match, when the watermark has passed its target and the tolerance.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("state"), F.col(m).cast("double").alias("_value")) for m in measurements])
    moment = lambda c: (F.unix_micros(c) / 1e6).alias("_at")
    nothing = F.lit(None).cast("double")
    measured = clean.withWatermark(time_ts, max_delay).select(
        *keys, F.col(time_ts).alias("_ts"), moment(time_ts), F.inline(cells)).select(
        *keys, "state", "_ts", "_at", "_value", nothing.alias("origin_time"), nothing.alias("forecast_horizon_s"), F.lit(False).alias("_asks"))
    asked = forecasts.withWatermark(target_ts, max_delay).where(F.col("state").isin(list(measurements))).select(
        *keys, "state", F.col(target_ts).alias("_ts"), moment(target_ts), F.col("predicted_value").cast("double").alias("_value"),
        F.col("origin_time").cast("double").alias("origin_time"), F.col("forecast_horizon_s").cast("double").alias("forecast_horizon_s"), F.lit(True).alias("_asks"))
    both = measured.unionByName(asked)
    by = [*keys, "state"]
    processor = _NearestMatch(both.columns, by, float(tolerance_seconds))
    kinds = {f.name: f.dataType for f in both.schema.fields}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in processor.names()])
    out = both.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    stamp = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("bigint"))
    return out.withColumns({target_ts: stamp("_target"), "matched_ts": stamp("_matched")}).drop("_target", "_matched")
