"""One-step prediction, projection, rollout, forecasts and Kalman filtering.

Constant linear maps are plain column expressions and stay in generated code. Recursions run
as streaming folds over partitions hashed by (case, segment) and sorted by time: memory is one
Arrow batch, never a whole case. Segments of a hot case start from states found by composing the
affine summaries of the segments before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.functions import linalg as L
from trajmill.functions.columns import dot
from trajmill.operators.fitting import LinearModel, PODBasis, measurement_matrix
from trajmill.operators.shaping import transitions
from trajmill.plans.segments import SEGMENT, CaseLayout, cluster, join_null_safe, ordered_partitions, plan_layout, with_lags
from trajmill.spec import TrajectorySpec


# -- constant linear maps -----------------------------------------------------------------------

def affine_columns(weights: np.ndarray, offset: np.ndarray, columns: list) -> list[Column]:
    """One column expression per row of ``weights``."""
    return [dot(row, columns) + F.lit(float(c)) if c != 0.0 else dot(row, columns) for row, c in zip(weights, offset)]


MOST_TERMS = 256


def apply_affine(df: DataFrame, weights: np.ndarray, offset: np.ndarray, columns: list[str], outputs: list[str]) -> DataFrame:
    """Add ``outputs = weights @ columns + offset``.

    Small maps are column expressions in generated code; a map with many terms is one matrix product
    per Arrow batch, as thousands of generated terms would no longer compile into one method.
    """
    if weights.size <= MOST_TERMS:
        return df.withColumns(dict(zip(outputs, affine_columns(weights, offset, columns))))
    kept = [c for c in df.columns if c not in outputs]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[columns].to_numpy(float) @ weights.T + offset
            yield pd.concat([frame[kept].reset_index(drop=True), pd.DataFrame(values, columns=outputs)], axis=1)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{c}` double" for c in outputs])
    return df.mapInPandas(product, schema)


def predict_one_step(df: DataFrame, model: LinearModel, dt: float | None = None, prefix: str = "pred_") -> DataFrame:
    """Add the next state of every row."""
    full = model.physical()
    a, b = full.step(dt)
    return apply_affine(df, np.column_stack([a, b]), full.offset, [*full.states, *full.inputs],
                        [f"{prefix}{s}" for s in full.states])


def encode_columns(pod: PODBasis, columns: list[str]) -> list[Column]:
    return affine_columns(pod.encoder(), pod.encode_offset(), columns)


def pod_transform(df: DataFrame, pod: PODBasis) -> DataFrame:
    """Add modal coefficients ``a1..``."""
    return apply_affine(df, pod.encoder(), pod.encode_offset(), pod.states, [f"a{i + 1}" for i in range(pod.rank)])


def pod_inverse(df: DataFrame, pod: PODBasis, prefix: str = "rec_") -> DataFrame:
    """Add full states reconstructed from ``a1..``."""
    names = [f"a{i + 1}" for i in range(pod.rank)]
    return apply_affine(df, pod.decoder(), pod.mean, names, [f"{prefix}{s}" for s in pod.states])


def _sensor_map(pod: PODBasis, indices: list[int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    chosen = list(indices)
    weights = np.linalg.pinv(pod.modes[chosen]) / pod.spread[chosen]
    return weights, -weights @ pod.mean[chosen], [pod.states[i] for i in chosen]


def coefficients_from_sensors(df: DataFrame, pod: PODBasis, indices: list[int]) -> DataFrame:
    """Least-squares modal coefficients from the selected sensor columns."""
    weights, offset, sensors = _sensor_map(pod, indices)
    return apply_affine(df, weights, offset, sensors, [f"a{i + 1}" for i in range(pod.rank)])


def reconstruct_from_sensors(df: DataFrame, pod: PODBasis, indices: list[int], prefix: str = "rec_") -> DataFrame:
    """Full states from the selected sensor columns: both maps multiplied into one."""
    weights, offset, sensors = _sensor_map(pod, indices)
    decoder = pod.decoder()
    return apply_affine(df, decoder @ weights, decoder @ offset + pod.mean, sensors, [f"{prefix}{s}" for s in pod.states])


# -- streaming folds over ordered partitions ------------------------------------------------------

def _runs(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True at the first row of every run of equal keys."""
    first = np.zeros(len(frame), bool)
    first[0] = True
    for k in keys:
        codes, _ = pd.factorize(frame[k].to_numpy(), use_na_sentinel=False)
        first[1:] |= codes[1:] != codes[:-1]
    return first


def _key(frame: pd.DataFrame, keys: list[str], row: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in (frame[k].iat[row] for k in keys))


def _scan(matrices: np.ndarray, forcing: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``x[k] = M x[k-1] + f[k]`` restarted where ``first``; M is constant or given per row."""
    return (L.affine_scan if matrices.ndim == 2 else L.varying_scan)(matrices, forcing, first)


def _blocks(sizes: list[int]) -> list[slice]:
    edges = np.cumsum([0, *sizes])
    return [slice(int(lo), int(hi)) for lo, hi in zip(edges, edges[1:])]


def _segment_starts(ordered: DataFrame, layout: CaseLayout, keys: list[str], summarise, schema: str,
                    sizes: list[int]) -> DataFrame | None:
    """State carried into each later segment of a hot case, by composing segment summaries.

    A summary is ``(_phi, _c)`` with ``x_end = phi x_start + c`` per block (row-major). At most 8,192
    summaries exist; those of one case meet in one small task.
    """
    if not layout.split:
        return None
    case_keys, cuts = layout.keys, _blocks(sizes)
    flat = _blocks([n * n for n in sizes])
    summaries = layout.hot_rows(ordered).mapInPandas(summarise, schema)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(SEGMENT).reset_index(drop=True)
        state, out = None, []
        for phi, c in zip(frame["_phi"], frame["_c"]):
            out.append(None if state is None else state.tolist())
            start = np.zeros(sum(sizes)) if state is None else state
            phi, state = np.asarray(phi, float), np.array(c, float)
            for n, at, where in zip(sizes, flat, cuts):
                state[where] += phi[at].reshape(n, n) @ start[where]
        return frame[[*case_keys, SEGMENT]].assign(_start=out)

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    out_schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*case_keys, SEGMENT]) + ", _start array<double>"
    return summaries.groupBy(*(case_keys or [F.lit(0)])).applyInPandas(compose, out_schema)


def _recursion(df: DataFrame, spec: TrajectorySpec, layout: CaseLayout, sizes: list[int], keep: list[str],
               prepare, outputs: list[str], emit) -> DataFrame:
    """Run one or several independent affine recursions over every case of a clustered table in one pass.

    ``prepare(frame, opening)`` gives the matrices of each block (one constant matrix, or one per
    row) and the forcing of all blocks side by side; ``opening`` marks the first row of a case,
    whose forcing is the initial state itself. ``emit`` turns the states of a batch, and the states
    one row before, into output columns.
    """
    marked = with_lags(df, layout, spec.sort, {"_opening": (F.lit(True), 1)}).withColumn(
        "_opening", F.col("_opening").isNull())
    ordered = ordered_partitions(marked, layout, spec.sort, clustered=True)
    runs, cuts, total = [*layout.keys, SEGMENT], _blocks(sizes), sum(sizes)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}

    def scan(matrices, forcing, first):
        return np.column_stack([_scan(m, forcing[:, w], first) for m, w in zip(matrices, cuts)])

    def apply(matrices, row, state):
        return np.concatenate([(m if m.ndim == 2 else m[row]) @ state[w] for m, w in zip(matrices, cuts)])

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, phis, c = None, None, None

        def record():
            flat = np.concatenate([phi.ravel() for phi in phis]).tolist()
            return pd.DataFrame([[*key, flat, c.tolist()]], columns=[*runs, "_phi", "_c"])

        for frame in frames:
            if not len(frame):
                continue
            opening = frame["_opening"].to_numpy(bool)
            matrices, forcing = prepare(frame, opening)
            bounds = [*np.flatnonzero(_runs(frame, runs)).tolist(), len(frame)]
            for lo, hi in zip(bounds, bounds[1:]):
                here = _key(frame, runs, lo)
                if here != key:
                    if key is not None:
                        yield record()
                    key, phis, c = here, [np.eye(n) for n in sizes], np.zeros(total)
                part, fresh = np.array(forcing[lo:hi], float), np.zeros(hi - lo, bool)
                fresh[0] = True
                if opening[lo]:
                    phis = [np.zeros((n, n)) for n in sizes]
                else:
                    part[0] += apply(matrices, lo, c)
                c = scan([m if m.ndim == 2 else m[lo:hi] for m in matrices], part, fresh)[-1]
                for i, m in enumerate(matrices):
                    if m.ndim == 2:
                        phis[i] = np.linalg.matrix_power(m, hi - lo) @ phis[i]
                    elif lo + int(opening[lo]) < hi:
                        phis[i] = L.chain_product(m[lo + int(opening[lo]):hi]) @ phis[i]
        if key is not None:
            yield record()

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in runs) + ", _phi array<double>, _c array<double>"
    starts = _segment_starts(ordered, layout, runs, summarise, schema, sizes)
    if starts is not None:
        ordered = ordered_partitions(layout.join_carry(layout.assign(marked), starts).drop(SEGMENT), layout, spec.sort)

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            if not len(frame):
                continue
            opening = frame["_opening"].to_numpy(bool)
            matrices, forcing = prepare(frame, opening)
            first = _runs(frame, runs)
            forcing, previous = np.array(forcing, float), np.full((len(frame), total), np.nan)
            for row in np.flatnonzero(first & ~opening):
                goes_on = row == 0 and _key(frame, runs, 0) == key  # from the last batch
                before = state if goes_on else np.asarray(frame["_start"].iat[row], float)
                forcing[row] += apply(matrices, row, before)
                previous[row] = before
            x = scan(matrices, forcing, first)
            previous[1:] = np.where(first[1:, None], previous[1:], x[:-1])
            key, state = _key(frame, runs, len(frame) - 1), x[-1].copy()
            values = emit(frame, x, previous)
            yield pd.concat([frame[keep].reset_index(drop=True), pd.DataFrame(values, columns=outputs)], axis=1)

    out_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + "".join(f", `{c}` double" for c in outputs)
    return ordered.mapInPandas(expand, out_schema)


def rollout(df: DataFrame, spec: TrajectorySpec, model: LinearModel, *, keep: list[str] | None = None,
            layout: CaseLayout | None = None, prefix: str = "pred_") -> DataFrame:
    """Free run of every case from its first row under its recorded inputs: ``pred_<state>`` per row.

    Row 0 of a case is its measured state. Continuous models hold the input over each actual step.
    """
    return rollout_many(df, spec, {"": model}, keep=keep, layout=layout, prefix=prefix)


def rollout_many(df: DataFrame, spec: TrajectorySpec, models: dict[str, LinearModel], *, keep: list[str] | None = None,
                 layout: CaseLayout | None = None, prefix: str = "pred_") -> DataFrame:
    """Free runs of several models side by side in one pass: ``pred_<model>_<state>``."""
    parts = list(models.values())
    full = [m.pod.states if m.pod is not None else m.states for m in parts]
    inputs = sorted({c for m in parts for c in m.inputs})
    missing = sorted(({c for s in full for c in s} | set(inputs)) - set(df.columns))
    if missing:
        raise ValueError(f"the model needs columns the table lacks: {missing}")
    keep = list(dict.fromkeys(keep or [*spec.keys, spec.time, *spec.order, *spec.states]))
    layout = layout or plan_layout(df, spec.keys, spec.time)
    # Only what the fold needs is shuffled.
    needed = list(dict.fromkeys([*keep, *spec.keys, *spec.sort, *[c for s in full for c in s], *inputs]))
    shifted = with_lags(cluster(df.select(*needed), layout), layout, spec.sort, {**{f"_u_{c}": (c, 1) for c in inputs}, "_t_before": (spec.time, 1)})
    time, sizes = spec.time, [len(m.states) for m in parts]

    def prepare(frame, opening):
        matrices, forcing = [], []
        for i, m in enumerate(parts):
            u = np.zeros((len(frame), 0))
            if m.inputs:
                u = np.where(opening[:, None], 0.0, frame[[f"_u_{c}" for c in m.inputs]].to_numpy(float))
            if m.continuous:
                dts = np.where(opening, 1.0, (frame[time] - frame["_t_before"]).to_numpy(float))
                if not (dts > 0).all():
                    raise ValueError("time must strictly increase inside a case")
                rows, push = L.hold_steps(m.a, m.b, dts)
                push = np.einsum("kij,kj->ki", push, u)
            else:
                rows, push = m.a, u @ m.b.T + m.offset
            x0 = frame[full[i]].to_numpy(float)[opening]
            push[opening] = (x0 - m.pod.mean) / m.pod.spread @ m.pod.modes if m.pod is not None else x0
            matrices.append(rows)
            forcing.append(push)
        return matrices, np.column_stack(forcing)

    cuts = _blocks(sizes)

    def emit(frame, x, previous):
        return np.column_stack([
            x[:, w] @ m.pod.modes.T * m.pod.spread + m.pod.mean if m.pod is not None else x[:, w]
            for m, w in zip(parts, cuts)])

    names = [f"{prefix}{name}_{c}" if name else f"{prefix}{c}" for name, states in zip(models, full) for c in states]
    return _recursion(shifted, spec, layout, sizes, keep, prepare, names, emit)


def rollout_persistence(df: DataFrame, spec: TrajectorySpec, prefix: str = "pred_", mean: dict[str, float] | None = None,
                        layout: CaseLayout | None = None) -> DataFrame:
    """Baselines: the first state repeated, or (with ``mean``) the training mean after the exact first row.

    Only the first row of a case is needed, so one aggregation by case replaces any ordering.
    """
    rank = F.struct(*spec.sort)
    firsts = df.groupBy(*spec.keys).agg(F.min_by(F.struct(*spec.states), rank).alias("_x0"), F.min(rank).alias("_at"))
    joined = join_null_safe(df, firsts, list(spec.keys))
    opening = rank == F.col("_at")
    return joined.select(*df.columns, *[
        (F.col(f"_x0.{c}") if mean is None else F.when(opening, F.col(f"_x0.{c}")).otherwise(F.lit(mean[c]))
         ).alias(f"{prefix}{c}") for c in spec.states])


# -- forecasts ---------------------------------------------------------------------------------------

DEFAULT_HORIZONS = (5.0, 10.0, 30.0, 60.0)


def horizon_maps(model: LinearModel, horizons, dt: float | None = None) -> list[tuple[float, float, np.ndarray, np.ndarray, np.ndarray]]:
    """(horizon, effective horizon, A_h, B_h, offset_h) under a constant input.

    Continuous models take the horizon as it is; discrete ones take ceil(h/dt) steps, at least one.
    """
    full = model.physical()
    out = []
    for h in horizons:
        if not h > 0:
            raise ValueError("forecast horizons must be positive")
        if full.continuous:
            a, b = L.hold_step(full.a, full.b, float(h))
            out.append((float(h), float(h), a, b, np.zeros(len(a))))
            continue
        step = dt or full.dt or full.metadata.get("dt") or 1.0
        count = max(1, ceil(h / step))
        # [A B c; 0 I 0; 0 0 1] ** count gives the whole affine map at once
        n, m = full.b.shape
        block = np.eye(n + m + 1)
        block[:n] = np.column_stack([full.a, full.b, full.offset])
        power = np.linalg.matrix_power(block, count)[:n]
        out.append((float(h), count * step, power[:, :n], power[:, n:n + m], power[:, -1]))
    return out


def forecast(df: DataFrame, model: LinearModel, time: str, horizons=DEFAULT_HORIZONS, *, dt: float | None = None,
             keys: list[str] = (), row_index: str | None = None, received: str | None = None,
             model_path: str = "", model_type: str | None = None, origin_type: str | None = None) -> DataFrame:
    """Long forecasts of every row, one per horizon and state, without state between rows.

    Works on batch and streaming tables alike: each horizon is one constant linear map.
    """
    full = model.physical()
    cells = []
    for h, effective, a, b, c in horizon_maps(model, horizons, dt):
        values = affine_columns(np.column_stack([a, b]), c, [*full.states, *full.inputs])
        cells += [F.struct(F.lit(h).alias("forecast_horizon_s"), F.lit(effective).alias("effective_horizon_s"),
                           F.lit(s).alias("state"), v.alias("predicted_value")) for s, v in zip(full.states, values)]
    base = df.select(*keys, F.col(time).alias("origin_time"),
                     (F.col(row_index) if row_index else F.lit(None).cast("bigint")).alias("origin_row_index"),
                     (F.col(received) if received else F.lit(None).cast("string")).alias("received_utc"),
                     F.explode(F.array(*cells)).alias("_f"))
    out = base.select(
        *keys, "origin_time", "origin_row_index", "received_utc", "_f.forecast_horizon_s", "_f.effective_horizon_s",
        (F.col("origin_time") + F.col("_f.forecast_horizon_s")).alias("target_time"),
        (F.col("origin_time") + F.col("_f.effective_horizon_s")).alias("effective_target_time"),
        "_f.state", "_f.predicted_value", F.lit(model_type or model.kind).alias("model_type"),
        F.lit(model_path).alias("model_path"))
    return out.withColumn("forecast_origin_type", F.lit(origin_type)) if origin_type else out


# -- Kalman filter -------------------------------------------------------------------------------------

def kalman_filter(df: DataFrame, spec: TrajectorySpec, model: LinearModel, measurements: list[str], h: np.ndarray, *,
                  q: np.ndarray | None = None, r: np.ndarray | None = None, p0: np.ndarray | None = None,
                  x0=None, d: np.ndarray | None = None, h_offset: np.ndarray | None = None,
                  input_alignment: str = "current", initialise: bool = False,
                  decode: PODBasis | None = None, layout: CaseLayout | None = None) -> DataFrame:
    """Filter the measurement columns of every case; adds states, covariance trace and innovations.

    The filtered state obeys ``x[k] = (I - K H)(A x[k-1] + B u[k]) + K y[k]``, an affine recursion with
    known matrices, so hot cases are cut into segments like any rollout. ``initialise`` starts each
    case from the pseudo-inverse of its first measurement. ``input_alignment`` "current" drives
    step k-1 -> k by u[k], "previous" by u[k-1].
    """
    from trajmill.plans.segments import with_position

    n = model.a.shape[0]
    q = np.eye(n) * 1e-8 if q is None else np.asarray(q, float)
    r = np.eye(len(measurements)) * 1e-4 if r is None else np.asarray(r, float)
    p0 = np.eye(n) if p0 is None else np.asarray(p0, float)
    a, b, offset = model.a, model.b, model.offset
    d = np.zeros((len(measurements), len(model.inputs))) if d is None else np.asarray(d, float)
    shift = np.zeros(len(measurements)) if h_offset is None else np.asarray(h_offset, float)
    start = np.zeros(n) if x0 is None else np.asarray(x0, float)
    inverse = np.linalg.pinv(h)
    schedule = L.RiccatiScan(a, h, q, r, p0)
    layout = layout or plan_layout(df, spec.keys, spec.time)
    needed = list(dict.fromkeys([*spec.keys, *spec.sort, *measurements, *model.inputs]))
    placed = with_position(cluster(df.select(*needed), layout), layout, spec.sort)
    lag = 1 if input_alignment == "previous" else 0
    driven = with_lags(placed, layout, spec.sort, {f"_u_{c}": (c, lag) for c in model.inputs}) if model.inputs else placed
    inputs = [f"_u_{c}" for c in model.inputs]
    eye = np.eye(n)

    def parts(frame):
        y = frame[measurements].to_numpy(float) - shift
        u = frame[inputs].to_numpy(float) if inputs else np.zeros((len(frame), 0))
        u = np.where(np.isnan(u), 0.0, u) if lag else u
        gains, covariances = schedule.at(frame["_k"].to_numpy())
        return y, u, gains, covariances

    def prepare(frame, opening):
        y, u, gains, _ = parts(frame)
        keep = eye - gains @ h
        drive = u @ b.T + offset
        forcing = np.einsum("kij,kj->ki", keep, drive) + np.einsum("kij,kj->ki", gains, y - u @ d.T)
        at = np.flatnonzero(opening)
        x = y[at] @ inverse.T if initialise else np.broadcast_to(start, (len(at), n))
        forcing[at] = x + np.einsum("kij,kj->ki", gains[at], y[at] - x @ h.T - u[at] @ d.T)
        return [keep @ a], forcing

    spread = decode
    states = list(decode.states) if decode is not None else list(model.states)

    def emit(frame, x, previous):
        y, u, _, covariances = parts(frame)
        opening = frame["_opening"].to_numpy(bool)
        prior = previous @ a.T + u @ b.T + offset
        prior[opening] = y[opening] @ inverse.T if initialise else start
        innovation = y - prior @ h.T - u @ d.T
        full = x @ spread.modes.T * spread.spread + spread.mean if spread is not None else x
        trace = np.trace(covariances, axis1=1, axis2=2)[:, None]
        norm = np.linalg.norm(innovation, axis=1)[:, None]
        return np.column_stack([full, *([x] if spread is not None else []), trace, norm, innovation])

    modal = [f"a{i + 1}" for i in range(n)] if decode is not None else []
    outputs = [*[f"est_{c}" for c in states], *modal, "covariance_trace", "innovation_norm",
               *[f"innovation_{c}" for c in measurements]]
    keep_columns = list(dict.fromkeys([*spec.keys, spec.time, *spec.order, *measurements, *model.inputs]))
    return _recursion(driven, spec, layout, [n], keep_columns, prepare, outputs, emit)


def kalman_pod(df: DataFrame, spec: TrajectorySpec, model: LinearModel, measurements: list[str], *,
               process_noise: float = 1e-6, measurement_noise: float = 1e-3, initial_covariance: float = 1.0,
               input_alignment: str = "current", layout: CaseLayout | None = None) -> DataFrame:
    """Filter sparse measurements into modal and full states, each case started by pseudo-inverse."""
    for name, value in (("process_noise", process_noise), ("measurement_noise", measurement_noise),
                        ("initial_covariance", initial_covariance)):
        if not value > 0:
            raise ValueError(f"{name} must be positive")
    pod = model.pod
    chosen = [pod.states.index(c) for c in measurements]
    k = pod.rank
    return kalman_filter(
        df, spec, model, measurements, measurement_matrix(pod, chosen), q=np.eye(k) * process_noise,
        r=np.eye(len(chosen)) * measurement_noise, p0=np.eye(k) * initial_covariance, h_offset=pod.mean[chosen],
        initialise=True, decode=pod, input_alignment=input_alignment, layout=layout)


def innovations_long(estimates: DataFrame, keys: list[str], time: str, measurements: list[str]) -> DataFrame:
    """One row per sample and measurement channel."""
    cells = F.array(*[F.struct(F.lit(c).alias("measurement"), F.col(c).alias("measured_value"),
                               (F.col(c) - F.col(f"innovation_{c}")).alias("predicted_measurement"),
                               F.col(f"innovation_{c}").alias("innovation")) for c in measurements])
    carried = [c for c in ("origin_row_index", "received_utc", "estimator_type", "covariance_trace", "innovation_norm")
               if c in estimates.columns]
    return estimates.select(*keys, F.col(time).alias("origin_time"), *carried, F.inline(cells))


def one_step_table(df: DataFrame, spec: TrajectorySpec, model: LinearModel) -> DataFrame:
    """Transitions with their one-step predictions."""
    full = model.physical()
    steps = transitions(df, spec)
    if not full.continuous:
        return predict_one_step(steps, full)

    def step(frames):
        for frame in frames:
            x, u = frame[full.states].to_numpy(float), frame[full.inputs].to_numpy(float).reshape(len(frame), -1)
            a, b = L.hold_steps(full.a, full.b, frame["dt"].to_numpy(float))
            out = np.einsum("kij,kj->ki", a, x) + np.einsum("kij,kj->ki", b, u)
            yield frame.assign(**{f"pred_{c}": out[:, i] for i, c in enumerate(full.states)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema.fields)
    return steps.mapInPandas(step, kinds + "".join(f", pred_{c} double" for c in full.states))


