"""Error metrics, held-out evaluation and stability of fitted models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.operators.fitting import Factor, LinearModel, PODBasis
from trajmill.plans.segments import plan_layout, with_position
from trajmill.spec import TrajectorySpec


def _sums(pairs: dict[tuple, tuple[Column, Column]], where: Column | None = None) -> tuple[list[Column], dict]:
    """Mergeable error sums for named (truth, prediction) pairs, computed side by side in one aggregation."""
    columns, names = [], {}
    for i, (name, (y, p)) in enumerate(pairs.items()):
        r = y - p if where is None else F.when(where, y - p)
        y2 = y * y if where is None else F.when(where, y * y)
        names[name] = i
        columns += [F.count(r).alias(f"_n{i}"), F.sum(r * r).alias(f"_ss{i}"), F.sum(F.abs(r)).alias(f"_sa{i}"),
                    F.max(F.abs(r)).alias(f"_mx{i}"), F.sum(r).alias(f"_sr{i}"), F.sum(y2).alias(f"_yy{i}")]
    return columns, names


def _fold(i: int) -> list[Column]:
    return [F.max(f"_mx{i}").alias(f"_mx{i}"), *[F.sum(f"{p}{i}").alias(f"{p}{i}") for p in ("_n", "_ss", "_sa", "_sr", "_yy")]]


def _relative(ss: Column, yy: Column) -> Column:
    return F.when(yy > 0, F.sqrt(ss) / F.sqrt(yy)).otherwise(F.sqrt(ss))


def error_by_column(df: DataFrame, pairs: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """rmse, mae, largest error and bias (truth minus prediction) per column; ``pairs`` maps truth to prediction."""
    if len(pairs) > 16:  # hundreds of aggregates would leave generated code; long form keeps six of them
        long = df.select(*(by or []), F.inline(F.array(*[
            F.struct(F.lit(y).alias("column"), F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
            for y, p in pairs.items()])))
        error = F.col("_y") - F.col("_p")
        return long.groupBy(*(by or []), "column").agg(
            F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.max(F.abs(error)).alias("max_abs"),
            F.avg(error).alias("bias"), _relative(F.sum(error * error), F.sum(F.col("_y") * F.col("_y"))).alias("relative_error"))
    columns, names = _sums({y: (F.col(y), F.col(p)) for y, p in pairs.items()})
    sums = df.groupBy(*(by or [])).agg(*columns)
    cells = [F.struct(F.lit(n).alias("column"), F.sqrt(F.col(f"_ss{i}") / F.col(f"_n{i}")).alias("rmse"),
                      (F.col(f"_sa{i}") / F.col(f"_n{i}")).alias("mae"), F.col(f"_mx{i}").alias("max_abs"),
                      (F.col(f"_sr{i}") / F.col(f"_n{i}")).alias("bias"),
                      _relative(F.col(f"_ss{i}"), F.col(f"_yy{i}")).alias("relative_error")) for n, i in names.items()]
    return sums.select(*(by or []), F.inline(F.array(*cells)))


def score_models(rolled: DataFrame, spec: TrajectorySpec, models: list[str], by: list[str], prefix: str = "pred_") -> DataFrame:
    """Errors of side-by-side rollouts per (by..., model, state) in one aggregation, long form with sums."""
    pairs = {(m, s): (F.col(s), F.col(f"{prefix}{m}_{s}" if m else f"{prefix}{s}")) for m in models for s in spec.states}
    columns, names = _sums(pairs)
    sums = rolled.groupBy(*by).agg(*columns)
    cells = [F.struct(F.lit(m).alias("model_name"), F.lit(s).alias("state"), F.col(f"_n{i}").alias("n"),
                      F.col(f"_ss{i}").alias("ss"), F.col(f"_sa{i}").alias("sa"), F.col(f"_mx{i}").alias("max_abs"),
                      F.col(f"_sr{i}").alias("sr"), F.col(f"_yy{i}").alias("yy")) for (m, s), i in names.items()]
    return sums.select(*by, F.inline(F.array(*cells)))


def summarise_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """Finish mergeable sums at any coarser grouping."""
    return scores.groupBy(*by).agg(
        F.sqrt(F.sum("ss") / F.sum("n")).alias("rmse"), (F.sum("sa") / F.sum("n")).alias("mae"),
        F.max("max_abs").alias("max_abs"), (F.sum("sr") / F.sum("n")).alias("bias"),
        _relative(F.sum("ss"), F.sum("yy")).alias("relative_error"), F.sum("n").alias("n_values"))


def evaluate_trajectories(rolled: DataFrame, spec: TrajectorySpec, prefix: str = "pred_") -> DataFrame:
    """Pooled and per-case rollout errors; the pooled row (level "pooled") folds the case rows."""
    scores = score_models(rolled, spec, [""], spec.keys, prefix)
    per_case = scores.groupBy(*spec.keys).agg(*[F.sum(c).alias(c) for c in ("n", "ss", "yy")])
    rolled_up = per_case.rollup(*spec.keys).agg(
        F.grouping(spec.case).alias("_g") if spec.case else F.lit(1).alias("_g"),
        *[F.sum(c).alias(c) for c in ("n", "ss", "yy")])
    return rolled_up.select(
        *spec.keys, F.when(F.col("_g") == 1, "pooled").otherwise("case").alias("level"),
        F.sqrt(F.col("ss") / F.col("n")).alias("rollout_rmse"), _relative(F.col("ss"), F.col("yy")).alias("rollout_relative_error"),
        F.col("n").alias("n_values"))


def horizon_errors(rolled: DataFrame, spec: TrajectorySpec, horizons=(1, 5, 10), by: list[str] | None = None,
                   prefix: str = "pred_") -> DataFrame:
    """Per case: error over rows h..end (``tail_rmse``) and at row h exactly, where the case reaches row h."""
    by = by if by is not None else spec.keys
    rows = rolled
    if "_k" not in rolled.columns:
        rows = with_position(rolled, plan_layout(rolled, spec.keys, spec.time), spec.sort)
    square, width = F.lit(0.0), len(spec.states)
    for s in spec.states:
        square = square + (F.col(s) - F.col(f"{prefix}{s}")) ** 2
    aggregates = []
    for i, h in enumerate(horizons):
        tail, exact = F.col("_k") >= h, F.col("_k") == h
        aggregates += [F.sum(F.when(tail, square)).alias(f"_t{i}"), F.count_if(tail).alias(f"_c{i}"),
                       F.sum(F.when(exact, square)).alias(f"_e{i}"), F.count_if(exact).alias(f"_d{i}")]
    sums = rows.groupBy(*by).agg(*aggregates)
    cells = [F.struct(F.lit(int(h)).alias("horizon"), F.sqrt(F.col(f"_t{i}") / (F.col(f"_c{i}") * width)).alias("tail_rmse"),
                      F.sqrt(F.col(f"_e{i}") / (F.col(f"_d{i}") * width)).alias("exact_rmse"),
                      F.col(f"_c{i}").alias("n_rows")) for i, h in enumerate(horizons)]
    return sums.select(*by, F.inline(F.array(*cells))).where("n_rows > 0")


def residual_table(rolled: DataFrame, spec: TrajectorySpec, prefix: str = "pred_") -> DataFrame:
    """Long residuals: one row per sample and state."""
    cells = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("measured_value"),
                               F.col(f"{prefix}{s}").alias("predicted_value"),
                               (F.col(s) - F.col(f"{prefix}{s}")).alias("residual")) for s in spec.states])
    return rolled.select(*spec.keys, spec.time, F.inline(cells))


def one_step_rmse(steps: DataFrame, spec: TrajectorySpec, prefix: str = "pred_", by: list[str] | None = None) -> DataFrame:
    """RMSE of one-step predictions against the next states."""
    square = F.lit(0.0)
    for s in spec.states:
        square = square + (F.col(f"next_{s}") - F.col(f"{prefix}{s}")) ** 2
    return steps.groupBy(*(by or [])).agg(F.sqrt(F.sum(square) / (F.count(square) * len(spec.states))).alias("one_step_rmse"),
                                          F.count(square).alias("n_transitions"))


def train_test_table(scores: DataFrame, keys: list[str] = ("model_name",), warn_ratio: float = 5.0) -> DataFrame:
    """Train and test error side by side, their gap and ratio; ``split`` is a column of ``scores``."""
    one = scores.groupBy(*keys).agg(*[
        F.sqrt(F.sum(F.when(F.col("split") == s, F.col("ss"))) / F.sum(F.when(F.col("split") == s, F.col("n")))).alias(f"{s}_rmse")
        for s in ("train", "test")])
    ratio = F.when(F.col("train_rmse") > 0, F.col("test_rmse") / F.col("train_rmse")).otherwise(F.lit(float("inf")))
    return one.withColumns({"generalization_gap": F.col("test_rmse") - F.col("train_rmse"),
                            "generalization_ratio": ratio}).withColumn("gap_warning", F.col("generalization_ratio") > warn_ratio)


# -- stability -------------------------------------------------------------------------------------------

def stability(model: LinearModel, warn: float = 1.0, tol: float = 1e-6) -> dict:
    """Spectral radius, unstable count and status of A; continuous models also by their growth rate."""
    values = np.linalg.eigvals(model.a)
    radius = float(np.abs(values).max())
    status = ("marginal" if abs(radius - 1.0) <= tol else
              "potentially_unstable" if radius > warn else "stable_by_spectral_radius")
    out = {"spectral_radius": radius, "n_unstable": int((np.abs(values) > 1.0 + tol).sum()), "status": status,
           "condition_number": float(np.linalg.cond(model.a))}
    if model.continuous:
        out["growth_rate"] = float(values.real.max())
    return out


def eigenvalue_table(a: np.ndarray) -> pd.DataFrame:
    values = np.linalg.eigvals(np.asarray(a, float))
    return pd.DataFrame({"index": np.arange(len(values)), "real": values.real, "imag": values.imag,
                         "magnitude": np.abs(values), "angle": np.angle(values)})


# -- sensors -----------------------------------------------------------------------------------------------

def sensor_error_curve(factor: Factor, pod: PODBasis, order: list[int], most: int | None = None,
                       physical: bool = True) -> pd.DataFrame:
    """Reconstruction error from the first k sensors, k = 1.., solved from the snapshot factor alone."""
    processed = (factor.of(pod.states) - factor.r[:, :1] * pod.mean) / pod.spread
    weight = pod.spread if physical else np.ones(len(pod.states))
    whole = np.linalg.norm(factor.of(pod.states) if physical else processed)
    rows = []
    for k in range(1, (most or len(order)) + 1):
        chosen = list(order[:k])
        fitted = processed[:, chosen] @ np.linalg.pinv(pod.modes[chosen]).T @ pod.modes.T
        norm = np.linalg.norm((processed - fitted) * weight)
        rows.append((k, norm / np.sqrt(factor.rows * len(pod.states)), norm / whole if whole > 0 else norm))
    return pd.DataFrame(rows, columns=["n_sensors", "rmse", "relative_error"])


