"""Windowed summaries of archived tables; several window lengths in one scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trajmill.functions.columns import melt
from trajmill.operators.quality import percentiles
from trajmill.plans.sizing import fits_one_task

WINDOWS = (60.0, 300.0, 3600.0)


def window_label(seconds: float) -> str:
    text = str(int(seconds)) if float(seconds).is_integer() else f"{seconds:g}".replace(".", "p")
    return f"{text}s"


def _windowed(df: DataFrame, time: str, windows) -> DataFrame:
    """One row per input row and window length; a missing time counts as second 0."""
    t = F.coalesce(F.col(time).try_cast("double"), F.lit(0.0))
    labels = F.array(*[F.struct(F.lit(window_label(w)).alias("window"),
                                (F.floor(t / F.lit(float(w))) * F.lit(float(w))).alias("window_start")) for w in windows])
    return df.select("*", F.inline(labels))


def _grouped(rows: DataFrame, by: list[str], measures: list[Column], value: str, shares: dict[str, float],
             target_rows: int | None) -> DataFrame:
    """Plain measures and exact percentiles; percentiles of huge groups take the ranked way."""
    if target_rows is None and fits_one_task(rows):
        clean = F.when(~F.isnan(value), F.col(value))
        return rows.groupBy(*by).agg(*measures, *[F.percentile(clean, F.lit(p)).alias(n) for n, p in shares.items()])
    plain = rows.groupBy(*by).agg(*measures)
    ranked = percentiles(rows, by, value, shares, target_rows).withColumnsRenamed({c: f"_p_{c}" for c in by})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in by])
    return plain.join(ranked, on, "left").drop(*[f"_p_{c}" for c in by])


def summarize_values(long: DataFrame, time: str, *, keys=(), windows=WINDOWS, state: str = "state", value: str = "value",
                     seq: tuple[str, ...] = (), target_rows: int | None = None) -> DataFrame:
    """Counts, moments, percentiles and last value per window and state."""
    by = [*keys, "window", "window_start", state]
    rows = _windowed(long.withColumn("_x", F.col(value).try_cast("double")), time, windows)
    x = F.when(~F.isnan("_x"), F.col("_x"))
    rank = F.struct(time, *seq)
    measures = [F.count(x).alias("n"), (F.count_if(x.isNull()) / F.count(F.lit(1))).alias("missing_fraction"),
                F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                F.max_by(x, F.when(x.isNotNull(), rank)).alias("last")]
    return _grouped(rows, by, measures, "_x", {"median": 0.5, "p05": 0.05, "p95": 0.95}, target_rows)


def summarize_wide(df: DataFrame, time: str, columns: list[str], *, keys=(), windows=WINDOWS, seq: tuple[str, ...] = (),
                   target_rows: int | None = None) -> DataFrame:
    """Wide logs (cleaned stream, state estimates): unpivot first, then as for long tables."""
    ids = list(dict.fromkeys([*keys, time, *seq]))
    return summarize_values(melt(df, ids, columns), time, keys=keys, windows=windows, seq=seq, target_rows=target_rows)


def summarize_residuals(df: DataFrame, time: str = "matched_time", *, keys=(), windows=WINDOWS, residual: str = "residual",
                        absolute: str = "abs_residual", target_rows: int | None = None) -> DataFrame:
    """Error measures per window and state, for raw or corrected residuals."""
    by = [*keys, "window", "window_start", "state"]
    rows = df if absolute in df.columns else df.withColumn(absolute, F.abs(F.col(residual).try_cast("double")))
    rows = _windowed(rows.withColumns({"_a": F.col(absolute).try_cast("double"), "_r": F.col(residual).try_cast("double")}), time, windows)
    a, r = F.when(~F.isnan("_a"), F.col("_a")), F.when(~F.isnan("_r"), F.col("_r"))
    measures = [F.count(a).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(a).alias("mae"), F.max(a).alias("max_abs"),
                F.avg(r).alias("bias_mean")]
    return _grouped(rows, by, measures, "_a", {"p95_abs": 0.95}, target_rows)


def summarize_trust(df: DataFrame, time: str = "time", *, keys=(), windows=WINDOWS, target_rows: int | None = None) -> DataFrame:
    by = [*keys, "window", "window_start"]
    rows = _windowed(df.withColumn("_x", F.col("trust_score").try_cast("double")), time, windows)
    x = F.when(~F.isnan("_x"), F.col("_x"))
    measures = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"),
                F.count_if(x < 0.5).alias("time_below_0p5_samples")]
    return _grouped(rows, by, measures, "_x", {"p05": 0.05}, target_rows)


def summarize_bias(df: DataFrame, time: str = "time", *, keys=(), windows=WINDOWS, seq: tuple[str, ...] = ()) -> DataFrame:
    rows = _windowed(df.withColumn("_x", F.col("bias_value").try_cast("double")), time, windows)
    x = F.when(~F.isnan("_x"), F.col("_x"))
    return rows.groupBy(*keys, "window", "window_start", "state").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean_bias"),
        F.max_by(x, F.when(x.isNotNull(), F.struct(time, *seq))).alias("last_bias"), F.max(F.abs(x)).alias("max_abs_bias"))


def summarize_alerts(df: DataFrame, keys=()) -> DataFrame:
    """Counts by severity and code, most frequent first."""
    return df.groupBy(*keys, "severity", "code").agg(F.count(F.lit(1)).alias("alert_count")).orderBy(
        F.col("alert_count").desc(), "severity", "code")
