"""Status tables behind operator displays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Display colour of each sensor status.
COLOURS = {"unknown": "#9ca3af", "nominal": "#16a34a", "warning": "#f59e0b", "critical": "#dc2626"}
RESIDUAL_TIMES = ("matched_time", "target_time", "time", "origin_time")


def _one_row(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # every part is a global aggregate: one row


def run_status(*, clean: DataFrame, time: str, estimates: DataFrame | None = None, forecasts: DataFrame | None = None,
               residuals: DataFrame | None = None, alerts: DataFrame | None = None, trust: DataFrame | None = None,
               events: DataFrame | None = None, seq: str | None = None) -> DataFrame:
    """One status row for a live run from its tables; each table is aggregated once."""
    latest = F.max_by(F.col(time).try_cast("double"), F.col(seq)) if seq else F.max(F.col(time).try_cast("double"))
    parts = [clean.agg(F.count(F.lit(1)).alias("n_clean_samples"), latest.alias("latest_time"))]

    def counted(df, name, *more):
        spark = clean.sparkSession
        if df is None:
            empty = spark.range(1).select(F.lit(0).cast("bigint").alias(name), *[m[1] for m in more])
            parts.append(empty)
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias(name), *[m[0] for m in more]))

    zero = lambda n: F.lit(0).cast("bigint").alias(n)
    nothing = lambda n: F.lit(None).cast("double").alias(n)
    severity = F.lower("severity")
    counted(estimates, "n_state_estimates")
    counted(forecasts, "n_forecast_rows", (
        F.array_sort(F.collect_set(F.col("forecast_horizon_s").cast("double"))).alias("forecast_horizons_seconds"),
        F.array().cast("array<double>").alias("forecast_horizons_seconds")))
    counted(residuals, "n_residual_rows")
    counted(alerts, "n_alerts", (F.count_if(severity == "warning").alias("n_warning_alerts"), zero("n_warning_alerts")),
            (F.count_if(severity == "critical").alias("n_critical_alerts"), zero("n_critical_alerts")))
    counted(trust, "n_trust_rows",
            (F.max_by("trust_score", F.when(F.col("trust_score").isNotNull(), F.struct("time"))).alias("latest_trust_score"),
             nothing("latest_trust_score")), (F.min("trust_score").alias("min_trust_score"), nothing("min_trust_score")))
    counted(events, "n_bias_update_events", (F.count_if("accepted").alias("n_bias_updates_accepted"), zero("n_bias_updates_accepted")))
    row = _one_row(parts)
    low = lambda limit: F.coalesce(F.col("latest_trust_score") < limit, F.lit(False))
    status = (F.when((F.col("n_critical_alerts") > 0) | low(0.5), "critical")
              .when((F.col("n_warning_alerts") > 0) | low(0.8), "warning")
              .when((F.col("n_clean_samples") == 0) & (F.col("n_forecast_rows") == 0) & (F.col("n_state_estimates") == 0), "empty")
              .otherwise("healthy"))
    return row.drop("n_trust_rows").withColumn("status", status)


def archive_status(manifest: DataFrame, trust_summary: DataFrame | None = None, alert_summary: DataFrame | None = None) -> DataFrame:
    """One status row for an archive, from its manifest and summaries only."""
    spark = manifest.sparkSession
    totals = manifest.agg(
        F.count(F.lit(1)).alias("manifest_rows"), F.array_sort(F.collect_set("data_kind")).alias("data_kinds"),
        F.array_sort(F.collect_set("run_id")).alias("run_ids"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_archived_rows"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_archived_bytes"))
    trust = (trust_summary.agg(F.max("window_start").alias("latest_window_start"),
                               F.max_by("mean", "window_start").alias("latest_mean_trust"), F.min("min").alias("min_trust"))
             if trust_summary is not None else spark.range(1).select(
                 *[F.lit(None).cast("double").alias(c) for c in ("latest_window_start", "latest_mean_trust", "min_trust")]))
    alerts = (alert_summary.agg(F.count(F.lit(1)).alias("n_alert_summary_rows"),
                                F.coalesce(F.sum("alert_count"), F.lit(0)).alias("n_alerts_reported"))
              if alert_summary is not None else spark.range(1).select(
                  *[F.lit(0).cast("bigint").alias(c) for c in ("n_alert_summary_rows", "n_alerts_reported")]))
    low = lambda limit: F.coalesce(F.col("min_trust") < limit, F.lit(False))
    status = (F.when(F.col("manifest_rows") == 0, "empty").when(low(0.5), "critical")
              .when((F.col("n_alerts_reported") > 0) | low(0.8), "warning").otherwise("healthy"))
    return _one_row([totals, trust, alerts]).withColumn("status", status)


def latest_residual_by_state(residuals: DataFrame, keys=(), seq: tuple[str, ...] = ()) -> DataFrame:
    """The newest residual of every state (ties broken by ``seq``)."""
    time = next((c for c in RESIDUAL_TIMES if c in residuals.columns), None)
    rows = residuals
    if "abs_residual" not in rows.columns:
        rows = rows.withColumn("abs_residual", F.abs(F.col("residual").try_cast("double")))
    if "residual" not in rows.columns:
        rows = rows.withColumn("residual", F.lit(None).cast("double"))
    rows = rows.where(F.col("abs_residual").try_cast("double").isNotNull())
    moment = F.col(time).try_cast("double") if time else F.lit(None).cast("double")
    rank = F.struct(moment.alias("_t"), *seq)
    newest = F.max_by(F.struct(F.col("residual").alias("residual"), F.col("abs_residual").alias("abs_residual"),
                               moment.alias("latest_time")), rank)
    return rows.groupBy(*keys, F.col("state").cast("string").alias("state")).agg(newest.alias("_r")).select(
        *keys, "state", "_r.residual", "_r.abs_residual", "_r.latest_time")


def residual_status(c: Column, warning: float = 2.0, critical: float = 5.0) -> Column:
    return (F.when(c.isNull() | F.isnan(c), "unknown").when(c >= critical, "critical")
            .when(c >= warning, "warning").otherwise("nominal"))


def sensor_status(spark: SparkSession, states: list[str], residuals: DataFrame | None = None, *,
                  positions: dict[str, float] | None = None, measured: list[str] = (), warning: float = 2.0,
                  critical: float = 5.0, seq: tuple[str, ...] = ()) -> DataFrame:
    """One row per state with position, newest residual, status and colour.

    States without a position follow after the placed ones; without any geometry they are evenly
    spaced in the given order.
    """
    placed = {s: float(p) for s, p in (positions or {}).items()} if positions else {s: float(i) for i, s in enumerate(states)}
    for s in states:
        placed.setdefault(s, float(len(placed)))
    table = spark.createDataFrame([(s, placed[s], s in set(measured)) for s in states],
                                  "state string, position_m double, measurement_available boolean")
    if residuals is None:
        newest = spark.createDataFrame([], "state string, residual double, abs_residual double, latest_time double")
    else:
        newest = latest_residual_by_state(residuals, seq=seq)
    joined = table.join(newest, "state", "left")  # both sides: one row per state
    colours = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    status = residual_status(F.col("abs_residual"), warning, critical)
    return joined.withColumn("status", status).select(
        "state", "position_m", "residual", "abs_residual", "status", colours[F.col("status")].alias("color"),
        "latest_time", "measurement_available").orderBy("position_m")


def summarize_sensor_status(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_sensors"), *[
        F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("nominal", "warning", "critical", "unknown")])


def top_residuals(residuals: DataFrame, n: int = 20, order: tuple[str, ...] = ()) -> DataFrame:
    return residuals.orderBy(F.col("abs_residual").desc_nulls_last(), *order).limit(n)


def last_alerts(alerts: DataFrame, n: int = 20, order: tuple[str, ...] = ()) -> DataFrame:
    return alerts.orderBy(F.col("time").desc_nulls_last(), *order).limit(n)
