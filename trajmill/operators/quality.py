"""Inspection, time-step quality and case quality of trajectory tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trajmill.functions.columns import floating_columns, is_missing
from trajmill.plans.segments import plan_layout, with_lags, with_running
from trajmill.spec import TrajectorySpec

# Fixed value: status texts that count as a finished case (compared in lower case).
FINISHED = ("ok", "success", "succeeded", "complete", "completed")
ONE_CASE = "__single_case__"


# -- time windows ---------------------------------------------------------------------------

def filter_time_window(df: DataFrame, time: str, t_min: float | None = None, t_max: float | None = None) -> DataFrame:
    """Rows inside the closed interval; a bound may be left open. Reaches the scan as a filter."""
    out = df
    if t_min is not None:
        out = out.where(F.col(time) >= F.lit(t_min))
    if t_max is not None:
        out = out.where(F.col(time) <= F.lit(t_max))
    return out


def label_transient_steady(df: DataFrame, time: str, steady_start: float) -> DataFrame:
    """Label rows before ``steady_start`` transient and the others steady, in one scan."""
    early = F.col(time) < F.lit(steady_start)
    return df.withColumn("window", F.when(early, "transient").when(F.col(time).isNotNull(), "steady"))


def split_transient_steady(df: DataFrame, time: str, steady_start: float) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(time) < F.lit(steady_start)), df.where(F.col(time) >= F.lit(steady_start))


def describe_window(df: DataFrame, spec: TrajectorySpec, t_min: float | None = None, t_max: float | None = None) -> DataFrame:
    """Row and case counts before and after a time window, and the time range after it."""
    inside = F.lit(True)
    if t_min is not None:
        inside = inside & (F.col(spec.time) >= t_min)
    if t_max is not None:
        inside = inside & (F.col(spec.time) <= t_max)
    kept = F.when(inside, F.col(spec.time))
    measures = [F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("m"),
                F.min(kept).alias("lo"), F.max(kept).alias("hi")]
    # One row per case first: counting distinct cases then needs no second shuffle of the rows.
    per_case = df.groupBy(*spec.keys).agg(*measures)
    case_seen = F.col(spec.case).isNotNull() if spec.case else F.lit(True)
    return per_case.agg(
        F.sum("n").alias("rows_before"), F.sum("m").alias("rows_after"),
        F.count_if(case_seen).alias("cases_before"),
        F.count_if(case_seen & (F.col("m") > 0)).alias("cases_after"),
        F.min("lo").alias("time_min_after"), F.max("hi").alias("time_max_after"))


# -- table inspection -----------------------------------------------------------------------

def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    floating = floating_columns(df)
    one = df.agg(*[F.count_if(is_missing(c, c in floating)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "n_missing")


def case_lengths(df: DataFrame, case: str | None) -> DataFrame:
    """Rows per case; rows without a case form a group of their own."""
    if case is None:
        return df.agg(F.lit(ONE_CASE).alias("case_id"), F.count(F.lit(1)).alias("n_rows"))
    return df.groupBy(case).agg(F.count(F.lit(1)).alias("n_rows"))


def variance_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance, spread and range of each column; nulls and NaN are left out."""
    def clean(c):
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

    one = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.var_pop(clean(c)).alias("variance"), F.stddev_pop(clean(c)).alias("std"),
                 F.min(clean(c)).alias("min"), F.max(clean(c)).alias("max")).alias(f"_s{i}")
        for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*one.columns)))


def table_summary(df: DataFrame, spec: TrajectorySpec) -> DataFrame:
    rows = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    seen = F.count_if(F.col(spec.case).isNotNull()) if spec.case else F.lit(1).cast("bigint")
    return rows.agg(F.sum("n").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), seen.alias("n_cases"))


# -- exact percentiles per group --------------------------------------------------------------

def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float],
                target_rows: int | None = None) -> DataFrame:
    """Exact interpolated percentiles of ``value`` per group, also for groups too big for one task.

    Small groups use the built-in. Where a group is hot, its values are counted (map-side),
    ranked across value segments, and only the two neighbours of each rank are kept.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    layout = plan_layout(rows, keys, value, target_rows)
    if not layout.split:
        return rows.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in shares.items()])
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_running(counted, layout, [value], total={"_upto": F.col("_n")})
    totals = rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_top"))
    if keys:
        names = {k: f"_g_{k}" for k in keys}
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(g)) for k, g in names.items()])
        joined = ranked.join(totals.withColumnsRenamed(names), on)
    else:
        joined = ranked.crossJoin(F.broadcast(totals))  # one row

    def neighbours(p):
        at = F.col("_top") * F.lit(float(p))
        return [F.min(F.when(F.col("_upto") > f(at), F.col(value))) for f in (F.floor, F.ceil)]

    bounds = joined.groupBy(*keys).agg(F.max("_top").alias("_top"), *[
        c.alias(f"_{side}_{n}") for n, p in shares.items() for side, c in zip(("lo", "hi"), neighbours(p))])

    def between(n, p):
        at = F.col("_top") * F.lit(float(p))
        return F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (at - F.floor(at))

    return bounds.select(*keys, *[between(n, p).alias(n) for n, p in shares.items()])


# -- time steps -------------------------------------------------------------------------------

def time_steps(df: DataFrame, spec: TrajectorySpec, target_rows: int | None = None) -> DataFrame:
    """Steps of each case: positive ``dt`` to the time before, ``_copies`` of earlier rows at this time.

    ``_n`` rows stand behind each output row and ``_upto`` rows lie at or before it. When a case is
    hot, copies of one time are counted (map-side) before anything is ordered, so a time that
    holds a large share of all rows is one row here; otherwise one shuffle by case does it all.
    """
    times = df.select(*spec.keys, F.col(spec.time).cast("double").alias(spec.time))
    layout = plan_layout(times, spec.keys, spec.time, target_rows)
    if not layout.split:
        w = layout.window([spec.time])
        stepped = times.withColumns({"_before": F.lag(spec.time).over(w), "_n": F.lit(1).cast("bigint"),
                                     "_upto": F.row_number().over(w).cast("bigint")})
        same = F.col(spec.time) == F.col("_before")
        return stepped.withColumns({"_copies": F.when(same, 1).otherwise(0).cast("bigint"),
                                    "dt": F.when(~same, F.col(spec.time) - F.col("_before"))})
    times = times.groupBy(*spec.keys, spec.time).agg(F.count(F.lit(1)).alias("_n"))
    layout = plan_layout(times, spec.keys, spec.time, target_rows)
    stepped = with_lags(times, layout, [spec.time], {"_before": (spec.time, 1)})
    stepped = with_running(stepped, layout, [spec.time], total={"_upto": F.col("_n")})
    return stepped.withColumns({"_copies": F.col("_n") - 1, "dt": F.col(spec.time) - F.col("_before")})


def dt_summary(df: DataFrame, spec: TrajectorySpec, rtol: float = 1e-3, target_rows: int | None = None,
               steps: DataFrame | None = None) -> DataFrame:
    """Time-step summary per case: median and spread over positive steps, range over all steps."""
    steps = time_steps(df, spec, target_rows) if steps is None else steps
    copies = F.sum("_copies")
    if target_rows is None and not plan_layout(steps, spec.keys, spec.time).split:
        median_over, median = None, F.percentile("dt", F.lit(0.5))
    else:
        median_over, median = percentiles(steps, spec.keys, "dt", {"median_dt": 0.5}, target_rows), None
    stats = steps.groupBy(*spec.keys).agg(
        F.sum("_n").alias("n_samples"), F.min(spec.time).alias("time_start"), F.max(spec.time).alias("time_end"),
        *([median.alias("median_dt")] if median is not None else []),
        F.min("dt").alias("_min_dt"), F.max("dt").alias("_max_dt"), F.stddev_pop("dt").alias("dt_std"),
        copies.alias("duplicate_time_count"))
    if median_over is not None:
        stats = _by_keys(stats, median_over, spec.keys)
    enough = F.col("n_samples") >= 2
    increasing = enough & (F.col("duplicate_time_count") == 0)
    # The step farthest from the median is the smallest or the largest one.
    deviation = F.greatest(F.col("_max_dt") - F.col("median_dt"), F.col("median_dt") - F.col("_min_dt"))
    tolerance = F.lit(rtol) * F.greatest(F.abs("median_dt"), F.lit(1.0))
    case = F.col(spec.case) if spec.case else F.lit(ONE_CASE)
    repeated = F.col("duplicate_time_count") > 0
    return stats.select(
        case.alias("case_id"), "n_samples",
        F.when(enough, F.col("time_start")).alias("time_start"), F.when(enough, F.col("time_end")).alias("time_end"),
        "median_dt",
        F.when(repeated, F.lit(0.0)).otherwise(F.col("_min_dt")).alias("min_dt"),
        F.coalesce(F.col("_max_dt"), F.when(repeated, F.lit(0.0))).alias("max_dt"), "dt_std",
        "duplicate_time_count", F.col("duplicate_time_count").alias("nonmonotonic_dt_count"),
        increasing.alias("is_strictly_increasing"),
        F.coalesce(increasing & (deviation <= tolerance), F.lit(False)).alias("is_uniform"))


def _by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe left join of two tables that hold one row per case."""
    if not keys:
        return left.crossJoin(right)  # one row each
    names = {k: f"_k_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), on, "left").drop(*names.values())


def large_gaps(df: DataFrame, spec: TrajectorySpec, factor: float = 5.0, target_rows: int | None = None) -> DataFrame:
    """Steps longer than ``factor`` times the median positive step of their case."""
    steps = time_steps(df, spec, target_rows)
    medians = percentiles(steps, spec.keys, "dt", {"median_dt": 0.5}, target_rows)
    if spec.keys:
        names = {k: f"_k_{k}" for k in spec.keys}
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        joined = steps.join(medians.withColumnsRenamed(names), on)
    else:
        joined = steps.crossJoin(F.broadcast(medians))  # one row
    case = F.col(spec.case) if spec.case else F.lit(ONE_CASE)
    return joined.where(F.col("dt") > F.lit(factor) * F.col("median_dt")).select(
        case.alias("case_id"), (F.col("_upto") - F.col("_n") - 1).alias("row_before_sorted"),
        F.col("_before").alias("time_before"), F.col(spec.time).alias("time_after"), "dt", "median_dt")


def nonuniform_cases(summary: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Cases whose steps differ from the median by more than the loader's (tighter) tolerance."""
    deviation = F.greatest(F.col("max_dt") - F.col("median_dt"), F.col("median_dt") - F.col("min_dt"))
    return summary.where(deviation > F.lit(rtol) * F.greatest(F.abs("median_dt"), F.lit(1.0)))


# -- warnings as rows ---------------------------------------------------------------------------

_WARNINGS = {
    "MISSING_VALUES": ("Columns used for modelling hold missing values.",
                       "Dense fits cannot use rows with holes.", "Fill short gaps, or drop the rows or cases."),
    "NO_TIME_COLUMN": ("No time column is named.", "Time steps cannot be judged and resampling is unavailable.",
                       "Name the time column of the table."),
    "NEAR_ZERO_STATE_VARIANCE": ("A state hardly varies.", "It distorts scaling, energies and relative errors.",
                                 "Leave constant states out of the model."),
    "NEAR_ZERO_INPUT_VARIANCE": ("An input hardly varies.", "Its effect cannot be told apart within a case.",
                                 "Keep it only where it differs between cases."),
    "TOO_FEW_SAMPLES": ("A case has fewer than two rows.", "It holds no transition.", "Drop the case."),
    "DUPLICATE_TIME_VALUES": ("A case repeats a time.", "The order of its rows is ambiguous.",
                              "Drop or average the repeated rows."),
    "NON_MONOTONIC_TIME": ("The time of a case does not strictly increase.", "Transitions need one clear order.",
                           "Sort the case and drop repeated times."),
    "IRREGULAR_TIME_STEP": ("The step of a case varies.", "A discrete model then maps sample to sample only.",
                            "Fit the variable-step model, or resample on purpose."),
    "LARGE_TIME_GAPS": ("A case has steps far above its median.", "Gaps dominate rollouts and interpolation.",
                        "Look at the gap table, or use continuous stretches only."),
}


def quality_warnings(df: DataFrame, spec: TrajectorySpec, *, rtol: float = 1e-3, factor: float = 5.0,
                     has_time: bool = True) -> DataFrame:
    """All findings as rows: code, case or column concerned, count, message, reason, action."""
    def found(rows: DataFrame, code: str, subject: Column, count: Column) -> DataFrame:
        message, why, action = _WARNINGS[code]
        return rows.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"),
                           count.cast("bigint").alias("count"), F.lit(message).alias("message"),
                           F.lit(why).alias("why_it_matters"), F.lit(action).alias("suggested_action"))

    parts = [found(missing_values(df, spec.required).where(F.col("n_missing") > 0), "MISSING_VALUES",
                   F.col("column"), F.col("n_missing"))]
    spread = variance_by_column(df, spec.values).where(F.col("variance") <= 1e-14)
    for code, names in (("NEAR_ZERO_STATE_VARIANCE", spec.states), ("NEAR_ZERO_INPUT_VARIANCE", spec.inputs)):
        parts.append(found(spread.where(F.col("column").isin(list(names))), code, F.col("column"), F.lit(1)))
    if has_time:
        s = dt_summary(df, spec, rtol)
        case, up = F.col("case_id"), F.col("is_strictly_increasing")
        dup = F.col("duplicate_time_count")
        parts += [
            found(s.where(F.col("n_samples") < 2), "TOO_FEW_SAMPLES", case, F.col("n_samples")),
            found(s.where(dup > 0), "DUPLICATE_TIME_VALUES", case, dup),
            found(s.where(dup > 0), "NON_MONOTONIC_TIME", case, dup),
            found(s.where(up & ~F.col("is_uniform")), "IRREGULAR_TIME_STEP", case, F.col("n_samples")),
            found(large_gaps(df, spec, factor).groupBy("case_id").count(), "LARGE_TIME_GAPS", case, F.col("count")),
        ]
    else:
        one = df.sparkSession.range(1)
        parts.append(found(one, "NO_TIME_COLUMN", F.lit(None), F.lit(1)))
    return reduce(lambda a, b: a.unionByName(b), parts)


# -- case quality ---------------------------------------------------------------------------------

def case_quality(df: DataFrame, spec: TrajectorySpec, *, required: list[str] | None = None, min_samples: int = 3,
                 expected_final_time: float | None = None, final_time_tol: float = 1e-6,
                 status: str | None = None) -> DataFrame:
    """One row per case with its problems and whether it may be used for a fit.

    Repeated times are found by counting copies per (case, time) first, so neither a hot case nor
    a hot time meets in one task.
    """
    required = list(required or [])
    absent = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    floating = floating_columns(df)
    has_time = spec.time in df.columns
    order = [c for c in spec.sort if c in df.columns]
    missing = F.lit(0)
    for c in present:
        missing = missing + is_missing(c, c in floating).cast("int")
    at = [spec.time] if has_time else []
    local = df.groupBy(*spec.keys, *at).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(missing).cast("bigint").alias("_missing"),
        *([F.max(F.struct(*[F.col(c) for c in order], F.coalesce(F.col(status).cast("string"), F.lit("None")).alias("_status"))).alias("_last")]
          if status and status in df.columns else []))
    moment = F.col(spec.time).cast("double") if has_time else F.lit(None).cast("double")
    timed = moment.isNotNull() & ~F.isnan(moment)  # rows without a time are no copies of each other
    per_case = local.groupBy(*spec.keys).agg(
        F.sum("_n").alias("n_rows"), F.sum("_missing").alias("n_missing_required_values"),
        F.min(moment).alias("time_start"), F.max(moment).alias("time_end"),
        F.coalesce(F.bool_or(timed & (F.col("_n") > 1)), F.lit(False)).alias("_repeated"),
        *([F.max("_last").getField("_status").alias("explicit_status")] if "_last" in local.columns
          else [F.lit(None).cast("string").alias("explicit_status")]))
    nonmonotonic = F.when((F.col("n_rows") >= 2) & F.lit(has_time), F.col("_repeated"))
    final_ok = (F.abs(F.col("time_end") - F.lit(float(expected_final_time))) <= final_time_tol
                if expected_final_time is not None and has_time else F.lit(None).cast("boolean"))
    judged = per_case.withColumns({"nonmonotonic_time": nonmonotonic, "final_time_ok": final_ok})
    finished = F.lower("explicit_status").isin(*FINISHED)
    checks = {
        "too_short": F.col("n_rows") < min_samples,
        "missing_required_columns": F.lit(bool(absent)),
        "nan_in_required_columns": F.col("n_missing_required_values") > 0,
        "nonmonotonic_or_duplicate_time": F.col("nonmonotonic_time"),
        "missing_expected_final_time": ~F.col("final_time_ok"),
        "status_not_success": (~F.coalesce(finished, F.lit(False)) if status and status in df.columns else F.lit(False)),
    }
    problems = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))
    case = F.col(spec.case) if spec.case else F.lit(ONE_CASE)
    return judged.select(
        case.alias("case_id"), "n_rows", "time_start", "time_end", "final_time_ok", "nonmonotonic_time",
        "explicit_status", "n_missing_required_values", F.array_join(problems, ";").alias("problems"),
        (F.size(problems) == 0).alias("usable_for_rom"))


def filter_usable_cases(df: DataFrame, quality: DataFrame, case: str) -> DataFrame:
    """Rows of usable cases (semi join)."""
    good = quality.where("usable_for_rom").select(F.col("case_id").alias(case))
    return df.join(good, case, "left_semi")
