"""Transitions, delay embedding, resampling, as-of and nearest-time joins, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill.functions.columns import number
from trajmill.plans.segments import CaseLayout, join_null_safe, plan_layout, with_lags, with_running
from trajmill.plans.sizing import BROADCAST_ROWS, fits_one_task
from trajmill.session import settle
from trajmill.spec import TrajectorySpec


# -- rows next to each other ------------------------------------------------------------------

def transitions(df: DataFrame, spec: TrajectorySpec, layout: CaseLayout | None = None,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per step of a case: start time, states, inputs, ``next_<state>`` and ``dt``.

    The row is built at the *end* of the step from the row before, so only lags are needed and a
    step never crosses cases.
    """
    layout = layout or plan_layout(df, spec.keys, spec.time)
    before = {f"_b_{c}": (c, 1) for c in [spec.time, *spec.values]}
    shifted = with_lags(df, layout, spec.sort, before).where(F.col(f"_b_{spec.time}").isNotNull())
    return shifted.select(
        *spec.keys, F.col(f"_b_{spec.time}").alias(spec.time),
        *[F.col(f"_b_{c}").alias(c) for c in spec.values],
        *[F.col(c).alias(f"next_{c}") for c in spec.states],
        (F.col(spec.time) - F.col(f"_b_{spec.time}")).alias("dt"), *extra)


def slopes(df: DataFrame, spec: TrajectorySpec, layout: CaseLayout | None = None) -> DataFrame:
    """Transitions with ``slope_<state>``; a step that does not move time forward stops the job."""
    steps = transitions(df, spec, layout)
    dt = F.when(F.col("dt") > 0, F.col("dt")).otherwise(
        F.raise_error(F.lit("time must strictly increase inside a case")).cast("double"))
    return steps.withColumns({f"slope_{c}": (F.col(f"next_{c}") - F.col(c)) / dt for c in spec.states})


def delay_names(states, n_delays: int) -> list[str]:
    return [f"{c}__lag{i}" for i in range(n_delays) for c in states]


def delay_embedding(df: DataFrame, spec: TrajectorySpec, n_delays: int,
                    layout: CaseLayout | None = None) -> tuple[DataFrame, TrajectorySpec]:
    """Stack the last ``n_delays`` states of every row (lag-major); the first rows of a case leave."""
    if n_delays < 1:
        raise ValueError("n_delays must be at least 1")
    layout = layout or plan_layout(df, spec.keys, spec.time)
    lags = {f"{c}__lag{i}": (c, i) for i in range(1, n_delays) for c in spec.states}
    mark = {"_filled": (F.lit(True), n_delays - 1)} if n_delays > 1 else {}
    shifted = with_lags(df, layout, spec.sort, {**lags, **mark}) if lags else df
    if mark:
        shifted = shifted.where("_filled")
    current = {f"{c}__lag0": F.col(c) for c in spec.states}
    names = delay_names(spec.states, n_delays)
    keep = list(dict.fromkeys([*spec.keys, spec.time, *spec.order, *spec.inputs]))
    return shifted.withColumns(current).select(*keep, *names), spec.with_states(names)


# -- as-of and nearest joins --------------------------------------------------------------------

_ASK = 1  # rows of the asking side sort after rows of the answering side at one time


def _seek(left: DataFrame, right: DataFrame, keys: list[str], left_time: Column, order: list[str], answer,
          target_rows: int | None) -> DataFrame:
    """Union both sides, let ``answer(rows, layout)`` add columns by running windows, keep the left rows.

    ``right`` brings ``_t`` and the columns it answers with. When one time of a case holds a
    large share of the left rows, every (case, time) is asked once and the answers are joined
    back, so that the copies are spread by the adaptive skew join.
    """
    asking = left.withColumns({"_t": left_time.cast("double"), "_side": F.lit(_ASK)})
    given = right.withColumn("_side", F.lit(0))
    layout = plan_layout(asking.select(*keys, "_t").unionByName(given.select(*keys, "_t")), keys, "_t", target_rows)
    if not (layout.split and layout.heavy_ties):
        both = asking.unionByName(given, allowMissingColumns=True)
        return answer(both, layout).where(F.col("_side") == _ASK).drop("_t", "_side", *order)
    asks = asking.select(*keys, "_t", "_side").distinct()
    told = answer(asks.unionByName(given, allowMissingColumns=True), layout).where(F.col("_side") == _ASK)
    told = told.drop("_side", *order).withColumnsRenamed({c: f"_a_{c}" for c in [*keys, "_t"]})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in [*keys, "_t"]])
    return asking.join(told, on, "left").drop("_t", "_side", *[f"_a_{c}" for c in [*keys, "_t"]])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                  values: list[str], order: tuple[str, ...] = (), slack: float = 1e-12,
                  target_rows: int | None = None) -> DataFrame:
    """Add to each left row the latest right values with ``right_time <= left_time + slack``.

    Both sides are unioned and a running last value is taken per case segment; the value of
    earlier segments comes in as a carry, so no case has to fit into one task.
    """
    ranks = [f"_o{i}" for i in range(len(order))]
    given = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).cast("double").alias("_t"), *[F.col(c).alias(r) for c, r in zip(order, ranks)],
        F.struct(*values).alias("_found"))

    def answer(both, layout):
        return with_running(both, layout, ["_t", "_side", *ranks], last={"_seen": F.col("_found")}).drop("_found")

    found = _seek(left, given, keys, F.col(left_time) + F.lit(slack), ranks, answer, target_rows)
    keep = [c for c in left.columns if c not in values]
    return found.select(*keep, *[F.col(f"_seen.{v}").alias(v) for v in values])


def nearest_match(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                  values: list[str], tolerance: float | Column, target_rows: int | None = None,
                  order: tuple[str, ...] = ()) -> DataFrame:
    """Inner join each left row with the nearest right row within ``tolerance`` (earlier wins ties).

    Of right rows at one time the first in ``order`` stands for them; without an order any of them.

    The nearest row is the last one at or before the target or the first one after it. Both come
    from running windows over one union (one shuffle, two sorts), so no pairs are formed however
    many right rows fall into one tolerance interval.
    """
    picked = [right_time, *values]
    if order:
        right = right.groupBy(*keys, right_time).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v")).select(
            *keys, right_time, *[F.col(f"_v.{v}").alias(v) for v in values])
    given = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).cast("double").alias("_t"), F.struct(*[
            F.col(c).cast("double").alias(c) if c == right_time else F.col(c) for c in picked]).alias("_found"))

    def answer(both, layout):
        low = with_running(both, layout, ["_t", "_side"], last={"_low": F.col("_found")})
        return with_running(low, layout, ["_t", "_side"], last={"_high": F.col("_found")}, reverse=True).drop("_found")

    both = _seek(left, given, keys, F.col(left_time), [], answer, target_rows)
    target = F.col(left_time).cast("double")
    d_low = target - F.col(f"_low.{right_time}")
    d_high = F.col(f"_high.{right_time}") - target
    use_low = d_low.isNotNull() & (d_high.isNull() | (d_low <= d_high))
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    gap = F.when(use_low, d_low).otherwise(d_high)
    return both.withColumns({"time_error_s": gap, "_hit": F.when(use_low, F.col("_low")).otherwise(F.col("_high"))}).where(
        F.col("time_error_s") <= tolerance).select(
        *left.columns, *[F.col(f"_hit.{c}").alias(c) for c in picked], "time_error_s")


def flags_at_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                  flags: dict[str, Column], tolerance: float = 1e-9, target_rows: int | None = None) -> DataFrame:
    """Add boolean flags: does any right row within ``tolerance`` of the left time satisfy them?

    For each flag the latest flagged time up to ``left_time + tolerance`` decides; all flags come
    from one running window.
    """
    marks = {name: F.when(condition, F.col(right_time).cast("double")) for name, condition in flags.items()}
    given = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).cast("double").alias("_t"), *[m.alias(f"_m_{n}") for n, m in marks.items()])
    given = given.groupBy(*keys, "_t").agg(*[F.max(f"_m_{n}").alias(f"_m_{n}") for n in marks])

    def answer(both, layout):
        return with_running(both, layout, ["_t", "_side"], last={f"_at_{n}": F.col(f"_m_{n}") for n in marks}).drop(
            *[f"_m_{n}" for n in marks])

    found = _seek(left, given, keys, F.col(left_time) + F.lit(tolerance), [], answer, target_rows)
    return found.select(*left.columns, *[
        F.coalesce(F.abs(F.col(f"_at_{n}") - F.col(left_time)) <= tolerance, F.lit(False)).alias(n) for n in flags])


# -- resampling -----------------------------------------------------------------------------------

def resample_linear(df: DataFrame, spec: TrajectorySpec, dt: float, columns: list[str] | None = None,
                    drop_duplicate_times: bool = True, target_rows: int | None = None) -> DataFrame:
    """Linear interpolation of every case on its own grid ``t0 + i*dt``.

    Each pair of neighbouring rows makes the grid points between them, so grid, bracket and
    interpolation come from one lag and one explode; no grid is joined to the data. The last
    point may lie up to half a step past the end and takes the last value.
    """
    if dt <= 0:
        raise ValueError("dt must be positive")
    columns = columns or [c for c, kind in df.dtypes
                          if kind in ("double", "float", "int", "bigint", "smallint", "tinyint")
                          and c not in (spec.time, *spec.keys, *spec.order)]
    t = F.col(spec.time).cast("double")
    rows = df.select(*spec.keys, t.alias(spec.time), *[c for c in spec.order if c not in columns and c != spec.time],
                     *[F.col(c).cast("double").alias(c) for c in columns]).where(F.col(spec.time).isNotNull())
    layout = plan_layout(rows, spec.keys, spec.time, target_rows)
    # Of several rows at one time the first counts, by ``order`` and then by the values, in either layout.
    tie = [c for c in spec.order if c in rows.columns]
    if drop_duplicate_times:
        if layout.split and layout.heavy_ties:
            pick = F.struct(*[F.col(c) for c in [*tie, *columns]])
            rows = rows.groupBy(*spec.keys, spec.time).agg(F.min(pick).alias("_first")).select(
                *spec.keys, spec.time, *[F.col(f"_first.{c}").alias(c) for c in dict.fromkeys([*tie, *columns])])
        else:
            rows = with_lags(rows, layout, list(dict.fromkeys([spec.time, *tie, *columns])), {"_seen": (spec.time, 1)})
            rows = rows.where(F.col("_seen").isNull() | (F.col("_seen") < F.col(spec.time))).drop("_seen")
    pairs = with_lags(rows, layout, [c for c in spec.sort if c in rows.columns], {
        "_a_t": (spec.time, 1), **{f"_a_{c}": (c, 1) for c in columns}})
    span = {"_t0": F.min(spec.time), "_tn": F.max(spec.time)}
    if layout.split:
        ends = rows.groupBy(*spec.keys).agg(*[f.alias(n) for n, f in span.items()])
        pairs = pairs.where(F.col("_a_t").isNotNull())
        pairs = join_null_safe(pairs, ends, list(spec.keys))
    else:  # every case fits a task and is already there
        whole = Window.partitionBy(*(spec.keys or [F.lit(0)]))
        pairs = pairs.withColumns({n: f.over(whole) for n, f in span.items()}).where(F.col("_a_t").isNotNull())
    t0, step = F.col("_t0"), F.lit(float(dt))
    at = lambda i: t0 + i * step
    # First grid index past the row before, last one up to this row; rounding is settled by comparing
    # the grid times themselves.
    def first_after(moment):
        i = F.floor((moment - t0) / step)
        return F.when(at(i) > moment, i).when(at(i + 1) > moment, i + 1).otherwise(i + 2)

    is_first, is_last = F.col("_a_t") == t0, F.col(spec.time) == F.col("_tn")
    lo = F.when(is_first, F.lit(0).cast("bigint")).otherwise(first_after(F.col("_a_t")))
    # arange(t0, tn + dt/2, dt) stops before its end
    hi = F.when(is_last, F.ceil((F.col("_tn") + 0.5 * step - t0) / step) - 1).otherwise(first_after(F.col(spec.time)) - 1)
    spread = pairs.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_hi") >= F.col("_lo"))
    grid = spread.withColumn("_i", F.explode(F.sequence("_lo", "_hi"))).withColumn("_g", at(F.col("_i")))
    share = F.least((F.col("_g") - F.col("_a_t")) / (F.col(spec.time) - F.col("_a_t")), F.lit(1.0))
    return grid.select(*spec.keys, F.col("_g").alias(spec.time), *[
        (F.col(f"_a_{c}") + share * (F.col(c) - F.col(f"_a_{c}"))).alias(c) for c in columns])


def resample_uniform(df: DataFrame, time: str, dt: float, columns: list[str] | None = None) -> DataFrame:
    """Resample a table that is one trajectory; its times are taken as they are."""
    return resample_linear(df, TrajectorySpec(time=time, states=()), dt, columns, drop_duplicate_times=False)


# -- train / test splits ----------------------------------------------------------------------------

class UnknownCases(ValueError):
    """A split names cases the table does not hold."""


def distinct_cases(df: DataFrame, case: str) -> DataFrame:
    return df.where(F.col(case).isNotNull()).select(case).distinct()


def split_by_case_ids(df: DataFrame, case: str, train: list, test: list) -> tuple[DataFrame, DataFrame]:
    """Rows of the named train and test cases; ids compare as text and may be in both."""
    train, test = [str(c) for c in train], [str(c) for c in test]
    if not train or not test:
        raise ValueError("both sides of a split need at least one case")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(c,) for c in sorted({*train, *test})], "id string")
    known = df.select(F.col(case).cast("string").alias("id")).where(F.col("id").isin([*train, *test])).distinct()
    unknown = [r["id"] for r in wanted.exceptAll(known).orderBy("id").collect()]
    if unknown:
        raise UnknownCases(f"unknown case ids: {unknown}")
    as_text = F.col(case).cast("string")
    return df.where(as_text.isin(train)), df.where(as_text.isin(test))


def split_labels(cases: DataFrame, case: str, train_fraction: float = 0.7) -> DataFrame:
    """Label sorted cases train or test; the train count is rounded half to even, within 1..N-1."""
    if not 0.0 < train_fraction < 1.0:
        raise ValueError("train_fraction must lie strictly between 0 and 1")
    numbered = global_rank(cases, case)
    n = F.col("_total")
    n_train = F.greatest(F.lit(1), F.least(F.bround(n * F.lit(train_fraction), 0).cast("bigint"), n - 1))
    return numbered.select(case, F.when(F.col("_rank") < n_train, "train").otherwise("test").alias("split"))


def global_rank(cases: DataFrame, column: str) -> DataFrame:
    """0-based rank of distinct values over the whole table, and the total.

    A list counted small is ranked by one window. A larger one is sorted into ranges, written to
    the shared folder (so that both uses see the same ranges), and ranked per range plus the count
    of the ranges before.
    """
    if fits_one_task(cases, BROADCAST_ROWS):
        everything = Window.partitionBy(F.lit(0))
        return cases.withColumns({"_rank": F.row_number().over(everything.orderBy(column)) - 1,
                                  "_total": F.count(F.lit(1)).over(everything)})
    parts = int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(cases.select(column).repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # one row per range
    before = sizes.select(
        "_part", F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_total"),
        F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").select(
        column, (F.col("_before") + F.col("_local")).alias("_rank"), "_total")


def split_by_fraction(df: DataFrame, case: str, train_fraction: float = 0.7) -> DataFrame:
    """Add a ``split`` column."""
    labels = split_labels(distinct_cases(df, case), case, train_fraction)
    return df.join(labels, case)


def leave_one_case_out(df: DataFrame, case: str) -> DataFrame:
    """One row per fold and case: the held-out case is test, all others train (fold table only).

    The fold of a case is its rank; the train side of a fold is "every other case", which the fit
    takes from merged factors and never from repeated rows.
    """
    return global_rank(distinct_cases(df, case), case).select(
        F.col("_rank").alias("fold"), F.col(case).alias("test_case"), (F.col("_total") - 1).alias("n_train_cases"))


# -- operating conditions -------------------------------------------------------------------------

def operating_conditions(df: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """Compare train and test ranges of each column; one aggregation over both sides."""
    def side(c, name, f):
        value = number(c)
        return f(F.when((F.col(split) == name) & ~F.isnan(value), value))

    one = df.agg(*[F.struct(F.lit(c).alias("condition"), *[
        side(c, name, f).alias(f"{name}_{label}") for name in ("train", "test")
        for label, f in (("min", F.min), ("max", F.max))]).alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = one.select(F.inline(F.array(*one.columns)))
    outside = (F.col("test_min") < F.col("train_min")) | (F.col("test_max") > F.col("train_max"))
    status = (F.when(outside.isNull(), "missing_numeric_values").when(outside, "extrapolation")
              .otherwise("interpolation_or_overlap"))
    return rows.select(
        "condition", *[F.when(outside.isNotNull(), F.col(c)).alias(c)
                       for c in ("train_min", "train_max", "test_min", "test_max")],
        outside.alias("test_outside_train_range"),
        (F.col("test_min") - F.col("train_min")).alias("low_margin_test_minus_train_min"),
        (F.col("test_max") - F.col("train_max")).alias("high_margin_test_minus_train_max"), status.alias("status"))


def extrapolation_warnings(summary: DataFrame) -> DataFrame:
    outside = summary.where(F.col("status") == "extrapolation")
    return outside.select("condition", F.format_string(
        "%s of the test cases leaves the trained range [%s, %s]", "condition",
        F.col("train_min").cast("string"), F.col("train_max").cast("string")).alias("warning"))


# -- long and wide forecasts ------------------------------------------------------------------------

def forecasts_wide(forecasts: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """One row per origin and horizon with a column per state; rows with a null key leave."""
    usable = forecasts
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    return usable.groupBy(*keys).pivot("state", states).agg(F.first("predicted_value", ignorenulls=True))


def join_positions(df: DataFrame, positions: dict[str, float], states: list[str], state: str = "state") -> DataFrame:
    """Add the position of each state (a constant map); states without one follow after the others."""
    placed = dict(positions)
    for s in states:
        placed.setdefault(s, float(len(placed)))
    pairs = F.create_map(*[x for s, p in placed.items() for x in (F.lit(s), F.lit(float(p)))])
    return df.withColumn("position_m", pairs[F.col(state)])
