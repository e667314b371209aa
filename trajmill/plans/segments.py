"""Ordered work on cases that may be far larger than one task.

``Window.partitionBy(case)`` puts a whole case into one task. A layout cuts every *hot* case
into time segments of about equal row count, so that the unit of ordered work is
``(case, segment)``. What an operator needs from the other segments of its case travels as a
small carry: the last ``k`` rows (lags), the latest value (as-of), or a running total.

Cut points exist for hot cases only. As a case is hot when it holds more than ``total/4096``
rows, there are at most 8,192 cut points in all, whatever the size of the data; that is what
makes the broadcasts in this module safe.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trajmill.plans.sizing import TARGET_ROWS

SEGMENT = "_seg"
HALO = "_halo"
MOST_SEGMENTS = 4096


@dataclass
class CaseLayout:
    """Cut points of the hot cases; ``cuts`` is None when no case is hot."""

    keys: list[str]
    time: str
    cuts: DataFrame | None = None
    depth: int = 0
    heavy_ties: bool = False

    @property
    def split(self) -> bool:
        return self.cuts is not None

    @property
    def group(self) -> list[str]:
        return [*self.keys, SEGMENT] if self.split else list(self.keys)

    def assign(self, df: DataFrame, time: str | None = None) -> DataFrame:
        """Add the segment number: how many cut points of the row's case lie at or before it."""
        if not self.split:
            return df
        moment = F.col(time or self.time)
        joined = join_null_safe(df, F.broadcast(self.cuts), self.keys)
        # Binary search, one comparison per power of two: get() is null past the end.
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(self.depth))])
        found = F.aggregate(
            steps, F.lit(0),
            lambda at, step: at + F.when(moment >= F.get(F.col("_cuts"), at + step - 1), step).otherwise(0),
        )
        return joined.withColumn(SEGMENT, F.when(F.col("_cuts").isNull(), 0).otherwise(found)).drop("_cuts")

    def window(self, order: list) -> Window:
        return Window.partitionBy(*(self.group or [F.lit(0)])).orderBy(*order)

    def join_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """Left-join one row per segment of the hot cases back to their rows."""
        return join_null_safe(df, F.broadcast(carry), self.group)

    def hot_rows(self, tagged: DataFrame) -> DataFrame:
        """The rows of hot cases only; the carries of this module are built from these."""
        hot = F.broadcast(self.cuts.select(*[F.col(k).alias(f"_hot_{k}") for k in self.keys]))
        on = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.keys]
        if not on:
            return tagged
        return tagged.join(hot, _all(on), "left_semi")


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join one row per key to the rows of that key, a null key included; without keys ``other`` is one row."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    renamed = other.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in other.columns])
    on = _all([F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def plan_layout(df: DataFrame, keys: list[str], time: str, target_rows: int | None = None) -> CaseLayout:
    """Measure the cases of ``df`` and cut the hot ones.

    Counted rows decide: a table that fits one task as a whole cannot hold a hot case. Otherwise one
    map-side-combined count by case follows, and only hot cases are read again for quantiles.
    """
    keys = list(keys)
    if target_rows is None:
        target_rows = TARGET_ROWS
        if df.count() <= target_rows:
            return CaseLayout(keys, time)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_layout_n"))
    total, biggest = counts.agg(F.sum("_layout_n"), F.max("_layout_n")).first()
    target = max(target_rows, ceil((total or 0) / MOST_SEGMENTS))
    if not biggest or biggest <= target:
        return CaseLayout(keys, time)
    hot = counts.where(F.col("_layout_n") > target)
    grid = 1 << ceil(biggest / target - 1).bit_length()
    shares = [i / grid for i in range(1, grid)]
    # hot holds at most 4,096 rows by the choice of target
    hot_only = join_null_safe(df.select(*keys, F.col(time).alias("_layout_at")), F.broadcast(hot), keys).where(F.col("_layout_n").isNotNull())
    sketch = hot_only.groupBy(*keys).agg(
        F.percentile_approx("_layout_at", F.array(*map(F.lit, shares)), F.lit(max(10_000, 8 * grid))).alias("_q"),
        F.ceil(F.max("_layout_n") / F.lit(float(target))).cast("int").alias("_pieces"),
    )
    picked = sketch.select(
        *keys, "_pieces",
        F.array_sort(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.col("_pieces") - 1),
            lambda j: F.get("_q", (j * F.lit(grid) / F.col("_pieces")).cast("int") - 1)))).alias("_cuts"),
    )
    rows = picked.collect()  # at most 8,192 doubles, see the module note
    longest = max((len(r["_cuts"]) for r in rows), default=0)
    # A cut point that repeats marks a time that holds several segments' worth of rows.
    ties = any(r["_pieces"] - 1 - len(r["_cuts"]) >= 2 for r in rows)
    schema = T.StructType([f for f in picked.schema.fields if f.name != "_pieces"])
    cuts = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) + (r["_cuts"],) for r in rows], schema)
    return CaseLayout(keys, time, cuts, max(1, longest.bit_length()), ties)


def with_lags(df: DataFrame, layout: CaseLayout, order: list[str], lags: dict[str, tuple[str | Column, int]]) -> DataFrame:
    """Add ``name = value k rows earlier in the same case`` for every entry of ``lags``.

    In a split layout the last rows of the preceding segments join each segment as halo rows and
    leave again after the window.
    """
    wanted = {name: (F.col(c) if isinstance(c, str) else c, k) for name, (c, k) in lags.items()}
    if not layout.split:
        w = layout.window(order)
        return df.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in wanted.items()})
    reach = max(k for _, k in wanted.values())
    sources = {f"_src{i}": c for i, (c, _) in enumerate(wanted.values())}
    tagged = layout.assign(df).withColumns(sources).withColumn(HALO, F.lit(False))
    cells = [*order, *sources]
    back = layout.window([F.col(c).desc() for c in order])
    tails = (
        layout.hot_rows(tagged).select(*layout.group, F.struct(*cells).alias("_row"),
                                       F.row_number().over(back).alias("_back"))
        .where(F.col("_back") <= reach)
        .groupBy(*layout.group).agg(F.sort_array(F.collect_list("_row")).alias("_tail"))  # reach rows at most
    )
    before = Window.partitionBy(*(layout.keys or [F.lit(0)])).orderBy(SEGMENT).rowsBetween(-reach, -1)
    halo = (
        tails.select(*layout.group, F.flatten(F.collect_list("_tail").over(before)).alias("_prev"))
        .where(F.size("_prev") > 0)
        .select(*layout.group, F.explode(F.slice("_prev", -F.least(F.size("_prev"), F.lit(reach)), reach)).alias("_row"))
        .select(*layout.group, *[F.col(f"_row.{c}").alias(c) for c in cells], F.lit(True).alias(HALO))
    )
    w = layout.window([F.col(HALO).desc(), *[F.col(c) for c in order]])
    both = tagged.unionByName(halo, allowMissingColumns=True)
    shifted = both.withColumns({n: F.lag(s, k).over(w) for s, (n, (_, k)) in zip(sources, wanted.items())})
    return shifted.where(~F.col(HALO)).drop(HALO, SEGMENT, *sources)


def with_running(df: DataFrame, layout: CaseLayout, order: list[str], *, last: dict[str, Column] | None = None,
                 total: dict[str, Column] | None = None, peak: dict[str, Column] | None = None, peers: bool = False,
                 reverse: bool = False) -> DataFrame:
    """Add running last-non-null values, running totals and running maxima in case order, the current row included.

    ``peers`` makes rows that share the whole order see each other (RANGE instead of ROWS);
    ``reverse`` runs from the end of each case to its start.
    """
    last, total, peak = last or {}, total or {}, peak or {}
    tagged = layout.assign(df)
    turn = (lambda c: F.col(c).desc()) if reverse else F.col
    w = layout.window([turn(c) for c in order])
    w = w.rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    sources = {f"_v{i}": c for i, c in enumerate([*last.values(), *total.values(), *peak.values()])}
    tagged = tagged.withColumns(sources)
    names = [*last, *total, *peak]

    def over(n: str, s: str) -> Column:
        return F.last(s, ignorenulls=True) if n in last else F.sum(s) if n in total else F.max(s)

    running = tagged.withColumns({n: over(n, s).over(w) for n, s in zip(names, sources)})
    if not layout.split:
        return running.drop(*sources)
    latest = F.min_by if reverse else F.max_by
    rank = F.struct(*order)
    per_segment = layout.hot_rows(tagged).groupBy(*layout.group).agg(*[
        (latest(F.col(s), F.when(F.col(s).isNotNull(), rank)) if n in last else over(n, s)).alias(s)
        for n, s in zip(names, sources)])
    before = Window.partitionBy(*(layout.keys or [F.lit(0)])).orderBy(turn(SEGMENT)).rowsBetween(
        Window.unboundedPreceding, -1)
    carry = per_segment.select(*layout.group, *[over(n, s).over(before).alias(f"_c{s}") for n, s in zip(names, sources)])
    joined = layout.join_carry(running, carry)

    def merge(n: str, c: str) -> Column:
        if n in last:
            return F.coalesce(F.col(n), F.col(c))
        if n in peak:
            return F.greatest(F.col(n), F.col(c))
        return F.when(F.col(n).isNull() & F.col(c).isNull(), None).otherwise(
            F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(c), F.lit(0)))

    merged = joined.withColumns({n: merge(n, f"_c{s}") for n, s in zip(names, sources)})
    return merged.drop(SEGMENT, *sources, *[f"_c{s}" for s in sources])


def with_position(df: DataFrame, layout: CaseLayout, order: list[str], name: str = "_k") -> DataFrame:
    """Add the 0-based position of each row in its case."""
    if not layout.split:
        return df.withColumn(name, F.row_number().over(layout.window(order)) - 1)
    numbered = with_running(df, layout, order, total={name: F.lit(1).cast("bigint")})
    return numbered.withColumn(name, (F.col(name) - 1).cast("bigint"))


def cluster(df: DataFrame, layout: CaseLayout) -> DataFrame:
    """Bring the rows of each case together before windows and a fold, when no case is hot.

    The windows that follow find the distribution they need and add no exchange, and neither does
    ``ordered_partitions(..., clustered=True)``: one shuffle serves all. Split layouts shuffle by
    segment later.
    """
    if layout.split:
        return df
    return df.repartition(*layout.keys) if layout.keys else df.repartition(1)


def ordered_partitions(df: DataFrame, layout: CaseLayout, order: list[str], clustered: bool = False) -> DataFrame:
    """Rows hashed by (case, segment) and sorted inside each partition, for streaming folds.

    ``clustered`` says the rows come from ``cluster`` and passed row-preserving steps only.
    """
    if not layout.split:
        tagged = df.withColumn(SEGMENT, F.lit(0))
        tagged = tagged if clustered else cluster(tagged, layout)
        return tagged.sortWithinPartitions(*layout.keys, *order)
    keys = [*layout.keys, SEGMENT]
    return layout.assign(df).repartition(*keys).sortWithinPartitions(*keys, *order)
