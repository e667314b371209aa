"""Checked live rows: value checks as columns, time-order checks as keyed state or as windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajmill.plans.segments import join_null_safe, plan_layout, with_lags, with_position, with_running
from trajmill.spec import TrajectorySpec

SEQ = "_stream_row_index"

# Warning codes of the live buffer.
MISSING, NOT_A_NUMBER, NOT_FINITE = "MISSING_REQUIRED_COLUMNS", "NONNUMERIC_REQUIRED_VALUE", "NONFINITE_REQUIRED_VALUE"
BACKWARDS, REPEATED = "NONMONOTONIC_LIVE_TIME", "DUPLICATE_LIVE_TIME"

_TEXTS = {
    MISSING: ("A live row lacks a required column.", "Compare the logger columns with the configured ones."),
    NOT_A_NUMBER: ("A required value is no number.", "Check units and how the logger writes missing values."),
    NOT_FINITE: ("A required value is missing or infinite.", "Drop or fill the row before predicting."),
    BACKWARDS: ("Time went back; the row is kept in arrival order.", "Check the order of the logger."),
    REPEATED: ("A time came twice; the row is kept.", "Check whether the logger writes rows again."),
}


def check_values(df: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """Add ``_code``: the first failed value check of a row, in fixed order; numbers become doubles.

    Works on streams. Invalid rows keep their raw text in ``_raw_<column>`` where they were text.
    """
    numeric = [*spec.values, spec.time]
    absent = [c for c in spec.required if c not in df.columns]
    if absent:
        return df.withColumns({**{c: F.lit(None).cast("double") for c in absent if c in numeric}, "_code": F.lit(MISSING)})
    as_number = {c: F.col(c).try_cast("double") for c in numeric}
    bad = lambda test: _any([test(c) for c in numeric])
    code = (F.when(bad(lambda c: F.col(c).isNotNull() & as_number[c].isNull()), NOT_A_NUMBER)
            .when(bad(lambda c: F.col(c).isNull() | F.isnan(as_number[c]) | (F.abs(as_number[c]) == float("inf"))), NOT_FINITE))
    return df.withColumn("_code", code).withColumns(as_number)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def gather(rows, columns: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch; computed columns arrive under positional names."""
    frame = pd.concat(list(rows), ignore_index=True)
    frame.columns = columns
    return frame


def in_order(rows, columns: list[str], order: str = SEQ) -> tuple[list[pd.DataFrame], np.ndarray]:
    """The frames of one key as they came, and the ranks of their rows in ``order``; rows without an order come last.

    Only the order column is put together and sorted. Frames stay as they are and can leave one by one.
    """
    frames = []
    for frame in rows:
        frame.columns = columns
        frames.append(frame.reset_index(drop=True))
    values = pd.concat([f[order] for f in frames], ignore_index=True) if frames else pd.Series([], dtype=float)
    return frames, values.argsort(kind="stable").to_numpy() if values.notna().all() else np.argsort(
        values.astype(float).fillna(np.inf).to_numpy(), kind="stable")


def dealt(values: np.ndarray, frames: list[pd.DataFrame]):
    """Values of all rows, cut to the frames they belong to."""
    edge = np.cumsum([0, *map(len, frames)])
    return zip(frames, (values[lo:hi] for lo, hi in zip(edge, edge[1:])))


BUCKETS = 512  # part of a stream's state: a checkpoint keeps the number it was begun with
CASE, BUCKET = "_case_key", "_bucket"


def bucketed(stream: DataFrame, case: str | None) -> DataFrame:
    """Add the text of the case and its bucket. State is kept by bucket, as a call per case and trigger costs far more than its rows do."""
    key = F.lit("all") if case is None else F.coalesce(F.concat(F.lit("="), F.col(case).cast("string")), F.lit("null"))
    return stream.withColumn(CASE, key).withColumn(BUCKET, F.pmod(F.xxhash64(CASE), F.lit(BUCKETS)).cast("int"))


def packed(held: pd.DataFrame) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_pandas(held, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(raw) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all().to_pandas()


def case_runs(names: np.ndarray, order: np.ndarray, held: pd.Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.Index]:
    """Rows of a bucket, case after case, each case in ``order``: their places, case numbers and ranks in the case, and all cases known.

    ``held`` are the cases known before; new ones follow them.
    """
    codes, fresh = pd.factorize(names)
    number = held.get_indexer(fresh)
    new = number < 0
    number[new] = len(held) + np.arange(new.sum())
    mine = number[codes]
    place = order[np.argsort(mine[order], kind="stable")]
    case = mine[place]
    return place, case, np.arange(len(case)) - np.searchsorted(case, case), held.append(pd.Index(fresh[new], dtype=object))


class _TimeOrder(StatefulProcessor):
    """Per bucket of cases: of each case the last and the latest time that arrived and how many rows came, and the times seen lately.

    The times lie in a map from stretch number to (case, time) pairs. A batch reads and writes the stretches that its rows fall into, and leaves
    out what lies before the memory of its case; of the older stretches a few are tidied in turn.
    """

    TIDIED = 2

    def __init__(self, columns: list[str], time: str, remember: float, forget: float | None):
        self.columns, self.time, self.remember, self.forget = columns, time, remember, forget
        self.stretch = remember / 8.0 if 0 < remember < float("inf") else 86400.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.forget is None else int(self.forget * 1000)
        self.state = handle.getValueState("order", "cases binary, stretches array<bigint>, next bigint, turn bigint", ttl)
        self.seen = handle.getMapState("seen", "stretch bigint", "pairs binary", ttl)

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        now = 0 if self.forget is None else timerValues.getCurrentProcessingTimeInMs()
        if held is None:
            cases = pd.DataFrame({"case": pd.Series([], dtype=object), "id": np.zeros(0, np.int64), "last": np.zeros(0), "latest": np.zeros(0),
                                  "rows": np.zeros(0, np.int64), "touched": np.zeros(0, np.int64)})
            self.stretches, fresh_id, turn = set(), 0, 0
            if self.forget is not None:
                self.seen.clear()
        else:
            cases, self.stretches, fresh_id, turn = unpacked(held[0]), set(held[1]), held[2], held[3]
            if self.forget is not None:  # a case that comes again after its silence is a new one, so its old times fit no more
                cases = cases[cases["touched"] + self.forget * 1000 > now].reset_index(drop=True)
        frames, order = in_order(rows, self.columns)
        whole = lambda c: np.concatenate([f[c].to_numpy() for f in frames])
        place, case, rank, names = case_runs(whole(CASE), order, pd.Index(cases["case"], dtype=object))
        added = len(names) - len(cases)
        ids = np.append(cases["id"].to_numpy(), fresh_id + np.arange(added)).astype(np.int64)
        last, latest = np.append(cases["last"], np.full(added, np.nan)), np.append(cases["latest"], np.full(added, -np.inf))
        count, touched = np.append(cases["rows"], np.zeros(added, np.int64)).astype(np.int64), np.append(cases["touched"], np.zeros(added, np.int64)).astype(np.int64)

        given = pd.concat([f[SEQ] for f in frames], ignore_index=True)
        numbered = np.empty(len(place), np.int64)
        numbered[place] = count[case] + rank
        numbers = given.where(given.notna(), pd.Series(numbered)).astype("int64").to_numpy()
        count += np.bincount(case, minlength=len(names))
        touched[case] = now
        codes = np.concatenate([f["_code"].to_numpy(object) for f in frames])
        sound = pd.isna(codes[place])
        valid, case = place[sound], case[sound]
        if len(valid):
            times = whole(self.time).astype(float)[valid] + 0.0
            first = np.append(True, case[1:] != case[:-1])
            before = np.append(np.nan, times[:-1])
            before[first] = last[case[first]]
            peak = pd.Series(np.maximum(times, latest[case])).groupby(case).cummax().to_numpy()
            peak_before = np.append(-np.inf, peak[:-1])
            peak_before[first] = latest[case[first]]
            end = np.append(first[1:], True)
            last[case[end]], latest[case[end]] = times[end], peak[end]
            known = self._seen_before(ids[case], times, ids, latest)
            remembered = known & (times >= peak_before - self.remember)
            codes[valid] = np.where(times < before, BACKWARDS, np.where((times == before) | remembered, REPEATED, None))
            turn = self._tidy(ids, latest, turn)
        cases = pd.DataFrame({"case": names, "id": ids, "last": last, "latest": latest, "rows": count, "touched": touched})
        self.state.update((packed(cases), sorted(self.stretches), int(fresh_id + added), int(turn)))
        for (frame, code), (_, number) in zip(dealt(codes, frames), dealt(numbers, frames)):
            yield frame.assign(**{"_code": code, SEQ: number})

    def _pairs(self, stretch: int) -> np.ndarray:
        """(case, time) pairs of a stretch as complex numbers."""
        found = self.seen.getValue((stretch,)) if stretch in self.stretches else None
        return np.zeros(0, complex) if found is None else np.frombuffer(bytes(found[0]), complex)

    def _keep(self, stretch: int, pairs: np.ndarray, ids: np.ndarray, latest: np.ndarray, fresh: int = 0) -> None:
        """Store the pairs of a stretch that are within the memory of their case; the last ``fresh`` ones are new."""
        at = np.minimum(np.searchsorted(ids, pairs.real), len(ids) - 1)
        kept = pairs[(ids[at] == pairs.real) & (pairs.imag >= latest[at] - self.remember)]
        if not len(kept):
            if stretch in self.stretches:
                self.seen.removeKey((stretch,))
            self.stretches.discard(stretch)
        elif fresh or len(kept) < len(pairs):
            self.seen.updateValue((stretch,), (kept.tobytes(),))
            self.stretches.add(stretch)

    def _seen_before(self, mine: np.ndarray, times: np.ndarray, ids: np.ndarray, latest: np.ndarray) -> np.ndarray:
        """Which times of a case came before, in the state or earlier in the batch; all are noted down."""
        pairs = mine + 1j * times
        known = pd.DataFrame({"id": mine, "at": times}).duplicated().to_numpy()
        number = np.floor(times / self.stretch).astype(np.int64)
        by = np.argsort(number, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(number[by])) + 1):
            stretch = int(number[at[0]])
            old = self._pairs(stretch)
            fresh = at[~known[at]]
            known[at] |= np.isin(pairs[at], old)
            fresh = fresh[~known[fresh]]
            if len(fresh):
                self._keep(stretch, np.concatenate([old, pairs[fresh]]), ids, latest, len(fresh))
        return known

    def _tidy(self, ids: np.ndarray, latest: np.ndarray, turn: int) -> int:
        """Clean a few of the stretches before the newest case's memory, so that none stays for good; returns where to go on."""
        past = sorted(s for s in self.stretches if (s + 1) * self.stretch < latest.max() - self.remember)
        for stretch in [past[(turn + i) % len(past)] for i in range(min(self.TIDIED, len(past)))]:
            self._keep(stretch, self._pairs(stretch), ids, latest)
        return turn + self.TIDIED

    def close(self) -> None:
        pass


def check_stream(stream: DataFrame, spec: TrajectorySpec, remember_seconds: float = 3600.0, forget_seconds: float | None = None) -> DataFrame:
    """Value and time checks on a stream, in arrival order, with state of every case, kept by bucket.

    Rows with a value problem are not clean; rows with a time problem are clean and warned about. A time counts as repeated while it is at most
    ``remember_seconds`` before the latest one, however rows are dealt to triggers. ``forget_seconds`` drops the state of a case that was silent for
    so long by the clock.
    """
    keyed = bucketed(check_values(stream, spec), spec.case)
    out = keyed.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=_TimeOrder(keyed.columns, spec.time, float(remember_seconds), forget_seconds), outputStructType=keyed.schema,
        outputMode="Append", timeMode="None" if forget_seconds is None else "ProcessingTime")
    return out.drop(CASE, BUCKET)


def check_table(df: DataFrame, spec: TrajectorySpec, target_rows: int | None = None, remember_seconds: float = float("inf")) -> DataFrame:
    """The same checks over a finished log, from windows; ``_stream_row_index`` is the arrival order."""
    checked = check_values(df, spec)
    valid, rest = checked.where(F.col("_code").isNull()), checked.where(F.col("_code").isNotNull())
    layout = plan_layout(valid, spec.keys, SEQ, target_rows)
    lags = {"_last": (spec.time, 1)}
    if remember_seconds != float("inf"):
        valid = with_running(valid, layout, [SEQ], peak={"_peak": F.col(spec.time)})
        lags["_peak_before"] = ("_peak", 1)
    stepped = with_lags(valid, layout, [SEQ], lags)
    firsts = valid.groupBy(*spec.keys, spec.time).agg(F.min(SEQ).alias("_first_seq"))
    joined = join_null_safe(stepped, firsts, [*spec.keys, spec.time])
    known = F.col("_first_seq") < F.col(SEQ)
    if remember_seconds != float("inf"):
        known &= F.col(spec.time) >= F.col("_peak_before") - remember_seconds
    code = (F.when(F.col(spec.time) < F.col("_last"), BACKWARDS)
            .when((F.col(spec.time) == F.col("_last")) | known, REPEATED))
    return joined.withColumn("_code", code).drop("_last", "_first_seq", "_peak", "_peak_before").unionByName(rest)


def clean_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("_code").isNull() | F.col("_code").isin(BACKWARDS, REPEATED)).drop("_code")


def buffer_warnings(checked: DataFrame, keys=()) -> DataFrame:
    """One row per warning: code, message, suggested action, row index."""
    texts = F.create_map(*[x for code, (message, action) in _TEXTS.items()
                           for x in (F.lit(code), F.struct(F.lit(message).alias("m"), F.lit(action).alias("a")))])
    text = texts[F.col("_code")]
    return checked.where(F.col("_code").isNotNull()).select(
        *keys, F.col("_code").alias("code"), text["m"].alias("message"), text["a"].alias("suggested_action"),
        F.col(SEQ).alias("sample_row_index"))


# -- rolling buffer over a clean log ----------------------------------------------------------------

def trim(clean: DataFrame, spec: TrajectorySpec, *, max_samples: int | None = None,
         buffer_seconds: float | None = None, target_rows: int | None = None) -> DataFrame:
    """The rows a rolling buffer still holds: the last ``max_samples``, then those near the last arrived time."""
    out = clean
    last = clean.groupBy(*spec.keys).agg(F.max_by(spec.time, SEQ).alias("_latest"), F.count(F.lit(1)).alias("_rows"))
    if max_samples:
        out = with_position(out, plan_layout(out, spec.keys, SEQ, target_rows), [SEQ])
    out = join_null_safe(out, last, list(spec.keys))
    if max_samples:
        out = out.where(F.col("_k") >= F.col("_rows") - max_samples).drop("_k")
    if buffer_seconds is not None:
        out = out.where(F.col(spec.time) >= F.col("_latest") - buffer_seconds)
    return out.drop("_latest", "_rows")


def latest_rows(clean: DataFrame, spec: TrajectorySpec) -> DataFrame:
    """The last arrived row of every case."""
    newest = clean.groupBy(*spec.keys).agg(F.max_by(F.struct(*[c for c in clean.columns if c not in spec.keys]), SEQ).alias("_r"))
    return newest.select(*spec.keys, "_r.*")


def buffer_summary(clean: DataFrame, spec: TrajectorySpec, target_rows: int | None = None) -> DataFrame:
    """Counts, first and last arrived time and step statistics in arrival order, per case."""
    from trajmill.operators.quality import percentiles

    layout = plan_layout(clean, spec.keys, SEQ, target_rows)
    stepped = with_lags(clean, layout, [SEQ], {"_last": (spec.time, 1)}).withColumn("dt", F.col(spec.time) - F.col("_last"))
    stats = stepped.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_clean_samples"), F.min_by(spec.time, SEQ).alias("start_time"),
        F.max_by(spec.time, SEQ).alias("end_time"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"))
    median = percentiles(stepped, spec.keys, "dt", {"median_dt": 0.5}, target_rows)
    both = join_null_safe(stats, median, list(spec.keys))
    return both.withColumn("dt_ratio", F.when(F.col("min_dt") > 0, F.col("max_dt") / F.col("min_dt")).when(
        F.col("min_dt").isNotNull(), F.lit(float("inf"))))
