"""Streams give what the finished tables give, whatever the chunk size."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajmill import TrajectorySpec
from trajmill.operators import bias as B, fitting as fit, prediction as pred
from trajmill.sources import archive as AR
from trajmill.streaming import buffer as BUF, inputs as IN, live as LIVE

SPEC = TrajectorySpec(case="case_id", time="time", states=("TP1", "TP2"), inputs=("q",))


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="module")
def log(spark):
    rows = [("a", str(t), str(600 + i), str(590 + 0.5 * i), "50") for i, t in enumerate([0, 0.1, 0.23, 0.5, 0.2, 0.5, 0.9])]
    rows += [("b", "1", "x", "1", "1"), ("b", "2", "nan", "1", "1"), ("b", "3", "5", "1", "1"), ("b", None, "5", "1", "1")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "case_id string, time string, TP1 string, TP2 string, q string, n int")


def collect_stream(stream):
    parts = []
    IN.run_until_done(stream, lambda df, _: parts.append(df.toPandas()), folder())
    return pd.concat([p for p in parts if len(p)], ignore_index=True)


@pytest.mark.parametrize("chunk", [1, 5, 100])
def test_checks_do_not_depend_on_chunks(spark, log, chunk):
    path = folder() + "/replay"
    assert IN.write_replay(log, path, chunk_size=chunk, order=("n",)) == -(-11 // chunk)
    schema = spark.read.parquet(path).schema
    got = collect_stream(BUF.check_stream(IN.make_stream(spark, "csv_replay", path, schema=schema), SPEC))
    codes = dict(zip(got["n"], got["_code"]))
    want = {4: BUF.BACKWARDS, 5: BUF.REPEATED, 7: BUF.NOT_A_NUMBER, 8: BUF.NOT_FINITE, 10: BUF.NOT_FINITE}
    assert {k: v for k, v in codes.items() if v} == want and len(got) == 11
    table = BUF.check_table(log.withColumn("_stream_row_index", F.col("n").cast("bigint")), SPEC)
    assert {r["n"]: r["_code"] for r in table.collect() if r["_code"]} == want
    assert BUF.clean_rows(table).count() == 8 and BUF.buffer_warnings(table).count() == 5


def test_rolling_buffer(log):
    clean = BUF.clean_rows(BUF.check_table(log.withColumn("_stream_row_index", F.col("n").cast("bigint")), SPEC)).where("case_id = 'a'")
    assert sorted(r["n"] for r in BUF.trim(clean, SPEC, max_samples=3).collect()) == [4, 5, 6]
    assert sorted(r["n"] for r in BUF.trim(clean, SPEC, buffer_seconds=0.5).collect()) == [3, 5, 6]
    assert BUF.latest_rows(clean, SPEC).first()["n"] == 6
    row = BUF.buffer_summary(clean, SPEC).first()
    assert row["n_clean_samples"] == 7 and row["end_time"] == 0.9 and row["dt_ratio"] == float("inf")
    missing = BUF.check_values(clean.drop("q"), SPEC)
    assert missing.first()["_code"] == BUF.MISSING


def test_ingest_archives_all_tables(spark, log):
    path, root, check = folder() + "/replay", folder() + "/archive", folder()
    IN.write_replay(log, path, chunk_size=4, order=("n",))
    schema = spark.read.parquet(path).schema
    model = fit.LinearModel("dmdc", ["TP1", "TP2"], ["q"], np.eye(2), np.zeros((2, 1)), np.zeros(2))
    for _ in range(2):  # the second run finds nothing new
        LIVE.ingest(IN.replay_stream(spark, path, schema), SPEC, root, "r1", check, model=model, horizons=(5.0,), dt=1.0)
    assert AR.load_kind(spark, root, "raw_stream").count() == 11
    assert AR.load_kind(spark, root, "cleaned_stream").count() == 8
    assert AR.load_kind(spark, root, "warnings").count() == 5
    assert AR.load_kind(spark, root, "forecasts").count() == 16
    assert AR.read_manifest(spark, root).agg(F.sum("n_rows")).first()[0] == 11 + 8 + 5 + 16


def test_tail_reads_new_files_only(spark):
    drop, check, seen = folder(), folder(), []
    def put(name, lines):
        with open(f"{drop}/{name}", "w") as f:
            f.write("time,TP1\n" + lines)
    put("a.csv", "0,1\n1,2\n")
    for name, lines in (("b.csv", "2,3\n"), ("c.csv", "3,4\n4,5\n")):
        IN.run_until_done(IN.make_stream(spark, "tail", drop, columns=["time", "TP1"]), lambda df, _: seen.append(df.count()), check)
        put(name, lines)
    IN.run_until_done(IN.make_stream(spark, "csv_tail", drop, columns=["time", "TP1"]), lambda df, _: seen.append(df.count()), check)
    assert sum(seen) == 5
    late = collect_late(spark, drop)
    assert late == 0
    with pytest.raises(ValueError):
        IN.make_stream(spark, "socket", drop)


def collect_late(spark, drop):
    seen = []
    IN.run_until_done(IN.tail_stream(spark, drop, ["time", "TP1"], since="2100-01-01 00:00:00"), lambda df, _: seen.append(df.count()), folder())
    return sum(seen)


def test_one_growing_file(spark):
    """Rows appended between triggers come once each, half lines wait, and a restart goes on where it stopped."""
    drop, check, seen = folder(), folder(), []
    path = f"{drop}/log.csv"

    def put(text, mode="a"):
        with open(path, mode, newline="") as f:
            f.write(text)

    def poll(source=path, checkpoint=check, **options):
        rows = []
        stream = IN.make_stream(spark, "csv_tail", source, columns=["time", "TP1", "absent"], **options)
        IN.run_until_done(stream, lambda df, _: rows.extend(df.orderBy("_stream_row_index").collect()), checkpoint)
        seen.extend((r.time, r.TP1) for r in rows)
        return rows

    assert poll() == []  # no file yet
    put("TP1,time\r\n1,0\r\n2,1\r\n3,", "w")
    first = poll()
    assert [(r.time, r.TP1, r.absent) for r in first] == [("0", "1", None), ("1", "2", None)] and first[0]["_stream_source"] == "log.csv"
    assert poll() == []
    put("2\r\n")
    put('"4, x",3\n\n,4\n')
    assert [(r.time, r.TP1) for r in poll(part_bytes=3)] == [("2", "3"), ("3", "4, x"), ("4", None)]
    body = "".join(f"{i},{i}\n" for i in range(5, 3000))
    put(body + "half")
    more = poll(part_bytes=1000)
    assert [int(r.time) for r in more] == list(range(5, 3000)) and len(set(r["_stream_row_index"] for r in more)) == 2995
    assert all(more[i]["_stream_row_index"] < more[i + 1]["_stream_row_index"] for i in range(2994))
    assert len(seen) == len(set(seen)) == 3000
    late, fresh = folder(), folder()
    assert poll(checkpoint=late, start_at_end=True) == [] and poll(drop, fresh)  # at the end; the folder form reads all
    put("\n9999,9999\n")
    assert [r.time for r in poll(checkpoint=late, start_at_end=True)] == [None, "9999"]
    put("TP1,time\n7,7\n", "w")  # written anew
    assert [(r.time, r.TP1) for r in poll()] == [("7", "7")]
    with open(f"{drop}/second.csv", "w") as f:
        f.write("time,TP1,case\n1,1,a\n2,2,b\n")
    assert [r.TP1 for r in poll(drop, fresh)] == ["7", "1", "2"]


def test_runs_stop_at_their_limits(spark, log):
    path = folder() + "/replay"
    IN.write_replay(log, path, chunk_size=3, order=("n",))
    schema, seen = spark.read.parquet(path).schema, []

    def run(check, **limits):
        got = []
        IN.run_until_done(IN.replay_stream(spark, path, schema), lambda df, _: got.append([r.n for r in df.orderBy("n").collect()]), check, **limits)
        return got

    assert run(folder(), max_samples=7) == [[0, 1, 2], [3, 4, 5], [6]]
    check = folder()
    assert run(check, max_polls=2) == [[0, 1, 2], [3, 4, 5]]
    assert run(check) == [[6, 7, 8], [9, 10]]  # nothing after the limit was lost
    assert run(folder(), max_samples=0) == [] and run(folder(), max_polls=3, poll_seconds=0.2)[:1] == [[0, 1, 2]]
    assert run(folder(), max_samples=100) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10]]
    failing = lambda df, _: 1 / 0
    with pytest.raises(Exception, match="ZeroDivision|division"):
        IN.run_until_done(IN.replay_stream(spark, path, schema), failing, folder(), max_polls=5)


@pytest.mark.parametrize("triggers", [1, 10])
def test_checks_equal_the_table_with_a_short_memory(spark, triggers):
    rng = np.random.default_rng(6)
    rows = [(str(rng.integers(3)), float(rng.integers(0, 400) / 4 + i / 4), float(i), float(i), "1", i) for i in range(300)]
    df = spark.createDataFrame(rows, "case_id string, time double, TP1 double, TP2 double, q string, n long")
    path = folder() + "/replay"
    IN.write_replay(df, path, chunk_size=-(-300 // triggers), order=("n",))
    schema = spark.read.parquet(path).schema
    stream = BUF.check_stream(IN.replay_stream(spark, path, schema), SPEC, remember_seconds=20.0)
    got = collect_stream(stream)
    table = df.withColumn("_stream_row_index", F.col("n"))
    want = {r.n: r["_code"] for r in BUF.check_table(table, SPEC, remember_seconds=20.0).collect()}
    split = {r.n: r["_code"] for r in BUF.check_table(table, SPEC, remember_seconds=20.0, target_rows=25).collect()}
    everything = {r.n: r["_code"] for r in BUF.check_table(table, SPEC).collect()}
    assert dict(zip(got.n, got["_code"])) == want == split
    assert want != everything and BUF.REPEATED in want.values() and BUF.BACKWARDS in want.values()


def test_frames_stay_apart_and_are_ranked():
    part = lambda *values: pd.DataFrame({"x": values})
    frames, order = BUF.in_order(iter([part(2, 1), part(9, None), part(5, 7)]), [BUF.SEQ])
    assert [len(f) for f in frames] == [2, 2, 2] and order.tolist() == [1, 0, 4, 5, 2, 3]
    assert [v.tolist() for _, v in BUF.dealt(np.arange(6), frames)] == [[0, 1], [2, 3], [4, 5]]


@pytest.mark.parametrize("chunk", [7, 100])
def test_stream_filter_equals_batch_filter(spark, chunk):
    rng = np.random.default_rng(3)
    frames = []
    for case, n in (("a", 40), ("b", 25)):
        z = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        x = z @ rng.normal(size=(2, 4)) + 450
        frames.append(pd.DataFrame(x, columns=["s0", "s1", "s2", "s3"]).assign(case_id=case, time=np.arange(float(n)), q=rng.normal(size=n)))
    df = spark.createDataFrame(pd.concat(frames))
    spec = TrajectorySpec(case="case_id", time="time", states=("s0", "s1", "s2", "s3"), inputs=("q",))
    model = fit.fit_pod_dmdc(fit.fit_transitions(df, spec), fit.fit_snapshots(df, spec.states), spec, pod_rank=2)
    want = pred.kalman_pod(df, spec, model, ["s0", "s2"]).toPandas().sort_values(["case_id", "time"]).reset_index(drop=True)
    path = folder() + "/replay"
    IN.write_replay(df, path, chunk_size=chunk, time="time", order=("case_id",))
    stream = IN.replay_stream(spark, path, spark.read.parquet(path).schema)
    estimates = LIVE.estimate_stream(stream, spec, model, ["s0", "s2"])
    got = collect_stream(estimates).sort_values(["case_id", "time"]).reset_index(drop=True)
    for c in ("est_s1", "a1", "covariance_trace", "innovation_norm", "innovation_s2"):
        assert np.allclose(got[c], want[c], atol=1e-7), c
    assert got["initialized_from_measurement"].sum() == 2
    rows = LIVE.forecast_estimates(spark.createDataFrame(got), model, spec, (2.0,), dt=1.0)
    assert rows.count() == 65 * 4 and rows.first()["forecast_origin_type"] == "pod_kalman_filtered_state"


def test_stream_bias_equals_batch_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 2}", 1.0, float(i), float(i) - 1.0, float(rng.normal(2, 5)), bool(rng.random() > 0.2), i) for i in range(40)]
    df = spark.createDataFrame(rows, "state string, forecast_horizon_s double, matched_time double, origin_time double, residual double, accepted boolean, n int")
    rules = B.BiasRules(learning_rate=0.3)
    path = folder() + "/replay"
    IN.write_replay(df, path, chunk_size=9, order=("n",))
    got = collect_stream(LIVE.bias_stream(IN.replay_stream(spark, path, spark.read.parquet(path).schema), [], rules))
    current = {"s0": 0.0, "s1": 0.0}
    new = dict(zip(got["n"], got["new_bias"]))
    for state, _, _, _, residual, ok, n in rows:
        if ok:
            current[state] = B._moved(current[state], float(np.clip(residual, -20, 20)), rules)
        assert np.isclose(new[n], current[state])


def test_stream_residuals(spark):
    base = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) ts, cast(id as double) as x1, 'r' as run, id n from range(0, 400, 10)")
    forecasts = base.select("run", F.col("x1").alias("origin_time"), F.lit(12.0).alias("forecast_horizon_s"), F.lit("x1").alias("state"),
                            (F.col("ts") + F.expr("INTERVAL 12 SECONDS")).alias("target_ts"), F.lit(0.0).alias("predicted_value"), "n")
    a, b = folder() + "/a", folder() + "/b"
    IN.write_replay(base, a, chunk_size=10, order=("n",))
    IN.write_replay(forecasts, b, chunk_size=10, order=("n",))
    clean = IN.replay_stream(spark, a, spark.read.parquet(a).schema)
    asked = IN.replay_stream(spark, b, spark.read.parquet(b).schema)
    out = LIVE.residual_stream(clean, asked, ["run"], "ts", "target_ts", ["x1"], 5.0, "30 seconds")
    got = collect_stream(out)
    assert len(got) >= 25 and (got["measured_value"] == got["origin_time"] + 10).all()


def test_stream_residuals_equal_the_table(spark):
    from trajmill.operators import monitoring as mon

    rng = np.random.default_rng(11)
    n = 120
    seconds = np.cumsum(rng.choice([0.5, 1.0, 3.0], n))
    clean = pd.DataFrame({"run": rng.choice(["a", "b"], n), "time": seconds, "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    asked = pd.DataFrame([(r.run, r.time, h, s, r.time + h, float(rng.normal())) for r in clean.itertuples() for h in (2.0, 7.0) for s in ("x1", "x2", "other")],
                         columns=["run", "origin_time", "forecast_horizon_s", "state", "target_time", "predicted_value"])
    end = pd.DataFrame({"run": ["a", "b"], "time": [500.0, 500.0], "x1": 0.0, "x2": 0.0})  # moves the watermark past all targets
    clean = pd.concat([clean, end], ignore_index=True)
    base = pd.Timestamp("2024-01-01")
    clean["ts"], asked["ts"] = base + pd.to_timedelta(clean["time"], unit="s"), base + pd.to_timedelta(asked["target_time"], unit="s")
    last = pd.DataFrame([("a", 499.0, 1.0, "x1", 500.0, 0.0, base + pd.to_timedelta(500.0, unit="s"))], columns=asked.columns)
    asked = pd.concat([asked, last], ignore_index=True)
    left, right = spark.createDataFrame(clean), spark.createDataFrame(asked)
    a, b = folder() + "/a", folder() + "/b"
    IN.write_replay(left, a, chunk_size=30, time="time", order=("run",))
    IN.write_replay(right, b, chunk_size=180, time="origin_time", order=("state", "forecast_horizon_s", "run"))
    out = LIVE.residual_stream(IN.replay_stream(spark, a, spark.read.parquet(a).schema), IN.replay_stream(spark, b, spark.read.parquet(b).schema),
                               ["run"], "ts", "ts", ["x1", "x2"], 1.0, "20 seconds")
    got = collect_stream(out)
    want = mon.forecast_residuals(left.drop("ts"), right.drop("ts"), ["run"], "time", ["x1", "x2"], tolerance=1.0).where("target_time < 400").toPandas()
    by = ["run", "state", "forecast_horizon_s", "origin_time"]
    got, want = (f.sort_values(by).reset_index(drop=True) for f in (got[got.origin_time < 400], want))
    assert len(got) == len(want) > 100 and (got[by] == want[by]).all().all()
    assert np.allclose(got["residual"], want["residual"]) and np.allclose(got["measured_value"], want["measured_value"])


def test_estimation_as_one_run(spark):
    """Check, filter and archive in one query: equal to the batch filter of the clean rows, whatever the chunks."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        z = rng.normal(size=2)
        rows.append(("ab"[i % 2], str(float(i // 2)), str(450 + z[0] + z[1]), str(450 - z[0]), str(rng.normal()), i))
    rows[7] = (*rows[7][:2], "broken", *rows[7][3:])
    rows[20] = (rows[20][0], rows[16][1], *rows[20][2:])  # time runs back: clean, with a warning
    log = spark.createDataFrame(rows, "case_id string, time string, s0 string, s2 string, q string, n int")
    spec = TrajectorySpec(case="case_id", time="time", states=("s0", "s1", "s2"), inputs=("q",))
    full = spark.createDataFrame(pd.DataFrame({"case_id": "a", "time": np.arange(40.0), "s0": rng.normal(450, 1, 40), "s1": rng.normal(450, 1, 40), "s2": rng.normal(450, 1, 40), "q": rng.normal(size=40)}))
    model = fit.fit_pod_dmdc(fit.fit_transitions(full, spec), fit.fit_snapshots(full, spec.states), spec, pod_rank=2)
    clean = BUF.clean_rows(BUF.check_table(log.withColumn("_stream_row_index", F.col("n").cast("bigint")), spec.with_states(["s0", "s2"])))
    # The filter takes rows as they arrived.
    arrived = TrajectorySpec(case="case_id", time="n", states=("s0", "s2"), inputs=("q",))
    want = pred.kalman_pod(clean.withColumn("n", F.col("n").cast("double")), arrived, model, ["s0", "s2"]).toPandas().sort_values("n").reset_index(drop=True)
    for chunk in (20,):
        path, root = folder() + "/replay", folder() + "/archive"
        IN.write_replay(log, path, chunk_size=chunk, order=("n",))
        LIVE.run_estimation(IN.replay_stream(spark, path, spark.read.parquet(path).schema), spec, root, "r", folder(), model, ["s0", "s2"], horizons=(2.0,), dt=1.0)
        kind = lambda name: AR.load_kind(spark, root, name).toPandas()
        states, modal, cov = (kind(k).sort_values(BUF.SEQ).reset_index(drop=True) for k in ("state_estimates", "modal_estimates", "estimate_covariance"))
        assert len(kind("raw_stream")) == 60 and len(kind("cleaned_stream")) == len(states) == 59 and len(kind("warnings")) >= 2
        assert np.allclose(states[["s0", "s1", "s2"]], want[["est_s0", "est_s1", "est_s2"]]) and np.allclose(modal[["a1", "a2"]], want[["a1", "a2"]])
        assert np.allclose(cov["covariance_trace"], want["covariance_trace"]) and np.allclose(cov["var_a1"] + cov["var_a2"], cov["covariance_trace"])
        inn = kind("kalman_innovations")
        assert len(inn) == 2 * 59 and np.allclose(inn[inn.measurement == "s2"].sort_values("origin_row_index")["innovation"], want["innovation_s2"])
        assert len(kind("forecasts")) == 3 * 59 and states["initialized_from_measurement"].sum() == 2


class _CountedState:
    """State of one bucket in plain dictionaries, with a count of the calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def clear(self):
        self.map.clear()


def test_state_calls_do_not_grow_with_the_cases():
    """A trigger over 50 or 2,000 cases costs about the same number of state calls, and the codes are those of a plain loop."""
    calls = []
    for n in (50, 2000):
        rng, state = np.random.default_rng(n), _CountedState()
        df = pd.DataFrame({BUF.CASE: [f"={i}" for i in rng.integers(0, n, 6 * n)], "time": rng.integers(0, 40, 6 * n) / 2 + np.arange(6 * n) // n, "_code": None, BUF.SEQ: np.arange(6 * n)})
        df.loc[5, "_code"] = BUF.NOT_FINITE
        check = BUF._TimeOrder(list(df.columns), "time", 8.0, None)
        check.init(state)
        got = pd.concat([f for lo in range(0, len(df), 2 * n) for f in check.handleInputRows((0,), iter([df[lo: lo + n].copy(), df[lo + n: lo + 2 * n].copy()]), None)])
        want, before = [], {}
        for r in df.itertuples(index=False):
            seen = before.setdefault(r[0], [])
            known = r.time in seen and r.time >= max(seen) - 8.0
            want.append(r[2] or (BUF.BACKWARDS if seen and r.time < seen[-1] else BUF.REPEATED if known or seen and r.time == seen[-1] else None))
            if r[2] is None:
                seen.append(r.time)
        assert [None if pd.isna(c) else c for c in got["_code"]] == want and {BUF.BACKWARDS, BUF.REPEATED} <= set(want)
        calls.append(state.calls)
    assert calls[1] <= 1.2 * calls[0]


def test_filter_of_a_bucket_equals_its_cases_alone():
    """Three batches of 40 mixed cases give what each case gives by itself, with two state calls a batch."""
    rng = np.random.default_rng(8)
    modes = np.linalg.qr(rng.normal(size=(3, 2)))[0]
    pod = fit.PODBasis(["p", "q", "r"], rng.normal(size=3), np.ones(3), modes, np.ones(2), 9, modes)
    model = fit.LinearModel("pod_dmdc", ["p", "q", "r"], ["u"], np.array([[0.9, 0.1], [-0.2, 0.7]]), rng.normal(size=(2, 1)), rng.normal(size=2), pod=pod)
    df = pd.DataFrame(rng.normal(size=(600, 2)), columns=["p", "u"]).assign(**{BUF.CASE: [f"={i}" for i in rng.integers(0, 40, 600)], BUF.SEQ: np.arange(600), "_code": None})
    df.loc[::50, "_code"] = BUF.NOT_A_NUMBER

    def run(rows):
        state, out = _CountedState(), []
        kalman = LIVE._PODKalman(list(df.columns), model, ["p"], 1e-3, 1e-2, 1.0)
        kalman.init(state)
        for _, part in rows.groupby(np.arange(len(rows)) // 200):
            out += list(kalman.handleInputRows((0,), iter([part.copy()]), None))
        return pd.concat(out).sort_values(BUF.SEQ), state.calls

    got, calls = run(df)
    alone = pd.concat([run(part)[0] for _, part in df.groupby(BUF.CASE)]).sort_values(BUF.SEQ)
    names = ["est_p", "est_q", "est_r", "a1", "a2", "covariance_trace", "innovation_p", "var_a2"]
    assert np.allclose(got[names].astype(float), alone[names].astype(float), equal_nan=True) and got["est_p"].isna().sum() == 12
    assert got["initialized_from_measurement"].sum() == 40 and calls == 6
