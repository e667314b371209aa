import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajmill import TrajectorySpec
from trajmill.operators import fitting as fit, models as MT, status as ST, summaries as SU
from trajmill.sources import archive as AR, tables as TB


@pytest.fixture(scope="module")
def tables(spark):
    clean = spark.createDataFrame([(0.0, 600.0, 590.0, 50.0), (1.0, 601.0, 590.5, 50.0), (2.0, 602.0, 591.0, 50.0), (61.0, 603.0, 591.5, 50.0)],
                                  "time double, TP1 double, TP2 double, q_heater double")
    residuals = spark.createDataFrame([(0.0, "TP1", 0.1), (1.0, "TP2", -2.0), (61.0, "TP1", 0.3)], "matched_time double, state string, residual double")
    residuals = residuals.withColumn("abs_residual", F.abs("residual"))
    trust = spark.createDataFrame([(0.0, 1.0), (1.0, 0.9), (2.0, 0.8), (61.0, 0.7)], "time double, trust_score double")
    bias = spark.createDataFrame([(0.0, "TP1", 0.1), (1.0, "TP1", 0.2), (61.0, "TP1", 0.3)], "time double, state string, bias_value double")
    alerts = spark.createDataFrame([(1.0, "warning", "FORECAST_RESIDUAL_HIGH", "TP2")], "time double, severity string, code string, state string")
    return {"cleaned_stream": clean, "residuals": residuals, "trust_score": trust, "bias_state_timeseries": bias, "alerts": alerts}


@pytest.fixture(scope="module")
def root(spark, tables):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/archive"
    AR.archive_run(tables, folder, "run_1")
    AR.archive_run({"trust_score": tables["trust_score"]}, folder, "run_1")  # repeated write: no copies
    return folder


def test_manifest_and_load(spark, root, tables):
    manifest = AR.read_manifest(spark, root)
    assert {r["data_kind"] for r in manifest.collect()} == set(tables)
    one = manifest.where("data_kind = 'cleaned_stream'").first()
    assert one["date_partition"] == "relative" and one["hour_partition"] == "0000" and one["time_col"] == "time"
    assert manifest.where("data_kind = 'trust_score'").agg(F.sum("n_rows")).first()[0] == 4
    assert os.path.exists(f"{root}/{one['path']}")
    assert AR.load_kind(spark, root, "cleaned_stream").count() == 4
    assert AR.load_kind(spark, root, "cleaned_stream", 1).count() >= 1
    assert AR.load_kind(spark, root, "forecasts") is None
    assert AR.counts_by_kind(manifest).count() == 5 and AR.context_summary(manifest).count() == 5
    assert "file_size_mb" in AR.context_index(manifest).columns
    status = AR.validation_status(AR.validate_archive(spark, root)).first()
    assert (status["status"], status["n_errors"]) == ("warning", 0)
    lost = manifest.withColumn("path", F.concat("path", F.lit(".gone.parquet")))
    assert AR.validation_status(AR.validate_archive(spark, root, lost)).first()["status"] == "failed"


def test_search(spark, root):
    rows = AR.search_archive(spark, root, residual_above=1.0).collect()
    assert len(rows) == 1 and rows[0]["state"] == "TP2"
    assert AR.search_archive(spark, root, severity="WARNING").count() == 1
    assert AR.search_archive(spark, root, trust_below=0.8).count() == 2
    wide = AR.search_archive(spark, root, data_kind="cleaned_stream", state="TP1")
    assert set(wide.columns) == {"time", "TP1", "data_kind"}
    assert AR.matching_files(AR.read_manifest(spark, root), trust_below=0.5).count() >= 1


def test_calendar_partitions(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("bad",)], "timestamp string")
    got = df.select(*[c.alias(n) for c, n in zip(AR.partition_columns(df, "timestamp"), "dh")]).collect()
    assert {tuple(r) for r in got} == {("2024-01-02", "03"), ("unknown", "unknown")}
    numeric = spark.createDataFrame([("7200",), ("x",), ("1",), ("2",), ("3",), ("4",)], "time string")
    assert {tuple(r) for r in numeric.select(*AR.partition_columns(numeric, "time")).collect()} == {("relative", "0002"), ("relative", "0000")}


@pytest.mark.parametrize("target", [None, 1])
def test_window_summaries(tables, target):
    wide = SU.summarize_wide(tables["cleaned_stream"], "time", ["TP1"], windows=(60.0, 0.5), target_rows=target)
    row = wide.where("window = '60s' and window_start = 0").first()
    assert (row["n"], row["mean"], row["last"], row["median"]) == (3, 601.0, 602.0, 601.0) and np.isclose(row["p95"], 601.9)
    assert wide.where("window = '0p5s'").count() == 4
    res = SU.summarize_residuals(tables["residuals"], windows=(60.0,), target_rows=target).where("state = 'TP2'").first()
    assert res["max_abs"] == 2.0 and res["bias_mean"] == -2.0
    assert SU.summarize_trust(tables["trust_score"], windows=(60.0,), target_rows=target).where("window_start = 60").first()["min"] == 0.7
    assert SU.summarize_bias(tables["bias_state_timeseries"], windows=(60.0,)).where("window_start = 0").first()["last_bias"] == 0.2
    assert SU.summarize_alerts(tables["alerts"]).first()["alert_count"] == 1


def test_status_rows(spark, tables, root):
    row = ST.run_status(clean=tables["cleaned_stream"], time="time", alerts=tables["alerts"], trust=tables["trust_score"]).first()
    assert row["status"] == "warning" and row["latest_trust_score"] == 0.7 and row["latest_time"] == 61.0
    assert ST.run_status(clean=tables["cleaned_stream"].where("false"), time="time").first()["status"] == "empty"
    trust = SU.summarize_trust(tables["trust_score"], windows=(60.0,))
    arch = ST.archive_status(AR.read_manifest(spark, root), trust, SU.summarize_alerts(tables["alerts"])).first()
    assert arch["status"] == "warning" and arch["min_trust"] == 0.7
    residuals = spark.createDataFrame([(1.0, "a", 0.2), (2.0, "b", 2.5), (1.0, "c", 1.0), (2.0, "c", -7.0)], "matched_time double, state string, residual double")
    table = ST.sensor_status(spark, ["a", "b", "c", "d"], residuals, positions={"a": 0, "b": 1, "c": 2}, measured=["a"])
    assert [r["status"] for r in table.collect()] == ["nominal", "warning", "critical", "unknown"]
    assert ST.summarize_sensor_status(table).first()["n_unknown"] == 1
    assert ST.top_residuals(residuals.withColumn("abs_residual", F.abs("residual")), 1).first()["state"] == "c"


def test_model_table(spark):
    store = MT.ModelTable(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/models")
    model = fit.LinearModel("dmdc", ["x"], [], np.array([[0.5]]), np.zeros((1, 0)), np.zeros(1), metadata={"k": 1})
    store.register(model, "loop a", "v1")
    store.register(model, "loop a", "v2", stage="production")
    assert store.deployments().count() == 2
    store.promote("loop_a", "v1")
    assert store.resolve("loop_a").a[0, 0] == 0.5
    assert store.deployments().where("stage = 'production'").first()["version"] == "v1"
    line = spark.createDataFrame([(0.0, 8.0), (1.0, 0.0), (2.0, 0.0)], "t double, x double")
    rolled = MT.predict_saved(store, line, TrajectorySpec(time="t", states=("x",)), "loop_a")
    assert [r["pred_x"] for r in rolled.orderBy("t").collect()] == [8.0, 4.0, 2.0]
    for bad in (lambda: store.promote("loop_a", "v9"), lambda: store.resolve("other"), lambda: store.resolve("loop_a", version="v9")):
        with pytest.raises(MT.UnknownModel):
            bad()
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(30, 3)), columns=list("xyz")))
    pod = fit.fit_pod(fit.fit_snapshots(df, "xyz"), "xyz", rank=2)
    reduced = fit.LinearModel("pod_dmdc", ["a1", "a2"], [], np.eye(2), np.zeros((2, 0)), np.zeros(2), pod=pod)
    store.register(reduced, "modes", "v1")
    assert np.allclose(store.resolve("modes", version="v1").physical().a, reduced.physical().a)


def test_folder_import(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, text in {"run_2.csv": "t,x,u\n0,1,2\n1,2,3\n", "run_1.csv": "t,y,x\n0,5,1\n1,oops,bad\n", "junk.csv": "\"broken\n\x00\n"}.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    rows, skipped = TB.read_folder(spark, folder, "*.csv", required=["time", "x"], mapping=TB.parse_rename_pairs(["t=time"]))
    got = rows.orderBy("case_id", "time").collect()
    assert [(r["case_id"], r["time"], r["x"]) for r in got] == [("run_1", 0.0, 1.0), ("run_1", 1.0, None), ("run_2", 0.0, 1.0), ("run_2", 1.0, 2.0)]
    assert set(rows.columns) == {"time", "x", "u", "y", "source_file", "case_id"} and skipped.count() == 1
    one, _ = TB.read_folder(spark, folder, "run*.csv", required=["time"], mapping={"t": "time"}, max_files=1)
    assert {r["source_file"] for r in one.collect()} == {"run_1.csv"}
    chunks, _ = TB.read_daq_folder(spark, folder, "run*.csv", required=["time"], mapping={"t": "time"}, settle_seconds=None)
    assert {r["importer"] for r in chunks.collect()} == {"daq_folder"}
    with pytest.raises(FileNotFoundError):
        TB.read_folder(spark, folder, "*.none", required=["time"])
    assert TB.list_files(spark, folder, "*.csv", settle_seconds=3600).count() == 0
    profile = TB.import_table(rows, folder + "/out.parquet", case_value="z")
    assert {r["column"]: r["n_missing"] for r in profile.collect()}["x"] == 1
    assert TB.read_table(spark, folder + "/out.parquet").count() == 4
    with pytest.raises(ValueError):
        TB.read_table(spark, "a.xyz")


def test_writes_append_and_repeat(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/archive"
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").cast("double").alias("time"), (F.col("id") * 2.0).alias("x"))
    assert AR.load_kind(spark, root, "raw_stream") is None and AR.read_manifest(spark, root).count() == 0
    AR.write_records(rows(0, 100), root, "raw_stream", "run-1", write_id="epoch-0")
    AR.write_records(rows(50, 150), root, "raw_stream", "run-1", write_id="epoch-1")  # the same hour
    AR.write_records(rows(50, 150), root, "raw_stream", "run-1", write_id="epoch-1")  # a repeated epoch
    AR.write_records(rows(0, 10), root, "raw_stream", "other")
    AR.write_records(rows(0, 0), root, "raw_stream", "other", write_id="nothing")
    assert AR.load_kind(spark, root, "raw_stream").count() == 210 and AR.load_kind(spark, root, "raw_stream", run_id="run-1").count() == 200
    manifest = AR.read_manifest(spark, root)
    assert {(r.run_id, r.n) for r in manifest.groupBy("run_id").agg(F.sum("n_rows").alias("n")).collect()} == {("run-1", 200), ("other", 10)}
    assert AR.compact(spark, root, "raw_stream", "run-1") and AR.compact(spark, root, "raw_stream", "run-1") is None
    whole = AR.load_kind(spark, root, "raw_stream", run_id="run-1")
    assert whole.count() == 200 and whole.agg(F.sum("x")).first()[0] == sum(2 * i for i in [*range(100), *range(50, 150)])
    assert AR.read_manifest(spark, root).where("run_id = 'run-1'").select("write_id").distinct().count() == 1
    assert AR.load_kind(spark, root, "raw_stream").count() == 210
    findings = AR.validation_status(AR.validate_archive(spark, root)).first()
    assert findings["n_errors"] == 0
    with pytest.raises(ValueError):
        AR.write_records(rows(0, 10), root, "raw_stream", "run/1")


def test_a_broken_file_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/archive"
    AR.write_records(spark.range(10).select(F.col("id").cast("double").alias("time")), root, "raw_stream", "r")
    path = AR.read_manifest(spark, root).first()["path"]
    os.remove(f"{root}/{path}")
    with open(f"{root}/{path}", "wb") as f:
        f.write(b"no parquet")
    with pytest.raises(Exception):
        AR.load_kind(spark, root, "raw_stream").count()


def test_tables_of_one_epoch_have_their_entries_from_one_job(spark):
    root, other = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    rows = spark.range(60).select((F.col("id") * 600.0).alias("time"), "id")
    later = rows.withColumnRenamed("time", "origin_time")

    def tables(cleaned):
        return [(rows, "raw_stream", "time"), (cleaned, "cleaned_stream", "time"), (rows.select("id"), "warnings", None), (later, "forecasts", "origin_time")]
    compared = ["data_kind", "run_id", "write_id", "n_columns", "columns", "time_col", "date_partition", "hour_partition", "schema_version", "format", "source_file"]
    listed = lambda place: sorted(map(tuple, AR.read_manifest(spark, place).groupBy(*compared).agg(
        F.sum("n_rows"), F.min(F.col("min_time").cast("double")), F.max(F.col("max_time").cast("double"))).collect()))
    for cleaned in (rows.where("id < 20"), rows.limit(0)):  # the repeated epoch has no such rows
        AR.write_together(tables(cleaned), root, "r", "epoch-0")
        for df, kind, time in tables(cleaned):
            AR.write_records(df, other, kind, "r", time=time, write_id="epoch-0")
        assert listed(root) == listed(other)
    assert {r[0] for r in listed(root)} == {"raw_stream", "warnings", "forecasts"}
    jobs = {f.rsplit("/part-", 1)[1][6:42] for f in spark.read.parquet(f"{root}/_manifest").inputFiles()}
    assert len(jobs) == 1
    for kind, n in (("raw_stream", 60), ("forecasts", 60)):
        assert AR.load_kind(spark, root, kind).count() == n


def test_a_live_run_writes_the_entries_of_an_epoch_together(spark):
    from trajmill import TrajectorySpec
    from trajmill.streaming import inputs as IN, live as LIVE

    path, root, check = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    rows = spark.range(40).select((F.col("id") % 2).alias("c"), (F.col("id") * 1.0).alias("t"), F.rand(1).alias("x"))
    IN.write_replay(rows, f"{path}/in", chunk_size=20, time="t")
    spec = TrajectorySpec(case="c", time="t", states=("x",))
    LIVE.ingest(IN.replay_stream(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema), spec, root, "r", check)
    files = spark.read.parquet(f"{root}/_manifest").inputFiles()
    jobs = {}
    for f in files:
        jobs.setdefault(f.split("write_id=")[1].split("/")[0], set()).add(f.rsplit("/part-", 1)[1][6:42])
    assert len(jobs) == 2 and all(len(j) == 1 for j in jobs.values())
    assert AR.load_kind(spark, root, "cleaned_stream").count() == 40
