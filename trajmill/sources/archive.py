"""Partitioned archive of live tables: write, manifest, load, search, validate."""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

# Data kinds and the columns that may hold their time, best first.
_PLAIN = ("time", "timestamp")
_FORECAST = ("origin_time", "target_time", "time", "timestamp")
_MATCHED = ("matched_time", "target_time", "origin_time", "time", "timestamp")
KIND_TIMES = {
    "raw_stream": _PLAIN, "cleaned_stream": _PLAIN, "state_estimates": _PLAIN, "modal_estimates": _PLAIN,
    "estimate_covariance": _PLAIN, "kalman_innovations": _PLAIN,
    "forecasts": _FORECAST, "forecasts_wide": _FORECAST, "residuals": _MATCHED,
    "bias_corrected_forecasts": _FORECAST, "bias_corrected_residuals": _MATCHED,
    "bias_update_events": ("time", "matched_time", "target_time", "origin_time"),
    "bias_state_timeseries": _PLAIN, "bias_horizon_timeseries": _PLAIN,
    "alerts": _PLAIN, "trust_score": _PLAIN, "warnings": _PLAIN,
}
ANY_TIME = ("time", "timestamp", "origin_time", "target_time", "matched_time")
SCHEMA_VERSION = "live_archive_v1"
MANIFEST_SCHEMA = (
    "schema_version string, written_at_utc string, data_kind string, source_file string, path string, format string, "
    "n_rows bigint, n_columns bigint, columns string, time_col string, min_time string, max_time string, "
    "file_size_bytes bigint, date_partition string, hour_partition string, run_id string, write_id string")
PLACES = ("data_kind", "run_id", "write_id", "date", "hour")
REQUIRED_MANIFEST = ("schema_version", "run_id", "data_kind", "path", "format", "n_rows", "columns", "file_size_bytes")
RECOMMENDED = {
    "cleaned_stream": ("time",), "state_estimates": ("time",),
    "forecasts": ("origin_time", "forecast_horizon_s", "state", "predicted_value"),
    "residuals": ("state", "residual", "abs_residual"),
    "bias_update_events": ("state", "old_bias", "new_bias", "accepted"),
    "alerts": ("severity", "code"), "trust_score": ("trust_score",),
}


def infer_time_column(columns: list[str], kind: str | None = None) -> str | None:
    return next((c for c in (*KIND_TIMES.get(kind or "", ()), *ANY_TIME) if c in columns), None)


def partition_columns(df: DataFrame, time: str | None) -> tuple[Column, Column]:
    """Date and hour partition of each row.

    Timestamps (and text that is mostly no number but parses as a time) give calendar partitions;
    numbers are relative seconds. Only text columns need a look at the data: one aggregation.
    """
    if time is None or time not in df.columns:
        return F.lit("unknown"), F.lit("unknown")
    kind = dict(df.dtypes)[time]
    moment = None
    if kind.startswith(("timestamp", "date")):
        moment = F.col(time).cast("timestamp")
    elif kind == "string":
        parsed = F.col(time).try_cast("timestamp")
        share, any_time = df.agg(F.count(F.col(time).try_cast("double")) / F.count(F.lit(1)), F.count(parsed)).first()
        moment = parsed if (share or 0.0) < 0.8 and any_time else None
    if moment is not None:
        return (F.coalesce(F.date_format(moment, "yyyy-MM-dd"), F.lit("unknown")),
                F.coalesce(F.date_format(moment, "HH"), F.lit("unknown")))
    seconds = F.coalesce(F.col(time).try_cast("double"), F.lit(0.0))
    return F.lit("relative"), F.format_string("%04d", F.floor(seconds / 3600.0).cast("bigint"))


def _place(kind: str, run_id: str, write_id: str) -> str:
    """The folder of one write; names that a path would spell otherwise are refused."""
    for name in (kind, run_id, write_id):
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"letters, digits, dot, dash and underscore only: {name!r}")
    return f"data_kind={kind}/run_id={run_id}/write_id={write_id}"


def _found(read, otherwise):
    """The result of a read, or ``otherwise`` where nothing has been written yet; any other problem is raised."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return otherwise


def write_together(tables: list[tuple[DataFrame, str, str | None]], root: str, run_id: str, write_id: str) -> None:
    """Append several tables (rows, kind, time column) under one id: files are written side by side, all manifest entries by one job at the end.

    The same as ``write_records`` of each; small writes cost jobs, not rows.
    """
    spark, root = tables[0][0].sparkSession, root.rstrip("/")
    with ThreadPoolExecutor(len(tables)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(partial(_write_rows, df, f"{root}/{_place(kind, run_id, write_id)}", time)))
                 for df, kind, time in tables]
    for write in begun:
        write.result()
    entries, groups = [], {}
    for df, kind, time in tables:
        groups.setdefault((time, dict(df.dtypes).get(time)), {})[kind] = df.columns
    for (time, type_), kinds in groups.items():  # each reads one time column
        schema = f"{f'`{time}` {type_}, ' if time else ''}data_kind string, date string, hour string"
        written = spark.read.option("basePath", root).schema(schema).parquet(*[f"{root}/{_place(k, run_id, write_id)}" for k in kinds])
        entries.append(manifest_rows(written, kinds, None, run_id, time, ""))
    marks = spark.createDataFrame([(kind,) for _, kind, _ in tables], "data_kind string")  # an empty table replaces its entry too
    rows = reduce(DataFrame.unionByName, entries).unionByName(marks, allowMissingColumns=True).withColumns(
        {"run_id": F.lit(run_id), "write_id": F.lit(write_id), "replaces": F.array().cast("array<string>")})
    (rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("data_kind", "run_id", "write_id")
     .parquet(f"{root}/_manifest"))


def _write_rows(df: DataFrame, path: str, time: str | None) -> T.StructType:
    """Write rows below ``path`` by (date, hour); returns the schema of the files."""
    date, hour = partition_columns(df, time)
    placed = df.withColumns({"date": date, "hour": hour})
    (placed.hint("rebalance", "date", "hour").write.mode("overwrite").option("compression", "zstd")
     .partitionBy("date", "hour").parquet(path))
    return placed.schema


def write_records(df: DataFrame, root: str, kind: str, run_id: str, *, source: str = "", time: str | None = None,
                  write_id: str | None = None, replaces: list[str] = ()) -> str:
    """Append one table to a run of the archive and list its files in the manifest; returns the id of the write.

    Every write has a folder and a manifest entry of its own: what it costs depends on its rows, not on the archive. The write counts
    once its entry stands. Without ``write_id`` it is a new one; a repeated id (a failed write, a streaming epoch) replaces itself as a
    whole. ``replaces`` names writes that no longer count from then on (``compact``). Rows are rebalanced by (date, hour): an hour holding a
    third of all rows becomes several files, and small hours do not become many.
    """
    spark, root, write_id = df.sparkSession, root.rstrip("/"), write_id or uuid.uuid4().hex
    time = time or infer_time_column(df.columns, kind)
    place = _place(kind, run_id, write_id)
    written = spark.read.schema(_write_rows(df, f"{root}/{place}", time)).parquet(f"{root}/{place}")
    rows = manifest_rows(written, df.columns, kind, run_id, time, source).withColumn("replaces", F.lit(list(replaces)).cast("array<string>"))
    rows.drop("data_kind", "run_id").coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest/{place}")
    return write_id


def compact(spark: SparkSession, root: str, kind: str, run_id: str) -> str | None:
    """Bring all writes of a kind in a run together into one, so that many small files become few.

    The new write's manifest entry replaces the old writes in one step; their files stay until the storage is cleaned, as readers may still hold them.
    """
    manifest = read_manifest(spark, root).where((F.col("data_kind") == kind) & (F.col("run_id") == run_id))
    writes = sorted(r["write_id"] for r in manifest.select("write_id").distinct().collect())  # names of writes
    if len(writes) < 2:
        return None
    first = manifest.select("source_file", "time_col").first()
    rows = load_kind(spark, root, kind, run_id=run_id).drop(*PLACES)
    return write_records(rows, root, kind, run_id, source=first["source_file"], time=first["time_col"] or None, replaces=writes)


def manifest_rows(written: DataFrame, columns: list[str] | dict[str, list[str]], kind: str | None, run_id: str, time: str | None, source: str) -> DataFrame:
    """One row per file; reads only the time column of what was just written. Without ``kind`` the rows carry theirs, and ``columns`` are given by kind."""
    moment = F.col(time) if time else F.lit(None)
    kinds = {kind: columns} if kind is not None else columns
    named = F.lit(kind) if kind is not None else F.col("data_kind")
    of_kind = lambda value: F.create_map(*[F.lit(x) for k, c in kinds.items() for x in (k, value(c))])[F.col("data_kind")]
    per_file = written.groupBy(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("file_size_bytes"), named.alias("data_kind"), "date", "hour").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(moment).cast("string").alias("min_time"), F.max(moment).cast("string").alias("max_time"))
    return per_file.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(datetime.now(timezone.utc).isoformat()).alias("written_at_utc"),
        "data_kind", F.lit(source).alias("source_file"),
        F.regexp_extract("_file", r"(data_kind=.*)$", 1).alias("path"), F.lit("parquet").alias("format"), "n_rows",
        of_kind(len).cast("bigint").alias("n_columns"), of_kind(lambda c: json.dumps(list(c), separators=(",", ":"), ensure_ascii=False)).alias("columns"),
        F.lit(time or "").alias("time_col"),
        "min_time", "max_time", "file_size_bytes", F.col("date").cast("string").alias("date_partition"),
        F.col("hour").cast("string").alias("hour_partition"), F.lit(run_id).alias("run_id"))


def archive_run(tables: dict[str, DataFrame], root: str, run_id: str) -> DataFrame:
    """Archive all known tables of a finished run (one write per kind; a repeated run replaces it) and return the manifest."""
    unknown = set(tables) - set(KIND_TIMES)
    if unknown:
        raise ValueError(f"unknown data kinds: {sorted(unknown)}")
    for kind, df in tables.items():
        write_records(df, root, kind, run_id, source=kind, write_id="run")
    return read_manifest(next(iter(tables.values())).sparkSession, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per file of the writes that count."""
    empty = spark.createDataFrame([], MANIFEST_SCHEMA)
    log = _found(lambda: spark.read.schema(f"{MANIFEST_SCHEMA}, replaces array<string>").parquet(f"{root.rstrip('/')}/_manifest"), None)
    if log is None:
        return empty
    gone = log.select("data_kind", "run_id", F.explode("replaces").alias("write_id")).distinct()
    log = log.where(F.col("path").isNotNull())
    return log.join(gone, ["data_kind", "run_id", "write_id"], "left_anti").select(*empty.columns)


def load_kind(spark: SparkSession, root: str, kind: str, max_files: int | None = None, run_id: str | None = None) -> DataFrame | None:
    """Rows of one kind (None when it was never archived), of all runs or one; ``max_files`` keeps the newest manifest files.

    Only files that the manifest lists are read; a file that cannot be read is an error, not silently shorter.
    """
    root = root.rstrip("/")
    listed = read_manifest(spark, root).where(F.col("data_kind") == kind)
    if run_id is not None:
        listed = listed.where(F.col("run_id") == run_id)
    if max_files is not None:
        listed = listed.orderBy(F.col("written_at_utc").desc(), F.col("path").desc()).limit(max_files)
        paths = [r["path"] for r in listed.select("path").collect()]  # max_files paths
    else:
        # One folder per write: the file index of the read holds these anyway.
        paths = [_place(kind, r["run_id"], r["write_id"]) for r in listed.select("run_id", "write_id").distinct().collect()]
    reader = spark.read.option("basePath", root).option("mergeSchema", True)
    return reader.parquet(*[f"{root}/{p}" for p in paths]) if paths else None


# -- search -----------------------------------------------------------------------------------------

def kinds_to_scan(*, data_kind=None, code=None, severity=None, state=None, residual_above=None, trust_below=None) -> list[str]:
    """Data kinds a search has to open."""
    if data_kind:
        return [data_kind]
    kinds = []
    if code or severity:
        kinds.append("alerts")
    if trust_below is not None:
        kinds.append("trust_score")
    if residual_above is not None:
        kinds += ["residuals", "bias_corrected_residuals"]
    if state and not kinds:
        kinds += ["cleaned_stream", "state_estimates", "residuals", "bias_state_timeseries"]
    return kinds or ["alerts"]


def filter_rows(df: DataFrame, *, code=None, severity=None, state=None, residual_above=None, trust_below=None) -> DataFrame:
    """Search predicates as plain filters, so that they reach the scan; bounds are inclusive."""
    out, nothing = df, F.lit(False)
    if code and "code" in out.columns:
        out = out.where(F.col("code") == code)
    if severity and "severity" in out.columns:
        out = out.where(F.lower("severity") == severity.lower())
    if state:
        if "state" in out.columns:
            out = out.where(F.col("state") == state)
        elif state in out.columns:
            out = out.select(*[c for c in ("time", "timestamp", state) if c in out.columns])
        else:
            out = out.where(nothing)
    if residual_above is not None:
        sizes = [c for c in ("abs_residual", "abs_bias_corrected_residual") if c in out.columns]
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) >= float(residual_above), nothing) for c in sizes]) if sizes else nothing
        out = out.where(hit)
    if trust_below is not None:
        out = out.where(F.col("trust_score") <= float(trust_below)) if "trust_score" in out.columns else out.where(nothing)
    return out


def search_archive(spark: SparkSession, root: str, *, data_kind=None, max_files_per_kind: int | None = None,
                   date_from: str | None = None, date_to: str | None = None, **predicates) -> DataFrame | None:
    """Matching rows of all kinds the predicates concern; date bounds prune partitions."""
    found = []
    for kind in kinds_to_scan(data_kind=data_kind, **predicates):
        rows = load_kind(spark, root, kind, max_files_per_kind)
        if rows is None:
            continue
        if date_from is not None:
            rows = rows.where(F.col("date") >= date_from)
        if date_to is not None:
            rows = rows.where(F.col("date") <= date_to)
        found.append(filter_rows(rows, **predicates).withColumn("data_kind", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def matching_files(manifest: DataFrame, **search) -> DataFrame:
    """Manifest rows of the files a search concerns."""
    narrowed = any(search.get(k) is not None for k in ("data_kind", "code", "severity", "trust_below", "residual_above"))
    return manifest.where(F.col("data_kind").isin(kinds_to_scan(**search))) if narrowed else manifest


# -- context and validation -----------------------------------------------------------------------------

def context_index(manifest: DataFrame) -> DataFrame:
    return manifest.select("run_id", "data_kind", F.col("date_partition").alias("date"), F.col("hour_partition").alias("hour"),
                           "min_time", "max_time", "n_rows", "file_size_bytes", "path", "source_file", "format",
                           "schema_version", (F.coalesce("file_size_bytes", F.lit(0)) / 1e6).alias("file_size_mb"))


def context_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("run_id", "data_kind").agg(
        F.count("path").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes")).withColumn("size_mb", F.col("bytes") / 1e6)


def counts_by_kind(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("data_kind").agg(F.count(F.lit(1)).alias("files")).orderBy(F.col("files").desc(), "data_kind")


def validate_archive(spark: SparkSession, root: str, manifest: DataFrame | None = None) -> DataFrame:
    """Findings as rows (level error or warning); an empty result means the archive passed.

    Every manifest path is checked against the actual files by an anti join, not only the first ones.
    """
    root = root.rstrip("/")
    manifest = read_manifest(spark, root) if manifest is None else manifest
    absent = sorted(set(REQUIRED_MANIFEST) - set(manifest.columns))
    finding = "level string, code string, detail string"
    fixed = [("error", "missing_manifest_column", c) for c in absent]
    parts = [spark.createDataFrame(fixed, finding)]
    total = manifest.agg(F.count(F.lit(1)).alias("_n"))
    parts.append(total.where("_n = 0").select(F.lit("error").alias("level"), F.lit("empty_manifest").alias("code"),
                                              F.lit(root).alias("detail")))
    if "path" in manifest.columns:
        actual = _found(lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.parquet").load(root).select(F.regexp_extract("path", r"(data_kind=.*)$", 1).alias("path")), None)
        lost = manifest.select("path").where(F.col("path").isNotNull())
        lost = lost if actual is None else lost.join(actual, "path", "left_anti")
        parts.append(lost.select(F.lit("error").alias("level"), F.lit("missing_file").alias("code"), F.col("path").alias("detail")))
    if {"data_kind", "columns"} <= set(manifest.columns):
        wanted = spark.createDataFrame([(k, list(c)) for k, c in RECOMMENDED.items()], "data_kind string, _wanted array<string>")
        seen = manifest.select("data_kind", "columns").distinct().select(
            "data_kind", F.explode(F.from_json("columns", "array<string>")).alias("_c")).groupBy("data_kind").agg(
            F.collect_set("_c").alias("_seen"))
        joined = F.broadcast(wanted).join(seen, "data_kind", "left")
        missing = F.array_join(F.array_sort(F.array_except("_wanted", F.coalesce("_seen", F.array()))), ",")
        parts.append(joined.where(F.col("_seen").isNull()).select(
            F.lit("warning").alias("level"), F.lit("kind_not_present").alias("code"), F.col("data_kind").alias("detail")))
        parts.append(joined.where(F.col("_seen").isNotNull() & (missing != "")).select(
            F.lit("warning").alias("level"), F.lit("recommended_columns_missing").alias("code"),
            F.concat("data_kind", F.lit(": "), missing).alias("detail")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def validation_status(findings: DataFrame) -> DataFrame:
    """One row: status failed, warning or passed, with counts."""
    return findings.agg(F.count_if(F.col("level") == "error").alias("n_errors"),
                        F.count_if(F.col("level") == "warning").alias("n_warnings")).withColumn(
        "status", F.when(F.col("n_errors") > 0, "failed").when(F.col("n_warnings") > 0, "warning").otherwise("passed"))
