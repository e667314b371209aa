"""Reading, checking and canonicalising trajectory tables."""

from __future__ import annotations

import csv
import fnmatch
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trajmill.functions.columns import floating_columns, is_missing
from trajmill.plans.segments import plan_layout, with_lags
from trajmill.spec import TrajectorySpec


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read CSV or Parquet by suffix; other suffixes are an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if suffix in (".csv", ".txt", ".tsv"):
        reader = spark.read.option("header", True).option("sep", "\t" if suffix == ".tsv" else ",")
        return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    raise ValueError(f"unsupported table format: {suffix!r}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a canonical table as Parquet or CSV."""
    if fmt == "parquet":
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unknown output format: {fmt!r}")


def list_files(spark: SparkSession, root: str, pattern: str = "*", *, settle_seconds: float | None = None,
               min_bytes: int = 1) -> DataFrame:
    """File listing (path, name, bytes, modified); no file content is read.

    ``settle_seconds`` keeps only files large enough and unchanged for that long, so that
    half-written chunks are left for later.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    )
    if settle_seconds is None:
        return files
    return stable_files(files, settle_seconds, min_bytes)


def stable_files(files: DataFrame, settle_seconds: float = 2.0, min_bytes: int = 1) -> DataFrame:
    age = (F.unix_micros(F.current_timestamp()) - F.unix_micros("modified")) / 1e6
    return files.where((F.col("bytes") >= min_bytes) & (age >= settle_seconds))


def apply_column_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; names absent from the table are ignored."""
    return df.withColumnsRenamed(mapping)


def parse_rename_pairs(pairs) -> dict[str, str]:
    """Turn "old=new" or "old:new" texts into a mapping; "=" is looked for first."""
    mapping = {}
    for pair in pairs or []:
        for mark in ("=", ":"):
            if mark in pair:
                old, new = (part.strip() for part in pair.split(mark, 1))
                break
        else:
            raise ValueError(f"rename pair needs '=' or ':': {pair!r}")
        if not old or not new:
            raise ValueError(f"rename pair needs both names: {pair!r}")
        mapping[old] = new
    return mapping


def read_folder(spark: SparkSession, root: str, pattern: str = "*.csv", *, required: list[str],
                mapping: dict[str, str] | None = None, case: str = "case_id", max_files: int | None = None,
                schema=None, settle_seconds: float | None = None, case_from_stem: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stack the files of a folder: outer union of columns, ``source_file`` and case from the stem.

    Returns ``(rows, skipped)``; ``skipped`` lists text files whose header holds none of the required
    columns, and Parquet files that gave no row (unreadable or empty). Every text file is read once for its header
    and once for its rows; with ``schema`` (all files alike) the first pass is not needed. Without
    ``case_from_stem`` files that lack the case column stay without one.
    """
    mapping = mapping or {}
    listing = list_files(spark, root, pattern, settle_seconds=settle_seconds)
    if max_files is not None:
        listing = listing.orderBy("name").limit(max_files)
    if listing.isEmpty():
        raise FileNotFoundError(f"no file matches {pattern!r} under {root}")
    chosen = listing.select(F.col("path").alias("_path")) if max_files or settle_seconds else None
    empty = spark.createDataFrame([], "path string, reason string")

    def label(df: DataFrame, only: DataFrame | None) -> DataFrame:
        df = df.withColumn("_path", F.col("_metadata.file_path"))
        df = df.join(only, "_path", "left_semi") if only is not None else df
        df = apply_column_mapping(df, mapping)
        name = F.element_at(F.split("_path", "/"), -1)
        df = df.withColumn("source_file", F.url_decode(name))
        if case_from_stem and case not in df.columns:
            df = df.withColumn(case, F.regexp_replace("source_file", r"\.[^.]*$", ""))
        return df.drop("_path")

    if fnmatch.fnmatch("x.parquet", pattern) or pattern.endswith((".parquet", ".pq")):
        found = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).option("pathGlobFilter", pattern).parquet(root)
        full = found.select(F.col("_metadata.file_path").alias("path")).distinct()
        unread = (listing.select("path") if chosen is None else chosen.select(F.col("_path").alias("path"))).join(full, "path", "left_anti")
        return label(found, chosen), unread.withColumn("reason", F.lit("no readable row"))
    if schema is not None:
        reader = spark.read.option("header", True).option("pathGlobFilter", pattern).schema(schema)
        return label(reader.csv(root), chosen), empty
    lines = spark.read.option("pathGlobFilter", pattern).text(root)
    heads = (
        lines.select(F.col("_metadata.file_path").alias("_path"), F.col("value"),
                     F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
        .groupBy("_path").agg(F.min_by("value", "at").alias("header"))
    )
    heads = heads.join(chosen, "_path", "left_semi") if chosen is not None else heads
    separator = "\t" if pattern.endswith(".tsv") else ","

    def names(header: str) -> list[str]:
        return [c.strip() for c in next(csv.reader([header], delimiter=separator), [])]

    wanted = set(required)
    files: dict[str, list[str]] = {}
    for r in heads.collect():  # file names, which Spark's listing keeps on the driver anyway
        files.setdefault(r["header"], []).append(r["_path"])
    readable = sorted(h for h in files if wanted & {mapping.get(c, c) for c in names(h)})
    skipped = spark.createDataFrame([(p, "header holds no required column") for h in sorted(set(files) - set(readable)) for p in sorted(files[h])],
                                    "path string, reason string")
    if not readable:
        raise ValueError(f"no readable file under {root}")
    parts = []
    for header in readable:
        kinds = T.StructType([T.StructField(c, T.StringType()) for c in names(header)])
        part = spark.read.option("header", True).option("sep", separator).schema(kinds).csv(sorted(files[header]))
        parts.append(label(part, None))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    texts = {"source_file", case}
    return rows.select(*[F.col(c) if c in texts else _typed(rows, c, wanted) for c in rows.columns]), skipped


def read_daq_folder(spark: SparkSession, root: str, pattern: str = "*.csv", **options) -> tuple[DataFrame, DataFrame]:
    """Folder of data-acquisition chunk files: as ``read_folder``, labelled with its importer.

    Such loggers may still be writing the newest chunk, so files changed within the last two seconds
    are left for the next import unless ``settle_seconds`` says otherwise.
    """
    rows, skipped = read_folder(spark, root, pattern, **{"settle_seconds": 2.0, **options})
    return rows.withColumn("importer", F.lit("daq_folder")), skipped


def _typed(df: DataFrame, column: str, numeric: set[str]):
    """Required columns of a text import become doubles; text that is no number becomes null."""
    return F.col(column).try_cast("double").alias(column) if column in numeric else F.col(column)


def canonicalise(df: DataFrame, mapping: dict[str, str] | None = None, *, source: str | None = None,
                 case: str = "case_id", case_value: str | None = None) -> DataFrame:
    """Import step: rename, then add the source and case columns where the table lacks them."""
    out = apply_column_mapping(df, mapping or {})
    if source is not None and "source_file" not in out.columns:
        out = out.withColumn("source_file", F.lit(source))
    if case_value is not None and case not in out.columns:
        out = out.withColumn(case, F.lit(case_value))
    return out


def import_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Canonicalise, write, and return the column profile of what was written."""
    out = canonicalise(df, **options)
    write_table(out, path, fmt)
    return column_profile(out)


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, missing values, distinct non-null values; one aggregation."""
    floating, kinds = floating_columns(df), dict(df.dtypes)

    def distinct(c):
        value = F.when(~is_missing(c, c in floating), F.col(c))
        return F.approx_count_distinct(value) if approximate else F.count_distinct(value)

    one = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"),
                 F.count_if(is_missing(c, c in floating)).alias("n_missing"),
                 distinct(c).alias("n_unique")).alias(f"_p{i}")
        for i, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*one.columns)))


class InvalidTrajectories(ValueError):
    """The table breaks a rule every fit relies on."""


def load_trajectories(df: DataFrame, spec: TrajectorySpec, *, cases: list[str] | None = None,
                      sort: bool = True, check: bool = True) -> DataFrame:
    """Select the role columns of the wanted cases and check them in one aggregation.

    Checks: required columns present, no null, finite numbers, two rows per case, strictly
    increasing time. Rows without a case are left out when the table has cases.
    """
    absent = [c for c in spec.required if c not in df.columns]
    if absent:
        raise InvalidTrajectories(f"missing required columns: {absent}")
    rows = df
    if spec.case:
        rows = rows.where(F.col(spec.case).isNotNull())
        if cases is not None:
            rows = rows.where(F.col(spec.case).cast("string").isin([str(c) for c in cases]))
    rows = spec.project(rows)
    if check:
        problems = trajectory_problems(rows, spec)
        if problems:
            raise InvalidTrajectories("; ".join(problems))
    return rows.orderBy(*spec.keys, *spec.sort) if sort else rows


def trajectory_problems(rows: DataFrame, spec: TrajectorySpec) -> list[str]:
    layout = plan_layout(rows, spec.keys, spec.time)
    stepped = with_lags(rows, layout, [spec.time], {"_before": (spec.time, 1)})
    numeric = [spec.time, *spec.values]
    per_case = stepped.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(spec.time) <= F.col("_before")).alias("backwards"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in numeric],
        *[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"bad_{c}") for c in numeric])
    totals = per_case.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") < 2).alias("short"),
        F.count_if(F.col("backwards") > 0).alias("backwards"),
        *[F.sum(f"{kind}_{c}").alias(f"{kind}_{c}") for kind in ("null", "bad") for c in numeric]).first()
    problems = []
    if not totals["cases"]:
        problems.append("no rows for the wanted cases")
    nulls = {c: totals[f"null_{c}"] for c in numeric if totals[f"null_{c}"]}
    infinite = [c for c in numeric if totals[f"bad_{c}"]]
    if nulls:
        problems.append(f"missing values in required columns: {nulls}")
    if infinite:
        problems.append(f"values that are not finite in columns: {infinite}")
    if totals["short"]:
        problems.append(f"{totals['short']} case(s) with fewer than two rows")
    if totals["backwards"]:
        problems.append(f"{totals['backwards']} case(s) whose time does not strictly increase")
    return problems
