"""Shared steps: the documents table, written tables that cut lineage, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: short lineage, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in Arrow batches of at most ``rows`` rows: an executor holds a batch several times, in both processes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def checked_broadcast(df: DataFrame, size: int, limit: int) -> DataFrame:
    """Broadcast a side whose *measured* size is within ``limit``; beyond it the join shuffles both sides."""
    return F.broadcast(df) if size <= limit else df


def remainder(id_column: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``: the fold of a document."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(17), key), key).limit(rows)
