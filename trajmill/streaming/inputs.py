"""Streaming sources: replay of a finished table, appended logs and drop folders; runs with limits."""

from __future__ import annotations

import uuid
from time import monotonic

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trajmill.plans.segments import plan_layout, with_position
from trajmill.session import shared_folder
from trajmill.streaming.tail import follow_stream

META = ["_stream_source", "_stream_row_index", "_received_utc"]


def write_replay(df: DataFrame, path: str, *, chunk_size: int, time: str | None = None, case: str | None = None,
                 case_value=None, order: tuple[str, ...] = (), max_samples: int | None = None) -> int:
    """Write a finished table as time-ordered chunk files, one per poll; returns the number of chunks.

    ``_stream_row_index`` counts rows in (time, order). Rows are dealt into chunks once, in the shared folder; the
    chunks are then committed one after the other, as the file source replays files by age.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    rows = df if case is None or case_value is None else df.where(F.col(case).cast("string") == str(case_value))
    sort = [*([time] if time else []), *order]
    if not sort:
        raise ValueError("a replay needs a time or order column")
    numbered = with_position(rows, plan_layout(rows, [], sort[0]), sort, "_stream_row_index")
    if max_samples is not None:
        numbered = numbered.where(F.col("_stream_row_index") < max_samples)
    numbered = numbered.withColumn("_stream_row_index", F.col("_stream_row_index").cast("bigint"))
    dealt = numbered.withColumn("_chunk", F.floor(F.col("_stream_row_index") / chunk_size))
    spark, staging = df.sparkSession, f"{shared_folder(df.sparkSession)}/replay-{uuid.uuid4().hex}"
    dealt.repartition("_chunk").write.partitionBy("_chunk").parquet(staging)
    top = spark.read.schema("_chunk bigint").parquet(staging).agg(F.max("_chunk")).first()[0]
    for i in range(0 if top is None else top + 1):
        part = spark.read.schema(numbered.schema).parquet(f"{staging}/_chunk={i}")
        part.coalesce(1).write.mode("append").parquet(path)  # one chunk
    return 0 if top is None else top + 1


def replay_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """Stream over replay chunks, one chunk per trigger."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return _stamped(stream)


def tail_stream(spark: SparkSession, path: str, columns: list[str], *, pattern: str = "*.csv", start_at_end: bool = False,
                since: str | None = None, settle_seconds: float = 0.0, case: str | None = None, case_value=None,
                files_per_trigger: int = 1000) -> DataFrame:
    """Stream over files dropped into a folder: one file per flush, all columns as text.

    ``start_at_end`` (or ``since``) leaves out files older than now (or that timestamp).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    stream = (spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", pattern)
              .option("latestFirst", False).option("maxFilesPerTrigger", files_per_trigger).csv(path))
    if start_at_end or since is not None:
        start = since or spark.sql("select cast(current_timestamp() as string)").first()[0]
        stream = stream.where(F.col("_metadata.file_modification_time") > F.lit(start).cast("timestamp"))
    if case is not None and case_value is not None:
        stream = stream.where(F.col(case) == str(case_value))
    return _stamped(stream)


def _stamped(stream: DataFrame) -> DataFrame:
    out = stream.withColumn("_stream_source", F.element_at(F.split("_metadata.file_path", "/"), -1))
    if "_stream_row_index" not in out.columns:
        out = out.withColumn("_stream_row_index", F.lit(None).cast("bigint"))
    return out.withColumn("_received_utc", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))


def make_stream(spark: SparkSession, stream_type: str, path: str, **options) -> DataFrame:
    """Stream by type name: csv_replay / replay, csv_tail / tail (appended files), or csv_drop / drop (one file per flush)."""
    kind = stream_type.lower().replace("-", "_")
    if kind in ("csv_replay", "replay"):
        return replay_stream(spark, path, **options)
    if kind in ("csv_tail", "tail"):
        return follow_stream(spark, path, **options)
    if kind in ("csv_drop", "drop"):
        return tail_stream(spark, path, **options)
    raise ValueError(f"unknown stream type: {stream_type!r}")


class _Enough(Exception):
    """Raised in a batch that must not be committed, because the limit was reached before it."""


def run_until_done(stream: DataFrame, each_batch, checkpoint: str, *, poll_seconds: float | None = None,
                   timeout: float | None = None, max_samples: int | None = None, max_polls: int | None = None,
                   order: str = "_stream_row_index"):
    """Drive a stream: everything that is there (default), or by polling every ``poll_seconds``.

    It ends after ``timeout`` seconds, after ``max_polls`` batches and idle poll intervals, or when ``max_samples`` rows were handed on. The
    batch that reaches the row limit is cut to it, in ``order``; a later batch is not committed, so that a run with the same
    checkpoint reads it again.
    """
    seen = {"rows": 0, "polls": 0}

    def full() -> bool:
        return (max_samples is not None and seen["rows"] >= max_samples) or (max_polls is not None and seen["polls"] >= max_polls)

    def limited(batch: DataFrame, epoch: int) -> None:
        if full():
            raise _Enough
        if max_samples is not None:
            batch = batch.persist()
            try:
                rows, left = batch.count(), max_samples - seen["rows"]
                if rows > left:
                    batch = batch.orderBy(*[c for c in (order,) if c in batch.columns]).limit(left)
                each_batch(batch, epoch)
            finally:
                batch.unpersist()
            seen["rows"] += min(rows, left)
        else:
            each_batch(batch, epoch)
        seen["polls"] += 1

    bounded = max_samples is not None or max_polls is not None
    writer = stream.writeStream.foreachBatch(limited if bounded else each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if poll_seconds is None else writer.trigger(processingTime=f"{poll_seconds} seconds")
    if full():
        return None
    query = writer.start()
    deadline, idle, tick = monotonic() + (timeout if timeout is not None else float("inf")), 0.0, 0.2
    try:
        while not query.awaitTermination(min(tick if bounded else 3600.0, max(0.01, deadline - monotonic()))):
            if bounded and poll_seconds is not None and query.status["message"].startswith("Waiting"):
                idle += tick
            waited = max_polls is not None and poll_seconds is not None and seen["polls"] + idle / max(poll_seconds, tick) >= max_polls
            if full() or waited or monotonic() >= deadline:
                query.stop()
    except StreamingQueryException:
        if not full():
            raise
    return query
