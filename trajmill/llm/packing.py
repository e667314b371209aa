"""Packing by power-of-two decomposition (dataset decomposition, Pouransari et al., 2024).

A document of L tokens becomes floor(L / longest) pieces of the longest length and one piece for every binary digit of the rest,
largest first. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding; sequences of
equal length form a bucket, and a training batch takes all its sequences from one bucket.

One pass over the texts, no shuffle: a sequence is numbered inside its task and bucket. What needs bucket-wide numbers
(``batches``) shuffles one row per task and bucket, not the tokens.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from trajmill.llm.tokens import word_ends
from trajmill.llm.words import blocks

LONGEST = 4096
END = 2
_TASK_BITS, _BUCKET_BITS = 20, 5  # of a sequence id; the rest counts inside the task
_FIELDS = "start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"


def binary_lengths(count: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, length) of the pieces of documents with ``count`` tokens each, in reading order."""
    digits = longest >> np.arange(longest.bit_length())  # longest, longest / 2, ... 1
    parts = np.where(digits == longest, count[:, None] // longest, (count[:, None] & digits) > 0).astype(np.int64)
    owner = np.repeat(np.arange(len(count)), parts.sum(axis=1))
    length = np.repeat(np.tile(digits, len(count)), parts.ravel())
    end = np.cumsum(length)
    begin = np.cumsum(count) - count
    return owner, end - length - begin[owner], length


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): one row per piece, and each piece fills its sequence.

    ``ids`` are little-endian unsigned 32-bit token ids of ``tokenizer`` (a word-end BPE file) without special tokens,
    and ``end_id`` after the last. ``longest`` is a power of two. A null text is empty: its one token is ``end_id``. Every row is a
    document of its own, also with a repeated or null id; whole texts are read, of any length; other columns are ignored. An
    empty table gives no rows. ``sequence_id`` holds task, number and bucket (``bucket``); it is unique in the result.
    """
    if longest < 1 or longest & (longest - 1) or longest.bit_length() > 1 << _BUCKET_BITS:
        raise ValueError("longest must be a power of two below 2**32")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches):
        encoder = word_ends(path)
        task = TaskContext.get().partitionId()
        if task >= 1 << _TASK_BITS:
            raise ValueError("more tasks than sequence ids have room for")
        used = np.zeros(longest.bit_length(), np.int64)  # sequences of each bucket so far
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, last in blocks(texts):
                ids = [np.append(encoder.ids(t or ""), np.uint32(end_id)) for t in texts[first:last]]
                count = np.array([len(x) for x in ids])
                owner, start, length = binary_lengths(count, longest)
                log = np.round(np.log2(length)).astype(np.int64)
                number = np.empty(len(log), np.int64)
                for b in np.unique(log):
                    mine = np.flatnonzero(log == b)
                    number[mine] = used[b] + np.arange(len(mine))
                    used[b] += len(mine)
                sequence = (task << (63 - _TASK_BITS)) | (number << _BUCKET_BITS) | log
                edge = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
                data = np.concatenate(ids).astype("<u4", copy=False)
                column = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edge), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(first + owner)), pa.array(start), pa.array(length), pa.array(count[owner]), column,
                     pa.array(sequence), pa.array(np.zeros(len(length), np.int64))],
                    names=["_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    schema = f"_id {docs.schema[doc_id].dataType.simpleString()}, {_FIELDS}"
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).mapInArrow(cut, schema).withColumnRenamed("_id", doc_id)


def bucket(sequence_id: str = "sequence_id"):
    """The bucket of a sequence: the binary logarithm of its length."""
    return F.col(sequence_id).bitwiseAND((1 << _BUCKET_BITS) - 1).cast("int")


def batches(packed: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """Add ``batch``: the number, inside its bucket, of the training batch of ``tokens`` tokens that the sequence belongs to.

    All sequences of a batch have one length, and only the last batch of a bucket may be short. ``tokens`` is at least the longest
    length. ``packed`` is a table written from ``pack``: bucket-wide places come from one count per task and bucket.
    """
    task = F.shiftright("sequence_id", 63 - _TASK_BITS).cast("int")
    within = F.shiftright(F.col("sequence_id").bitwiseAND((1 << (63 - _TASK_BITS)) - 1), _BUCKET_BITS)
    count = packed.groupBy(bucket().alias("_bucket"), task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_bucket").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begin = count.select("_bucket", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    placed = packed.withColumns({"_bucket": bucket(), "_task": task}).join(begin, ["_bucket", "_task"])
    return placed.withColumn("batch", F.floor((F.col("_begin") + within) / F.floor(F.lit(tokens) / F.col("length"))).cast("bigint")).drop("_bucket", "_task", "_begin")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length under ``path``: each task writes what it has of each, nothing is shuffled."""
    packed.withColumn("bucket", bucket()).write.partitionBy("bucket").parquet(path)
