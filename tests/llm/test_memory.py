"""A Python worker holds little beside the Arrow batch that Spark hands it, whatever the batch's size."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from trajmill.llm import near_duplicates as nd, toxicity as tx
from trajmill.llm.words import pieces


def test_pieces_cover_a_column_in_order():
    draw = random.Random(3)
    texts = [draw.choice([None, "", "aé€ 𝄞" * draw.choice([1, 40, 700])]) for _ in range(500)]
    for data, limit in ((texts, 1), (texts, 4000), (texts, 1 << 20), ([], 10), ([None] * 3, 2)):
        column = pa.array(["before", *data], pa.string()).slice(1)
        got = list(pieces(column, limit))
        assert [t for _, _, part in got for t in part] == data
        assert all(end > first and part == data[first:end] for first, end, part in got)
        assert [first for first, *_ in got] == [0, *[end for _, end, _ in got]][: len(got)]
        size = lambda part: sum(len((t or "").encode()) + 1 for t in part)
        assert all(size(part[:-1]) < limit for *_, part in got)  # a piece ends with the text that reaches the limit


@pytest.mark.parametrize("step", ["sign", "set", "count"])
def test_a_large_batch_is_worked_on_in_pieces(step):
    draw = random.Random(1)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(1000)]
    line = " ".join(draw.choice(words) for _ in range(2000))
    texts = pa.array([line[draw.randrange(5000):] for _ in range(4000)], pa.string())  # about 30 MB
    ids = pa.array(range(len(texts)), pa.int64())
    keys = pa.array([b"none"] * len(texts), pa.binary())
    work, batch = {"sign": (nd._signer(5), [ids, texts]), "set": (nd._setter(5), [texts, ids, keys]), "count": (tx._count, [texts])}[step]
    small = pa.RecordBatch.from_arrays([c.slice(0, 40) for c in batch], names=list("abc")[: len(batch)])
    large = pa.RecordBatch.from_arrays(batch, names=small.schema.names)
    list(work([small]))  # what a process makes once
    tracemalloc.start()
    try:
        for _ in work([large]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < texts.nbytes
