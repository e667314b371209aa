"""Alignment of two tokenizers by merge-path partitioning (Odeh et al., 2012; Green et al., 2014).

The byte offsets where tokens of A and of B end are two sorted lists. Diagonals of their merge matrix, each found by one binary search,
divide the merging into pieces of equal work that need nothing from each other. A piece merges its part, emits the overlaps of A and B
tokens in it, and marks where both lists end; what reaches over a piece's border is stitched to the next piece's first group. The texts
of a batch are merged as one pair of lists, as both lists end at the end of every text, so long and short texts give equal pieces.

The corpus-wide part counts, for every pair of ids, the documents that hold it linked. Distinct pairs of a document are written once;
counting them combines before it shuffles. Frequent pairs, at most ``frequent`` by the choice of their least count, are broadcast and
looked up beside the documents; only rows of rare pairs, each in few documents, are shuffled to their counts.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import chain
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajmill.llm.common import stored
from trajmill.llm.tokens import byte_level, pieces
from trajmill.llm.words import blocks

WORK = 1 << 14  # merged ends of a piece
FREQUENT = 500_000  # pairs whose counts are broadcast, 12 bytes each
LINKS = 1 << 22  # links spelt out at once
_SHIFT = 32


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Points (i, j) of the merge path at every ``work``-th merged element: of the first i + j, i come from ``a``, which is first at ties.

    One binary search for each diagonal, all of them side by side.
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = a[np.where(open_, mid, 0)] <= b[np.where(open_, d - mid - 1, 0)]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(A token, B token, both end there) of every overlap of a piece, and whether its first element only closes the overlap before it.

    ``a`` and ``b`` are the piece's own ends, ``i`` and ``j`` the tokens before them, ``before`` the last end before the piece. Of two equal
    ends the second adds no overlap: it says that the overlap before it ends in both lists.
    """
    place = np.searchsorted(a, b, side="right") + np.arange(len(b))
    from_b = np.zeros(len(a) + len(b), bool)
    from_b[place] = True
    ends = np.empty(len(from_b), np.int64)
    ends[from_b], ends[~from_b] = b, a
    over_b = j + np.cumsum(from_b) - from_b
    over_a = i + j + np.arange(len(ends)) - over_b
    real = np.diff(ends, prepend=before) > 0
    closes = np.append(~real[1:], False)
    return over_a[real], over_b[real], closes[real], bool(len(real)) and not real[0]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps (A token, B token, both end there) of two increasing lists of ends with the same last value.

    A pair of equal ends that the border of two pieces parts is stitched: the next piece says so, and the overlap before it closes.
    """
    at_a, at_b = diagonals(a, b, work)
    parts = []
    for i, j, k, m in zip(at_a[:-1], at_b[:-1], at_a[1:], at_b[1:]):
        part = merge_piece(a[i:k], b[j:m], i, j, max(a[i - 1] if i else 0, b[j - 1] if j else 0))
        if part[3]:
            parts[-1][2][-1] = True
        if len(part[0]):
            parts.append(part)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate([p[c] for p in parts]) for c in range(3))


def group_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B up to the end of each group: a group is a run of overlaps up to one that ends in both lists."""
    over_a, over_b, closes = overlaps(a, b, work)
    return over_a[closes] + 1, over_b[closes] + 1


class Block:
    """Tokens and groups of a run of texts; ``tokens_a`` and the like count up to each text's end."""

    def __init__(self, texts: list, path_a: str, path_b: str):
        first, second = byte_level(path_a), pieces(path_b)
        ids = [_tokens(t, first, second) for t in texts]
        self.ids_a, self.tokens_a = _joined([x for x, _ in ids])
        self.ids_b, self.tokens_b = _joined([y for _, y in ids])
        self.groups_a, self.groups_b = group_ends(np.cumsum(_sizes(path_a, byte_level)[self.ids_a]), np.cumsum(_sizes(path_b, pieces)[self.ids_b]))
        self.groups = np.searchsorted(self.groups_a, self.tokens_a, side="right")

    def links(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): the distinct linked id pairs of every text, as a << 32 | b, and how many links each is."""
        wide, high = np.diff(self.groups_a, prepend=0), np.diff(self.groups_b, prepend=0)
        text = np.searchsorted(self.groups, np.arange(len(wide)), side="right")
        total = np.cumsum(wide * high)
        found = []
        for g, h in _ranges(total, LINKS):
            one = wide[g:h] * high[g:h]
            if h == g + 1 and one[0] > LINKS:  # one huge group: distinct ids first
                x, nx = np.unique(self.ids_a[self.groups_a[g] - wide[g]: self.groups_a[g]], return_counts=True)
                y, ny = np.unique(self.ids_b[self.groups_b[g] - high[g]: self.groups_b[g]], return_counts=True)
                found.append((np.full(len(x) * len(y), text[g]), np.repeat(x, len(y)) * size_b + np.tile(y, len(x)), np.outer(nx, ny).ravel()))
                continue
            owner = np.repeat(np.arange(g, h), one)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(one) - one, one)
            x = self.ids_a[self.groups_a[owner] - wide[owner] + step // high[owner]]
            y = self.ids_b[self.groups_b[owner] - high[owner] + step % high[owner]]
            found.append(_summed(text[owner], x * size_b + y, np.ones(len(owner), np.int64)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        text, pair, times = found[0] if len(found) == 1 else _summed(*(np.concatenate(c) for c in zip(*found)))
        return text, (pair // size_b << _SHIFT) | pair % size_b, times

    def digests(self) -> list[str]:
        """sha256 of each text's groups, spelt ``a1,a2|b1;a3|b2,b3``; an empty string for a text without tokens."""
        spelt = np.empty(len(self.ids_a) + len(self.ids_b), object)
        group_a = np.searchsorted(self.groups_a, np.arange(len(self.ids_a)), side="right")
        group_b = np.searchsorted(self.groups_b, np.arange(len(self.ids_b)), side="right")
        for ids, group, ends, place, last in (
                (self.ids_a, group_a, self.groups_a, np.append(0, self.groups_b)[group_a], "|"),
                (self.ids_b, group_b, self.groups_b, self.groups_a[group_b], ";")):
            number = np.arange(len(ids))
            spelt[place + number] = _numbers(last)[2 * ids + (ends[group] == number + 1)]
        begin = 0
        out = []
        for end in self.tokens_a + self.tokens_b:
            out.append(hashlib.sha256("".join(spelt[begin:end].tolist())[:-1].encode()).hexdigest() if end > begin else "")
            begin = end
        return out


def _tokens(text: str | None, first, second) -> tuple[list, list]:
    """Ids of blank + text by both vocabularies; none where either does not give back its bytes."""
    if not text:
        return [], []
    raw = (" " + text).encode("utf-8", "surrogatepass")
    x, y = first.ids(" " + text), second.ids(text)
    same = b"".join(map(first.bytes.__getitem__, x)) == raw and b"".join(map(second.bytes.__getitem__, y)) == raw
    return (x, y) if same else ([], [])


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists))), np.cumsum([len(x) for x in lists])


@cache
def _sizes(path: str, load) -> np.ndarray:
    """Bytes of each id."""
    tokens = load(path).bytes
    sizes = np.zeros(max(tokens) + 1, np.int64)
    sizes[list(tokens)] = [len(b) for b in tokens.values()]
    return sizes


@cache
def _numbers(last: str) -> np.ndarray:
    """Decimal numbers followed by a comma (even places) or by ``last`` (odd places)."""
    return np.array([f"{i}{sign}" for i in range(1 << 17) for sign in (",", last)], object)


def _ranges(total: np.ndarray, limit: int):
    """Ranges of groups with at most ``limit`` links, or one group with more; ``total`` is the running number of links."""
    begin = 0
    while begin < len(total):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield begin, end
        begin = end


def _summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per (text, pair), sorted by them."""
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    fresh = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))) if len(text) else np.zeros(0, np.int64)
    return text[fresh], pair[fresh], np.add.reduceat(times, fresh) if len(fresh) else times


def _row_sums(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums of whole numbers by the sorted row ``owner``."""
    edge = np.searchsorted(owner, np.arange(rows + 1))
    running = np.append(0, np.cumsum(values))
    return running[edge[1:]] - running[edge[:-1]]


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """A list column: ``values`` are dealt to the row ``owner``, which is sorted."""
    edge = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(values))


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids_a, ids_b, ends_a, ends_b): the tokens of both vocabularies and how many of each lie before the end of each group.

    A is a byte-level BPE file and reads a blank and the text; B is a sentencepiece file with byte fallback that puts the blank itself. Null and
    empty texts, and texts whose bytes a vocabulary does not give back, have no tokens. Each row is a document; whole texts of
    any length are read; other columns are ignored.
    """
    paths = _paths(path_a, path_b)

    def spell(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in blocks(texts):
                block = Block(texts[first:last], *paths)
                n = last - first
                row_a, row_b = np.repeat(np.arange(n), np.diff(block.tokens_a, prepend=0)), np.repeat(np.arange(n), np.diff(block.tokens_b, prepend=0))
                row = np.repeat(np.arange(n), np.diff(block.groups, prepend=0))
                base_a, base_b = np.append(0, block.tokens_a)[row], np.append(0, block.tokens_b)[row]
                columns = [_lists(v.astype(np.int32), o, n) for v, o in (
                    (block.ids_a, row_a), (block.ids_b, row_b), (block.groups_a - base_a, row), (block.groups_b - base_b, row))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *columns], names=["_id", "ids_a", "ids_b", "ends_a", "ends_b"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_id {kind}, ids_a array<int>, ids_b array<int>, ends_a array<int>, ends_b array<int>"
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).mapInArrow(spell, schema).withColumnRenamed("_id", doc_id)


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a document's groups as a digest, and its distinct linked id pairs.

    A pair is ``a << 32 | b``, linked ``times`` times: every A token with every B token of its group. Rows as in ``groups``. A document's
    distinct pairs are held in its task.
    """
    paths = _paths(path_a, path_b)

    def count(batches):
        size_b = len(_sizes(paths[1], pieces))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in blocks(texts):
                block = Block(texts[first:last], *paths)
                n = last - first
                owner, pair, times = block.links(size_b)
                links = _row_sums(times, owner, n)
                counts = [pa.array(np.diff(c, prepend=0)) for c in (block.tokens_a, block.tokens_b, block.groups)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *counts, pa.array(links), pa.array(block.digests()), _lists(pair, owner, n), _lists(times.astype(np.int32), owner, n)],
                    names=["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).mapInArrow(count, schema).withColumnRenamed("_id", doc_id)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) of ``linked`` rows: in how many documents a pair is linked, and whether no other pair of its A id is in more."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    first = F.shiftright("pair", _SHIFT)
    # One row per A id: bounded by the vocabulary, whatever the corpus.
    most = counts.groupBy(first.alias("_a")).agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most), first == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text",
          frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): ``linked`` with the corpus-wide counts of its links.

    ``count_sum`` adds, over all links, the documents that hold the pair; ``n_best`` counts links whose pair has the most documents of its A id
    (ties included). Documents without tokens have zeros and an empty digest; an empty table gives no rows; a null or repeated id is kept.
    """
    spark = docs.sparkSession
    rows = stored(linked(docs, path_a, path_b, doc_id, text).withColumnRenamed(doc_id, "_id").withColumn("_row", F.monotonically_increasing_id()), "linked")
    counts = stored(pair_counts(rows), "pair-counts")
    size = counts.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    # Fewer than `frequent` pairs can be in more than rows / frequent documents, so what is collected and broadcast is bounded.
    least = 1 if size["pairs"] <= frequent else ceil(size["rows"] / frequent) + 1
    table = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches):
        pair, n, best = known.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy().astype(np.int64)
            want, rows = lists.flatten().to_numpy(), len(batch)
            owner = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
            place = np.minimum(np.searchsorted(pair, want), max(0, len(pair) - 1))
            hit = pair[place] == want if len(pair) else np.zeros(len(want), bool)
            place = place[hit]
            total, first = (_row_sums(times[hit] * x[place], owner[hit], rows) for x in (n, best))
            rest = ~hit
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first), pa.array(total), _lists(want[rest], owner[rest], rows), _lists(times[rest], owner[rest], rows)],
                names=["_row", "best", "total", "pairs", "times"])

    looked = stored(rows.select("_row", "pairs", "times").mapInArrow(
        look_up, "_row bigint, best bigint, total bigint, pairs array<bigint>, times array<bigint>"), "looked-up")
    rare = looked.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select("_row", "_p.pairs", "_p.times")
    rare = rare.join(counts.where(F.col("n") < least), F.col("pairs") == F.col("pair"))
    rare = rare.select("_row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("best"), (F.col("times") * F.col("n")).alias("total"))
    summed = looked.select("_row", "best", "total").union(rare).groupBy("_row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return rows.drop("pairs", "times").join(summed, "_row").select(
        F.col("_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
