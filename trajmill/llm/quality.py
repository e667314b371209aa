"""Quality by attention-based multiple-instance learning (after Ilse, Tomczak and Welling, 2018).

A document is a bag of passages. Every passage is encoded from measures of its characters and words; a gated attention
learns from document labels which passages matter, and the document's score comes from the attention-weighted sum of
its passages. Whole texts are read, in passages of a fixed number of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.llm.common import bounded_sample
from trajmill.llm.words import blocks, word_hashes

PASSAGE_WORDS = 100
TRAIN_ROWS = 6_000  # labelled documents learned from, those with the smallest hash of their id
TRAIN_PASSAGES = 60_000  # of these, whole documents in that order up to so many passages
HIDDEN, ATTENTION, STEPS, RATE = 16, 8, 400, 0.03
LINE = 0.3
MEASURES = ("letters", "upper", "digits", "marks", "breaks", "word_length", "word_spread", "repeated", "repeated_pairs", "long_words",
            "same_mark_twice", "sentence_ends", "words")

_UPPER, _LETTER, _DIGIT, _MARK, _BREAK, _END = 1, 2, 4, 8, 16, 32
_tables: dict = {}


def _classes() -> np.ndarray:
    if not _tables:
        table = np.full(0x110000, _MARK, np.uint8)
        for c in range(0x30000):  # no letters beyond the third plane
            ch = chr(c)
            table[c] = (_LETTER | (_UPPER if ch.isupper() else 0) if ch.isalpha() else _DIGIT if ch.isdigit()
                        else (_BREAK if ch == "\n" else 0) if ch.isspace() else _MARK | (_END if ch in ".!?" else 0))
        _tables["kind"] = table
    return _tables["kind"]


def passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of every text, and each text's first passage (and the end). Every text has at least one."""
    texts = [t or "" for t in texts]
    code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    begin = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])])
    # Words end at ASCII space, as in word_hashes, so that both count alike.
    space = (code == 32) | ((code >= 9) & (code <= 13))
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:])
    at = np.searchsorted(first, begin)
    hashes, _ = word_hashes(texts)
    count = np.diff(at)
    bags = np.maximum(1, -(-count // PASSAGE_WORDS))
    edge = np.concatenate([[0], np.cumsum(bags)])
    text_of = np.repeat(np.arange(len(texts)), bags)
    nth = np.arange(edge[-1]) - edge[:-1][text_of]
    w0 = at[:-1][text_of] + nth * PASSAGE_WORDS
    w1 = np.minimum(w0 + PASSAGE_WORDS, at[1:][text_of])
    c0 = np.where(nth == 0, begin[text_of], first[np.minimum(w0, max(len(first) - 1, 0))] if len(first) else 1)
    c1 = np.append(c0[1:], len(code))
    is_last = np.append(text_of[1:] != text_of[:-1], True)
    c1 = np.where(is_last, begin[text_of + 1] - 1, c1)

    def chars(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[c1] - total[c0]) / np.maximum(c1 - c0, 1)

    n = np.maximum(w1 - w0, 1)

    def words(value: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(value)])
        return (total[w1] - total[w0]) / n

    size = np.minimum(last - first + 1, 200).astype(float)
    owner = np.repeat(np.arange(edge[-1]), w1 - w0)

    def repeats(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, owner))
        v, o = value[order], owner[order]
        again = np.zeros(len(value))
        again[1:] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
        return np.bincount(o, again, edge[-1]) / n

    pair = hashes.copy()
    pair[:-1] ^= hashes[1:] * np.uint64(0x9E3779B97F4A7C15)
    end = w1[w1 > w0] - 1  # the last word of a passage has no pair in it: a value of its own
    pair[end] = end.astype(np.uint64)
    letter, mark = (kind & _LETTER) > 0, (kind & _MARK) > 0
    twice = np.zeros(len(code), bool)
    twice[1:] = mark[1:] & (code[1:] == code[:-1])
    mean = words(size)
    upper = chars((kind & _UPPER) > 0)
    share = chars(letter)
    table = np.stack([
        share, upper / np.maximum(share, 1e-3), chars((kind & _DIGIT) > 0), chars(mark), chars((kind & _BREAK) > 0), mean / 10,
        np.sqrt(np.maximum(words(size * size) - mean * mean, 0)) / 10, repeats(hashes), repeats(pair), words(size > 20), chars(twice),
        chars((kind & _END) > 0), np.log1p(w1 - w0) / 5], axis=1)
    return table.astype(np.float32), edge


class Attention:
    """The network: encode, gated attention, weighted sum, logistic output. Trained by Adam on whole bags."""

    NAMES = ("encode", "encode_b", "tanh", "tanh_b", "gate", "gate_b", "weigh", "out", "out_b")

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        scale = lambda *shape: draw.normal(0, shape[0] ** -0.5, shape)
        m = len(MEASURES)
        self.p = dict(zip(self.NAMES, (scale(m, HIDDEN), np.zeros(HIDDEN), scale(HIDDEN, ATTENTION), np.zeros(ATTENTION), scale(HIDDEN, ATTENTION),
                                       np.zeros(ATTENTION), scale(ATTENTION), scale(HIDDEN), np.zeros(1))))
        self.mean, self.spread, self.prior, self.fitted = np.zeros(m), np.ones(m), 0.5, False

    def _forward(self, x: np.ndarray, edge: np.ndarray):
        p, bag = self.p, np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["encode"] + p["encode_b"])
        t, g = np.tanh(h @ p["tanh"] + p["tanh_b"]), 1 / (1 + np.exp(-(h @ p["gate"] + p["gate_b"])))
        e = (t * g) @ p["weigh"]
        e = np.exp(e - np.maximum.reduceat(e, edge[:-1])[bag])
        a = e / np.add.reduceat(e, edge[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, edge[:-1])
        y = 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["out_b"][0], -30, 30)))
        return bag, x, h, t, g, a, z, y

    def fit(self, x: np.ndarray, edge: np.ndarray, label: np.ndarray) -> "Attention":
        self.prior = float(label.mean()) if len(label) else 0.5
        if len(set(label.tolist())) < 2:
            return self
        self.fitted = True
        self.mean, self.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        p, first, second = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            bag, z_in, h, t, g, a, z, y = self._forward(x, edge)
            dy = (y - label) / len(label)
            dz = dy[:, None] * p["out"]
            da = (dz[bag] * h).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, edge[:-1])[bag])
            dt, dg = de[:, None] * p["weigh"] * g * (1 - t * t), de[:, None] * p["weigh"] * t * g * (1 - g)
            dh = (a[:, None] * dz[bag] + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - h * h)
            slope = dict(zip(self.NAMES, (z_in.T @ dh, dh.sum(axis=0), h.T @ dt, dt.sum(axis=0), h.T @ dg, dg.sum(axis=0), (t * g).T @ de, z.T @ dy, dy.sum(keepdims=True))))
            for k in self.NAMES:
                d = slope[k] + (1e-4 * p[k] if not k.endswith("_b") else 0)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.fitted:
            for first, end in blocks(texts):
                x, edge = passages(texts[first:end])
                out[first:end] = self._forward(x, edge)[-1]
        return out


def _measure(batches):
    for batch in batches:
        ids, labels, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for first, end in blocks(texts):
            x, edge = passages(texts[first:end])
            offsets = pa.array((edge * len(MEASURES)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, end - first), labels.slice(first, end - first), pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float32()))],
                names=["id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label",
        rows: int = TRAIN_ROWS, most: int = TRAIN_PASSAGES) -> Attention:
    """Network from at most ``rows`` labelled documents (doc_id, label 0/1) with ``most`` passages together."""
    kind = dict(docs.dtypes)[doc_id]
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    chosen = bounded_sample(named, "_id", rows)
    seen = (docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_t")
            .mapInArrow(_measure, f"id {kind}, y int, x array<float>"))
    seen = seen.withColumn("_n", F.size("x") / len(MEASURES)).withColumn("_k", F.xxhash64(F.lit(17), "id"))
    # The sample is small (at most ``rows`` rows of measures); a document too long for what is left is passed over.
    seen = seen.where(F.col("_n") <= most / 20)
    bags = seen.select("_k", "id", "y", "x", "_n").orderBy("_k", "id").toPandas()
    bags = bags[bags["_n"].cumsum() <= most]
    x = [np.asarray(b, np.float32).reshape(-1, len(MEASURES)) for b in bags["x"]]
    edge = np.concatenate([[0], np.cumsum([len(b) for b in x])]).astype(int)
    return Attention().fit(np.concatenate(x) if x else np.zeros((0, len(MEASURES))), edge, bags["y"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, fold: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``labels`` holds (doc_id, label); rows for which ``fold`` holds are never learned from. Null and empty texts are one passage without words
    and get that passage's score. Without labels of both kinds every score is the share of label 1 (0.5 without any).
    Rows without doc_id are scored and count as not held out; repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(~fold), doc_id, text))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.select(F.col(doc_id), F.coalesce(fold, F.lit(False)).alias("held_out"), score(F.col(text)).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= LINE, 1).otherwise(0))
