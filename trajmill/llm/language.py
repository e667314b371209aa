"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes one blank; n-grams of 1 to 4 characters fall into a table of fixed
size. The matrix of log-probabilities (buckets x languages) is broadcast, and each batch is scored by summing the
rows of the n-grams that occur, without a dense vector per text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trajmill.llm.common import bounded_sample
from trajmill.llm.words import blocks, mixed

BITS = 14
SIZES = (1, 2, 3, 4)
TRAIN_ROWS = 20_000  # labelled rows learned from, those with the smallest hash of their id
LANGUAGES = 256  # the matrix has at most so many columns: the languages with the most labelled rows
SMOOTHING = 0.5
NONE = "und"
_tables: dict = {}


def _letters() -> np.ndarray:
    if not _tables:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _tables["letters"] = table
    return _tables["letters"]


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts and the text each belongs to; n-grams of blanks only are left out."""
    lower = [(t or "").lower() for t in texts]
    if not lower:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    code = np.frombuffer((" " + "  ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower)), [len(t) + 2 for t in lower])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters only the first stays
    keep[np.concatenate([[0], np.cumsum([len(t) + 2 for t in lower])[:-1]]).astype(int)] = True  # the blank before a text
    code, owner, letter = np.where(letter, code, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    buckets, owners = [], []
    key, some = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
    for size in SIZES:
        if len(code) < size:
            break
        key = (key[: len(code) - size + 1] * np.uint64(0x100000001B3)) ^ mixed(code[size - 1:] + np.uint64(size << 32))
        some = some[: len(code) - size + 1] | letter[size - 1:]
        chosen = some & (owner[: len(code) - size + 1] == owner[size - 1:])
        buckets.append((key[chosen] >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(owner[: len(code) - size + 1][chosen])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def _count(batches):
    tables: dict = {}
    for batch in batches:
        texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, end in blocks(texts):
            bucket, owner = grams(texts[first:end])
            edge = np.searchsorted(owner, np.arange(end - first + 1))
            for i, name in enumerate(names[first:end]):
                table = tables.setdefault(name, np.zeros(1 << BITS, np.int64))
                np.add.at(table, bucket[edge[i]: edge[i + 1]], 1)
    for name, table in tables.items():
        hit = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(hit), pa.string()), pa.array(hit, pa.int64()), pa.array(table[hit], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, labelled: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> dict:
    """Model from at most ``rows`` rows for which ``labelled`` holds and ``lang`` is not null.

    A language's prior is its share of these rows. Of more than LANGUAGES languages those with most rows are kept.
    """
    have = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).isNotNull())
    chosen = bounded_sample(have.select(F.col(doc_id).alias("_id")).where("_id is not null"), "_id", rows)
    picked = have.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_l")).join(F.broadcast(chosen.distinct()), "_id")
    priors = picked.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(LANGUAGES).collect()
    names = sorted(r["_l"] for r in priors)
    if not names:
        return {"names": [], "matrix": np.zeros((1 << BITS, 0), np.float32), "prior": np.zeros(0)}
    table = np.zeros((1 << BITS, len(names)))
    counted = picked.select("_t", "_l").mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = counted.toPandas()  # at most languages * 2**BITS rows
    counted = counted[counted["lang"].isin(names)]
    table[counted["bucket"].to_numpy(int), counted["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int)] = counted["n"].to_numpy(float)
    share = (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (1 << BITS))
    by = {r["_l"]: r["count"] for r in priors}
    prior = np.array([by[n] for n in names], float)
    return {"names": names, "matrix": np.log(share).astype(np.float32), "prior": np.log(prior / prior.sum())}


def predict(texts: list, model: dict) -> pd.DataFrame:
    """lang_pred and score (posterior of that language) of each text; ``und`` and 0 without a letter or without a model."""
    names, scores = [NONE] * len(texts), np.zeros(len(texts))
    if model["names"]:
        for first, end in blocks(texts, 1 << 18):
            bucket, owner = grams(texts[first:end])
            if not len(bucket):
                continue
            edge = np.searchsorted(owner, np.arange(end - first + 1))
            full = np.flatnonzero(edge[1:] > edge[:-1])
            total = np.stack([np.add.reduceat(model["matrix"][:, j][bucket].astype(np.float64), edge[:-1][full])
                              for j in range(len(model["names"]))], axis=1) + model["prior"]
            total -= total.max(axis=1, keepdims=True)
            chance = np.exp(total)
            best = total.argmax(axis=1)
            scores[first + full] = 1.0 / chance.sum(axis=1)
            for i, b in zip(full, best):
                names[first + i] = model["names"][b]
    return pd.DataFrame({"lang_pred": names, "score": scores})


def identify(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Rows with ``held_out`` are never learned from. A null text or one without a letter is ``und`` with score 0, and so is all if no
    labelled row exists. Ties go to the first language by name. Repeated rows repeat; rows without doc_id are judged but not learned
    from and count as not held out; other columns are ignored.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out, doc_id, text, lang, rows))

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return predict(texts.tolist(), shared.value)

    return (docs.select(F.col(doc_id), held_out.alias("held_out"), judge(F.col(text)).alias("_p"))
            .select(doc_id, "held_out", "_p.lang_pred", "_p.score"))
