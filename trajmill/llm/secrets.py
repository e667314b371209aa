"""Secret scan: wide candidate patterns, then a random forest that removes false positives.

Features of a candidate: length, character classes and transitions, how its letter pairs follow those of the corpus, how much of it
dictionary words cover, what its path looks like and which words stand beside it. Dictionary and letter pairs are counted
over all documents in tables of fixed size; the forest is trained on a bounded sample of labelled findings.
"""

from __future__ import annotations

import re
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajmill.llm.common import bounded_sample, stored
from trajmill.llm.words import blocks, word_hashes

BITS = 20  # the dictionary is one table of 2**BITS word counts, whatever the corpus
SHARE = 2e-6  # of all words: the least frequency of a dictionary word
TRAIN_ROWS = 20_000  # labelled findings used for the forest
TREES, DEPTH, BINS = 25, 6, 24
LINE = 0.5
MASK = "[SECRET]"
SPAN = 4096  # characters whose dictionary words are looked up at once

# Formats of known issuers, words that name a secret, and words of examples and identifiers.
ISSUED = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
NAMES = "token secret password passwd pwd apikey api_key key auth credential credentials bearer private access"
HARMLESS = "example sample test dummy placeholder changeme your xxx todo sha commit hash uuid guid md5 checksum id phone card"

_BEGIN, _END = (re.compile(rf"-----{part} [A-Z ]*PRIVATE KEY-----") for part in ("BEGIN", "END"))
_ISSUED = re.compile(rf"\b(?:{ISSUED})")
# A value ends where the next parameter of a URL begins. Addresses are no values, but their parameters are, and after a colon NAME=VALUE is none.
_SET = re.compile(r"(?:=>?|:(?!//)>?(?![ \t]{0,3}[\"'`]?[A-Za-z_][\w.-]*=[^\s=]))[ \t]{0,3}[\"'`]?(?![A-Za-z][A-Za-z0-9+.-]*://)"
                  r"((?:(?!&[A-Za-z_][\w.-]*=)[^\s\"'`,;|<>]){8,})")
_BARE = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
_AFTER = re.compile(r"[A-Za-z0-9+/_=-]")  # what follows a sign that is no padding
SHORTEST_BARE = 16
_WORD = re.compile(r"[a-z0-9]+")
_NAMES, _HARMLESS = frozenset(NAMES.split()), frozenset(HARMLESS.split())
FEATURES = ("length", "switches", "pairs", "entropy", "covered", "digits", "upper", "hex", "named", "harmless", "assigned",
            "quoted", "issued", "path_depth", "path_harmless", "known_neighbours")


# -- corpus statistics -------------------------------------------------------------------------------

def _count(batches):
    words, pairs = np.zeros(1 << BITS, np.int64), np.zeros(1 << 16, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for first, end in blocks(texts):
            hashes, _ = word_hashes(texts[first:end])
            words += np.bincount((hashes >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
            raw = np.frombuffer(b" ".join((t or "").encode("utf-8", "replace").lower() for t in texts[first:end]), np.uint8).astype(np.int32)
            pairs += np.bincount(raw[:-1] * 256 + raw[1:], minlength=1 << 16)
    both = np.concatenate([words, pairs])
    hit = np.flatnonzero(both)
    for i in range(0, len(hit), 1 << 18):
        part = hit[i: i + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(both[part], pa.int64())], names=["slot", "n"])


def statistics(docs: DataFrame, text: str = "text") -> dict:
    """Word counts and letter-pair surprise over all rows."""
    counted = stored(docs.select(text).mapInArrow(_count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")), "words")
    a_word = F.col("slot") < (1 << BITS)
    least = max(3.0, (counted.where(a_word).agg(F.sum("n")).first()[0] or 0) * SHARE)
    rows = counted.where(~a_word | (F.col("n") >= least)).toPandas()  # at most 1 / SHARE words and 2**16 pairs
    both = np.zeros((1 << BITS) + (1 << 16))
    both[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    words, pairs = both[: 1 << BITS], both[1 << BITS:].reshape(256, 256)
    chance = (pairs + 0.1) / (pairs.sum(axis=1, keepdims=True) + 25.6)
    return {"dictionary": words >= least, "surprise": -np.log2(chance).astype(np.float32)}


def _in_dictionary(words: list[str], stats: dict) -> np.ndarray:
    if not words:
        return np.zeros(0, bool)
    hashes, at = word_hashes(words)
    out = np.zeros(len(words), bool)
    one = np.flatnonzero(np.diff(at) == 1)
    out[one] = stats["dictionary"][(hashes[at[one]] >> np.uint64(64 - BITS)).astype(np.int64)]
    return out


# -- candidates --------------------------------------------------------------------------------------

def _keys(text: str) -> list[tuple[int, int]]:
    """Key blocks, each from a first line to the next last line; a block that never closes is none, and ends the search."""
    found, at = [], 0
    while (first := _BEGIN.search(text, at)) and (last := _END.search(text, first.end())):
        at = last.end()
        found.append((first.start(), at))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of everything that might be a secret, in order and without overlaps; later patterns see what earlier ones left."""
    taken = _keys(text)
    for pattern in (_ISSUED, _SET, _BARE):
        found, at = [], 0
        for a, b in [*taken, (len(text), len(text))]:
            found += [m.span(pattern.groups) for m in pattern.finditer(text, at, a)]
            at = b
        if pattern is _BARE:
            found = [(a, b - len(text[a:b]) + len(text[a:b].rstrip("="))) if _AFTER.match(text, b) else (a, b) for a, b in found]
            found = [(a, b) for a, b in found if b - a >= SHORTEST_BARE and re.search(r"\d", text[a:b])]
        taken = sorted(taken + found)
    return taken


def _covered(low: str, stats: dict) -> np.ndarray:
    """Which characters of a value lie in a dictionary word of 4 to 12 letters."""
    covered = np.zeros(len(low), bool)
    for lo in range(0, len(low), SPAN):
        pieces = [(s, e) for s in range(lo, min(lo + SPAN, len(low))) for e in range(s + 4, min(len(low), s + 12) + 1) if low[s:e].isalpha()]
        for (s, e), known in zip(pieces, _in_dictionary([low[s:e] for s, e in pieces], stats)):
            covered[s:e] |= known
    return covered


def features(text: str, spans: list[tuple[int, int]], path: str, stats: dict) -> np.ndarray:
    rows = np.zeros((len(spans), len(FEATURES)))
    steps = _WORD.findall((path or "").lower())
    for i, (a, b) in enumerate(spans):
        value = text[a:b]
        low = value.lower()
        raw = np.frombuffer(low.encode("utf-8", "replace"), np.uint8).astype(np.int64)
        kind = np.array([1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 for c in value])
        share = np.unique(raw, return_counts=True)[1] / len(raw)
        covered = _covered(low, stats)
        before, after = text[max(0, a - 60): a], text[b: b + 60]
        beside = _WORD.findall(before.lower().replace("_", " "))[-3:]
        around = before.split()[-3:] + after.split()[:3]
        rows[i] = (
            len(value), (kind[1:] != kind[:-1]).mean() if len(kind) > 1 else 0.0,
            stats["surprise"][raw[:-1], raw[1:]].mean() if len(raw) > 1 else 0.0, -sum(p * log2(p) for p in share),
            covered.mean(), (kind == 3).mean(), (kind == 2).mean(), bool(re.fullmatch(r"[0-9a-fA-F]+", value)),
            bool(_NAMES.intersection(beside)), bool(_HARMLESS.intersection([*beside, *_WORD.findall(low.replace("_", " "))])),
            bool(re.search(r"[=:]>?\s*[\"'`]?$", before)), before[-1:] in ("\"", "'", "`"),
            bool(_ISSUED.match(value) or value.startswith("-----BEGIN ")), len(steps), bool(_HARMLESS.intersection(steps)),
            _in_dictionary(around, stats).mean() if around else 0.0)
    return rows


def weak_label(x: np.ndarray) -> int | None:
    """Label of a finding where its circumstances leave no doubt, else None: stands in for an auditor's labels."""
    f = dict(zip(FEATURES, x))
    if f["harmless"] or f["digits"] == 1.0 or (not f["assigned"] and f["covered"] > 0.5) or (not f["named"] and not f["issued"] and f["entropy"] < 3.0):
        return 0
    if f["issued"] or (f["assigned"] and f["named"] and f["length"] >= 20 and f["entropy"] >= 3.2 and f["covered"] < 0.4):
        return 1
    return None


# -- random forest -----------------------------------------------------------------------------------

class Forest:
    """Bagged trees over binned features with random feature subsets; trained on a bounded table, applied to batches."""

    def __init__(self, seed: int = 7):
        self.seed, self.trees, self.prior = seed, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        self.prior = float(y.mean()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return self
        draw = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))  # both classes count alike
        for _ in range(TREES):
            rows = draw.integers(0, len(y), len(y))
            tree: list = []
            self._grow(tree, binned[rows], y[rows], weight[rows], cuts, draw, 0)
            self.trees.append(np.array(tree))
        return self

    def _grow(self, tree, b, y, w, cuts, draw, depth) -> int:
        """Append (feature, cut, left, right, value) rows; returns the index of the subtree's root."""
        here, total, bad = len(tree), w.sum(), (w * y).sum()
        tree.append([-1, 0.0, 0, 0, (bad + 0.5) / (total + 1.0)])
        if depth == DEPTH or len(y) < 4 or bad in (0.0, total):
            return here
        best = (1e-9, None, None)
        for j in draw.choice(b.shape[1], max(1, round(b.shape[1] ** 0.5) + 1), replace=False):
            if not len(cuts[j]):
                continue
            n = np.cumsum(np.bincount(b[:, j], w, len(cuts[j]) + 1))[:-1]
            k = np.cumsum(np.bincount(b[:, j], w * y, len(cuts[j]) + 1))[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = k * (n - k) / n + (bad - k) * (total - n - bad + k) / (total - n)
            gain = np.where((n > 0) & (n < total), bad * (total - bad) / total - impurity, -1.0)
            at = int(np.nanargmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], j, at)
        if best[1] is None:
            return here
        left = b[:, best[1]] <= best[2]
        tree[here][:2] = [best[1], cuts[best[1]][best[2]]]
        tree[here][2] = self._grow(tree, b[left], y[left], w[left], cuts, draw, depth + 1)
        tree[here][3] = self._grow(tree, b[~left], y[~left], w[~left], cuts, draw, depth + 1)
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.full(len(x), self.prior)
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                inner = tree[at, 0] >= 0
                j = np.where(inner, tree[at, 0], 0).astype(int)
                down = np.where(x[np.arange(len(x)), j] <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(int)
                at = np.where(inner, down, at)
            total += tree[at, 4]
        return total / len(self.trees)


# -- operator ----------------------------------------------------------------------------------------

def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", findings: DataFrame | None = None,
          rows: int = TRAIN_ROWS) -> dict:
    """Statistics of all ``docs`` and a forest from at most ``rows`` labelled findings.

    ``findings`` holds (doc_id, start, label); without it the clear cases label themselves (``weak_label``).
    """
    stats = statistics(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(stats)

    def collect(frames):
        for frame in frames:
            out = []
            for doc, t, p in zip(frame["_id"], frame["_t"], frame["_p"]):
                spans = candidates(t or "")
                x = features(t or "", spans, p, shared.value)
                out += [(str(doc), a, row.tolist(), weak_label(row)) for (a, _), row in zip(spans, x)]
            yield pd.DataFrame(out, columns=["doc", "start", "x", "label"]).astype({"label": "Int32"})

    seen = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_t"), F.col(path).cast("string").alias("_p")).mapInPandas(
        collect, "doc string, start bigint, x array<double>, label int")
    if findings is not None:
        given = findings.select(F.col(doc_id).cast("string").alias("doc"), F.col("start").cast("bigint").alias("start"), F.col("label").cast("int").alias("label"))
        seen = seen.drop("label").join(given, ["doc", "start"])
    chosen = (seen.where("label is not null").withColumn("_k", F.concat_ws(":", "doc", F.col("start").cast("string"))))
    chosen = bounded_sample(chosen, "_k", rows).select("x", "label").toPandas()
    x = np.array(chosen["x"].tolist(), float).reshape(-1, len(FEATURES))
    return {"stats": stats, "forest": Forest().fit(x, chosen["label"].to_numpy(int))}


def _judge(text: str, path: str, model: dict) -> list[tuple[int, int, float]]:
    spans = candidates(text)
    if not spans:
        return []
    return [(a, b, float(s)) for (a, b), s in zip(spans, model["forest"].predict(features(text, spans, path, model["stats"])))]


def scan(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start, end (0-based code points), value_sha256, score, is_secret.

    Null and empty texts have no candidate; a null path counts as an empty one; repeated rows repeat their findings. The value itself
    is not given back, only its hash, so the report leaks nothing.
    """
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(frames):
        for frame in frames:
            out = [(doc, a, b, hashlib.sha256(t[a:b].encode("utf-8", "replace")).hexdigest(), s)
                   for doc, t, p in zip(frame["_id"], frame["_t"], frame["_p"]) if t for a, b, s in _judge(t, p, shared.value)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "value_sha256", "score"])

    kind = dict(docs.dtypes)[doc_id]
    return (docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.col(path).cast("string").alias("_p"))
            .mapInPandas(find, f"doc_id {kind}, start bigint, end bigint, value_sha256 string, score double")
            .withColumn("is_secret", F.col("score") >= LINE))


def redacted(docs: DataFrame, model: dict, text: str = "text", path: str = "source") -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced by MASK; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def mask(texts: pd.Series, paths: pd.Series) -> pd.Series:
        def one(t, p):
            if not t:
                return t
            parts, at = [], 0
            for a, b, s in _judge(t, p, shared.value):
                if s >= LINE:
                    parts += [t[at:a], MASK]
                    at = b
            return "".join([*parts, t[at:]])
        return pd.Series([one(t, p) for t, p in zip(texts, paths)], dtype=object)

    return docs.withColumn(text, mask(F.col(text), F.col(path).cast("string")))
