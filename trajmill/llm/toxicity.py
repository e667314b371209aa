"""Toxicity behind disguises: a noisy channel restores the text, then a lexicon model scores it.

Disguised spots (leetspeak, spaced or dotted letters, stretched letters) open a lattice of characters. Viterbi decoding, with a
beam over the last characters, finds the path that a character language model of the corpus and the channel's costs
favour together. Undisguised words have a lattice of one path and are taken as they are.

The language model counts letter n-grams of all documents; the lexicon and its weights are learned from a bounded sample
of labelled rows.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajmill.llm.common import bounded_sample, text_batches
from trajmill.llm.words import PIECE_BYTES, POWERS, blocks, mixed, pieces

ORDER = 5
HELD = 1 << 21  # n-grams that a counting task holds before it hands them on
BEAM = 8
REMEMBERED = 64  # characters of the longest spots whose restoration is kept for the next time
TRAIN_ROWS = 12_000  # labelled rows used to learn the lexicon, those with the smallest hash of their id
STEMS = (5, 6)  # lengths of word beginnings that may stand in the lexicon, written ``begin*``
LEXICON = 2_000  # entries at most
EVIDENCE = 20.0  # least likelihood ratio (G2) of a lexicon entry
PURITY, PURITY_STEM = 0.9, 0.97  # least share of toxic rows among those with a word, or with a beginning
LINE = 0.3

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "ilt", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
SEPARATORS = ".-_*·~"
_SIGNS = "".join(LEET) + SEPARATORS

_LETTER, _LEET, _SEPARATOR, _OTHER, _SPACE = 1, 2, 4, 8, 16
_MULTIPLIER, _MASK = 1000003, (1 << 64) - 1
_BETWEEN = "\n\x01\n"  # a token of no letter keeps spots from reaching into the next text
_LETTERS = re.compile(r"[^\W\d_]+")
_tables: dict = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of every code point; built once per process."""
    if not _tables:
        kind = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x30000):  # letters beyond the third plane are unassigned
            ch = chr(c)
            if ch.isalpha():
                kind[c] = _LETTER
            elif ch.isspace():
                kind[c] = _SPACE
        for ch in SEPARATORS:
            kind[ord(ch)] = _SEPARATOR
        for ch in LEET:
            kind[ord(ch)] = _LEET | (_SEPARATOR if ch in SEPARATORS else 0)
        _tables["kind"], _tables["value"] = kind, mixed(np.arange(1, 0x110001, dtype=np.uint64))
    return _tables["kind"], _tables["value"]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer(("\n" + _BETWEEN.join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


def _begins(texts: list[str]) -> np.ndarray:
    return np.concatenate([[1], 1 + np.cumsum([len(t) + len(_BETWEEN) for t in texts])])


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true values; the array is false at both ends."""
    return np.flatnonzero(~inside[:-1] & inside[1:]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:])


# -- character language model ------------------------------------------------------------------------

def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the letter n-grams; every distinct word is taken apart once."""
    kind, value = _classes()
    code = _codes(texts)
    first, last = _runs(kind[code] == _LETTER)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, at, times = np.unique(Scorer._hash_runs(code, value, first, last), return_index=True, return_counts=True)
    size = last[at] - first[at] + 3  # with the edges before and after
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(size.sum()) - np.repeat(begin, size)  # in the word, 0 is the edge before it
    plain = code[np.repeat(first[at] - 1, size) + place].astype(np.uint64)
    plain[begin] = plain[begin + size - 1] = 32
    weight = np.repeat(times, size)
    key, keys, counts = np.zeros(len(plain), np.uint64), [], []
    for n in range(1, ORDER + 1):
        key = key.copy()
        key[n - 1:] += plain[: len(plain) - n + 1] * np.uint64(pow(_MULTIPLIER, n - 1, 1 << 64))
        chosen = place >= max(n - 1, 1)
        keys.append(key[chosen])
        counts.append(weight[chosen])
    return _summed(keys, counts)


def _count(batches):
    """Per task: (gram, n) of the letter n-grams up to ORDER that begin at a word's edge or inside it."""
    keys, counts, held = [], [], 0

    def handed_on():
        key, count = _summed(keys, counts)
        for i in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(key[i: i + (1 << 18)].view(np.int64)), pa.array(count[i: i + (1 << 18)], pa.int64())], names=["gram", "n"])

    for batch in batches:
        for _, _, texts in pieces(batch.column(0), 1 << 19):
            key, count = _grams([(t or "").lower() for t in texts])
            keys, counts, held = [*keys, key], [*counts, count], held + len(key)
            if held > HELD:
                key, count = _summed(keys, counts)
                keys, counts, held = [key], [count], len(key)
                if held > HELD // 2:
                    yield from handed_on()
                    keys, counts, held = [], [], 0
    if held:
        yield from handed_on()


def language_model(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Letter n-grams over all rows: their 64-bit keys in order, and how often each occurs.

    Every distinct n-gram has an entry of its own, so the arrays (12 bytes an entry) grow with the n-grams of the corpus
    and an n-gram that never occurs has none.
    """
    rows = docs.select(text).mapInArrow(_count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(np.float32)
    order = np.argsort(key)
    return key[order], n[order]


class Decoder:
    """Viterbi decoding of disguised spots under the language model."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.keys, self.counts = table
        self.most = float(self.counts.max()) if len(self.counts) else 0.0
        self.known, self.seen = {}, {}

    def _held(self, gram: str) -> float:
        key = 0
        for ch in gram:
            key = (key * _MULTIPLIER + ord(ch)) & _MASK
        at = int(self.keys.searchsorted(np.uint64(key)))
        return float(self.counts[at]) if at < len(self.keys) and int(self.keys[at]) == key else 0.0

    def step(self, past: str, ch: str) -> float:
        """Log-probability of ``ch`` after ``past``, with a fixed fine for every shorter history."""
        gram = (past + ch)[-ORDER:]
        if gram in self.known:
            return self.known[gram]
        fine, g = 0.0, gram
        while True:
            n = self._held(g)
            if n > 0 or len(g) == 1:
                whole = self._held(g[:-1]) if len(g) > 1 else self.most
                value = log(max(n, 0.1) / max(whole, n, 1.0)) - fine
                break
            g, fine = g[1:], fine + 1.5
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[gram] = value
        return value

    def restore(self, unit: str) -> str:
        """The likeliest plain text of a disguised spot of any length; a plain word keeps the signs around it."""
        whole, unit = unit, re.sub(r"(.)\1{2,}", r"\1\1\1", unit)
        found = self.seen.get(unit)
        if found is None:
            found = self._search(unit)
            if len(unit) <= REMEMBERED:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen[unit] = found
        return whole if found.strip() == whole.strip(_SIGNS) else found

    def _search(self, unit: str) -> str:
        paths = {" ": (0.0, None)}  # last characters -> (score, what was put last and the same before it)
        i = 0
        while i < len(unit):
            ch, run = unit[i], 1
            while i + run < len(unit) and unit[i + run] == ch:
                run += 1
            options = []  # (what it stands for, cost)
            if ch.isalpha():
                options = [(ch, 0.0 if run == 1 else 0.4)] + ([(ch * 2, 0.0 if run == 2 else 0.6)] if run > 1 else [])
            else:
                for other in LEET.get(ch, ""):
                    options.append((other, 0.4 if run == 1 else 0.8))
                    if run == 2:
                        options.append((other * 2, 0.8))
                if ch in SEPARATORS or ch == " ":
                    options += [("", 0.2), (" ", 1.2)]
                else:
                    options += [("", 2.5), (" ", 3.0)]
            ahead: dict = {}
            for past, (score, back) in paths.items():
                for put, cost in options:
                    total, now = score - cost, past
                    for c in put:
                        if c == " " and now[-1] == " ":
                            continue
                        total += self.step(now, c)
                        now = (now + c)[-(ORDER - 1):] if c != " " else " "
                    if now not in ahead or ahead[now][0] < total:
                        ahead[now] = (total, (back, put) if put else back)
            paths = dict(sorted(ahead.items(), key=lambda x: (-x[1][0], x[0]))[:BEAM])
            i += run
        return max((score + (0.0 if past == " " else self.step(past, " ")), self._spelled(back)) for past, (score, back) in paths.items())[1]

    @staticmethod
    def _spelled(back) -> str:
        puts = []
        while back:
            back, put = back
            puts.append(put)
        return "".join(reversed(puts))


# -- disguised spots ---------------------------------------------------------------------------------

def disguised(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the spots whose lattice has more than one path."""
    kind, _ = _classes()
    cls = kind[code]
    letter, leet, space = cls == _LETTER, (cls & _LEET) > 0, cls == _SPACE
    sep = (cls & _SEPARATOR) > 0
    mark = np.zeros(len(code), bool)
    mark[1:-1] |= letter[1:-1] & (code[:-2] == code[1:-1]) & (code[2:] == code[1:-1])  # a stretched letter
    if len(code) > 4:
        mark[:-4] |= letter[:-4] & sep[1:-3] & letter[2:-2] & sep[3:-1] & letter[4:]  # dotted letters
    first, last = _runs(~space)
    if not len(first):
        return first, last
    holds = lambda what: np.add.reduceat(what, first, dtype=np.int64) > 0
    hot = holds(mark) | (holds(letter) & holds(leet))
    single = (first == last) & (letter | leet)[first]
    spaced = np.concatenate([[False], single, [False]])
    begin, end = _runs(spaced)
    begin, end = begin - 1, end - 1
    letters = np.concatenate([[0], np.cumsum(letter[first])])
    long = (end - begin >= 2) & (letters[end + 1] > letters[begin])  # letters or signs one by one, not signs alone
    begin, end = begin[long], end[long]
    return np.concatenate([first[hot], first[begin]]), np.concatenate([last[hot], last[end]])


def restored_text(text: str, decoder: Decoder) -> str:
    """Lower-cased text with its disguised spots replaced by what they stand for."""
    text = text.lower()
    first, last = disguised(_codes([text]))
    out, at = [], 0
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if a - 1 < at:
            continue
        out += [text[at: a - 1], decoder.restore(re.sub(r"\s+", " ", text[a - 1: b]))]
        at = b
    return "".join([*out, text[at:]])


def entries(words) -> set[str]:
    """Words and the beginnings of longer words."""
    words = set(words)
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


# -- lexicon model -----------------------------------------------------------------------------------

class Scorer:
    """Scores batches of texts; equal for any batch size."""

    def __init__(self, model: dict):
        self.decoder = Decoder(model["table"])
        self.words = {w: i for i, w in enumerate(model["words"])}
        self.weights, self.bias = np.array(model["weights"], float), model["bias"]
        _, value = _classes()
        hashes = lambda words: self._hash_words(list(words), value)
        whole = [w for w in self.words if not w.endswith("*")]
        # By length of the beginning (None: whole words): sorted hashes and the entries they stand for.
        self.tables = {}
        for k in (None, *STEMS):
            chosen = whole if k is None else [w for w in self.words if w.endswith("*") and len(w) == k + 1]
            if chosen:
                hashed = hashes([w.rstrip("*") for w in chosen])
                order = np.argsort(hashed)
                self.tables[k] = hashed[order], np.array([self.words[chosen[i]] for i in order])
        self.squeezed = np.unique(hashes({re.sub(r"(.)\1+", r"\1", w) for w in whole}))

    @staticmethod
    def _hash_words(words: list[str], value: np.ndarray) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        return Scorer._hash_runs(_codes(words), value, *_runs(_codes(words) > 10))

    @staticmethod
    def _hash_runs(code, value, first, last) -> np.ndarray:
        up, down = POWERS.upto(len(code))
        total = np.cumsum(value[code] * up)
        return mixed((total[last] - total[first - 1]) * down[first])

    def found(self, texts: list[str]) -> list[set]:
        """Indexes of the lexicon words in each restored text."""
        kind, value = _classes()
        out = [set() for _ in texts]
        if not self.words:
            return out
        texts = [t.lower() for t in texts]
        code = _codes(texts)
        begin = _begins(texts)
        owner = lambda at: np.searchsorted(begin, at, "right") - 1
        first, last = _runs(kind[code] == _LETTER)
        if len(first):
            up, down = POWERS.upto(len(code))
            total = np.cumsum(value[code] * up)
            for k, (known, index) in self.tables.items():
                a, b = (first, last) if k is None else (first[last - first >= k], first[last - first >= k] + k - 1)
                hashes = mixed((total[b] - total[a - 1]) * down[a])
                slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[slot] == hashes)
                for doc, word in zip(owner(a[hit]), index[slot[hit]]):
                    out[doc].add(int(word))
            # Doubled letters: only runs that squeeze to a squeezed lexicon word can be one.
            fresh = np.ones(len(code), bool)
            fresh[1:] = (code[1:] != code[:-1]) | (kind[code[1:]] != _LETTER)
            if not fresh.all():
                thin = code[fresh]
                a, b = _runs(kind[thin] == _LETTER)
                doubled = np.flatnonzero(np.isin(self._hash_runs(thin, value, a, b), self.squeezed) & (b - a != last - first))
                for doc, i in zip(owner(first[doubled]), doubled):
                    self._look(out[doc], texts[doc][first[i] - begin[doc]: last[i] + 1 - begin[doc]])
        first, last = disguised(code)
        for doc, a, b in zip(owner(first), first, last):
            self._look(out[doc], re.sub(r"\s+", " ", texts[doc][a - begin[doc]: b + 1 - begin[doc]]))
        return out

    def _look(self, found: set, unit: str) -> None:
        found.update(self.words[w] for w in entries(_LETTERS.findall(self.decoder.restore(unit))) if w in self.words)

    def score(self, texts: list) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, end in blocks(texts, PIECE_BYTES):
            for i, words in enumerate(self.found([t or "" for t in texts[first:end]])):
                out[first + i] = self.bias + self.weights[sorted(words)].sum()
        return 1.0 - np.exp(out)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label",
        rows: int = TRAIN_ROWS) -> dict:
    """Language model over all ``docs``; lexicon and weights from at most ``rows`` labelled rows (doc_id, label 0/1)."""
    spark = docs.sparkSession
    text_batches(spark)
    table = language_model(docs, text)
    chosen = bounded_sample(labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
                            .where("_id is not null and _y is not null"), "_id", rows)
    shared = spark.sparkContext.broadcast(table)

    def words(frames):
        decoder = Decoder(shared.value)
        for frame in frames:
            yield pd.DataFrame({"y": frame["_y"], "words": [
                sorted(entries(_LETTERS.findall(restored_text(t or "", decoder)))) for t in frame["_t"]]})

    seen = (docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")  # at most ``rows``
            .select("_y", "_t").mapInPandas(words, "y int, words array<string>").persist())
    total = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = total.get(0, 0), total.get(1, 0)
    model = {"table": table, "words": [], "weights": [], "bias": 0.0}
    if bad:
        lift = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("t") + F.col("f")) * of / (good + bad)))).otherwise(0.0)
        lexicon = (seen.select("y", F.explode("words").alias("w")).groupBy("w")
                   .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("f"))
                   .where((F.col("t") >= F.when(F.col("w").endswith("*"), PURITY_STEM).otherwise(PURITY) * (F.col("t") + F.col("f"))) & (F.col("t") * (good + bad) > (F.col("t") + F.col("f")) * bad))
                   .withColumn("g", 2 * (lift("t", bad) + lift("f", good)))
                   .where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "w").limit(LEXICON))
        found = lexicon.collect()  # at most LEXICON
        model["words"] = [r["w"] for r in found]
        index = F.array(*map(F.lit, model["words"])) if model["words"] else F.array().cast("array<string>")
        plain = seen.where(F.size(F.array_intersect("words", index)) == 0).agg(F.sum("y").alias("t"), F.count("y").alias("n")).first()
        # Noisy or: an entry makes a text toxic with its share of toxic rows, shrunk towards that of rows without an entry.
        base = ((plain["t"] or 0) + bad / (good + bad)) / (plain["n"] + 1.0)
        model["bias"] = log(1 - min(base, 0.25))
        model["weights"] = [log(1 - min((r["t"] + base) / (r["t"] + r["f"] + 1.0), 1 - 1e-9)) for r in found]
    seen.unpersist()
    return model


def score_column(spark, model: dict, text: str = "text"):
    """A column of scores in 0..1 for any DataFrame with the column ``text``."""
    shared = spark.sparkContext.broadcast(model)
    text_batches(spark)

    @F.arrow_udf("double")
    def score(column: "pa.Array") -> "pa.Array":
        here = shared.value  # the scorer stays with the broadcast value: a worker drops both when its next work does not need them
        if "scorer" not in here:
            here["scorer"] = Scorer(here)
        return pa.array(np.concatenate([np.zeros(0), *(here["scorer"].score(texts) for _, _, texts in pieces(column))]))

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, fold, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``labels`` holds (doc_id, label) and ``fold`` is a boolean column over a doc_id that is true for held-out rows; these are
    never learned from. Null and empty texts score like texts without a lexicon word. Rows without doc_id are scored and
    count as not held out; without any positive label every score is 0. Repeated rows repeat in the result, other columns are ignored.
    """
    model = fit(docs, labels.where(~fold), doc_id, text)
    return docs.select(F.col(doc_id), F.coalesce(fold, F.lit(False)).alias("held_out"),
                       score_column(docs.sparkSession, model, text).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= LINE, 1).otherwise(0))
