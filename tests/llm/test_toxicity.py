import random
import re

import pytest
from pyspark.sql import functions as F

from trajmill.llm import toxicity as tx
from trajmill.llm.common import remainder

BAD = ["moron", "stupid", "loser", "clown"]
PLAIN = "the river ran over hills and under bridges while children sang songs about summer rain in the old town".split()


def corpus(n=400, seed=2):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [draw.choice(PLAIN) for _ in range(draw.choice([8, 30, 200]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, label int")
    return df, tx.fit(df, df)


def test_restores_disguises(fitted):
    decoder = tx.Decoder(fitted[1]["table"])
    for text, want in [
        ("you m0ron", "moron"), ("st00pid is stup1d", "stupid"), ("what a l0$er", "loser"), ("c l o w n here", "clown"), ("s.t.u.p.i.d", "stupid"),
        ("looooooser", "loser"), ("M-O-R-O-N!", "moron"), ("5tup1d", "stupid"), ("cl0wwwn", "clown"), ("m*ron", "moron"),
    ]:
        assert want in tx.restored_text(text, decoder), text
    for text in ["the old town", "see you at 10 or 12", "a b", "", "rain%%% songs*** hills!!"]:
        assert tx.restored_text(text, decoder) == text


def test_restores_spots_of_any_length(fitted):
    decoder, scorer = tx.Decoder(fitted[1]["table"]), tx.Scorer(fitted[1])
    phrase = "the river ran over the hills while you stupid clown sang"
    for text in (" ".join(phrase.replace(" ", "")), ".".join(phrase.replace(" ", "")), "_".join(phrase.replace(" ", "")), " ".join(phrase.replace(" ", "") * 20)):
        assert "stupid" in tx.restored_text(text, decoder) and scorer.score([text])[0] >= tx.LINE, text


def test_language_model_is_exact(spark, monkeypatch):
    monkeypatch.setattr(tx, "HELD", 1000)
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    texts = [" ".join("".join(draw.choice(letters) for _ in range(draw.choice([1, 4, 9]))) for _ in range(300)) for _ in range(60)] + [None, "", "1 2", "a, ab a"]
    want = {}
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", t or ""):
            padded = f" {word} "
            for n in range(1, tx.ORDER + 1):
                for i in range(max(n - 1, 1), len(padded)):
                    gram = padded[i - n + 1: i + 1]
                    want[gram] = want.get(gram, 0) + 1
    table = tx.language_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    decoder = tx.Decoder(table)
    assert len(table[0]) == len(want) and all(decoder._held(g) == n for g, n in want.items())
    unseen = ["".join(draw.choice(letters) for _ in range(5)) for _ in range(20_000)]
    assert not any(decoder._held(g) for g in unseen if g not in want)


def test_finds_every_spot_of_the_lattice(fitted):
    decoder, scorer = tx.Decoder(fitted[1]["table"]), tx.Scorer(fitted[1])
    for text, want in [("s t u p 1 d rain", "stupid"), ("the m 0 r 0 n sang", "moron"), ("5 7 u p 1 d", "stupid"),
                       ("you 5tup1d.", "stupid"), ("m0r0n55 m0r0n", "moron"), ("1o$3r", "loser"), ("a l05er's day", "loser")]:
        assert want in tx.restored_text(text, decoder), text
        assert (scorer.score([text])[0] >= tx.LINE) == (want in BAD), text
    for text in ("1 2 3 4 5", "5 * 3 + 2", "10537 at 10", "* + !"):
        assert tx.restored_text(text, decoder) == text
    # Words that end in two signs, and those with a single plain letter.
    spots = lambda t: [t[a - 1: b] for a, b in zip(*(x.tolist() for x in tx.disguised(tx._codes([t]))))]
    for text in ("sh17", "a55", "a$$", "5h17", "s h 1 t", "i d 1 o t"):
        assert spots(f"an {text} end") == [text], text


def test_single_plain_letter_is_scored(spark):
    rows = [(i, " ".join(PLAIN if i % 3 else [*PLAIN, "zonk"]), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = tx.fit(df, df)
    assert "zonk" in model["words"]
    assert (tx.Scorer(model).score(["a z0nk", "2onk here", "z 0 n k"]) >= tx.LINE).all()
    for word, text in (("as", "the a$ town"), ("us", "the u5 town")):
        scorer = tx.Scorer({**model, "words": [word], "weights": [-9.0]})
        scorer.decoder.restore = lambda unit, w=word: w  # the spot counts here, not how it is read
        assert scorer.score([text])[0] >= tx.LINE


def test_model_and_scores(spark, fitted):
    df, model = fitted
    assert set(BAD) <= set(model["words"]) <= set(BAD) | {"stupi*"}
    score = lambda *t: tx.Scorer(model).score(list(t))
    toxic = score("you are a moron", "such a L0SER today", "s t u p i d rain", "loooser", "the looser songs")
    assert (toxic >= tx.LINE).all()
    clean = score("the river ran over hills", None, "", "10 20 30", "x" * 300_000, "1a" * 50_000)
    assert (clean < tx.LINE).all()
    many = [t for _, t, _ in corpus(60, 9)]
    assert abs(tx.Scorer(model).score(many) - [score(t)[0] for t in many]).max() < 1e-12


def test_spots_do_not_join_neighbouring_texts(fitted):
    model = fitted[1]
    assert (tx.Scorer(model).score(["c l o", "w n"]) < tx.LINE).all()


def test_query_form_and_edge_rows(spark):
    rows = corpus(300, 4) + [(None, "you moron", None), (900, None, None), (901, "", None), (902, "you moron", None), (902, "you moron", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").withColumn("score", F.lit("x"))
    labels = df.select("doc_id", "label")
    out = tx.score_documents(df.drop("label"), labels, remainder("doc_id", 4) == 2).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    truth = {d: y for d, _, y in rows}
    held = [r for r in out if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held if truth[r.doc_id] is not None)
    assert [r.predicted for r in out if r.doc_id is None] == [1] and [r.predicted for r in out if r.doc_id == 902] == [1, 1]
    empty = spark.createDataFrame([], "doc_id bigint, text string, label int")
    assert tx.score_documents(empty, empty, remainder("doc_id", 4) == 2).collect() == []
