import random

import numpy as np
from pyspark.sql import functions as F

from trajmill.llm import language, quality, secrets
from trajmill.llm.common import remainder

SF = "/root/testdata/sf0.01"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- language ----------------------------------------------------------------------------------------

def test_grams_do_not_depend_on_neighbours():
    texts = ["Hello, World", None, "", "12 !", "été", "a", "x y"]
    bucket, owner = language.grams(texts)
    for i, t in enumerate(texts):
        alone, _ = language.grams([t])
        assert sorted(bucket[owner == i].tolist()) == sorted(alone.tolist()), t
    assert not len(language.grams(["12 !"])[0]) and not len(language.grams([])[0])


def test_letters_of_all_planes_are_letters():
    for text in ("\U00030000\U00030001", "\U0002a6d6", "ж"):
        assert text.isalpha() and len(language.grams([text])[0])


def test_held_out_accuracy(spark):
    docs = docs_of(spark)
    out = language.identify(docs, remainder("doc_id", 3) == 1).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    got = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert got.n > 250 and got.a > 0.97 and 0 <= got.lo and got.hi <= 1


def test_language_edge_rows(spark):
    rows = [(i, ["the cat sat on the mat", "der hund und die katze"][i % 2], ["en", "de"][i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 3!", "de"), (103, "the mat", None), (None, "die katze", None), (103, "the mat", None), (104, "the " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(df, remainder("doc_id", 3) == 1).collect()]
    assert len(got) == len(rows)
    by = {d: (p, s) for d, p, s in got}
    assert by[100] == by[101] == by[102] == ("und", 0.0) and by[103][0] == "en" and by[None][0] == "de" and by[104][0] == "en"
    assert language.identify(df.limit(0), F.lit(False)).collect() == []
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


# -- quality -----------------------------------------------------------------------------------------

def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_passages_do_not_depend_on_neighbours():
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["a", "Bc!", "%%", "x1", "ß\n"]) for _ in range(n)) for n in (0, 1, 99, 100, 101, 350)] + [None, "  "]
    x, edge = quality.passages(texts)
    for i, t in enumerate(texts):
        alone, bags = quality.passages([t])
        assert np.allclose(alone, x[edge[i]: edge[i + 1]], atol=1e-5), i
    assert np.diff(edge).tolist() == [1, 1, 1, 1, 2, 4, 1, 1]


def test_quality_held_out(spark):
    docs, labels = docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label")
    out = quality.score_documents(docs, labels, remainder("doc_id", 5) == 0)
    got = out.join(labels, "doc_id").where("held_out").toPandas()
    assert out.count() == docs.count() and len(got) > 50
    assert auc(got["score"].to_numpy(), got["label"].to_numpy()) > 0.85


def test_quality_edge_rows(spark):
    rows = [(i, "good plain words here " * 9 if i % 2 else "BAD!! ### %%% " * 9, i % 2) for i in range(80)] + [
        (None, "good plain words", 1), (200, None, None), (201, "", None), (202, "word " * 60_000, None), (202, "word " * 60_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").withColumn("held_out", F.lit(3))
    out = quality.score_documents(df.drop("label"), df.select("doc_id", "label"), remainder("doc_id", 5) == 0).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 80)
    none = quality.score_documents(df, df.select("doc_id", "label").limit(0), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_documents(df.limit(0), df.select("doc_id", "label"), F.lit(False)).collect() == []


# -- secrets -----------------------------------------------------------------------------------------

def findings_corpus():
    draw = random.Random(6)
    hexed = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    rows, truth = [], {}
    for i in range(240):
        prose = " ".join(draw.choice("some plain words stand here beside longer ones again".split()) for _ in range(30))
        value = hexed(40)
        spot, secret = [
            (f'token = "{value}"', True), (f"commit {value}", False), (f'password: "{draw.choice("QWERTZ")}{hexed(30)}"', True), ("card 4929348385146306", False),
            (f"sha = {value}", False), ('api_key = "your_example_key_goes_here_0"', False)][i % 6]
        rows.append((i, f"{prose} {spot} {prose}", "src"))
        truth[i] = secret
    return rows, truth


def test_secrets_found_and_masked(spark):
    rows, truth = findings_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    model = secrets.train(df)
    out = secrets.scan(df, model).collect()
    flagged = {r.doc_id for r in out if r.is_secret}
    assert flagged == {d for d, s in truth.items() if s}
    texts = {d: t for d, t, _ in rows}
    import hashlib
    assert all(hashlib.sha256(texts[r.doc_id][r.start:r.end].encode()).hexdigest() == r.value_sha256 for r in out)
    masked = {r.doc_id: r.text for r in secrets.redacted(df, model).collect()}
    assert all((secrets.MASK in masked[d]) == s and (masked[d] == texts[d]) != s for d, s in truth.items())


def test_candidates_inside_longer_runs():
    hexed, issued = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8
    github = "ghp_" + "a1B2" * 6
    for text, want in [
        (f"token={hexed}", [hexed]), (f"DB_PASSWORD_PRIMARY={hexed} x", [hexed]), (f"GH={github}", [github]), (f"export KEY={hexed};", [hexed]),
        (f"https://a.io/v1?access={issued}", [issued]), (f"https://a.io/v1?token={hexed}&user=bob", [hexed]), (f"url=https://a.io/v1?a=b&token={hexed}", [hexed]),
        (f"env: TOKEN={hexed}", [hexed]), (f"{hexed}/{issued}", [f"{hexed}/", issued]), (f'"token":"{hexed}"', [hexed]),
        (f"see {hexed}== here", [f"{hexed}=="]), (f"a {hexed[:15]}= b", [f"{hexed[:15]}="]),
    ]:
        assert [text[a:b] for a, b in secrets.candidates(text)] == want, text


def test_unclosed_key_blocks_take_linear_time():
    import time

    head, tail = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----\n"
    block = head + "abc\n" + tail
    assert secrets._keys(f"x {block}{head}{block} y {head}") == [(2, 1 + len(block)), (2 + len(block), 1 + len(block) + len(head) + len(block))]
    start = time.process_time()
    assert secrets._keys(head * 100_000) == [] and len(secrets._keys(block * 20_000)) == 20_000
    assert time.process_time() - start < 5


def test_assigned_without_spaces_is_masked(spark):
    rows, truth = findings_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    model, draw = secrets.train(df), random.Random(3)
    hexed, issued = "".join(draw.choice("0123456789abcdef") for _ in range(40)), "AKIA" + "Q7" * 8
    texts = [f"words {t} stand here" for t in (f"token={hexed}", f"DB_PASSWORD={hexed}", f"https://a.io/v1?token={hexed}&x=1", f"https://a.io/v1?access={issued}")]
    new = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    masked = [r.text for r in secrets.redacted(new, model).orderBy("doc_id").collect()]
    assert masked == [t.replace(hexed, secrets.MASK).replace(issued, secrets.MASK) for t in texts]


def test_given_labels_are_learned(spark):
    rows, truth = findings_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    spans = [(d, a, int("card" in t)) for d, t, _ in rows for a, _ in secrets.candidates(t)]
    labels = spark.createDataFrame(spans, "doc_id bigint, start bigint, label int")
    out = secrets.scan(df, secrets.train(df, findings=labels)).where("is_secret").collect()
    assert {r.doc_id for r in out} == {d for d, t, _ in rows if "card" in t}


def test_secret_edge_rows(spark):
    rows = [(1, None, None), (2, "", "s"), (None, 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"', None), (3, "a" * 200_000 + "1", "s"), (4, "= " * 50_000, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("start", F.lit(1))
    model = secrets.train(df)
    assert {r.doc_id for r in secrets.scan(df, model).collect()} == {None, 3}
    kept = secrets.redacted(df, model)
    assert kept.columns == df.columns and kept.count() == 5 and kept.where("doc_id = 1 and text is null").count() == 1
    assert secrets.scan(df.limit(0), secrets.train(df.limit(0))).collect() == []


def test_features_see_the_whole_value():
    """What stands far behind in a value counts: its length, dictionary words, harmless words and letters."""
    stats = {"dictionary": np.zeros(1 << secrets.BITS, bool), "surprise": np.zeros((256, 256), np.float32)}
    word, _ = secrets.word_hashes(["lantern"])
    stats["dictionary"][int(word[0] >> np.uint64(64 - secrets.BITS))] = True
    name = dict(zip(secrets.FEATURES, range(len(secrets.FEATURES)))).__getitem__
    for digits in (64, 4093, 9000):  # the second ends a stretch of look-ups inside the first word
        value = "7" * digits + "lantern" * 10 + "_sample"
        row = secrets.features(f"key={value}", [(4, 4 + len(value))], "", stats)[0]
        assert row[name("length")] == len(value) and np.isclose(row[name("covered")], 70 / len(value))
        assert row[name("harmless")] == 1 and np.isclose(row[name("digits")], digits / len(value))
