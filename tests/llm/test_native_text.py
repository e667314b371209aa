import hashlib
import re

from pyspark.sql import functions as F

from trajmill.llm import hosts, queries, quotes
from trajmill.llm.fingerprints import compare_edited

SF = "/root/testdata/sf0.001"


# -- fingerprints ------------------------------------------------------------------------------------

def tree(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = [sha(m) for m in re.findall(r"[^\n.!?]{1,160}[\n.!?]*|[\n.!?]+", text)]
    sections, brief = [""], ""
    for x in leaves:
        sections[-1] += x
        brief += x[:8]
        if x[0] == "0":
            sections.append("")
            brief += "|"
    return sha("".join(map(sha, sections)))[:32] + ":" + brief, {x[:8] for x in leaves}


def test_fingerprints_against_python(spark):
    texts = {5: "One. Two!\nThree? " * 4, 9: None, 7: "", 1: "é" * 401, 2: "🙂 a. b\n\n\nc" * 50, 11: "One. Two!\nThree? " * 4, 3: "x", 40: "word " * 30_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("_range", F.lit("clash"))
    order = sorted(texts, reverse=True)
    for per_range in (2_000, 1, 3):
        got = {r.doc_id: r for r in compare_edited(df, rows_per_range=per_range).collect()}
        assert set(got) == set(texts)
        for a, b in zip(order, order[1:] + order[:1]):
            t, n = texts[a] or "", texts[b] or ""
            k = len(t) // 2
            edited = t[: len(t) - k] + n[:k]
            (f, s), (g, e), (h, m) = tree(t), tree(edited), tree(n)
            like = lambda p, q, x, y: 1.0 if p == q else 2 * len(x & y) / max(1, len(x) + len(y))
            r = got[a]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g)
            assert abs(r.near_edited - like(f, g, s, e)) < 1e-12 and abs(r.near_next - like(f, h, s, m)) < 1e-12
            assert (r.edit_at is None) == (f == g)


def test_fingerprint_edge_tables(spark):
    schema = "doc_id bigint, text string"
    assert compare_edited(spark.createDataFrame([], schema)).collect() == []
    one = compare_edited(spark.createDataFrame([(4, "abcd")], schema)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = compare_edited(spark.createDataFrame([(None, "a"), (4, "b"), (4, "b"), (6, "c")], schema), rows_per_range=1).collect()
    assert len(rows) == 4 and all(0 <= r.near_edited <= 1 for r in rows)


# -- hosts -------------------------------------------------------------------------------------------

def test_rules_and_parts(spark):
    urls = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("x://example.net", "example.net", "", None, "allow"),
        ("https://q.example.com/de/?a", "q.example.com", "/de/", "example.com/de/", "block"), ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"), ("http://x.org/fr", "x.org", "/fr", None, "allow"), ("http://y.net/#t", "y.net", "/", "net/", "block"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b.org?c://d.net/en/", "b.org", "", None, "allow")]
    df = spark.createDataFrame([(i, u[0], "k") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(df, F.lit(0), queries.RULES).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert hosts.judge(df.limit(0), F.lit(0), queries.RULES).collect() == []
    assert {r.verdict for r in hosts.judge(df, F.lit(None), {}).collect()} == {"allow"}


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.a.com", 50, 45), ("one.a.com", 1, 1), ("good.a.com", 200, 4), ("x.b.com", 300, 9), ("y.c.org", 400, 20), ("z.c.org", 2, 0), ("", 3, 1)]
    got = {r.host: r for r in hosts.reputation(spark.createDataFrame(rows, "host string, n bigint, k bigint")).collect()}
    assert got["bad.a.com"].low > hosts.LIMIT > got["good.a.com"].low
    assert got["one.a.com"].rate < 1 and got["one.a.com"].low < hosts.LIMIT  # one bad page proves little
    pages = [(i, f"http://{h}/p", int(j < k)) for i, (h, n, k) in enumerate(rows) if h for j in range(n)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, bad int")
    verdicts = {(r.host, r.verdict) for r in hosts.judge(df, F.col("bad"), {}).collect()}
    assert ("bad.a.com", "block") in verdicts and len(verdicts) == 6 and sum(v == "block" for _, v in verdicts) == 1


# -- quotes ------------------------------------------------------------------------------------------

def test_nested_quotes_become_threads(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI lost it."),
        (1, 1, "assistant", "Ann wrote:\n> Where is  the KEY?\nOn the table."),
        (1, 2, "user", "A new matter."),
        (1, 3, "assistant", "> > where is the key?\n> On the table.\nNot any more."),
        (1, 4, "user", ">> On the table.\n> Not any more.\nI see."),
        (1, 5, "user", "> nobody said this\nHm."), (1, 6, "user", "> A new matter."), (1, 7, "user", None), (2, 0, "user", "> On the table."),
        (None, 1, "user", "x"), (1, None, "user", "> A new matter."), (1, 2, "user", "A new matter.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("level", F.lit(1))
    for target in (None, 3):
        out = quotes.conversations(df, target_rows=target).collect()
        assert len(out) == len(rows)
        by = {(r.conv_id, r.turn): r for r in out}
        links = {t: (by[1, t].reply_to, by[1, t].root_turn, by[1, t].depth, by[1, t].quoted_lines) for t in range(8)}
        assert links == {0: (None, 0, 0, 0), 1: (0, 0, 1, 1), 2: (None, 2, 0, 0), 3: (1, 0, 2, 2), 4: (3, 0, 3, 2), 5: (None, 5, 0, 0), 6: (2, 2, 1, 1), 7: (None, 7, 0, 0)}
        assert by[1, 1].text == "On the table." and by[1, 3].text == "Not any more." and by[1, 7].text is None and by[2, 0].reply_to is None
        order = [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)]
        assert order == [None, 0, 1, 3, 4, 2, 2, 6, 5, 7]
    assert quotes.conversations(df.limit(0)).collect() == []


def test_long_reply_chain(spark):
    rows = [(1, i, "user", f"line {i}" if i == 0 else f"> line {i - 1}\nline {i}") for i in range(40)]
    out = quotes.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {(r.turn, r.depth, r.root_turn) for r in out} == {(i, i, 0) for i in range(40)}
