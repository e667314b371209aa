import random
import re

from pyspark.sql import types as T

from trajmill.llm.components import components
from trajmill.llm.near_duplicates import near_duplicates, representatives
from trajmill.llm.words import shingles

SCHEMA = "doc_id bigint, text string, key string, n int, set int"  # the last three clash with inner names


def shingle_set(text, words):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = {d: shingle_set(t, words) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ß"]
    common = [draw.choice(vocabulary) for _ in range(25)]
    rows, n = [], 0
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 6, 40, 120]))]
        if draw.random() < 0.4:
            base = common + base
        for _ in range(draw.choice([1, 1, 2, 9])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append((n, draw.choice([" ", "\t", "\n "]).join(w.upper() if draw.random() < 0.1 else w for w in copy)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "x"), (n + 4, "X")]


def test_shingles_agree_with_sets():
    for words in (1, 2, 5):
        rows = corpus(words)
        value, at = shingles([t for _, t in rows], words)
        assert [int(b - a) for a, b in zip(at[:-1], at[1:])] == [len(shingle_set(t, words)) for _, t in rows]
        assert len(set(value.tolist())) == len(set().union(*[shingle_set(t, words) for _, t in rows]))


def test_against_all_pairs(spark):
    for words in (2, 5):
        rows = corpus(10 + words)
        df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], SCHEMA)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words).collect()}
        want = brute(rows, words, 80)
        assert got == want
        kept = {r.doc_id for r in representatives(df, words).collect()}
        assert kept == {d for d, (_, c) in want.items() if d == c}


def test_ids_that_are_null_or_repeat(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(3, text), (3, text), (3, "other words here"), (9, text + " z"), (None, text), (None, None)], "doc_id bigint, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert rows == sorted([(3, 3, True)] * 3 + [(9, 3, False)] + [(None, None, True)] * 2, key=str)
    kept = representatives(df, 2)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "3", "None", "None"]
    assert kept.columns == ["doc_id", "text"]


def test_long_mixed_lists_lose_no_link(spark, monkeypatch):
    import trajmill.llm.near_duplicates as nd

    draw = random.Random(4)
    line = [f"c{i}" for i in range(24)]
    rows = [(i, " ".join(line + [f"w{draw.randrange(30)}" for _ in range(draw.choice([3, 4, 5, 30]))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    real = nd.links
    monkeypatch.setattr(nd, "links", lambda *a, **k: real(*a, **k, open_pairs=4))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()}
    assert got == brute(rows, 2, 80)


def near_copies(seed, count, size, kinds, edits):
    """Texts that differ from one text by some of a few shared edits and some of their own: pairs between 0.6 and 0.85."""
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    common = [(draw.randrange(size), f"e{k}") for k in range(kinds)]
    rows = []
    for i in range(count):
        copy = list(base)
        for _ in range(draw.choice(edits)):
            at, word = draw.choice(common) if draw.random() < 0.6 else (draw.randrange(size), f"o{draw.randrange(10 ** 6)}")
            copy[at] = word
        rows.append((i, " ".join(copy)))
    return rows


def test_members_of_a_group_between_the_thresholds(spark):
    for seed, words in ((1, 2), (2, 5)):
        rows = near_copies(seed, 90, 60, 9, [0, 2, 4, 6, 7, 8, 9, 12])
        want = brute(rows, words, 80)
        assert 3 < len({c for _, c in want.values()}) < 85
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words).collect()}
        assert got == want


def test_across_finds_every_link_of_differences(spark):
    """The join on rare elements against all pairs, for sets that are far from and near to their hub."""
    import trajmill.llm.near_duplicates as nd

    draw = random.Random(7)
    hub = set(range(40))
    sets = {b"hub": hub}
    shared = [draw.randrange(1000, 1030) for _ in range(12)]
    for i in range(60):
        mine = {x for x in hub if draw.random() > draw.choice([0.02, 0.1, 0.2])} | set(draw.sample(shared, draw.choice([0, 1, 3, 6])))
        sets[f"k{i:02}".encode()] = mine | {2000 + 10 * i + j for j in range(draw.choice([0, 1, 4]))}
    roots = {k: draw.choice([k, b"hub", b"k01"]) for k in sets}
    rows = [(b"h", k, roots[k], len(v), sorted(v ^ hub)) for k, v in sets.items()]
    df = spark.createDataFrame([(bytearray(a), bytearray(b), bytearray(c), n, d) for a, b, c, n, d in rows], "hub binary, id binary, root binary, n int, d array<bigint>")
    for percent in (80, 60):
        got = {frozenset((bytes(r.u), bytes(r.v))) for r in nd._across(df, percent).collect()}
        up = dict(roots)

        def root(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        link = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        assert all(link(*p) for p in got)
        for u, v in map(tuple, got):
            up[root(u)] = root(v)
        assert all(root(a) == root(b) for a in sets for b in sets if a < b and roots[a] != roots[b] and link(a, b))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, extra int")
    assert near_duplicates(empty).collect() == [] and representatives(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + draw.randrange(40), 200 + draw.randrange(40)) for _ in range(30)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert components(spark.createDataFrame([], T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))).collect() == []


def test_links_at_the_threshold_are_lost_as_seldom_as_stated():
    from math import comb
    from trajmill.llm import near_duplicates as nd
    n = nd.COORDINATES
    assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(nd.MATCHES)) < 2e-5
