"""Packing, infilling and alignment against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajmill.llm import alignment, infilling, packing, tokens

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", None, "a", "\n", "\n\n", " ", "  two  blanks ", "tabs\tand\r\nreturns\x0b\x0c\x85\xa0", "It's WE'LL don't 'sup '", "É Ünïcode ſ ß İ Σ ΑΣ x", "數字 ١٢ ½ ²",
       "é ạ̈", "<|endoftext|> and <|startoftext|>", "null\0byte", "a▁b ▁", "🙂🙃 👩‍👩‍👧", "<P>x\ny", "x" * 5000, "word " * 3000, "ab" * 700 + " " * 333 + "q",
       "lone\n\n\nlines\n\nend", "no end of line\nlast", " sep　wide", "100%d $1 \\Q$0\\E %s\nnext$\n", "same text here\n" * 3, "same text here\n" * 3]


def frame(spark, texts):
    rows = [(i, t, "en", "k") for i, t in enumerate(texts)] + [(None, "id is null\nx", "de", "k"), (3, "repeated id\ny", None, "k")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start string"), rows


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    marks = [chr(c) for c in (*range(1, 0x180), *range(0x2010, 0x2020), 0x250, 0x3b1, 0x4e2d, 0x1f642)]
    letters = list("etaoin shrdlu" * 12 + "ETA.,'-\n019")
    mixed = ["".join(pick.choice(letters + (marks if k % 2 else [])) for _ in range(pick.randint(1, 400))) for k in range(150)]
    return ODD + mixed


# -- encoders ----------------------------------------------------------------------------------------

def test_word_ends_give_the_ids_of_the_file(texts):
    fast = tokens.word_ends(WORDS)
    entries = []
    symbols = tokens._symbols()
    for token in fast.slow.get_vocab():
        try:
            entries.append(bytes(symbols[c] for c in token.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            pass
    spots = [s for c in (*range(0x180), *range(0x2010, 0x2020)) for s in (f"a{chr(c)}b c", f"x1{chr(c)}{chr(c)}'s", f"{chr(c)}'{chr(c)}9")]
    for text in [t or "" for t in texts] + entries + spots:
        assert fast.ids(text).tolist() == fast.slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_level_gives_the_ids_of_the_file(texts):
    fast, slow = tokens.byte_level(BYTES), Tokenizer.from_file(BYTES)
    slow.encode_special_tokens = True
    spots = [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3200 or c % 61 == 0)]
    for text in [t or "" for t in texts] + spots:
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_stretches_do_not_change_ids(texts, monkeypatch):
    whole = "".join(t or "" for t in texts) + " plain words follow here" * 200
    plain = [list(f(p).ids(whole)) for f, p in ((tokens.word_ends, WORDS), (tokens.byte_level, BYTES), (tokens.pieces, PIECES))]
    monkeypatch.setattr(tokens, "STRETCH", 37)
    assert "".join(tokens.stretches(whole)) == whole and len(list(tokens.stretches(whole))) > 100
    assert [list(f(p).ids(whole)) for f, p in ((tokens.word_ends, WORDS), (tokens.byte_level, BYTES), (tokens.pieces, PIECES))] == plain


# -- packing -----------------------------------------------------------------------------------------

def test_binary_lengths():
    count = np.array([1, 2, 7, 8, 9, 4096, 10_001])
    owner, start, length = packing.binary_lengths(count, 8)
    for i, n in enumerate(count):
        mine = length[owner == i]
        assert mine.sum() == n and (mine[:-1] >= mine[1:]).all() and len(set(mine[mine < 8])) == (mine < 8).sum()
        assert (start[owner == i] == np.cumsum(mine) - mine).all()


def test_packing_against_plain_ids(spark, texts):
    df, rows = frame(spark, texts)
    slow = Tokenizer.from_file(WORDS)
    want = Counter(np.array(slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t, _, _ in rows)
    for longest in (4096, 16):
        packed = packing.pack(df.repartition(3), longest=longest)
        got = packed.collect()
        assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and len(r.ids) == 4 * r.length for r in got)
        assert all(r.length & (r.length - 1) == 0 and r.length <= longest for r in got)
        docs, found = [], Counter()
        for r in got:  # pieces of a document follow one another
            if r.start == 0:
                docs.append([])
            assert r.start == sum(len(x.ids) for x in docs[-1]) // 4 and r.doc_id == (docs[-1][0].doc_id if docs[-1] else r.doc_id)
            docs[-1].append(r)
        for d in docs:
            assert sum(r.length for r in d) == d[0].doc_tokens
            found[b"".join(r.ids for r in d)] += 1
        assert found == want
    assert packing.pack(df.limit(0)).collect() == []


def test_batches_hold_one_length(spark, texts, tmp_path):
    df, _ = frame(spark, texts)
    packing.pack(df.repartition(3), longest=64).write.parquet(str(tmp_path / "p"))
    packed = spark.read.parquet(str(tmp_path / "p"))
    got = packing.batches(packed, tokens=256).collect()
    assert len(got) == packed.count()
    sizes = defaultdict(list)
    for r in got:
        sizes[r.length, r.batch].append(r.length)
    for length in {k for k, _ in sizes}:
        numbers = sorted(b for k, b in sizes if k == length)
        assert numbers == list(range(len(numbers)))
        assert all(sum(sizes[length, b]) == 256 for b in numbers[:-1]) and sum(sizes[length, numbers[-1]]) <= 256
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert {(r.bucket, r.length) for r in back.select("bucket", "length").distinct().collect()} == {(n.bit_length() - 1, n) for n in {r.length for r in got}}


def test_packing_rejects_other_lengths(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).selectExpr("id doc_id", "'' text"), longest=100)


# -- infilling ---------------------------------------------------------------------------------------

def plain_cut(key, text, percent=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infilling_against_python(spark, texts):
    long = ["line\n" * 200_000, "\n" * 100_000 + "end", "one line of " + "é" * 1_000_000, "a<\nS><\nP" * 50]
    df, rows = frame(spark, texts + long)
    for percent, spm in ((100, 50), (60, 20)):
        cut = infilling.fill_in_middle(df, percent=percent, spm_percent=spm).withColumn("back", infilling.restore(F.col("output"), F.col("form")))
        got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in cut.collect() if r.back == r.source)
        assert got == Counter((k, *plain_cut("" if k is None else k, t or "", percent, spm)) for k, t, _, _ in rows)
        assert {f for _, _, f, _, _, _ in got} == {"plain", "spm", "psm"}
    assert infilling.fill_in_middle(df.limit(0)).collect() == []


def test_infilling_by_other_units(spark):
    df = spark.createDataFrame([(i, "one two  three four five six " * (i % 5)) for i in range(40)], "doc_id bigint, text string")
    cut = infilling.fill_in_middle(df, unit=r"\S+\s*|\s+", markers=("[pre]", "[suf]", "[mid]"))
    cut = cut.withColumn("back", infilling.restore(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert all(r.back == r.source and r.n == len(r.source.split()) for r in cut) and {r.form for r in cut} == {"plain", "spm", "psm"}


# -- alignment ---------------------------------------------------------------------------------------

def plain_groups(text):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    first, second = tokens.byte_level(BYTES).bytes, tokens.pieces(PIECES).bytes
    if not text:
        return [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if any(b"".join(d[i] for i in ids) != (" " + text).encode() for ids, d in ((x, first), (y, second))):
        return [], [], []
    ends_x, ends_y = np.cumsum([len(first[i]) for i in x]).tolist(), np.cumsum([len(second[i]) for i in y]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_x) & set(ends_y)):
        k, m = ends_x.index(end, i) + 1, ends_y.index(end, j) + 1
        groups.append((x[i:k], y[j:m]))
        i, j = k, m
    return x, y, groups


def plain_alignment(rows):
    docs = [(k, *plain_groups(t)) for k, t, _, _ in rows]
    held, links = Counter(), []
    for _, _, _, groups in docs:
        links.append(Counter((p, q) for x, y in groups for p in x for q in y))
        held.update(links[-1].keys())
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    for (key, x, y, groups), mine in zip(docs, links):
        spelt = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (key, len(x), len(y), len(groups), sum(mine.values()), sum(c for (p, q), c in mine.items() if held[p, q] == most[p]),
               sum(c * held[pair] for pair, c in mine.items()), hashlib.sha256(spelt.encode()).hexdigest() if x else "")


def test_alignment_against_python(spark, texts):
    df, rows = frame(spark, texts)
    want = Counter(plain_alignment(rows))
    for frequent in (500_000, 40, 1):
        got = alignment.align(df.repartition(3), frequent=frequent)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert alignment.align(df.limit(0)).collect() == []


def test_group_spans(spark):
    df, rows = frame(spark, ["Alignment of tokenizers, überall 🙂", "", None, "x▁y"])
    got = {(r.doc_id, len(r.ids_a)): r for r in alignment.groups(df).collect()}
    for key, text, _, _ in rows:
        x, y, groups = plain_groups(text)
        r = got[key, len(x)]
        assert r.ids_a == x and r.ids_b == y
        assert r.ends_a == np.cumsum([len(g) for g, _ in groups]).tolist() and r.ends_b == np.cumsum([len(h) for _, h in groups]).tolist()


def test_merge_path_pieces_of_any_size():
    pick = random.Random(2)
    for _ in range(300):
        last = pick.randint(1, 60)
        a, b = (np.array(sorted({*(pick.randint(1, last) for _ in range(pick.randint(0, last))), last})) for _ in range(2))
        common = sorted(set(a) & set(b))
        want = [(int((a <= e).sum()), int((b <= e).sum())) for e in common]
        meet = {(i, j) for i, e in enumerate(a) for j, f in enumerate(b) if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(e, f)}
        for work in (1, 2, 3, 7, 1000):
            i, j = alignment.diagonals(a, b, work)
            assert ((i + j)[1:-1] % work == 0).all() and (np.diff(i + j) <= work).all()
            x, y, closes = alignment.overlaps(a, b, work)
            assert set(zip(x.tolist(), y.tolist())) == meet and len(x) == len(meet)
            assert list(zip(*(c.tolist() for c in alignment.group_ends(a, b, work)))) == want


def test_huge_group_is_counted_by_ids(monkeypatch, texts):
    some = [t for t in texts if t][:40]
    block = alignment.Block(some, BYTES, PIECES)
    plain = [x.tolist() for x in block.links(32_000)]
    for limit in (1, 5):
        monkeypatch.setattr(alignment, "LINKS", limit)
        assert [x.tolist() for x in block.links(32_000)] == plain
