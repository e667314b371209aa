import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trajmill.llm.mixing import mix

WEIGHTS = {"domain": {"d0": 3.0, "d1": 1.0}, "language": {"en": 2.0, "xx": 0.0}}


def fill(children, budget):
    """Water-filling by repeated rounds: name -> (cap, weight)."""
    given, open_ = {c: 0.0 for c in children}, {c for c, (cap, w) in children.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        weight = sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] - given[c] <= left * children[c][1] / weight + 1e-12}
        if not full:
            for c in open_:
                given[c] += left * children[c][1] / weight
            break
        for c in full:
            left -= children[c][0] - given[c]
            given[c] = children[c][0]
        open_ -= full
        # what the open ones have got so far is nothing: each round starts over with what is left
    return given


def brute(rows, share, epochs, seed):
    tokens = {}
    for d, dom, lang, src, text in rows:
        tokens.setdefault(dom, {}).setdefault(lang, {}).setdefault(src, []).append((d, len((text or "").split())))
    total = sum(n for a in tokens.values() for b in a.values() for c in b.values() for _, n in c)
    # What has a weight of 0 takes nothing, and gives nothing above it room.
    tokens = {d: {k: v for k, v in a.items() if WEIGHTS["language"].get(k, 1.0) > 0} for d, a in tokens.items() if WEIGHTS["domain"].get(d, 1.0) > 0}
    size = lambda t: sum(size(x) for x in t.values()) if isinstance(t, dict) else sum(n for _, n in t)
    out = {}
    weight = lambda level, name: WEIGHTS.get(level, {}).get(name, 1.0)
    top = fill({k: (size(v) * epochs, weight("domain", k)) for k, v in tokens.items() if size(v)}, int(total * share))
    for dom, a in top.items():
        mid = fill({k: (size(v) * epochs, weight("language", k)) for k, v in tokens[dom].items() if size(v)}, a)
        for lang, b in mid.items():
            low = fill({k: (size(v) * epochs, 1.0) for k, v in tokens[dom][lang].items() if size(v)}, b)
            for src, c in low.items():
                docs, c = tokens[dom][lang][src], int(c + 1e-6)
                whole, rest = divmod(c, size(docs))
                place = lambda d: int(hashlib.md5(f"{seed}:{whole}:{d}".encode()).hexdigest()[:15], 16)
                at = 0
                for d, n in sorted(docs, key=lambda x: place(x[0])):
                    prefix = min(n, max(0, rest - at))
                    at += n
                    if n and (whole or prefix):
                        out[d] = (whole, prefix)
    return out


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.6, 1), (0.9, 3), (5.0, 2)])
def test_against_rounds(spark, share, epochs):
    draw = random.Random(int(share * 10))
    rows = [(i, draw.choice(["d0", "d0", "d1", "d2"]), draw.choice(["en", "en", "de", "xx"]), f"s{min(draw.randrange(9), 4)}",
             " ".join(["t"] * draw.choice([0, 1, 5, 40, 300]))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, place string, lang string, source string, text string").withColumn("whole", F.lit(9))
    got = mix(df, domain=F.col("place"), weights=WEIGHTS, share=share, epochs=epochs, seed=5)
    assert got.columns == [*df.columns, "mix_domain", "mix_tokens", "mix_copies", "mix_prefix"]
    found = {r.doc_id: (r.mix_copies, r.mix_prefix) for r in got.collect()}
    want = brute(rows, share, epochs, 5)
    assert sum(abs(a[0] - b[0]) for a, b in ((found.get(k, (0, 0)), want.get(k, (0, 0))) for k in {*found, *want})) == 0
    # floor() of a share may differ by a token in floating point
    assert all(abs(found.get(k, (0, 0))[1] - want.get(k, (0, 0))[1]) <= 1 for k in {*found, *want})


def test_weight_zero_loses_no_budget(spark):
    """A source whose tokens are mostly under weight 0 leaves its share to its sibling."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, "a", "de", words(1000)), (2, "a", "en", words(50)), (3, "b", "en", words(2000))]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    out = mix(df, domain=F.col("source"), language=F.col("lang"), weights={"language": {"en": 1.0}}, other={"language": 0.0}, share=0.3, epochs=1, seed=3).collect()
    spent = {r.doc_id: r.mix_copies * r.mix_tokens + r.mix_prefix for r in out}
    assert spent == {2: 50, 3: 865}  # 915 in all


def test_nulls_and_empty(spark):
    schema = "doc_id bigint, lang string, source string, text string"
    df = spark.createDataFrame([(1, None, None, "a b c"), (None, "en", "s", "d e"), (2, "en", "s", None), (3, "en", "s", ""), (1, None, None, "a b c")], schema)
    got = mix(df, domain=F.lit(None).cast("string"), share=10.0, epochs=1).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and all(r.mix_copies == 1 for r in got)
    assert mix(spark.createDataFrame([], schema), domain=F.lit("d")).collect() == []
