"""The driver keeps the plan of every execution: plans stay small, and a question about a table is asked once."""

import random

from trajmill.llm import components as co, near_duplicates as nd
from trajmill.llm.common import stored


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_a_round_of_components_names_its_edges_four_times(spark):
    edges = stored(spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "u bigint, v bigint"), "edges")
    assert leaves(co._small_star(co._large_star(edges))) <= 4


def test_near_duplicates_written_tables_have_small_plans(spark, monkeypatch):
    draw, sizes, asked = random.Random(4), {}, []
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(40):  # one group of edits, some beyond a link with the rest
        words = list(base)
        for _ in range(draw.choice([0, 2, 5, 9])):
            words[draw.randrange(60)] = f"x{draw.randrange(6)}"
        rows.append((n, " ".join(words)))

    def watched(df, name):
        sizes[name] = max(sizes.get(name, 0), leaves(df))
        return stored(df, name)
    repeats = nd._repeats
    monkeypatch.setattr(nd, "_repeats", lambda docs: asked.append(1) or repeats(docs))
    for module in (nd, co):
        monkeypatch.setattr(module, "stored", watched)
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")
    last = nd.representatives(docs, 2)
    assert {"stars", "early", "close", "links", "placed"} <= set(sizes)
    assert sizes["stars"] <= 4 and max(sizes.values()) <= 8 and leaves(last) <= 2, sizes
    assert len(asked) == 1
