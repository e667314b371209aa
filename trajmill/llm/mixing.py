"""Mixing sources to target weights over a tree domain > language > source.

A token budget runs down the tree. At each node it is shared among the children by weight, no child gets more than its
subtree can give (its tokens times the epochs allowed), and what a child cannot take goes to its siblings first, by
weight again. Only what a whole subtree cannot take reaches the siblings of its parent. A leaf spends its share on whole
epochs, then on a prefix of one more epoch in a seeded order of its documents.

Only counts by leaf and by (leaf, hash range) are gathered, so a leaf with most rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill.llm.common import checked_broadcast, stored

RANGES = 12  # bits: hash ranges of a leaf's epoch
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "language", "leaf_source")


def token_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("(none)"))


def _weight(names: Column, weights: dict[str, float], other: float) -> Column:
    pick = F.lit(float(other))
    for name, w in weights.items():
        pick = F.when(names == name, F.lit(float(w))).otherwise(pick)
    return pick


def share_out(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Share ``budget`` of each parent among its children (columns cap, weight) by weight, none beyond its cap."""
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    order = group.orderBy(F.col("_fill"), F.col(name))
    filled = nodes.where("weight > 0").withColumn("_fill", F.col("cap") / F.col("weight"))
    levels = filled.withColumns({
        "_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    levels = levels.withColumn("_level", (F.col(budget) - F.col("_before")) / F.col("_left"))
    levels = levels.withColumn("_open", F.col("_fill") > F.col("_level"))
    line = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (levels.withColumn("_line", line)
            .withColumn(out, F.when(F.col("_open"), F.greatest(F.lit(0.0), F.col("weight") * F.col("_line"))).otherwise(F.col("cap")))
            .drop("_fill", "_before", "_left", "_level", "_open", "_line", "weight"))


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], other: dict[str, float], budget: float, epochs: int) -> DataFrame:
    """Tokens for each leaf (columns of LEVELS, tokens): ``given``."""
    now, above = None, []
    # What lies under a weight of 0 takes no tokens and gives its ancestors no room for them.
    for level in LEVELS:
        leaves = leaves.where(_weight(F.col(level), weights.get(level, {}), other.get(level, 1.0)) > 0)
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("cap"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights.get(level, {}), other.get(level, 1.0)))
        nodes = nodes.withColumn("_budget", F.lit(float(budget))) if now is None else nodes.join(
            now.select(*above, F.col("_given").alias("_budget")), above)
        now, above = share_out(nodes, above, level, "_budget", "_given"), path
    return now.select(*LEVELS, F.floor("_given").cast("bigint").alias("given"))


def _place(seed: int, whole: str = "whole", doc_id: str = "_id") -> Column:
    """60 bits of a hash of seed, epoch and document."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(whole).cast("string"), _named(F.col(doc_id))).cast("binary"))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def plan(docs: DataFrame, doc_id: str, domain: Column, language: Column, source: Column, tokens: Column,
         weights: dict[str, dict[str, float]], other: dict[str, float], share: float, epochs: int, seed: int) -> DataFrame:
    """One row per leaf: LEVELS, whole (epochs), cut_place and cut_tokens (where the prefix of the next epoch ends)."""
    base = stored(docs.select(F.col(doc_id).alias("_id"), *_levels(domain, language, source), tokens.alias("tokens")), "tokens")
    leaves = stored(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves, weights, other, int(total * share), epochs)
    spent = stored(leaves.join(given, list(LEVELS)).select(
        *LEVELS, F.floor(F.col("given") / F.col("tokens")).cast("int").alias("whole"),
        (F.col("given") % F.col("tokens")).alias("rest")), "spent")
    small = checked_broadcast(spent.where("rest > 0"), spent.count(), BROADCAST_LEAVES)
    placed = base.join(small, list(LEVELS)).withColumn("place", _place(seed)).withColumn(
        "range", F.shiftright("place", 60 - RANGES))
    ranges = placed.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2**RANGES rows at most
    ranges = ranges.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    cut = (ranges.where("before < rest").groupBy(*LEVELS)
           .agg(F.max(F.struct("range", "before")).alias("_c")).select(*LEVELS, F.col("_c.range").alias("range"), F.col("_c.before").alias("before")))
    cut = stored(cut, "cuts")
    inside = placed.join(checked_broadcast(cut, cut.count(), BROADCAST_LEAVES), [*LEVELS, "range"])
    row = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    ends = (inside.where("tokens > 0").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(row), F.lit(0)))
            .where("at < rest").groupBy(*LEVELS).agg(F.max(F.struct("place", (F.col("rest") - F.col("at")).alias("cut"))).alias("_e"))
            .select(*LEVELS, F.col("_e.place").alias("cut_place"), F.col("_e.cut").alias("cut_tokens")))
    return stored(spent.join(ends, list(LEVELS), "left").select(*LEVELS, "whole", "cut_place", "cut_tokens"), "mix")


def _levels(domain: Column, language: Column, source: Column) -> list[Column]:
    return [_named(c).alias(n) for c, n in zip((domain, language, source), LEVELS)]


def mix(docs: DataFrame, *, domain: Column, language: Column | None = None, source: Column | None = None, doc_id: str = "doc_id",
        text: str = "text", weights: dict[str, dict[str, float]] | None = None, other: dict[str, float] | None = None,
        share: float = 0.5, epochs: int = 2, seed: int = 42) -> DataFrame:
    """The documents in the mix, with all their columns and ``mix_domain``, ``mix_tokens``, ``mix_copies``, ``mix_prefix``.

    ``share`` of all tokens is the budget. ``weights`` names weights by level (``domain``, ``language``, ``leaf_source``) and
    name; names without one weigh ``other`` of the level (default 1), and a weight of 0 leaves a branch out. A document is to be
    read ``mix_copies`` times as a whole and once more for its first ``mix_prefix`` tokens (runs of non-space). Null levels form
    a branch ``(none)``; documents without a token are not in the mix; rows of one doc_id share their place in an epoch. An empty
    table gives an empty result.
    """
    docs = docs.drop("mix_domain", "mix_tokens", "mix_copies", "mix_prefix")
    language = F.col("lang") if language is None else language
    source = F.col("source") if source is None else source
    tokens = token_count(text)
    leaves = plan(docs, doc_id, domain, language, source, tokens, weights or {}, other or {}, share, epochs, seed)
    leaves = checked_broadcast(leaves, leaves.count(), BROADCAST_LEAVES).select(
        *[F.col(c).alias(f"_mix_{c}") for c in (*LEVELS, "whole", "cut_place", "cut_tokens")])
    on = [a == F.col(f"_mix_{n}") for a, n in zip(map(_named, (domain, language, source)), LEVELS)]
    rows = docs.withColumn("mix_tokens", tokens).join(leaves, on[0] & on[1] & on[2])
    rows = rows.withColumn("_mix_place", _place(seed, "_mix_whole", doc_id))
    prefix = (F.when(F.col("_mix_place") < F.col("_mix_cut_place"), F.col("mix_tokens"))
              .when(F.col("_mix_place") == F.col("_mix_cut_place"), F.least("mix_tokens", "_mix_cut_tokens")).otherwise(0))
    return (rows.withColumns({"mix_domain": F.col("_mix_domain"), "mix_copies": F.col("_mix_whole"), "mix_prefix": prefix.cast("bigint")})
            .where((F.col("mix_tokens") > 0) & ((F.col("mix_copies") > 0) | (F.col("mix_prefix") > 0)))
            .select(*docs.columns, "mix_domain", "mix_tokens", "mix_copies", "mix_prefix"))
