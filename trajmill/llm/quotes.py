"""Chat formatting by quotation linking.

Lines quoted with ``>`` are parsed with their nesting, normalised and hashed, and joined to the first message of the conversation that
says them in its own words. A message replies to the origin of its least nested quotation. The conversation comes back in
reply order, thread by thread, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajmill.llm.common import stored
from trajmill.plans.segments import plan_layout, with_position

_QUOTE = r"^((?:[ \t]?>)+)[ \t]?"
_ATTRIBUTION = r"(?i)\bwrote:\s*$"


def level(line: str | Column) -> Column:
    """How deeply a line is quoted: 0 for the writer's own."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 1), r"[^>]", ""))


def normalised(line: str | Column) -> Column:
    """A line without quote marks, in lower case, runs of spaces as one."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, _QUOTE, ""), r"\s+", " ")))


def own_text(text: str) -> Column:
    """The lines of a message that are not quoted, without the line that introduces a quotation."""
    lines = F.split(text, "\n")
    keep = lambda line, i: ~line.rlike(_QUOTE) & ~(line.rlike(_ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(_QUOTE), F.lit(False)))
    return F.trim(F.array_join(F.filter(lines, keep), "\n"))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, quoted) of the messages (conv_id, turn, text) whose quotations have an origin."""
    lines = (messages.where("text is not null").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
             .select("conv_id", "turn", level("line").alias("level"), normalised("line").alias("_n")).where("_n <> ''")
             .select("conv_id", "turn", "level", F.xxhash64("_n").alias("hash"), F.xxhash64(F.reverse("_n")).alias("hash2")))
    key = ["conv_id", "hash", "hash2"]
    origin = lines.where("level = 0").groupBy(*key).agg(F.min("turn").alias("said"))
    found = lines.where("level > 0").join(origin, key).where("said < turn")
    votes = found.groupBy("conv_id", "turn", "said", "level").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "n", "said")).alias("_b"), F.sum("n").alias("quoted")
    ).select("conv_id", "turn", F.col("_b.said").alias("reply_to"), "quoted")


def threads(links: DataFrame) -> DataFrame:
    """Add root_turn and depth to (conv_id, turn, reply_to, quoted) by pointer doubling: the rounds are logarithmic in the depth."""
    now = stored(links.withColumns({"root_turn": F.col("reply_to"), "depth": F.lit(1)}), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("_up"), F.col("depth").alias("_more"))
        nxt = stored(now.join(up, ["conv_id", "root_turn"], "left"), "threads")
        if nxt.where("_up is not null").isEmpty():
            return now
        now = nxt.select("conv_id", "turn", "reply_to", "quoted", F.coalesce("_up", "root_turn").alias("root_turn"),
                         (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  target_rows: int | None = None) -> DataFrame:
    """Per message: conv_id, position, turn, role, text (own words), reply_to, root_turn, depth, quoted_lines.

    ``position`` counts from 0 through the conversation, thread after thread in the order of their first message, by turn inside a
    thread. ``reply_to`` is null without a quotation that has an origin: such a message opens a thread (root_turn = turn, depth 0).
    ``quoted_lines`` counts the lines with an origin. A null text has no words of its own and quotes nothing. Messages with equal conv_id
    and turn share their links and follow each other by role and text; null conv_ids form one conversation, null turns come first and
    link nothing. An empty table gives an empty result; other columns are ignored.
    """
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    links = threads(replies(rows.where("conv_id is not null and turn is not null")))
    joined = (rows.join(links, ["conv_id", "turn"], "left")
              .withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)),
                            "quoted_lines": F.coalesce("quoted", F.lit(0)), "text": own_text("text")}).drop("quoted"))
    layout = plan_layout(joined, ["conv_id"], "root_turn", target_rows)
    return with_position(joined, layout, ["root_turn", "turn", "role", "text"], "position").select(
        "conv_id", F.col("position").cast("bigint").alias("position"), "turn", "role", "text", "reply_to", "root_turn", "depth", "quoted_lines")
