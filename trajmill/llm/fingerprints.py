"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are the paragraphs of a text, a long paragraph in pieces at sentence ends. Sections are runs of leaves that end where
a leaf's own hash says so, hence an edit moves no border elsewhere. Section hashes come from leaf hashes, the root from section
hashes. The fingerprint spells the root and below it the leaves by section: equal roots mean equal texts, and where roots
differ the differing branches locate the edit.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

LEAF = r"[^\n.!?]{1,160}[\n.!?]*|[\n.!?]+"
DIGITS = 8  # hex digits of a leaf in the fingerprint; inner nodes use all 64
ROWS_PER_RANGE = 2_000
MOST_RANGES = 1 << 16


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint ``root:leaves|leaves|...`` of a text column; null counts as empty."""
    leaves, border = f"_{out}_leaves", F.lit("|")
    df = df.withColumn(leaves, F.transform(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256)))
    ends = lambda x: F.when(x.startswith("0"), border).otherwise("")
    whole = F.array_join(F.transform(leaves, lambda x: F.concat(x, ends(x))), "")
    brief = F.array_join(F.transform(leaves, lambda x: F.concat(F.substring(x, 1, DIGITS), ends(x))), "")
    root = F.sha2(F.array_join(F.transform(F.split(whole, r"\|"), lambda s: F.sha2(s, 256)), ""), 256)
    return df.withColumn(out, F.concat(F.substring(root, 1, 32), F.lit(":"), brief)).drop(leaves)


def leaves_of(fingerprint: str | Column) -> Column:
    f = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.regexp_extract_all(F.substring_index(f, ":", -1), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """Share of the distinct leaves of two fingerprints that both have: 1 for equal texts, 0 without a common leaf."""
    left, right = F.array_distinct(leaves_of(a)), F.array_distinct(leaves_of(b))
    both = 2.0 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce(both, F.lit(0.0)))


def first_difference(a: str, b: str) -> Column:
    """0-based index of the first leaf in which two fingerprints differ; null if they are equal."""
    unlike = F.zip_with(leaves_of(a), leaves_of(b), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(unlike, True) - 1
    return F.when(F.col(a) != F.col(b), F.when(at >= 0, at))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``next_<column>`` of the row that follows by descending doc_id; after the last row comes the first.

    Rows are dealt into ranges of doc_id of about equal size, and each range also gets the first row of the next one, so one
    shuffle serves and no task sees more than a range. Equal doc_ids follow in the order of ``columns``; rows without doc_id come last.
    """
    total = docs.select(doc_id).count()
    n = min(MOST_RANGES, max(1, ceil(total / rows_per_range)))
    ranges = 1 << max(0, (n - 1).bit_length())
    known = docs.where(F.col(doc_id).isNotNull())
    cuts = (known.agg(F.percentile_approx(doc_id, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0]
            if ranges > 1 else None) or []
    if cuts:  # binary search in the cut points, of which there are at most MOST_RANGES
        bounds = F.lit(sorted(set(cuts)))
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(set(cuts)).bit_length()))])
        place = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.coalesce(F.col(doc_id), F.lit(min(cuts) - 1)) >= F.get(bounds, at + s - 1), s).otherwise(0))
    else:
        place = F.lit(0)
    tagged = docs.withColumn("_range", place)
    firsts = known.withColumn("_range", place).groupBy("_range").agg(F.max(doc_id).alias("_top"))
    order = Window.orderBy("_range")  # one row per range
    after = firsts.select("_range", F.coalesce(F.lag("_top").over(order), F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_top"))
    ghosts = docs.join(F.broadcast(after), F.col(doc_id) == F.col("_top")).drop("_top")
    both = tagged.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
    row = Window.partitionBy("_range").orderBy("_ghost", F.col(doc_id).desc_nulls_last(), *columns)
    return (both.withColumns({f"next_{c}": F.lead(c).over(row) for c in columns})
            .where("not _ghost").drop("_range", "_ghost"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprint every text, and the same text with its second half replaced from the next document.

    Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_at
    (the first leaf that the edit touches). A null text is empty; two empty texts are alike (1), an empty and another are not (0). The
    only row of a table follows itself; without any doc_id the next text counts as empty. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fingerprint"), ["fingerprint", "text"], "doc_id", rows_per_range)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(
        F.substring("text", F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint",
                       "next_fingerprint", "_edited")
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       F.coalesce(likeness("fingerprint", "next_fingerprint"), F.lit(0.0)).alias("near_next"),
                       first_difference("fingerprint", "edited_fingerprint").alias("edit_at"))
