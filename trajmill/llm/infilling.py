"""Fill-in-the-middle by one counted-quantifier match per text, all in Spark's own expressions.

``regexp_count`` gives the number n of units (lines by default). Two numbers a <= b derived from a hash of the id become the counts
of a pattern made for the row, ``^((?:unit){a}+)((?:unit){b-a}+)(.*)$``; one ``regexp_replace`` with it puts prefix, middle and suffix in
their new order. Possessive counts never give a unit back, so the match is one walk through the text without a stack, and
no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LINE = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle


def _draws(seed: int, doc_id: str) -> Column:
    """Four 32-bit numbers of a document: the first groups of eight hex digits of sha256("seed:id")."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def _one(text: Column, pattern: Column | str, to: Column | str) -> Column:
    return F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), to if isinstance(to, Column) else F.lit(to))


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINE,
                   markers: tuple[str, str, str] = MARKERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, source, output): ``source`` is the text (null: empty), ``output`` its new form.

    ``unit`` is a pattern that never matches nothing and whose matches, left to right, make up a whole text; n counts them. ``percent``
    of the texts are transformed, of these ``spm_percent`` as spm (suffix first), else psm. A text that is empty or holds
    a marker stays plain; its lengths are null. Marker strings contain no second copy of their first character and no group references. A null
    id draws like an empty one; repeated rows repeat; texts of any length are matched whole; other columns are ignored.
    """
    prefix, suffix, middle = markers
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("source"), _draws(seed, doc_id).alias("_h"))
    counted = texts.withColumn("n", F.regexp_count("source", F.lit(unit)).cast("bigint"))
    cut = counted.withColumns({"_x": F.col("_h")[0] % (F.col("n") + 1), "_y": F.col("_h")[1] % (F.col("n") + 1)})
    cut = cut.withColumns({"_a": F.least("_x", "_y"), "_m": F.abs(F.col("_x") - F.col("_y"))})
    marked = F.lit(False)
    for m in markers:
        marked |= F.contains("source", F.lit(m))
    plain = (F.col("source") == "") | marked | (F.col("_h")[2] % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    pattern = F.format_string(rf"\A((?:{_plain(unit)}){{%d}}+)((?:{_plain(unit)}){{%d}}+)([\s\S]*)\z", "_a", "_m")
    order = F.when(F.col("form") == "spm", f"{suffix}$3{prefix}$1{middle}$2").otherwise(f"{prefix}$1{suffix}$3{middle}$2")
    out = cut.withColumn("form", form).withColumn(
        "output", F.when(F.col("form") == "plain", F.col("source")).otherwise(_one(F.col("source"), pattern, order)))
    # A text without markers has each of them once in its output, so lengths are read off their places.
    spm = F.col("form") == "spm"
    after_prefix = F.when(spm, F.instr("output", middle)).otherwise(F.instr("output", suffix))
    before_prefix = F.when(spm, F.instr("output", prefix) + len(prefix)).otherwise(F.lit(len(prefix) + 1))
    turned = F.col("form") != "plain"
    return out.select(
        F.col("_id").alias(doc_id), "n", "form", F.when(turned, after_prefix - before_prefix).cast("bigint").alias("prefix_chars"),
        F.when(turned, F.char_length("output") - F.instr("output", middle) - len(middle) + 1).cast("bigint").alias("middle_chars"), "source", "output")


def _plain(unit: str) -> str:
    """The unit inside a format string."""
    return unit.replace("%", "%%")


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text of ``fill_in_middle`` from its output and form."""
    prefix, suffix, middle = (rf"\Q{m}\E" for m in markers)
    back = F.when(form == "spm", rf"\A{suffix}([\s\S]*){prefix}([\s\S]*){middle}([\s\S]*)\z").otherwise(rf"\A{prefix}([\s\S]*){suffix}([\s\S]*){middle}([\s\S]*)\z")
    return F.when(form == "plain", output).otherwise(_one(output, back, F.when(form == "spm", "$2$3$1").otherwise("$1$3$2")))
