"""MinHash near-duplicates by an inverted join over signature coordinates.

Every text class (texts with one shingle set) is posted under each (coordinate, value) of its signature. A pair must
collide in at least ``matches`` of ``coordinates``; so values held by one class only are skipped, classes with fewer
shared values than ``matches`` cannot have a partner, and, with values in order of list length, each class is merged on its
``shared - matches + 1`` shortest lists only: the long lists are skipped and probed just for candidates. Candidates are
confirmed on the full shingle sets, so a reported link is never wrong; a pair at the threshold of 0.8 itself collides too
seldom with a probability of 1.3e-5 (48 coordinates, 26 matches), a closer pair far more rarely.

Groups of thousands of near copies would give all pairs. Lists are therefore joined to one member first, their hub: the member
whose values the most classes share, as the text that copies derive from does. What links have put into one component is not
compared again. Where members of a list are still in several components, each is known by its difference to the hub, the shingles that one
of the two has and the other not. For two members, ``|A xor B| = |dA| + |dB| - 2 |dA and dB|``, so a link asks for a number of shared
elements of their differences, and only members that share one of their rarest elements, as many as that number leaves open, are compared. Work
grows with the edits that texts share, not with the square of a group, and no full set travels with a pair. Members that were not
compared with their hub, as too few of their values agree, are compared with members of their lists that agree in enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trajmill.llm.common import checked_broadcast, stored, text_batches
from trajmill.llm.components import components
from trajmill.llm.words import mixed, pieces, shingles

COORDINATES = 48
MATCHES = 26
OPEN_PAIRS = 1_000_000  # lists with more pairs of members far from their hub are split by a second value
BROADCAST_IDS = 2_000_000
_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))


def _set_key(value: np.ndarray, at: np.ndarray) -> list:
    """128 bits that stand for a shingle set; None for the empty one."""
    if not len(value):
        return [None] * (len(at) - 1)
    low, high = np.zeros(len(value) + 1, np.uint64), np.zeros(len(value) + 1, np.uint64)
    low[1:] = np.cumsum(mixed(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    high[1:] = np.cumsum(mixed(value + np.uint64(0x5851F42D4C957F2D)))
    low, high, size = low[at[1:]] - low[at[:-1]], high[at[1:]] - high[at[:-1]], np.diff(at)
    return [bytes(memoryview(np.array([a, b]))) if n else None for a, b, n in zip(low, high, size)]


def _lists(flat: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _signer(words: int):
    def sign(batches):
        seeds = _SEEDS
        for batch in batches:
            for first, end, texts in pieces(batch.column(1)):
                value, at = shingles(texts, words)
                size = np.diff(at)
                full = np.flatnonzero(size)
                rows = np.zeros((end - first, COORDINATES), np.int64)
                for k in range(COORDINATES if len(full) else 0):
                    least = np.minimum.reduceat(((value ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))) >> np.uint64(24), at[:-1][full])
                    rows[full, k] = (least.astype(np.int64) << 8) | k  # a value of 40 bits, and its coordinate
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(_set_key(value, at), pa.binary()),
                     pa.array(size, pa.int64()),
                     _lists(rows[full].ravel(), np.where(size > 0, COORDINATES, 0), pa.int64())],
                    names=["doc_id", "key", "n_shingles", "sig"])
    return sign


def _setter(words: int):
    """(id, set) of the rows (text, id, key) whose text has the shingle set of their key."""
    def sets(batches):
        for batch in batches:
            for first, end, texts in pieces(batch.column(0)):
                value, at = shingles(texts, words)
                same = pc.equal(pa.array(_set_key(value, at), pa.binary()), batch.column(2).slice(first, end - first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, end - first), _lists(value.view(np.int64), np.diff(at), pa.int64())],
                    names=["id", "set"]).filter(same)
    return sets


def signatures(docs: DataFrame, words: int = 2) -> DataFrame:
    """(doc_id, key, n_shingles, sig) per row of ``docs`` (columns doc_id, text); key is null without words."""
    kind = dict(docs.dtypes)["doc_id"]
    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _signer(words), f"doc_id {kind}, key binary, n_shingles bigint, sig array<bigint>")


def shared_values(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(id, n, vals, center) of the classes that can have partners: the signature values a class shares with others, shortest list
    first, and how many classes share them in all. In a group of copies the text they derive from has the greatest ``center``.
    """
    posted = classes.select("id", F.col("n").cast("int").alias("n"), F.explode("sig").alias("val"))
    lists = posted.groupBy("val").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    return (posted.join(lists, "val")
            .groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "val"))).alias("vals"), F.sum("held").alias("center"))  # at most COORDINATES
            .where(F.size("vals") >= matches)
            .withColumn("vals", F.col("vals.val")))


def _prefix(matches: int, more: int = 0):
    return F.slice("vals", 1, F.least(F.size("vals") - (matches - 1 - more), F.size("vals")))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()


def _sets(ids: DataFrame, docs: DataFrame, named: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(id, set) of the wanted classes: the distinct shingle hashes of one of their texts."""
    wanted = stored(ids.distinct().join(named, "id"), "wanted")
    chosen = docs.select("doc_id", "text").join(checked_broadcast(wanted, wanted.count(), BROADCAST_IDS), "doc_id")
    sets = chosen.select("text", "id", "key").mapInArrow(_setter(words), "id bigint, set array<bigint>")
    if repeated:  # only then may a text come twice
        sets = sets.dropDuplicates(["id"])
    return stored(sets, "sets")


def _differences(pairs: DataFrame, docs: DataFrame, named: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(id, hub, n, m, d) for the stored pairs (id, hub): the sizes of both sets and what lies in only one of them."""
    sets = _sets(pairs.select(F.explode(F.array("id", "hub")).alias("id")), docs, named, words, repeated)
    hubs = pairs.select("hub").distinct()
    hub_sets = sets.select(F.col("id").alias("hub"), F.col("set").alias("_t"))
    hub_sets = hub_sets.join(checked_broadcast(hubs, hubs.count(), BROADCAST_IDS), "hub", "left_semi")
    both = pairs.join(sets.select("id", F.col("set").alias("_s")), "id").join(hub_sets, "hub")
    return both.select("id", "hub", F.size("_s").alias("n"), F.size("_t").alias("m"),
                       F.concat(F.array_except("_s", "_t"), F.array_except("_t", "_s")).alias("d"))


def _need(percent: int, a: str, b: str):
    """How many elements two differences must share: a link is ``(100 + percent) * |A xor B| <= (100 - percent) * (|A| + |B|)``."""
    return F.greatest(F.lit(1), F.ceil((F.col(a) + F.col(b)) / (2 * (100 + percent))))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members (hub, id, root, n, d) of one hub that lie in different components.

    ``e = (100 + percent) * |d| - (100 - percent) * n`` says how far a member is beyond a link with its hub's set: two members
    are linked if and only if they share ``(e1 + e2) / (2 * (100 + percent))`` elements. With none needed, both are linked
    to the member of the least ``e``, which connects them. Else the elements are ranked, rare ones of the hub's group first, and the first
    common element of a linked pair lies so early in both rankings that enough elements can follow.
    """
    beyond = members.withColumns({"e": (100 + percent) * F.size("d") - (100 - percent) * F.col("n"), "size": F.size("d")})
    beyond = stored(beyond, "beyond")
    best = beyond.groupBy("hub").agg(F.min(F.struct("e", "id", "root")).alias("_b"))
    direct = beyond.join(best, "hub").where((F.col("e") + F.col("_b.e") <= 0) & (F.col("root") != F.col("_b.root"))).select(
        F.col("id").alias("u"), F.col("_b.id").alias("v"))

    # The least e in another component bounds what a member needs at least.
    by_root = beyond.groupBy("hub", "root").agg(F.min("e").alias("e"))
    first = by_root.groupBy("hub").agg(F.min(F.struct("e", "root")).alias("_1"))
    second = by_root.join(first, "hub").where(F.col("root") != F.col("_1.root")).groupBy("hub").agg(F.min("e").alias("_2"))
    open_ = beyond.join(stored(first.join(second, "hub"), "bounds"), "hub")
    other = F.when(F.col("root") == F.col("_1.root"), F.col("_2")).otherwise(F.col("_1.e"))
    open_ = open_.withColumn("_other", other).withColumn("_least", _need(percent, "e", "_other")).where(F.col("_least") <= F.col("size"))
    posted = open_.select("hub", "id", "root", "e", "size", "_least", F.explode("d").alias("x"))
    shared = posted.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("_held"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    ranked = (posted.join(shared, ["hub", "x"]).groupBy("hub", "id", "root", "e", "size", "_least")
              .agg(F.sort_array(F.collect_list(F.struct("_held", "x", (F.col("_lo") != F.col("_hi")).alias("mixed")))).alias("_x")))  # one difference
    prefix = F.slice("_x", 1, (F.col("size") - F.col("_least") + 1).cast("int"))
    early = stored(ranked.select("hub", "id", "root", "e", "size", F.posexplode(prefix).alias("_at", "_y")).where("_y.mixed").select(
        "hub", "id", "root", "e", "size", (F.col("size") - F.col("_at")).alias("left"), "_y.x"), "early")
    a, b = (early.select("hub", "x", *[F.col(c).alias(f"{c}{i}") for c in ("id", "root", "e", "left")]) for i in (1, 2))
    pairs = a.join(b, ["hub", "x"]).where((F.col("root1") < F.col("root2")) & (F.least("left1", "left2") >= _need(percent, "e1", "e2")))
    pairs = stored(pairs.select("hub", F.col("id1").alias("u"), F.col("id2").alias("v")).distinct(), "close")
    mine = beyond.select("hub", F.col("id"), "d", "e")
    met = (pairs.join(mine.select("hub", F.col("id").alias("u"), F.col("d").alias("_d1"), F.col("e").alias("_e1")), ["hub", "u"])
           .join(mine.select("hub", F.col("id").alias("v"), F.col("d").alias("_d2"), F.col("e").alias("_e2")), ["hub", "v"]))
    return direct.union(met.where(F.size(F.array_intersect("_d1", "_d2")) >= _need(percent, "_e1", "_e2")).select("u", "v"))


def links(signed: DataFrame, docs: DataFrame, words: int = 2, percent: int = 80, matches: int = MATCHES,
          open_pairs: int = OPEN_PAIRS, repeated: bool | None = None) -> DataFrame:
    """(node, root) over text classes, from confirmed links. ``repeated``: whether doc_ids repeat, looked up where not given."""
    repeated = _repeats(docs) if repeated is None else repeated
    classes = stored(signed.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).withColumn(
        "id", F.monotonically_increasing_id()), "classes")  # n and sig are equal for all copies
    named = classes.select("id", "key", "doc_id")
    shared = stored(shared_values(classes, matches), "shared")
    lists = shared.select("id", "n", "center", F.explode(_prefix(matches)).alias("val"))
    near_size = lambda a, b: (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))
    linked = (100 + percent) * F.size("d") <= (100 - percent) * (F.col("n") + F.col("m"))

    hubs = lists.groupBy("val").agg(F.max(F.struct("center", "id", "n")).alias("_h")).select("val", F.col("_h.id").alias("hub"), F.col("_h.n").alias("m"))
    placed = stored(lists.join(hubs, "val").select("val", "id", "n", "hub", "m"), "lists")
    starred = placed.where((F.col("id") != F.col("hub")) & near_size("n", "m")).select("id", "hub").distinct()
    left = shared.select("id", F.col("vals").alias("_a"))
    right = shared.select(F.col("id").alias("hub"), F.col("vals").alias("_b"))
    near = starred.join(left, "id").join(right, "hub").where(F.size(F.array_intersect("_a", "_b")) >= matches).select("id", "hub")
    near = stored(near, "pairs")
    first = stored(_differences(near, docs, named, words, repeated).withColumn("linked", linked), "differences")
    star = first.where("linked").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    roots = stored(components(star), "roots")

    # Lists whose members are in several components may still hide links between these.
    placed = placed.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    counted = placed.groupBy("val", "root").agg(F.count(F.lit(1)).alias("_c")).groupBy("val").agg(F.sum("_c").alias("_all"), F.max("_c").alias("_top"))
    torn = stored(placed.join(counted.where("_top < _all"), "val"), "torn")
    beside = torn.select("hub", "id", "n", "root").distinct()
    itself = F.when(F.col("id") == F.col("hub"), F.array().cast("array<bigint>"))
    known = beside.join(first.select("id", "hub", "d"), ["id", "hub"], "left").withColumn("d", F.coalesce("d", itself)).where("d is not null")
    more = stored(_across(known, percent), "links")
    far = stored(_far_pairs(torn, first.select("id", "hub"), shared, near_size, matches, open_pairs), "pairs")
    if not far.isEmpty():
        far = _differences(far, docs, named, words, repeated).where(linked)
        more = more.union(stored(far.select(F.col("id").alias("u"), F.col("hub").alias("v")), "links"))
    found = roots if more.isEmpty() else components(roots.union(more), "node", "root")  # roots join what the first links do
    node, root = (classes.select(F.col("id").alias(c), F.col("key").alias(f"_{c}")) for c in ("node", "root"))
    return found.join(node, "node").join(root, "root").select(F.col("_node").alias("node"), F.col("_root").alias("root"))


def _far_pairs(torn: DataFrame, known: DataFrame, shared: DataFrame, near_size, matches: int, open_pairs: int) -> DataFrame:
    """Pairs (id, hub) of members of a torn list in different components that collide often enough, one of them not ``known`` to its hub."""
    told = torn.join(known.withColumn("_known", F.lit(True)), ["id", "hub"], "left").withColumn("_known", F.coalesce("_known", F.col("id") == F.col("hub")))
    strange = told.groupBy("val").agg(F.count_if(~F.col("_known")).alias("_far")).where("_far > 0")
    members = (told.join(strange, "val").withColumn("_long", F.col("_far") * F.col("_all") > open_pairs)
               .select("val", "id", "n", "root", "_known", "_long").join(shared.select("id", "vals"), "id"))
    members = stored(members, "mixed")
    second = F.explode(F.array_except(_prefix(matches, 1), F.array("val")))
    deeper = members.where("_long").withColumn("_second", second).withColumn(
        "val", F.xxhash64(F.least("val", "_second"), F.greatest("val", "_second"))).drop("_second")
    members = members.where("not _long").unionByName(deeper)
    a, b = (members.select(*[F.col(c).alias(f"{c}{i}") for c in members.columns]) for i in (1, 2))
    both = F.array_intersect("vals1", "vals2")  # in the order of vals: each pair is taken in its first common list only
    across = a.join(b, (F.col("val1") == F.col("val2")) & (F.col("root1") < F.col("root2")) & (F.col("_long1") == F.col("_long2"))
                    & ~(F.col("_known1") & F.col("_known2")) & near_size("n1", "n2") & (F.size(both) >= matches)
                    & (F.col("_long1") | (F.get(both, F.lit(0)) == F.col("val1"))))
    return across.select(F.col("id1").alias("id"), F.col("id2").alias("hub")).distinct()


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, repeated: bool | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text; others are ignored): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id that links reach, the own one included; ``kept`` marks doc_id = component_id.
    Links join texts with ``100 * intersection >= percent * union`` of their distinct ``words``-word shingles, after
    lower-casing A-Z. Texts that are null, empty or blank have no shingle and no link, and stay. Rows of one doc_id with
    different texts are linked on their own and each is judged by its text. Rows without doc_id link nothing and have no component; they are kept.
    Copies of one shingle set are grouped before anything is compared; an empty table gives an empty result.
    ``repeated`` says whether a doc_id occurs twice, for a caller that knows.
    """
    signed = stored(signatures(docs, words), "signed")
    known = signed.where("doc_id is not null")
    classes = known.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    found = links(known, docs.where("doc_id is not null"), words, percent, repeated=repeated)
    placed = stored(classes.join(found.withColumnRenamed("node", "key"), "key", "left"), "placed")
    inner = placed.where("root is not null")
    least = (inner.select("root", "rep").union(
        placed.join(inner.select(F.col("root").alias("key")).distinct(), "key").select(F.col("key").alias("root"), "rep"))
        .groupBy("root").agg(F.min("rep").alias("_least")))
    named = (placed.select("key", "rep", F.coalesce("root", "key").alias("root")).join(least, "root", "left")
             .select("key", F.coalesce("_least", "rep").alias("_component")))
    return (signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates of another: of each group the row with the least doc_id stays, all columns kept.

    Rows without doc_id or without a word stay. Where doc_ids repeat, rows with one doc_id and text count as one, and rows
    with one doc_id and different texts are judged apart.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not _repeats(rows.where("doc_id is not null")):
        gone = near_duplicates(rows, words, percent, repeated=False).where("not kept").select(F.col("doc_id").alias("_gone"))
        gone = stored(gone, "gone")
        return docs.join(checked_broadcast(gone, gone.count(), BROADCAST_IDS), F.col(doc_id) == F.col("_gone"), "left_anti")
    named = docs.withColumn("_row", F.when(F.col(doc_id).isNotNull(), F.struct(
        F.col(doc_id).alias("id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("of"))))
    known = named.where("_row is not null").dropDuplicates(["_row"])
    gone = near_duplicates(known.select(F.col("_row").alias("doc_id"), F.col(text).alias("text")), words, percent, repeated=False)
    gone = stored(gone.where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    return known.join(gone, F.col("_row") == F.col("_gone"), "left_anti").unionByName(named.where("_row is null")).drop("_row")
