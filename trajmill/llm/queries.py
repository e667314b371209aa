"""Registered queries of the subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill.llm import (alignment, decontamination, fingerprints, hosts, infilling, language, mixing, packing, quality, quotes,
                          secrets, toxicity)
from trajmill.llm.common import remainder, table
from trajmill.llm.near_duplicates import near_duplicates

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return keep


@query("op8_minhash_near_duplicates", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
linked AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, linked.v FROM reach JOIN linked ON reach.v = linked.u)
SELECT d.doc_id, len(s.s) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d JOIN sets s ON s.doc_id = d.doc_id JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = d.doc_id
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


# -- op1 ---------------------------------------------------------------------------------------------

MIX = {
    "weights": {"domain": {"web": 0.5, "reference": 0.3, "books": 0.2}, "language": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}},
    "other": {"domain": 0.05, "language": 0.05}, "share": 0.5, "epochs": 2, "seed": 42,
}


def mix_domain():
    """The domain of a source by the number at the end of its name."""
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1).cast("int")
    return F.when(number < 10, "web").when(number < 15, "reference").when(number >= 15, "books")


def _share_sql(nodes: str, parent: str, name: str, out: str) -> str:
    """Water-filling of _budget among the children of a parent."""
    part = f"PARTITION BY {parent} " if parent else ""
    return f"""{out}_f AS (SELECT *, cap / weight AS fill FROM {nodes} WHERE weight > 0),
{out}_l AS (SELECT *, (b - coalesce(sum(cap) OVER ({part}ORDER BY fill, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({part}ORDER BY fill, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {out}_f),
{out} AS (SELECT *, CASE WHEN fill > lev THEN greatest(0.0, weight * max(CASE WHEN fill > lev THEN lev END) OVER ({part or ""})) ELSE cap END AS g FROM {out}_l)"""


@query("op1_mixing", rf"""
WITH base AS (
  SELECT doc_id, coalesce(CASE WHEN n < 10 THEN 'web' WHEN n < 15 THEN 'reference' WHEN n >= 15 THEN 'books' END, '(none)') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, t
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT) AS n, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS t FROM documents)),
leaves AS (SELECT domain, lang, source, sum(t)::BIGINT AS t FROM base GROUP BY ALL HAVING sum(t) > 0),
total AS (SELECT floor(sum(t) * 0.5)::DOUBLE AS b FROM leaves),
n1 AS (SELECT domain, (sum(t) * 2)::DOUBLE AS cap,
  CASE domain WHEN 'web' THEN 0.5 WHEN 'reference' THEN 0.3 WHEN 'books' THEN 0.2 ELSE 0.05 END::DOUBLE AS weight, any_value(b) AS b FROM leaves, total GROUP BY domain),
{_share_sql("n1", "", "domain", "s1")},
n2 AS (SELECT l.domain, lang, (sum(t) * 2)::DOUBLE AS cap,
  CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 0.05 END::DOUBLE AS weight, any_value(g) AS b
  FROM leaves l JOIN s1 ON s1.domain = l.domain GROUP BY l.domain, lang),
{_share_sql("n2", "domain", "lang", "s2")},
n3 AS (SELECT l.domain, l.lang, source, t, (t * 2)::DOUBLE AS cap, 1.0::DOUBLE AS weight, g AS b
  FROM leaves l JOIN s2 ON s2.domain = l.domain AND s2.lang = l.lang),
{_share_sql("n3", "domain, lang", "source", "s3")},
spent AS (SELECT domain, lang, source, floor(floor(g) / t)::INT AS whole, floor(g)::BIGINT % t AS rest FROM s3),
placed AS (SELECT base.*, whole, rest, ('0x' || substr(md5('42:' || whole || ':' || doc_id), 1, 15))::BIGINT AS place
  FROM base JOIN spent USING (domain, lang, source)),
spots AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM placed)
SELECT doc_id, domain AS mix_domain, lang, source, t AS mix_tokens, whole AS mix_copies, least(t, greatest(0, rest - pos))::BIGINT AS mix_prefix
FROM spots WHERE t > 0 AND (whole > 0 OR rest > pos)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain=mix_domain(), **MIX)
    return mixed.select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_copies", "mix_prefix")


# -- op2 to op6 --------------------------------------------------------------------------------------

@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1)


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("quality", "label")
    return quality.score_documents(table(spark, sf_dir, "documents"), labels, remainder("doc_id", 5) == 0)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label")
    return toxicity.score_documents(table(spark, sf_dir, "documents"), labels, remainder("doc_id", 4) == 2)


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), segment=decontamination.SEGMENT, every_item=True)


# -- op7 ---------------------------------------------------------------------------------------------

def _tree_sql(text: str, out: str, source: str) -> str:
    """A list of leaf hashes and the fingerprint of a text column."""
    leaves = rf"list_transform(regexp_extract_all({text}, '[^\n.!?]{{1,160}}[\n.!?]*|[\n.!?]+'), lambda x: sha256(x))"
    spelled = lambda d: f"array_to_string(list_transform({out}_l, lambda x: substr(x, 1, {d}) || CASE WHEN x[1] = '0' THEN '|' ELSE '' END), '')"
    return f"""{out} AS (SELECT *, list_distinct(list_transform({out}_l, lambda x: substr(x, 1, 8))) AS {out}_s,
  substr(sha256(array_to_string(list_transform(string_split({spelled(64)}, '|'), lambda s: sha256(s)), '')), 1, 32) || ':' || {spelled(8)} AS {out}_p,
  FROM (SELECT *, {leaves} AS {out}_l FROM {source}))"""


def _like_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a}_p = {b}_p THEN 1.0 ELSE coalesce(2.0 * len(list_intersect({a}_s, {b}_s)) / (len({a}_s) + len({b}_s)), 0.0) END::DOUBLE"


@query("op7_fingerprints", f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_tree_sql("t", "a", "docs")},
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(a_s) OVER w, first_value(a_s) OVER w) AS n_s,
  coalesce(lead(a_p) OVER w, first_value(a_p) OVER w) AS n_p, length(t) // 2 AS k FROM a
  WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, substr(t, 1, length(t) - k) || substr(nt, 1, k) AS e FROM n),
{_tree_sql("e", "b", "x")}
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(e) AS edited_sha256, a_p AS fingerprint, b_p AS edited_fingerprint,
  {_like_sql("a", "b")} AS near_edited, {_like_sql("a", "n")} AS near_next,
  CASE WHEN a_p <> b_p THEN list_position(list_transform(range(1, greatest(len(a_l), len(b_l)) + 1),
    lambda i: substr(a_l[i], 1, 8) IS DISTINCT FROM substr(b_l[i], 1, 8)), true) - 1 END AS edit_at
FROM b
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


# -- op9 ---------------------------------------------------------------------------------------------

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
JUNK = r"[%&$*#]{3}|!!| \| "


def page_outcome():
    """The label of a page: bad if more than a fortieth of its characters begin a run of junk marks."""
    return (F.regexp_count("html", F.lit(JUNK)) * 40 > F.length("html")).cast("int")


def _strength_sql(level: str) -> str:
    return f"""(SELECT 1.0 / least(greatest(coalesce((sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.01),
  1e-3), 0.5) - 1.0 FROM {level})"""


@query("op9_host_reputation", rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{hosts._UPPER}', '{hosts._LOWER}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
  (len(regexp_extract_all(html, '{JUNK}')) * 40 > length(html))::INT AS bad FROM pages),
h AS (SELECT host, n, k, split_part(host, '.', -1) AS suffix, CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain
  FROM (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p GROUP BY host) WHERE n > 0),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value((SELECT (sum(k) + 0.5) / (sum(n) + 1.0) FROM h)) AS m FROM h GROUP BY suffix),
s2 AS (SELECT suffix, (m * c + k) / (c + n) AS pm FROM (SELECT *, {_strength_sql("s")} AS c FROM s)),
d AS (SELECT x.*, pm AS m FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix) x JOIN s2 USING (suffix)),
d2 AS (SELECT domain, (m * c + k) / (c + n) AS pm FROM (SELECT *, {_strength_sql("d")} AS c FROM d)),
g AS (SELECT h.*, pm AS m FROM h JOIN d2 USING (domain)),
ab AS (SELECT host, m * c + k AS a, (1 - m) * c + n - k AS b FROM (SELECT *, {_strength_sql("g")} AS c FROM g)),
low AS (SELECT host, a / (a + b) - {hosts.SURE} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab),
r AS (SELECT p.page_id, p.host, p.path, low,
  CASE WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(p.path, '/de/') THEN 'example.com/de/'
       WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(p.path, '/en/') THEN 'example.net/en/'
       WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(p.path, '/fr/') THEN 'org/fr/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(p.path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN low USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  WHEN 'net/' THEN 'block' ELSE CASE WHEN round(low, 9) > {hosts.LIMIT} THEN 'block' ELSE 'allow' END END AS verdict FROM r
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), page_outcome(), RULES)


# -- op10 --------------------------------------------------------------------------------------------

@query("op10_quote_threads", r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
lines AS (SELECT conv_id, turn, unnest(ls) AS line FROM m),
n AS (SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^((?:[ 	]?>)+)[ 	]?', 1), '[^>]', '', 'g')) AS lev,
  trim(lower(regexp_replace(regexp_replace(line, '^((?:[ 	]?>)+)[ 	]?', ''), '\s+', ' ', 'g'))) AS body FROM lines),
origin AS (SELECT conv_id, body, min(turn) AS said FROM n WHERE lev = 0 AND body <> '' GROUP BY conv_id, body),
votes AS (SELECT n.conv_id, n.turn, said, lev, count(*) AS c FROM n JOIN origin o ON o.conv_id = n.conv_id AND o.body = n.body
  WHERE lev > 0 AND said < n.turn GROUP BY ALL),
links AS (SELECT conv_id, turn, sum(c)::BIGINT AS quoted, first(said ORDER BY lev, c DESC, said DESC) AS up FROM votes GROUP BY conv_id, turn),
chain(conv_id, turn, root, depth) AS (SELECT conv_id, turn, up, 1 FROM links
  UNION ALL SELECT c.conv_id, c.turn, l.up, c.depth + 1 FROM chain c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.root),
roots AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM chain GROUP BY conv_id, turn),
j AS (SELECT m.conv_id, m.turn, m.role, l.up AS reply_to, coalesce(r.root, m.turn) AS root_turn, coalesce(r.depth, 0)::INT AS depth, coalesce(l.quoted, 0) AS quoted_lines,
  trim(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT regexp_matches(ls[i], '^((?:[ 	]?>)+)[ 	]?')
    AND NOT (regexp_matches(ls[i], '(?i)wrote:\s*$') AND coalesce(regexp_matches(ls[i + 1], '^((?:[ 	]?>)+)[ 	]?'), false))), lambda i: ls[i]), chr(10))) AS text
  FROM m LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn, role, text) - 1 AS position FROM j
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


# -- op11 to op13 ------------------------------------------------------------------------------------

@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infilling.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(infilling.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))
