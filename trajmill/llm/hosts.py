"""URL filter by host reputation with empirical-Bayes shrinkage.

Labelled page outcomes are counted by host. Rates shrink through beta priors: the suffix towards all pages, the registered domain
towards its suffix, the host towards its domain; how strongly is estimated from the spread of the rates at each level. A
host is blocked if even the lower posterior bound of its rate of bad pages is above a limit. Rules go before the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajmill.llm.common import checked_broadcast, stored

LIMIT = 0.2
SURE = 1.645  # posterior standard deviations below the mean
BROADCAST_HOSTS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``host/path`` -> verdict) that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        at, _, rest = rule.partition("/")
        fits = ((F.col(host) == at) | F.col(host).endswith(f".{at}")) & F.col(path).startswith(f"/{rest}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def _strength(children: DataFrame) -> float:
    """Prior pages of a level (columns n, k, m): from the spread of the rates around their parents' means."""
    spread = F.col("m") * (1 - F.col("m"))
    got = children.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("seen"), F.sum(spread).alias("chance"),
        F.sum(spread * (F.col("n") - 1)).alias("room")).first()
    rho = (got["seen"] - got["chance"]) / got["room"] if got["room"] else 0.01
    return 1.0 / min(max(rho, 1e-3), 0.5) - 1.0


def reputation(counts: DataFrame) -> DataFrame:
    """Posterior per host from (host, n labelled pages, k bad ones): host, n, k, rate, low (lower bound of the rate)."""
    parts = F.split("host", r"\.")
    suffix = F.element_at(parts, -1)
    domain = F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), suffix)).otherwise(suffix)
    hosts = counts.where("n > 0").select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (whole["k"] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.5
    level, above = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(mean)), None
    for name, finer in (("suffix", "domain"), ("domain", "host")):
        s = _strength(level)
        above = level.select(name, ((F.col("m") * s + F.col("k")) / (F.lit(s) + F.col("n"))).alias("m"))
        if finer == "domain":
            level = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(above, name)
        else:
            level = hosts.join(above, name)
        level = stored(level, "reputation")
    s = _strength(level)
    a, b = F.col("m") * s + F.col("k"), (1 - F.col("m")) * s + F.col("n") - F.col("k")
    rate = a / (a + b)
    return level.select("host", "n", "k", rate.alias("rate"),
                        (rate - SURE * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("low"))


def judge(pages: DataFrame, outcome: Column, rules: dict[str, str], page_id: str = "page_id", url: str = "url", limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``outcome`` is 1 for a bad page, 0 for a good one, null without a label. A null url or one without ``://`` has host and path '' and is
    judged like any host by the outcomes of such pages. Hosts without labelled pages are allowed. Repeated rows count and repeat;
    other columns are ignored.
    """
    rows = pages.select(F.col(page_id), host_of(url).alias("host"), path_of(url).alias("path"), outcome.cast("int").alias("_bad"))
    counts = rows.groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k"))
    blocked = stored(reputation(stored(counts, "hosts")).where(F.round("low", 9) > limit).select("host", F.lit(True).alias("_blocked")), "blocked")
    name, verdict = rule_of("host", "path", rules)
    return (rows.drop("_bad").join(checked_broadcast(blocked, blocked.count(), BROADCAST_HOSTS), "host", "left")
            .select(page_id, "host", "path", name.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict")))
