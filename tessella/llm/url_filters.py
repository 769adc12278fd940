"""URL filters: explicit rules, and empirical-Bayes reputations of hosts for what no rule decides.

Labelled page outcomes are counted per host, registered domain and suffix. Every level is a beta-binomial prior for the
next: the suffix shrinks to the overall rate, the domain to its suffix, the host to its domain, each by a strength that
the scatter of the level's rates around their parents' gives. A page is blocked when the lower bound of its host's posterior bad rate
passes a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import LOWER, UPPER, ascii_lower, stored, strength_around, strength_around_sql

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
THRESHOLD, Z = 0.5, 1.645
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls if none fits."""
    rule = verdict = None
    for says, name in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        its_host, slash, rest = name.partition("/")
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(slash + rest)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _lower_bound(k: Column, n: Column, strength: float, parent: Column, z: float) -> Column:
    a, b = k + strength * parent, (n - k) + strength * (1 - parent)
    mean, all_ = a / (a + b), a + b
    return mean - z * F.sqrt(mean * (1 - mean) / (all_ + 1))


def levels_of(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host, without its port: the last label, or a suffix of several that is listed, and one label more."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    listed = "|".join([*(s.replace(".", r"\.") for s in sorted(suffixes, key=len, reverse=True)), "[^.]*"])
    return F.regexp_extract(bare, rf"(?:^|\.)({listed})$", 1), F.regexp_extract(bare, rf"((?:[^.]*\.)?(?:{listed}))$", 1)


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: Sequence[str] = ()) -> DataFrame:
    """host, n, k, rate, bound of (host, bad) rows, bad being 0, 1 or null (not labelled).

    suffixes: public ones of several labels (co.uk), which no rule tells.

    The levels come from one aggregation by host; coarser ones aggregate that table, so that a host with a third of all
    pages is summed before it is sent. Strengths are four numbers on the driver, whatever the size.
    """
    hosts = stored(
        outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
        .withColumns(dict(zip(("suffix", "domain"), levels_of(F.col("host"), suffixes), strict=True))),
        "hosts",
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    above = (total.k + 0.5) / (total.n + 1.0) if total.n else 0.5
    out = hosts.withColumn("parent", F.lit(above))
    for level in LEVELS[:-1]:
        sums = stored(out.groupBy(level).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.first("parent").alias("parent")), f"{level}-rates")
        strength = strength_around(sums)
        rates = sums.select(level, ((F.col("k") + strength * F.col("parent")) / (F.col("n") + strength)).alias("parent"))
        out = out.drop("parent").join(rates, level)
    out = stored(out, "host-rates")
    strength, above = strength_around(out), F.col("parent")
    return out.select(
        "host", "n", "k", ((F.col("k") + strength * above) / (F.col("n") + strength)).alias("rate"),
        _lower_bound(F.col("k"), F.col("n"), strength, above, z).alias("bound"),
    )


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD, z: float = Z, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url); labels: (page_id, bad).

    Null url, or one without ://: host and path empty, judged as the host ''. A null page_id has no label. Repeated rows
    are judged alike and count as often as they stand. Several labels of one page: bad if any says so. Hosts without
    labels take their domain's rate. Other columns of either table are not read. Empty tables: no rows; without labels
    all rates are one half and nothing passes the bound.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.select(F.col("page_id").alias("l_id"), F.col("bad").cast("int").alias("bad")).where("bad IS NOT NULL").groupBy("l_id").agg(F.max("bad").alias("bad"))
    seen = p.select("page_id", "host").join(known, F.col("page_id") == F.col("l_id"), "left").select("host", "bad")
    verdicts = stored(host_reputation(seen, z, suffixes).select(F.col("host").alias("r_host"), (F.col("bound") > threshold).alias("r_bad")), "reputation")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return p.join(verdicts, F.col("host") == F.col("r_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.coalesce(F.col("r_bad"), F.lit(False)), "block").otherwise("allow")).alias("verdict")
    )


def oracle() -> str:
    cases = {"rule": [], "verdict": []}
    for says, name in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, rest = name.partition("/")
        fits = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}'))"
        cases["rule"].append(f"WHEN {fits} THEN '{name}'")
        cases["verdict"].append(f"WHEN {fits} THEN '{says}'")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
host AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '([^.]*)$', 1) AS suffix, regexp_extract(regexp_replace(host, ':[0-9]*$', ''), '((?:[^.]*\\.)?[^.]*)$', 1) AS domain
  FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
p0 AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5) / (sum(n) + 1.0) ELSE 0.5 END AS p0 FROM host),
suffix AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(p0) AS parent FROM host, p0 GROUP BY suffix),
suffix_rate AS (SELECT suffix, (k + s * parent) / (n + s) AS rate FROM suffix, (SELECT {strength_around_sql("suffix")} AS s)),
domain AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(rate) AS parent FROM host JOIN suffix_rate USING (suffix) GROUP BY domain),
domain_rate AS (SELECT domain, (k + s * parent) / (n + s) AS rate FROM domain, (SELECT {strength_around_sql("domain")} AS s)),
h AS (SELECT host, n, k, rate AS parent FROM host JOIN domain_rate USING (domain)),
r AS (SELECT host, k + s * parent AS a, n - k + s * (1 - parent) AS b FROM h, (SELECT {strength_around_sql("h")} AS s)),
v AS (SELECT host AS v_host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {THRESHOLD} AS bad FROM r)
SELECT page_id, host, path, CASE {" ".join(cases["rule"])} END AS rule,
  CASE {" ".join(cases["verdict"])} WHEN v.bad THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN v ON host = v_host"""
