"""URL filter: explicit rules, then empirical-Bayes reputation of hosts.

Pages that an explicit rule judges are the labelled outcomes (allow: good,
block: bad).  Their bad shares are shrunk level by level through
beta-binomial priors: suffix (last label of the host) towards all pages,
registered domain (last two labels) towards its suffix, host towards its
domain.  Each level's prior strength comes from the spread of that level's
units by the method of moments.  A page without a rule is blocked if the
lower posterior bound of its host's bad share reaches ``BLOCK_AT``.

Only built-in DataFrame functions are used.  A null url, or one without
``://``, has an empty host and path, which no rule fits; the empty host is a
host like any other.  Repeated rows get equal verdicts.  Without labelled
pages the prior is one half with no evidence, and nothing more is blocked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho.llm.common import staged

#: FIXED VALUES: the explicit rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BLOCK_AT = 0.5              # bad share that a host's lower bound must reach
Z = 1.645                   # one-sided 95 % bound
LEAST_RHO, MOST_RHO = 0.01, 0.9   # bounds of the correlation within a unit


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame) -> float:
    """Prior strength of beta-binomial units (n, bad), by the method of moments."""
    total = units.where("n > 0").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"),
                                     F.sum(F.col("n") * F.col("n")).alias("nn"),
                                     F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    if not total.k or total.k < 2:
        return (1 - MOST_RHO) / MOST_RHO
    n, mean = float(total.n), total.bad / total.n
    within = mean * (1 - mean)
    spread = float(total.bb) - n * mean * mean
    room = within * (n - float(total.nn) / n - (total.k - 1))
    rho = (spread - within * (total.k - 1)) / room if room > 0 else MOST_RHO
    rho = min(max(rho, LEAST_RHO), MOST_RHO)
    return (1 - rho) / rho


def host_reputation(judged: DataFrame) -> DataFrame:
    """``host, bad_share, bad_bound`` for every host of ``judged`` (host, verdict)."""
    hosts = staged(judged.groupBy("host").agg(
        F.count("verdict").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
        .withColumn("domain", F.substring_index("host", ".", -2))
        .withColumn("suffix", F.substring_index("host", ".", -1)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = ((total.bad or 0) + 1) / ((total.n or 0) + 2)

    def shrunk(prior: Column, strength: float) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("n") + strength)

    # written, so that the join shuffles both sides and a suffix with most domains can be split
    by_suffix = staged(suffixes.select("suffix", shrunk(F.lit(mean), _strength(suffixes)).alias("suffix_share")),
                       "suffixes")
    by_domain = staged(domains.join(by_suffix, "suffix").select(
        "domain", shrunk(F.col("suffix_share"), _strength(domains)).alias("domain_share")), "domains")
    m = _strength(hosts)
    share = shrunk(F.col("domain_share"), m)
    return hosts.join(by_domain, "domain").select(
        "host", share.alias("bad_share"),
        (share - Z * F.sqrt(share * (1 - share) / (F.col("n") + m + 1))).alias("bad_bound"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict``: one row for each row of ``pages``."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("verdict"))
    # written, so that the join below shuffles both sides and a hot host can be split
    known = staged(host_reputation(judged.select("host", "verdict")), "reputation")
    return judged.join(known, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("bad_bound") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"))


def _sql_rules() -> str:
    rows = ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in RULES)
    return f"(VALUES {rows}) AS r(kind, rhost, rpath)"


def _sql_strength(units: str) -> str:
    return f"""(SELECT CASE WHEN count(*) < 2 THEN {(1 - MOST_RHO) / MOST_RHO!r} ELSE
      (1 - least(greatest(max(rho), {LEAST_RHO}), {MOST_RHO})) / least(greatest(max(rho), {LEAST_RHO}), {MOST_RHO}) END
      FROM (SELECT CASE WHEN room > 0 THEN (spread - within * (k - 1)) / room ELSE {MOST_RHO} END AS rho
        FROM (SELECT *, within * (sn - snn / sn - (k - 1)) AS room FROM (
          SELECT *, mean * (1 - mean) AS within, bb - sn * mean * mean AS spread FROM (
            SELECT sum(n)::DOUBLE AS sn, sum(bad)::DOUBLE / sum(n) AS mean, count(*) AS k,
              sum(n * n)::DOUBLE AS snn, sum(bad * bad::DOUBLE / n) AS bb FROM {units} WHERE n > 0))), {units} WHERE n > 0))"""


ORACLE = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS row_no FROM cut),
hit AS (SELECT row_no, max_by(rhost || rpath, length(rhost) + length(rpath)) AS rule,
    max_by(kind, length(rhost) + length(rpath)) AS verdict
  FROM part JOIN {_sql_rules()} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY row_no),
judged AS (SELECT part.*, rule, verdict FROM part LEFT JOIN hit USING (row_no)),
hosts AS (SELECT host, count(verdict) AS n, count(*) FILTER (verdict = 'block') AS bad,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
    list_extract(string_split(host, '.'), -1) AS suffix FROM judged GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
total AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) AS mean FROM suffixes),
strength AS (SELECT {_sql_strength('suffixes')} AS ms, {_sql_strength('domains')} AS md,
    {_sql_strength('hosts')} AS mh),
s AS (SELECT suffix, (bad + ms * mean) / (n + ms) AS share FROM suffixes, total, strength),
d AS (SELECT domain, (bad + md * s.share) / (n + md) AS share FROM domains JOIN s USING (suffix), strength),
h AS (SELECT host, (bad + mh * d.share) / (n + mh) AS share, n + mh + 1 AS size
  FROM hosts JOIN d USING (domain), strength)
SELECT page_id, judged.host, path, rule, coalesce(verdict,
  CASE WHEN share - {Z} * sqrt(share * (1 - share) / size) >= {BLOCK_AT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN h USING (host)
"""
