"""Registered queries: search-pass records (flatten, explode, prompts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import search as SR
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables

W = with_views("search_log_flat", "search_hits", "companies", "site_checks")
_OK = "coalesce(l.error, '') = ''"


def _log(spark, sf_dir):
    return B.search_log(Tables(spark, sf_dir))


@register("explode_snippets", sql=f"""{W}
SELECT l.rcid, CAST(h.rnk AS INTEGER) AS rank, h.title, h.url, h.score
FROM search_log_flat l JOIN search_hits h ON l.rcid = h.rcid WHERE {_OK}""")
def q_explode_snippets(spark, sf_dir):
    """One row per search hit with its rank."""
    return SR.explode_snippets(_log(spark, sf_dir))


_WIDE = ", ".join(
    f"coalesce(max(CASE WHEN h.rnk = {i} THEN h.{f} END), '') AS result_{i}_{f}"
    for i in range(1, 6) for f in ("title", "url", "content"))


@register("flatten_top_results", sql=f"""{W}
SELECT l.rcid, l.name,
  CASE WHEN {_OK} THEN 'Summary of ' || coalesce(l.name, '') ELSE '' END AS answer,
  CAST(CASE WHEN {_OK} THEN count(h.rnk) ELSE 0 END AS INTEGER) AS result_count,
  {_WIDE}
FROM search_log_flat l LEFT JOIN search_hits h ON l.rcid = h.rcid AND {_OK}
GROUP BY l.rcid, l.name, l.error, l.day""")
def q_flatten_top_results(spark, sf_dir):
    """Up to 5 nested hits -> 15 wide columns, answer falls back to the raw
    response (P20)."""
    return SR.flatten_top_results(_log(spark, sf_dir))


def _prompt_sql():
    snippets = ("string_agg(CAST(h.rnk AS VARCHAR) || '. ' || coalesce(h.title, '') || chr(10) || "
                "coalesce(h.url, '') || chr(10) || coalesce(h.content, ''), chr(10) || chr(10) ORDER BY h.rnk)")
    profile = ("concat_ws(chr(10), 'Company: ' || " + Q.null_to_na("c.name") +
               ", 'Description: ' || " + Q.blank_to_na("c.short_description") +
               ", 'About: ' || " + Q.blank_to_na("c.long_description") +
               ", 'Homepage: ' || " + Q.blank_to_na("c.homepage_url") + ")")
    website = ("'Website: ' || CASE WHEN s.rcid IS NULL THEN 'unreachable (No URL provided)' "
               "WHEN s.status_code BETWEEN 200 AND 399 THEN 'reachable (status ' || CAST(s.status_code AS VARCHAR) || ')' "
               "ELSE 'unreachable (' || coalesce(s.error, 'no response') || ')' END")
    summary = f"CASE WHEN {_OK} THEN 'Search summary: Summary of ' || coalesce(l.name, '') END"
    evidence = (f"CASE WHEN coalesce(l.error, '') <> '' THEN 'Search failed: ' || l.error "
                f"WHEN count(h.rnk) = 0 THEN 'No search results found.' "
                f"ELSE 'Search results (' || CAST(count(h.rnk) AS VARCHAR) || ' found):' || chr(10) || {snippets} END")
    return f"""{W}
SELECT l.rcid, l.timestamp,
  concat_ws(chr(10) || chr(10), any_value({profile}), any_value({website}), any_value({summary}), {evidence}) AS prompt
FROM search_log_flat l JOIN companies c ON l.rcid = c.rcid
LEFT JOIN site_checks s ON s.rcid = l.rcid
LEFT JOIN search_hits h ON l.rcid = h.rcid AND {_OK}
GROUP BY l.rcid, l.timestamp, l.error, l.name"""


@register("build_evidence_prompt", sql=_prompt_sql())
def q_build_evidence_prompt(spark, sf_dir):
    """Classifier prompt from a search record: profile, website line,
    summary, numbered snippets; error / no-result branches (P13)."""
    return SR.build_evidence_prompt(_log(spark, sf_dir))


@register("build_pass_record", sql=f"""{W}
SELECT c.rcid, c.name, c.short_description, c.long_description AS description, c.homepage_url,
  {Q.normalize_url('c.homepage_url')} AS website_url,
  coalesce(s.status_code BETWEEN 200 AND 399, false) AS is_alive, s.status_code, s.final_url,
  CASE WHEN c.homepage_url IS NULL THEN {Q.q(S.NO_URL_MESSAGE)} ELSE s.error END AS error,
  CAST(coalesce(h.n, 0) AS INTEGER) AS result_count, coalesce(h.texts, '') AS results,
  'Find information on the company ' || coalesce(c.name, '') AS query
FROM companies c
LEFT JOIN site_checks s ON s.rcid = c.rcid
LEFT JOIN (SELECT rcid, count(*) AS n, string_agg(concat_ws('|', title, url, content), chr(10) ORDER BY rnk) AS texts
  FROM search_hits GROUP BY rcid) h ON h.rcid = c.rcid""")
def q_build_pass_record(spark, sf_dir):
    """Compose each company's nested pass record from profile, website
    check and search hits (P22)."""
    t = Tables(spark, sf_dir)
    checks = B.site_checks(t).select(
        "rcid", F.col("status_code").between(200, 399).alias("is_alive"), "status_code",
        "final_url", "error")
    hits = B._search_results(t)
    rec = SR.build_pass_record(B.companies(t), checks, hits, "2026-01-01T00:00:00")
    return rec.select("rcid", "name", "short_description", "description", "homepage_url",
                      F.col("website_check.url").alias("website_url"),
                      *[F.col(f"website_check.{c}").alias(c) for c in ("is_alive", "status_code", "final_url", "error")],
                      F.array_join(F.transform("tavily.raw_response.results", lambda r: F.concat_ws(
                          "|", r["title"], r["url"], r["content"])), "\n").alias("results"),
                      F.col("tavily.result_count").alias("result_count"),
                      F.col("tavily.query").alias("query"))
