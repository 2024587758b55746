"""Registered queries: request batching, slices, samples, request files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X
from tallyho.operators import batching as BT
from tallyho.operators import profiles as P
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.q_text import _CID, _req_sql
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources import readers as RD
from tallyho.sources.tables import Tables

W_C = with_views("companies")
CHUNK = 200
#: Small limits, so that the test tables fill many batches of every kind.
CAP = BT.even_plan_cap(max_requests=90)
GREEDY_MAX_ROWS, GREEDY_MAX_BYTES = 60, 128 * 1024


def _companies(spark, sf_dir):
    return B.companies(Tables(spark, sf_dir))


_EVEN = f"""SELECT rcid, CAST(least(floor(idx / sz) + 1, nb) AS INTEGER) AS batch_num FROM (
  SELECT rcid, idx, nb, greatest(floor(n / nb), 1) AS sz FROM (
    SELECT rcid, idx, n, greatest(ceil(n / {CAP}), 1) AS nb FROM (
      SELECT rcid, row_number() OVER (ORDER BY rcid) - 1 AS idx, count(*) OVER () AS n FROM companies)))"""


@register("plan_even_batches", sql=f"""{W_C}
{_EVEN}""")
def q_plan_even_batches(spark, sf_dir):
    """Even plan: cap = min(token, size, count limits); ceil(N/cap) batches of
    N//n rows, last takes the rest (W1, distributed global index)."""
    return BT.plan_even_batches(_companies(spark, sf_dir).select("rcid"), ["rcid"], CAP)


@register("chunk_fixed", sql=f"""{W_C}
SELECT rcid, CAST(floor((row_number() OVER (ORDER BY rcid) - 1) / {CHUNK}) + 1 AS INTEGER) AS chunk
FROM companies""")
def q_chunk_fixed(spark, sf_dir):
    """Fixed 200-row chunks in id order, the last one short."""
    return BT.chunk_fixed(_companies(spark, sf_dir).select("rcid"), ["rcid"], CHUNK)


@register("slice_rows", sql=f"""{W_C}
SELECT rcid, name FROM companies ORDER BY rcid LIMIT 200 OFFSET 100""")
def q_slice_rows(spark, sf_dir):
    """Rows [100, 300) in id order, selected in parallel."""
    return BT.slice_rows(_companies(spark, sf_dir).select("rcid", "name"), ["rcid"], 100, 200)


def _seeded_sql(k: str, seed: int) -> str:
    p = 2147483647
    h = f"(({k} % {p}) * 48271 + {seed}) % {p}"
    h = f"(({h}) * ({h})) % {p}"
    h = f"(({h}) * 48271 + {seed}) % {p}"
    return f"(({h}) * ({h})) % {p}"


@register("sample_n_seeded", sql=f"""{W_C}
SELECT rcid, name FROM companies ORDER BY {_seeded_sql('rcid', 42)}, rcid LIMIT 50""")
def q_sample_n_seeded(spark, sf_dir):
    """Exactly 50 companies, reproducible for seed 42 (S8; the limit is
    the feature)."""
    return RD.sample_n_seeded(_companies(spark, sf_dir).select("rcid", "name"), "rcid", 50, 42)


_REQ = f"""SELECT rcid, strlen({_req_sql(Q.profile_message(), S.CLASSIFY_SYSTEM_PROMPT)}) + 1 AS bytes
FROM (SELECT *, {_CID} AS cid FROM companies)"""


@register("plan_greedy_batches", sql=f"""{W_C.replace('WITH ', 'WITH RECURSIVE ', 1)},
req AS ({_REQ}),
x AS (SELECT rcid, bytes, row_number() OVER (ORDER BY rcid) AS i FROM req),
g(i, rcid, batch, cnt, used) AS (
  SELECT i, rcid, 1, 1, bytes FROM x WHERE i = 1
  UNION ALL
  SELECT x.i, x.rcid,
    CASE WHEN g.cnt >= {GREEDY_MAX_ROWS} OR g.used + x.bytes > {GREEDY_MAX_BYTES} THEN g.batch + 1 ELSE g.batch END,
    CASE WHEN g.cnt >= {GREEDY_MAX_ROWS} OR g.used + x.bytes > {GREEDY_MAX_BYTES} THEN 1 ELSE g.cnt + 1 END,
    CASE WHEN g.cnt >= {GREEDY_MAX_ROWS} OR g.used + x.bytes > {GREEDY_MAX_BYTES} THEN x.bytes ELSE g.used + x.bytes END
  FROM g JOIN x ON x.i = g.i + 1)
SELECT g.rcid, x.bytes AS request_bytes, CAST(g.batch AS INTEGER) AS batch_num, x.bytes > {GREEDY_MAX_BYTES} AS oversize
FROM g JOIN x ON g.i = x.i""")
def q_plan_greedy_batches(spark, sf_dir):
    """Greedy packing: close a batch at 60 requests or when the next line
    would pass 128 KiB; equal to the sequential rule at any size (W2)."""
    req = P.build_requests(_companies(spark, sf_dir), S.CLASSIFY_SYSTEM_PROMPT,
                           S.DEFAULT_MODEL)
    plan = BT.plan_greedy_batches(req.select("rcid", "request_bytes"), "rcid", "request_bytes",
                                  GREEDY_MAX_ROWS, GREEDY_MAX_BYTES)
    return plan.select("rcid", "request_bytes", "batch_num", "oversize")


@register("sink_request_jsonl", sql=f"""{W_C},
plan AS ({_EVEN}),
req AS (SELECT rcid, {_req_sql(Q.profile_message(), S.CLASSIFY_SYSTEM_PROMPT)} AS request
        FROM (SELECT *, {_CID} AS cid FROM companies))
SELECT p.batch_num, r.request FROM req r JOIN plan p ON r.rcid = p.rcid""")
def q_sink_request_jsonl(spark, sf_dir):
    """Write one JSONL request-file set per even-plan batch, then read back
    every line with the batch it was filed under (S10)."""
    from tallyho.sources import sinks
    c = _companies(spark, sf_dir)
    req = P.build_requests(c, S.CLASSIFY_SYSTEM_PROMPT, S.DEFAULT_MODEL)
    plan = BT.plan_even_batches(c.select("rcid"), ["rcid"], CAP)
    path = sinks.scratch_path(spark, "requests")
    sinks.sink_request_jsonl(req.join(plan, "rcid"), path)
    return spark.read.text(path).select(F.col("batch_num").cast("int").alias("batch_num"),
                                        F.col("value").alias("request"))


_DESIGNS = [("full", 3600), ("short_only", 3400)]
_DAILY = 1_000_000_000


@register("token_budget", sql=f"""{W_C},
n AS (SELECT count(*) AS requests FROM companies
      WHERE NOT {Q.is_blank('short_description')} AND NOT {Q.is_blank('long_description')})
SELECT d.design, n.requests, CAST(d.tpr AS BIGINT) AS tokens_per_request,
  n.requests * d.tpr AS total_tokens, n.requests * ({_DESIGNS[0][1]} - d.tpr) AS tokens_saved,
  round(n.requests * d.tpr * 100.0 / {_DAILY}, 6) AS pct_of_daily_limit
FROM n CROSS JOIN (VALUES {', '.join(f"('{a}', {b})" for a, b in _DESIGNS)}) d(design, tpr)""")
def q_token_budget(spark, sf_dir):
    """Tokens for full vs short-only input on rows with both texts; saving
    and % of a 1 B/day limit (A21)."""
    rows = P.filter_both_descriptions(_companies(spark, sf_dir))
    return BT.token_budget(rows, _DESIGNS, _DAILY)


_CSV_COLS = S.COMPANY_CSV_SCHEMA.fieldNames()


@register("scan_companies_csv", sql=f"""{W_C}
SELECT CAST(rcid AS VARCHAR) AS rcid, {', '.join(f'{Q.blank_to_null(c)} AS {c}' for c in _CSV_COLS if c != 'rcid')}
FROM companies""")
def q_scan_companies_csv(spark, sf_dir):
    """Write the whole company table as CSV (quotes, commas, newlines inside
    fields) and scan it back with the declared schema; blanks -> NULL (S1)."""
    from tallyho.sources import sinks
    path = sinks.scratch_path(spark, "companies_csv")
    sinks.sink_fixed_csv(_companies(spark, sf_dir), _CSV_COLS, path)
    return RD.scan_companies_csv(spark, path)


@register("sink_jsonl_append", sql=f"""{W_C}
SELECT rcid, {Q.q(S.SEARCH_QUERY_PREFIX)} || coalesce(name, '') AS query FROM companies
UNION ALL SELECT rcid, {Q.q(S.SEARCH_QUERY_PREFIX)} || coalesce(name, '') FROM companies""")
def q_sink_jsonl_append(spark, sf_dir):
    """Append the same records twice to a JSON-lines log and read the log
    back: appends keep earlier lines.  Files of a writer that died before its
    commit, and a retry of an append that is in the log, add nothing (S9)."""
    from tallyho.sources import commits, sinks
    c = _companies(spark, sf_dir).select("rcid", X.build_search_query("name").alias("query"))
    path = sinks.scratch_path(spark, "log")
    commits.write_files(c, path, "second", "json")
    for commit in ("first", "second", "first"):
        sinks.sink_jsonl_append(c, path, commit)
    return sinks.read_jsonl_log(spark, path, "rcid bigint, query string")
