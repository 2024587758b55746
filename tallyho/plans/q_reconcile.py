"""Registered queries: resume logs, retries, lookups, versions, statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import reconcile as RC
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.q_replies import _adoption_flat, _cls_ingested
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources import readers as RD
from tallyho.sources.tables import Tables

W_LOG = with_views("search_log_flat")


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@register("filter_usable_records", sql=f"""{W_LOG}
SELECT rcid, timestamp FROM search_log_flat WHERE coalesce(error, '') = ''""")
def q_filter_usable_records(spark, sf_dir):
    """Drop records whose search errored; '' counts as no error (F2)."""
    log = B.search_log(_t(spark, sf_dir))
    return RC.filter_usable_records(log).select("rcid", "timestamp")


@register("pass_status", sql=f"""{with_views('search_log_flat', 'companies')},
st AS (SELECT rcid, bool_or(coalesce(error, '') = '') AS any_ok, bool_or(coalesce(error, '') <> '') AS any_error
       FROM search_log_flat GROUP BY rcid)
SELECT (SELECT count(CASE WHEN any_ok THEN 1 END) FROM st) AS n_ok,
  (SELECT count(CASE WHEN NOT any_ok AND any_error THEN 1 END) FROM st) AS n_error,
  (SELECT count(*) FROM st) AS n_logged,
  (SELECT count(*) FROM (SELECT DISTINCT rcid FROM companies) c WHERE c.rcid NOT IN (SELECT rcid FROM st)) AS n_remaining""")
def q_pass_status(spark, sf_dir):
    """Distinct ids ok / errored / remaining; a retried id counts once."""
    t = _t(spark, sf_dir)
    return RC.pass_status(B.search_log(t), B.companies(t))


@register("pending_work", sql=f"""{with_views('search_log_flat', 'companies')}
SELECT rcid, name FROM companies WHERE rcid NOT IN (SELECT rcid FROM search_log_flat)""")
def q_pending_work(spark, sf_dir):
    """Companies with no record yet (resume: skip successes and errors)."""
    t = _t(spark, sf_dir)
    return RC.pending_work(B.companies(t), B.search_log(t)).select("rcid", "name")


@register("pending_work_retry", sql=f"""{with_views('search_log_flat', 'companies')}
SELECT rcid, name FROM companies
WHERE rcid NOT IN (SELECT rcid FROM search_log_flat WHERE coalesce(error, '') = '')""")
def q_pending_work_retry(spark, sf_dir):
    """Companies never processed successfully (retry mode)."""
    t = _t(spark, sf_dir)
    return RC.pending_work(B.companies(t), B.search_log(t), retry_errors=True) \
        .select("rcid", "name")


@register("latest_record_per_id", sql=f"""{W_LOG}
SELECT rcid, timestamp, error FROM search_log_flat
QUALIFY row_number() OVER (PARTITION BY rcid ORDER BY timestamp DESC) = 1""")
def q_latest_record_per_id(spark, sf_dir):
    """Last record per id (dict overwrite) via a partial max_by."""
    log = B.search_log(_t(spark, sf_dir)).select(
        "rcid", "timestamp", F.col("tavily.error").alias("error"))
    return RC.latest_record_per_id(log, "rcid", "timestamp")


@register("attach_source", sql=f"""{with_views('adoption_flat', 'companies')}
SELECT a.company_id, a.genai_strict_label, a.genai_lenient_label, c.rcid, c.cb_url,
  c.homepage_url, c.category_list
FROM adoption_flat a LEFT JOIN companies c ON a.company_id = c.org_uuid""")
def q_attach_source(spark, sf_dir):
    """Results left-join the source on company_id = org_uuid."""
    res = _adoption_flat(spark, sf_dir)
    src = B.companies(_t(spark, sf_dir)).select("org_uuid", "rcid", "cb_url",
                                                "homepage_url", "category_list")
    j = RC.attach_source(res, src, "company_id", "org_uuid")
    return j.select("company_id", "genai_strict_label", "genai_lenient_label", "rcid",
                    "cb_url", "homepage_url", "category_list")


def _lookup(t):
    c = B.companies(t).select(F.col("org_uuid").alias("CompanyID"), "name", "homepage_url",
                              "rcid")
    upd = c.where(F.col("rcid") % 9 == 0).select(
        "CompanyID", F.concat(F.col("name"), F.lit(" (renamed)")).alias("name"),
        "homepage_url", "rcid")
    return c.withColumn("seq", F.lit(1)).unionByName(upd.withColumn("seq", F.lit(2)))


@register("enrich_lookup", sql=f"""{with_views('cls_parsed', 'companies')},
lk AS (SELECT org_uuid AS CompanyID, name, homepage_url, 1 AS seq FROM companies
       UNION ALL SELECT org_uuid, name || ' (renamed)', homepage_url, 2 FROM companies WHERE rcid % 9 = 0),
last AS (SELECT CompanyID, arg_max(name, seq) AS name, arg_max(homepage_url, seq) AS homepage_url
         FROM lk GROUP BY CompanyID)
SELECT p.custom_id, p.CompanyID, coalesce(l.name, 'Unknown ID') AS name,
  coalesce(l.homepage_url, '') AS homepage_url
FROM cls_parsed p LEFT JOIN last l ON p.CompanyID = l.CompanyID
WHERE p.failure_kind IS NULL""")
def q_enrich_lookup(spark, sf_dir):
    """Reply id -> name / homepage from a lookup with repeated keys, last
    wins; missing -> 'Unknown ID' / '' (J5)."""
    t = _t(spark, sf_dir)
    ok = _cls_ingested(spark, sf_dir).where(F.col("failure_kind").isNull()) \
        .select("custom_id", "CompanyID")
    return RC.enrich_lookup(ok, _lookup(t), "CompanyID", "seq",
                            {"name": S.UNKNOWN_ID, "homepage_url": ""})


@register("find_failed_requests", sql=f"""{with_views('cls_parsed', 'cls_submitted')}
SELECT DISTINCT batch_num, custom_id FROM cls_submitted s
WHERE NOT EXISTS (SELECT 1 FROM cls_parsed p WHERE p.failure_kind IS NULL
                  AND p.batch_num = s.batch_num AND p.custom_id = s.custom_id)""")
def q_find_failed_requests(spark, sf_dir):
    """submitted - successful, distinct, per batch."""
    t = _t(spark, sf_dir)
    return RC.find_failed_requests(B.submitted_requests(t), _cls_ingested(spark, sf_dir))


def _retry_sql():
    from tallyho.plans.q_text import _CID, _req_sql
    msg = Q.adoption_message()
    return f"""{with_views('cls_parsed', 'cls_submitted', 'companies')},
failed AS (SELECT DISTINCT custom_id FROM cls_submitted s
  WHERE NOT EXISTS (SELECT 1 FROM cls_parsed p WHERE p.failure_kind IS NULL
                    AND p.batch_num = s.batch_num AND p.custom_id = s.custom_id))
SELECT rcid, cid AS custom_id, request, strlen(request) + 1 AS request_bytes FROM (
  SELECT rcid, cid, {_req_sql(msg, S.ADOPTION_SYSTEM_PROMPT, json_mode=True)} AS request
  FROM (SELECT *, {_CID} AS cid FROM companies) WHERE cid IN (SELECT custom_id FROM failed))"""


@register("build_retry_batch", sql=_retry_sql())
def q_build_retry_batch(spark, sf_dir):
    """Failed ids -> their source rows -> new JSON-mode requests."""
    t = _t(spark, sf_dir)
    failed = RC.find_failed_requests(B.submitted_requests(t), _cls_ingested(spark, sf_dir))
    return RC.build_retry_batch(B.companies(t), failed, S.ADOPTION_SYSTEM_PROMPT,
                                S.DEFAULT_MODEL).select("rcid", "custom_id", "request",
                                                        "request_bytes")


W_BS = with_views("batch_status")
_LATEST = """(SELECT * FROM batch_status QUALIFY row_number() OVER (PARTITION BY batch_num ORDER BY checked_at DESC) = 1)"""


@register("batches_not_uploaded", sql=f"""{W_BS}
SELECT batch_num FROM {_LATEST} WHERE has_jsonl AND batch_id IS NULL""")
def q_batches_not_uploaded(spark, sf_dir):
    """Request files without a remote batch id."""
    latest = RC.latest_batch_status(B.batch_status(_t(spark, sf_dir)))
    return RC.batches_not_uploaded(latest)


@register("results_not_downloaded", sql=f"""{W_BS}
SELECT batch_num, batch_id FROM {_LATEST} WHERE status = 'completed' AND NOT has_results""")
def q_results_not_downloaded(spark, sf_dir):
    """Completed batches without a results file."""
    latest = RC.latest_batch_status(B.batch_status(_t(spark, sf_dir)))
    return RC.results_not_downloaded(latest)


@register("scan_latest_version", sql=f"""{with_views('runs_a', 'runs_b')}
SELECT * FROM (
  SELECT *, '2025-w09' AS run_id FROM runs_a UNION ALL BY NAME SELECT *, '2025-w10' AS run_id FROM runs_b)
WHERE run_id = (SELECT max(run_id) FROM (SELECT '2025-w09' AS run_id UNION ALL SELECT '2025-w10'))""")
def q_scan_latest_version(spark, sf_dir):
    """Whole rows of the newest tagged run only."""
    t = _t(spark, sf_dir)
    runs = (B.runs_a(t).withColumn("run_id", F.lit("2025-w09"))
            .unionByName(B.runs_b(t).withColumn("run_id", F.lit("2025-w10"))))
    return RD.scan_latest_version(runs, ["CompanyID"], "run_id")


@register("scan_latest_file", sql=f"""{with_views('runs_b')}
SELECT * FROM runs_b""")
def q_scan_latest_file(spark, sf_dir):
    """Whole rows of the newest file set only: run B is written over a second after
    run A, beside it (S6, by file time)."""
    import time
    from tallyho.sources import sinks
    t = _t(spark, sf_dir)
    path = sinks.scratch_path(spark, "runs")
    a, b = B.runs_a(t), B.runs_b(t)
    a.write.parquet(path)
    time.sleep(1.1)     # some file systems keep whole seconds
    b.write.mode("append").parquet(path)
    return RD.scan_latest_file(spark, path, b.schema)


@register("scan_jsonl_tolerant", sql=f"""{with_views('search_log_flat', 'companies', 'search_hits')}
SELECT 'good' AS kind, l.rcid, l.name, c.short_description, c.long_description AS description, c.homepage_url,
  l.timestamp, l.error, {Q.q(S.SEARCH_QUERY_PREFIX)} || coalesce(l.name, '') AS query,
  CASE WHEN coalesce(l.error, '') = '' THEN 'Summary of ' || coalesce(l.name, '') END AS answer,
  CAST(CASE WHEN coalesce(l.error, '') = '' THEN coalesce(h.n, 0) ELSE 0 END AS INTEGER) AS result_count,
  CASE WHEN coalesce(l.error, '') = '' THEN coalesce(h.texts, '') END AS results, CAST(NULL AS VARCHAR) AS line
FROM search_log_flat l JOIN companies c USING (rcid) LEFT JOIN (SELECT rcid, count(*) AS n,
  string_agg(concat_ws('|', title, url, content), chr(10) ORDER BY rnk) AS texts
  FROM search_hits GROUP BY rcid) h ON l.rcid = h.rcid
UNION ALL SELECT 'malformed', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  '{{"rcid": ' || CAST(rcid AS VARCHAR) || ', "name": '
FROM companies WHERE rcid % 50 = 25""")
def q_scan_jsonl_tolerant(spark, sf_dir):
    """Write the search log as JSON lines with blank and broken lines mixed
    in, scan it tolerantly, and return the records and the malformed lines (S3)."""
    from tallyho.sources import sinks
    t = _t(spark, sf_dir)
    log = B.search_log(t)
    lines = log.select(F.to_json(F.struct(*log.columns)).alias("value"))
    c = B.companies(t)
    broken = c.where(F.col("rcid") % 50 == 25).select(
        F.concat(F.lit('{"rcid": '), F.col("rcid").cast("string"), F.lit(', "name": ')).alias("value"))
    blank = c.where(F.col("rcid") % 50 == 26).select(F.lit("   ").alias("value"))
    path = sinks.scratch_path(spark, "search_log_jsonl")
    lines.unionByName(broken).unionByName(blank).write.text(path)
    good, bad = RD.scan_jsonl_tolerant(spark, path, S.SEARCH_PASS_SCHEMA)
    raw = F.col("tavily.raw_response")
    hits = F.array_join(F.transform(raw["results"], lambda r: F.concat_ws("|", r["title"], r["url"], r["content"])), "\n")
    return (good.select(F.lit("good").alias("kind"), "rcid", "name", "short_description", "description", "homepage_url",
                        "timestamp", F.col("tavily.error").alias("error"), F.col("tavily.query").alias("query"),
                        raw["answer"].alias("answer"), F.col("tavily.result_count").alias("result_count"),
                        hits.alias("results"))
            .unionByName(bad.select(F.lit("malformed").alias("kind"), F.col(RD.CORRUPT).alias("line")),
                         allowMissingColumns=True))


@register("rebuild_search_struct", sql=f"""{with_views('search_log_flat', 'search_hits')}
SELECT l.rcid, l.timestamp,
  CASE WHEN coalesce(l.error, '') = '' THEN 'Summary of ' || coalesce(l.name, '') END AS answer,
  CAST(CASE WHEN coalesce(l.error, '') = '' THEN coalesce(h.n, 0) ELSE 0 END AS INTEGER) AS result_count,
  CASE WHEN coalesce(l.error, '') = '' THEN coalesce(h.texts, '') ELSE '' END AS results
FROM search_log_flat l LEFT JOIN (SELECT rcid, count(*) AS n,
  string_agg(concat_ws('|', title, url, content), chr(10) ORDER BY rnk) AS texts
  FROM search_hits GROUP BY rcid) h ON l.rcid = h.rcid""")
def q_rebuild_search_struct(spark, sf_dir):
    """Stored raw JSON records -> typed search struct; the answer falls back
    to the raw response, missing keys get defaults (P21)."""
    from tallyho.operators import search as SR
    log = B.search_log(_t(spark, sf_dir))
    raw = log.select(F.to_json(F.struct(*log.columns)).alias("json"))
    rebuilt = SR.rebuild_search_struct(raw, "json")
    return rebuilt.select("rcid", "timestamp", F.col("tavily.answer").alias("answer"),
                          F.col("tavily.result_count").alias("result_count"),
                          F.array_join(F.transform("tavily.results", lambda r: F.concat_ws(
                              "|", r["title"], r["url"], r["content"])), "\n").alias("results"))
