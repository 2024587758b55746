"""Registered queries: profile text, validation, URLs, request building."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X
from tallyho.operators import profiles as P
from tallyho.operators import web as WEB
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables

W_C = with_views("companies")
_STR_COLS = ["org_uuid", "name", "cb_url", "homepage_url", "short_description",
             "long_description", "category_list", "category_groups_list",
             "created_date", "founded_date"]


def _companies(spark, sf_dir):
    return B.companies(Tables(spark, sf_dir))


@register("scan_companies", sql=f"""{W_C}
SELECT rcid, {', '.join(f'{Q.blank_to_null(c)} AS {c}' for c in _STR_COLS)} FROM companies""")
def q_scan_companies(spark, sf_dir):
    """Company scan with every blank / whitespace-only string as NULL."""
    return P.normalize_blanks(_companies(spark, sf_dir))


_URL_OK = "coalesce(regexp_matches(cb_url, '^https?://[^\\s/?#]+'), false)"
_ERRORS = f"""list_filter([
  CASE WHEN rcid IS NULL THEN 'rcid: missing' END,
  CASE WHEN rcid IS NOT NULL AND TRY_CAST(CAST(rcid AS VARCHAR) AS BIGINT) IS NULL THEN 'rcid: not an integer' END,
  CASE WHEN {Q.is_blank('org_uuid')} THEN 'org_uuid: missing' END,
  CASE WHEN NOT {_URL_OK} THEN 'cb_url: not a URL' END], lambda e: e IS NOT NULL)"""


@register("scan_validated", sql=f"""{W_C}
SELECT TRY_CAST(CAST(rcid AS VARCHAR) AS BIGINT) AS rcid, {Q.strip_ws('org_uuid')} AS org_uuid,
  CASE WHEN {Q.is_blank('name')} THEN 'Unknown' ELSE {Q.strip_ws('name')} END AS name,
  cb_url, homepage_url, short_description, long_description,
  {Q.parse_categories('category_list')} AS categories, founded_date
FROM companies WHERE len({_ERRORS}) = 0""")
def q_scan_validated(spark, sf_dir):
    """Typed validation; passing rows with empty name -> 'Unknown' (S2)."""
    return P.scan_validated(_companies(spark, sf_dir))


@register("scan_quarantine", sql=f"""{W_C}
SELECT CAST(rcid AS VARCHAR) AS rcid, name, array_to_string({_ERRORS}, '; ') AS error
FROM companies WHERE len({_ERRORS}) > 0""")
def q_scan_quarantine(spark, sf_dir):
    """Rows failing validation with their reasons, kept not dropped."""
    return P.scan_quarantine(_companies(spark, sf_dir))


@register("extract_year", sql=f"""{W_C}
SELECT rcid, founded_date, {Q.extract_year('founded_date')} AS year_founded FROM companies""")
def q_extract_year(spark, sf_dir):
    """First standalone 19xx/20xx year of founded_date, else 'N/A' (P1)."""
    return _companies(spark, sf_dir).select(
        "rcid", "founded_date", X.extract_year("founded_date").alias("year_founded"))


@register("blank_to_na", sql=f"""{W_C}
SELECT rcid, {Q.blank_to_na('short_description')} AS short_na,
  {Q.blank_to_na('long_description')} AS long_na FROM companies""")
def q_blank_to_na(spark, sf_dir):
    """NULL / blank / whitespace (NBSP too) -> 'N/A', else trimmed."""
    return _companies(spark, sf_dir).select(
        "rcid", X.blank_to_na("short_description").alias("short_na"),
        X.blank_to_na("long_description").alias("long_na"))


@register("merge_keywords", sql=f"""{W_C}
SELECT rcid, {Q.merge_keywords('category_list', 'category_groups_list')} AS keywords FROM companies""")
def q_merge_keywords(spark, sf_dir):
    """'categories, groups' / whichever exists / 'N/A' (P3)."""
    return _companies(spark, sf_dir).select(
        "rcid", X.merge_keywords("category_list", "category_groups_list")
        .alias("keywords"))


@register("build_profile_message", sql=f"""{W_C}
SELECT rcid, {Q.profile_message()} AS message FROM companies""")
def q_build_profile_message(spark, sf_dir):
    """Six-field request text per company over whole descriptions."""
    df = _companies(spark, sf_dir)
    return df.select("rcid", P.profile_message(df).alias("message"))


_ABLATED = ("id", "name", "short", "keywords", "year")


@register("build_profile_message_ablated", sql=f"""{W_C}
SELECT rcid, {Q.profile_message(_ABLATED)} AS message FROM companies""")
def q_build_profile_message_ablated(spark, sf_dir):
    """Request text without the long description (input ablation, P4b)."""
    df = _companies(spark, sf_dir)
    return df.select("rcid", P.profile_message(df, _ABLATED).alias("message"))


@register("build_adoption_message", sql=f"""{W_C}
SELECT rcid, {Q.adoption_message()} AS message FROM companies""")
def q_build_adoption_message(spark, sf_dir):
    """Four-line Name / Short / Long / Categories text."""
    return _companies(spark, sf_dir).select(
        "rcid", X.build_adoption_message("name", "short_description",
                                         "long_description", "category_list")
        .alias("message"))


_CID = (f"CASE WHEN {Q.is_blank('org_uuid')} THEN 'startup-row-' || CAST(rcid AS VARCHAR) "
        f"ELSE 'startup-' || {Q.strip_ws('org_uuid')} END")


def _req_sql(message_sql: str, prompt: str, json_mode: bool = False) -> str:
    rf = ", response_format: {type: 'json_object'}" if json_mode else ""
    return (f"to_json({{custom_id: cid, method: 'POST', url: '/v1/chat/completions', "
            f"body: {{model: {Q.q(S.DEFAULT_MODEL)}, messages: ["
            f"{{role: 'system', content: {Q.q(prompt)}}}, "
            f"{{role: 'user', content: {message_sql}}}]{rf}}}}})::VARCHAR")


@register("build_batch_request", sql=f"""{W_C}
SELECT rcid, cid AS custom_id, request, strlen(request) + 1 AS request_bytes FROM (
  SELECT rcid, cid, {_req_sql(Q.profile_message(), S.CLASSIFY_SYSTEM_PROMPT)} AS request
  FROM (SELECT *, {_CID} AS cid FROM companies))""")
def q_build_batch_request(spark, sf_dir):
    """Serialised chat request per company; custom_id falls back to the
    row key when org_uuid is missing (P5)."""
    df = _companies(spark, sf_dir)
    return P.build_requests(df, S.CLASSIFY_SYSTEM_PROMPT, S.DEFAULT_MODEL)


@register("estimate_request_size", sql=f"""{W_C}
SELECT count(*) AS requests, CAST(sum(strlen(request) + 1) AS BIGINT) AS total_bytes,
  max(strlen(request) + 1) AS max_bytes,
  round(avg(strlen(request) + 1), 6) AS avg_bytes,
  count(*) * {S.EVEN_PLAN_TOKENS_PER_REQUEST} AS est_tokens
FROM (SELECT {_req_sql(Q.profile_message(), S.CLASSIFY_SYSTEM_PROMPT)} AS request
      FROM (SELECT *, {_CID} AS cid FROM companies))""")
def q_estimate_request_size(spark, sf_dir):
    """Bytes of every serialised request and the token estimate."""
    df = _companies(spark, sf_dir)
    r = P.build_requests(df, S.CLASSIFY_SYSTEM_PROMPT, S.DEFAULT_MODEL)
    return r.agg(F.count(F.lit(1)).alias("requests"),
                 F.sum("request_bytes").alias("total_bytes"),
                 F.max("request_bytes").alias("max_bytes"),
                 F.round(F.avg("request_bytes"), 6).alias("avg_bytes"),
                 (F.count(F.lit(1)) * S.EVEN_PLAN_TOKENS_PER_REQUEST)
                 .alias("est_tokens"))


@register("parse_categories", sql=f"""{W_C}
SELECT rcid, {Q.parse_categories('category_list')} AS categories FROM companies""")
def q_parse_categories(spark, sf_dir):
    """Comma list -> trimmed array; NULL/empty -> []."""
    return _companies(spark, sf_dir).select(
        "rcid", X.parse_categories("category_list").alias("categories"))


@register("sanitize_unicode", sql=f"""
SELECT doc_id, {Q.sanitize('text')} AS text FROM documents""")
def q_sanitize_unicode(spark, sf_dir):
    """Twelve typographic characters -> ASCII over whole document texts."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", X.sanitize_unicode("text").alias("text"))


W_S = with_views("site_checks")


@register("normalize_url", sql=f"""{W_C}
SELECT rcid, {Q.normalize_url('homepage_url')} AS url,
  {Q.normalize_url('homepage_url')} IS NULL AS no_url FROM companies""")
def q_normalize_url(spark, sf_dir):
    """https:// added when no http(s) scheme; missing URL flagged."""
    u = X.normalize_url("homepage_url")
    return _companies(spark, sf_dir).select("rcid", u.alias("url"),
                                            u.isNull().alias("no_url"))


@register("detect_redirect", sql=f"""{W_S}
SELECT rcid, url, final_url, {Q.detect_redirect('url', 'final_url')} AS is_redirect FROM site_checks""")
def q_detect_redirect(spark, sf_dir):
    """Host differs after lower-casing and removing 'www.' (P9)."""
    s = B.site_checks(Tables(spark, sf_dir))
    return s.select("rcid", "url", "final_url",
                    X.detect_redirect("url", "final_url").alias("is_redirect"))


_ERRCAT = """CASE WHEN error IS NULL THEN NULL
  WHEN contains(error, 'Timeout') OR contains(error, 'timed out') THEN 'Timeout'
  WHEN contains(error, 'Name or service not known') OR contains(error, 'getaddrinfo failed') THEN 'DNS lookup failed'
  WHEN contains(error, 'Connection refused') THEN 'Connection refused'
  WHEN starts_with(error, 'Connect') THEN 'Connection failed'
  WHEN contains(lower(error), 'redirect') THEN 'Too many redirects'
  ELSE error END"""


@register("classify_liveness", sql=f"""{W_S}
SELECT rcid, coalesce({Q.normalize_url('url')}, '') AS url,
  coalesce(status_code >= 200 AND status_code < 400, false) AS is_alive, status_code,
  CASE WHEN {Q.normalize_url('url')} IS NULL THEN 'No URL provided' ELSE {_ERRCAT} END AS error,
  {Q.detect_redirect(Q.normalize_url('url'), 'final_url')} AS is_redirect
FROM site_checks""")
def q_classify_liveness(spark, sf_dir):
    """alive iff 200 <= status < 400; network errors -> categories (P10)."""
    return WEB.classify_liveness(B.site_checks(Tables(spark, sf_dir)))


W_API = with_views("api_calls")
_RETRY_KINDS = Q.arr(WEB.RETRYABLE_ERROR_KINDS)
_OK = "(status_code >= 200 AND status_code < 300 AND error_kind IS NULL)"
_RETRYABLE = (f"(NOT {_OK} AND (coalesce(status_code IN {tuple(S.RETRYABLE_STATUS_CODES)}, false) "
              f"OR coalesce(list_contains({_RETRY_KINDS}, error_kind), false)))")


@register("classify_retryable", sql=f"""{W_API}
SELECT call_id, service, status_code, error_kind, {_OK} AS ok, {_RETRYABLE} AS retryable FROM api_calls""")
def q_classify_retryable(spark, sf_dir):
    """Transient statuses / network errors are retryable."""
    return WEB.classify_retryable(B.api_calls(Tables(spark, sf_dir)))


@register("backoff_schedule", sql=f"""{W_API}
SELECT call_id, service, CAST(r AS INTEGER) AS retry, {S.RETRY_BASE_DELAY_SEC} * pow(2.0, r) AS delay_sec
FROM api_calls CROSS JOIN range({S.RETRY_MAX_ATTEMPTS}) t(r) WHERE {_RETRYABLE}""")
def q_backoff_schedule(spark, sf_dir):
    """Retries of each retryable failure with delay base * 2^attempt."""
    return WEB.backoff_schedule(B.api_calls(Tables(spark, sf_dir)))


@register("build_search_query", sql=f"""{W_C}
SELECT rcid, {Q.q(S.SEARCH_QUERY_PREFIX)} || coalesce(name, '') AS query FROM companies""")
def q_build_search_query(spark, sf_dir):
    """'Find information on the company <name>' per company."""
    return _companies(spark, sf_dir).select(
        "rcid", X.build_search_query("name").alias("query"))


@register("coerce_numeric", sql=f"""{with_views('runs_a')}
SELECT CompanyID, {Q.coerce_numeric('AI_native')} AS label, {Q.coerce_numeric('Confidence_1to5')} AS confidence
FROM runs_a""")
def q_coerce_numeric(spark, sf_dir):
    """Unparseable reply values (and 'nan') -> NULL, '1.0' -> 1.0."""
    r = B.runs_a(Tables(spark, sf_dir))
    return r.select("CompanyID", X.coerce_numeric("AI_native").alias("label"),
                    X.coerce_numeric("Confidence_1to5").alias("confidence"))


@register("safe_ratio", sql=f"""{with_views('batch_status')}
SELECT batch_id, checked_at, round({Q.pct('completed', 'total')}, 6) AS progress_pct,
  round({Q.ratio('completed + failed', 'total')}, 6) AS done_share
FROM batch_status""")
def q_safe_ratio(spark, sf_dir):
    """Progress % per snapshot, 0 when the total is 0."""
    s = B.batch_status(Tables(spark, sf_dir))
    return s.select("batch_id", "checked_at",
                    F.round(X.safe_pct("completed", "total"), 6).alias("progress_pct"),
                    F.round(X.safe_ratio(F.col("completed") + F.col("failed"),
                                         "total"), 6).alias("done_share"))


@register("filter_both_descriptions", sql=f"""{W_C}
SELECT rcid, name FROM companies
WHERE NOT {Q.is_blank('short_description')} AND NOT {Q.is_blank('long_description')}""")
def q_filter_both_descriptions(spark, sf_dir):
    """Keep companies with non-blank short and long text (F1)."""
    return P.filter_both_descriptions(_companies(spark, sf_dir)).select("rcid", "name")


_NAME_PATTERN = r"doc 1\d*7$"


@register("search_by_name", sql=f"""{W_C}
SELECT rcid, name FROM companies WHERE regexp_matches(name, {Q.q('(?i)' + _NAME_PATTERN)})""")
def q_search_by_name(spark, sf_dir):
    """Case-insensitive regex *contains* on the name; NULL never matches."""
    return P.search_by_name(_companies(spark, sf_dir), _NAME_PATTERN).select("rcid", "name")


@register("lookup_by_key", sql=f"""{W_C}
SELECT rcid, org_uuid, name FROM companies WHERE rcid = 7 LIMIT 1""")
def q_lookup_by_key(spark, sf_dir):
    """First company row with rcid = 7."""
    return P.lookup_by_key(_companies(spark, sf_dir), "rcid", 7).select(
        "rcid", "org_uuid", "name")


@register("description_coverage", sql=f"""{W_C}
SELECT count(*) AS total, count(CASE WHEN NOT {Q.is_blank('short_description')} THEN 1 END) AS has_short,
  count(CASE WHEN NOT {Q.is_blank('long_description')} THEN 1 END) AS has_long,
  count(CASE WHEN NOT {Q.is_blank('short_description')} AND NOT {Q.is_blank('long_description')} THEN 1 END) AS has_both,
  round({Q.pct("count(CASE WHEN NOT " + Q.is_blank('short_description') + " AND NOT " + Q.is_blank('long_description') + " THEN 1 END)", 'count(*)')}, 6) AS pct_retained
FROM companies""")
def q_description_coverage(spark, sf_dir):
    """Has short / long / both and % retained by the both-filter."""
    return P.description_coverage(_companies(spark, sf_dir))
