"""Registered queries: ingesting replies, flattening, failures, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import error_codes as EC
from tallyho.operators import findings as FD
from tallyho.operators import labelers as L
from tallyho.operators import replies as R
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables

RUN_TS = "2026-01-01 00:00:00"


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


def _cls_ingested(spark, sf_dir):
    t = _t(spark, sf_dir)
    return R.ingest_classification_replies(B.classification_responses(t))


def _adoption_flat(spark, sf_dir):
    return R.adoption_table(B.adoption_responses(_t(spark, sf_dir)))


@register("lexical_ai_native", sql=f"""{with_views('u2')}
SELECT rcid, custom_id, CompanyID, CompanyName, AI_native, Confidence_1to5,
  Reasons_3_points, Sources_used, Verification_critique FROM u2""")
def q_lexical_ai_native(spark, sf_dir):
    """Rule labeller over whole descriptions, in reply form."""
    return L.lexical_ai_native(B.companies(_t(spark, sf_dir)))


@register("scan_batch_responses", sql=f"""{with_views('cls_responses')}
SELECT batch_num, custom_id, status_code, n_choices, content, error_message FROM cls_responses""")
def q_scan_batch_responses(spark, sf_dir):
    """Nested batch responses -> (id, status, content, error)."""
    return R.scan_batch_responses(B.classification_responses(_t(spark, sf_dir)))


_REPLY_COLS = ", ".join(S.REPLY_COLUMNS)


@register("parse_csv_reply", sql=f"""{with_views('cls_parsed')}
SELECT custom_id, {_REPLY_COLS}, csv_ok FROM cls_parsed""")
def q_parse_csv_reply(spark, sf_dir):
    """First CSV record of each reply, >= 7 fields, first 7 trimmed."""
    return _cls_ingested(spark, sf_dir).select("custom_id", *S.REPLY_COLUMNS, "csv_ok")


@register("drop_unidentified", sql=f"""{with_views('cls_parsed')}
SELECT batch_num, {_REPLY_COLS} FROM cls_parsed WHERE CompanyID <> ''""")
def q_drop_unidentified(spark, sf_dir):
    """Parsed replies with an empty CompanyID are dropped."""
    return R.drop_unidentified(_cls_ingested(spark, sf_dir)).select(
        "batch_num", *S.REPLY_COLUMNS)


@register("merge_batch_outputs", sql=f"""{with_views('cls_parsed')}
SELECT batch_num, {', '.join(f"nullif({c}, '') AS {c}" for c in S.REPLY_COLUMNS)}
FROM cls_parsed WHERE CompanyID <> ''""")
def q_merge_batch_outputs(spark, sf_dir):
    """Write each batch's parsed output as its own CSV file set, then read
    them all back in one scan in the fixed 7-column order (S5).  As with any
    CSV read, an empty field comes back as NULL."""
    from tallyho.sources import readers, sinks
    parsed = R.drop_unidentified(_cls_ingested(spark, sf_dir)).select(
        "batch_num", *S.REPLY_COLUMNS)
    path = sinks.scratch_path(spark, "batch_outputs")
    (parsed.write.partitionBy("batch_num").option("header", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    merged = readers.merge_batch_outputs(spark, path)
    return merged.select(
        F.regexp_extract("source_file", r"batch_num=(\d+)", 1).cast("int")
        .alias("batch_num"), *S.REPLY_COLUMNS)


_FAIL_UNION = """SELECT failure_kind, status_code FROM cls_parsed
UNION ALL SELECT 'missing' AS failure_kind, NULL AS status_code FROM cls_submitted s
WHERE NOT EXISTS (SELECT 1 FROM cls_responses r WHERE r.batch_num = s.batch_num AND r.custom_id = s.custom_id)"""


@register("failure_taxonomy", sql=f"""{with_views('cls_parsed', 'cls_submitted')}
SELECT coalesce(failure_kind, 'ok') AS outcome, count(*) AS n FROM ({_FAIL_UNION})
GROUP BY 1 ORDER BY n DESC, outcome""")
def q_failure_taxonomy(spark, sf_dir):
    """ok / http_error / empty_choices / bad_reply / missing counts."""
    t = _t(spark, sf_dir)
    ing = R.with_missing(_cls_ingested(spark, sf_dir), B.submitted_requests(t))
    return R.failure_taxonomy(ing)


@register("top_error_codes", sql=f"""{with_views('cls_parsed')}
SELECT status_code, count(*) AS n FROM cls_parsed WHERE status_code <> 200
GROUP BY 1 ORDER BY n DESC, status_code""")
def q_top_error_codes(spark, sf_dir):
    """Error status codes by count, descending (T5)."""
    return R.top_error_codes(_cls_ingested(spark, sf_dir))


@register("batch_error_codes", sql=f"""{with_views('batch_error_rows')}
SELECT batch_num, CAST(row_number() OVER (PARTITION BY batch_num ORDER BY n DESC, code) AS INTEGER) AS rank, code, n
FROM (SELECT batch_num, code, count(*) AS n FROM batch_error_rows GROUP BY 1, 2)""")
def q_batch_error_codes(spark, sf_dir):
    """Codes of each batch's error list by count, descending (T5)."""
    return EC.batch_error_codes(B.batch_errors(_t(spark, sf_dir)))


@register("top_batch_error_codes", sql=f"""{with_views('batch_error_rows')}
SELECT code, count(*) AS n FROM batch_error_rows GROUP BY 1 ORDER BY n DESC, code LIMIT 10""")
def q_top_batch_error_codes(spark, sf_dir):
    """The ten most frequent error codes of all batches' lists, counted exactly
    without counting every free-form code (T5; the limit is the feature)."""
    return EC.top_batch_error_codes(B.batch_errors(_t(spark, sf_dir)))


@register("failure_log", sql=f"""{with_views('cls_parsed')}
SELECT batch_num, custom_id, failure_kind, status_code,
  coalesce(error_message, failure_kind) AS error, content
FROM cls_parsed WHERE failure_kind IS NOT NULL""")
def q_failure_log(spark, sf_dir):
    """Failed items with kind, error and the whole reply."""
    return R.failure_log(_cls_ingested(spark, sf_dir))


_U3_COLS = ", ".join(R.ADOPTION_FLAT_COLUMNS)


@register("lexical_adoption_modes", sql=f"""{with_views('u3')}
SELECT custom_id, {_U3_COLS} FROM u3""")
def q_lexical_adoption_modes(spark, sf_dir):
    """Three nested-vocabulary labels per company, flattened."""
    lab = L.lexical_adoption_modes(B.companies(_t(spark, sf_dir)))
    a = F.col("adoption")
    kws, det = R.join_function_lists(a["genai_functions"])
    cols = []
    for m in S.ADOPTION_MODES:
        cols += [a[f"genai_adoption_{m}"]["label"].alias(f"genai_{m}_label"),
                 a[f"genai_adoption_{m}"]["confidence"].alias(f"genai_{m}_confidence")]
    return lab.select("custom_id", "company_id", "company_name", *cols,
                      a["primary_assessment"].alias("primary_assessment"),
                      F.when(a["no_evidence_of_genai_use"], F.lit(1)).otherwise(F.lit(0))
                      .alias("no_evidence_flag"),
                      kws.alias("genai_functions_list"), det.alias("genai_functions_details"),
                      F.array_join(a["reasoning"], " ").alias("reasoning"))


@register("flatten_adoption_json", sql=f"""{with_views('adoption_flat')}
SELECT {_U3_COLS} FROM adoption_flat""")
def q_flatten_adoption_json(spark, sf_dir):
    """Nested three-mode JSON replies -> 13 flat columns with defaults."""
    return _adoption_flat(spark, sf_dir)


@register("join_function_lists", sql=f"""{with_views('adoption_flat')}
SELECT company_id, genai_functions_list, genai_functions_details FROM adoption_flat""")
def q_join_function_lists(spark, sf_dir):
    """'; ' keyword list and ' | ' 'kw: description' list."""
    return _adoption_flat(spark, sf_dir).select(
        "company_id", "genai_functions_list", "genai_functions_details")


@register("modes_to_rows", sql=f"""{with_views('adoption_flat')}
SELECT company_id, 'strict' AS mode, genai_strict_label AS label, genai_strict_confidence AS confidence FROM adoption_flat
UNION ALL SELECT company_id, 'moderate', genai_moderate_label, genai_moderate_confidence FROM adoption_flat
UNION ALL SELECT company_id, 'lenient', genai_lenient_label, genai_lenient_confidence FROM adoption_flat""")
def q_modes_to_rows(spark, sf_dir):
    """Three modes wide -> long."""
    return R.modes_to_rows(_adoption_flat(spark, sf_dir))


@register("adoption_by_mode", sql=f"""{with_views('adoption_flat')},
c AS (SELECT count(*) AS total, count(CASE WHEN genai_strict_label = 'Yes' THEN 1 END) AS strict,
  count(CASE WHEN genai_moderate_label = 'Yes' THEN 1 END) AS moderate, count(CASE WHEN genai_lenient_label = 'Yes' THEN 1 END) AS lenient,
  count(CASE WHEN no_evidence_flag = 1 THEN 1 END) AS no_evidence FROM adoption_flat)
SELECT 'strict' AS mode, strict AS n, round({Q.pct('strict', 'total')}, 6) AS pct FROM c
UNION ALL SELECT 'moderate', moderate, round({Q.pct('moderate', 'total')}, 6) FROM c
UNION ALL SELECT 'lenient', lenient, round({Q.pct('lenient', 'total')}, 6) FROM c
UNION ALL SELECT 'no_evidence', no_evidence, round({Q.pct('no_evidence', 'total')}, 6) FROM c""")
def q_adoption_by_mode(spark, sf_dir):
    """Yes-count and % per mode plus no-evidence (A2)."""
    return R.adoption_by_mode(_adoption_flat(spark, sf_dir))


@register("confidence_by_mode", sql=f"""{with_views('adoption_flat')},
long AS (SELECT 'strict' AS mode, genai_strict_label AS label, genai_strict_confidence AS confidence FROM adoption_flat
  UNION ALL SELECT 'moderate', genai_moderate_label, genai_moderate_confidence FROM adoption_flat
  UNION ALL SELECT 'lenient', genai_lenient_label, genai_lenient_confidence FROM adoption_flat),
c AS (SELECT m.mode, count(CASE WHEN l.confidence = 'Low' THEN 1 END) AS low, count(CASE WHEN l.confidence = 'Medium' THEN 1 END) AS medium,
  count(CASE WHEN l.confidence = 'High' THEN 1 END) AS high
  FROM (SELECT unnest(['strict', 'moderate', 'lenient']) AS mode) m
  LEFT JOIN (SELECT * FROM long WHERE label = 'Yes') l ON l.mode = m.mode GROUP BY m.mode)
SELECT mode, low, medium, high, low + medium + high AS yes_total,
  round({Q.pct('low', 'low + medium + high')}, 6) AS pct_low,
  round({Q.pct('medium', 'low + medium + high')}, 6) AS pct_medium,
  round({Q.pct('high', 'low + medium + high')}, 6) AS pct_high
FROM c""")
def q_confidence_by_mode(spark, sf_dir):
    """Low/Medium/High among Yes rows per mode, zero-filled (A3)."""
    return R.confidence_by_mode(_adoption_flat(spark, sf_dir))


_EXPLODE = f"""SELECT company_id, f AS function FROM (
  SELECT company_id, unnest(string_split(genai_functions_list, ';')) AS raw FROM adoption_flat
  WHERE genai_functions_list IS NOT NULL), LATERAL (SELECT {Q.strip_ws('raw')} AS f) WHERE f <> ''"""


@register("explode_function_list", sql=f"""{with_views('adoption_flat')}
{_EXPLODE}""")
def q_explode_function_list(spark, sf_dir):
    """'; ' function list -> one row per non-blank keyword."""
    return R.explode_function_list(_adoption_flat(spark, sf_dir))


@register("top_functions", sql=f"""{with_views('adoption_flat')}
SELECT function, count(*) AS n FROM ({_EXPLODE}) GROUP BY function ORDER BY n DESC, function LIMIT 10""")
def q_top_functions(spark, sf_dir):
    """Top 10 business functions by count, ties by keyword."""
    return R.top_functions(_adoption_flat(spark, sf_dir))


@register("sample_adopters", sql=f"""{with_views('adoption_flat')}
SELECT company_id, company_name,
  CASE WHEN {Q.is_blank('genai_functions_list')} THEN 'N/A' ELSE genai_functions_list END AS genai_functions_list
FROM adoption_flat WHERE genai_strict_label = 'Yes' ORDER BY company_id LIMIT 20""")
def q_sample_adopters(spark, sf_dir):
    """First 20 strict adopters by id (T2; the limit is the feature)."""
    return R.sample_adopters(_adoption_flat(spark, sf_dir))


# ---- research results ------------------------------------------------------

_RJ = with_views("research_companies", "finding_rows")
_NF = """(SELECT company_id, count(*) AS nf, count(confidence) AS n_conf, sum(confidence) AS conf,
  string_agg(concat_ws('|', tool_name, use_case, business_function, evidence_summary, source_url, source_type), ';'
             ORDER BY ordinal) AS texts FROM finding_rows GROUP BY company_id)"""
_SPAN_ERR = """CASE WHEN c.result_is_null OR c.company_id % 29 = 0 THEN 'No JSON object found in response'
  WHEN c.company_id % 37 = 0 THEN (CASE WHEN coalesce(n.nf, 0) > 0 THEN 'Invalid JSON'
                                        ELSE 'No JSON object found in response' END) END"""
_PARSE_ERR = f"""coalesce({_SPAN_ERR}, CASE WHEN c.company_id % 43 <> 1 AND c.company_id % 47 = 2
  AND n.n_conf > 0 THEN 'Parse error' END)"""


@register("extract_json_span", sql=f"""{_RJ}
SELECT c.company_id, ({_SPAN_ERR}) IS NULL AS json_ok, {_SPAN_ERR} AS parse_error
FROM research_companies c LEFT JOIN {_NF} n ON c.company_id = n.company_id""")
def q_extract_json_span(spark, sf_dir):
    """First '{' to last '}' of each reply; none / invalid -> reason."""
    rr = B.research_replies(_t(spark, sf_dir))
    err = R.json_parse_error("reply")
    return rr.select("company_id", err.isNull().alias("json_ok"), err.alias("parse_error"))


_FINDING_TEXTS = [f.name for f in S.FINDING_SCHEMA.fields if f.name != "confidence"]


@register("parse_research_result", sql=f"""{_RJ}
SELECT c.company_id, {_PARSE_ERR} AS parse_error,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN c.genai_adoption_found ELSE false END AS genai_adoption_found,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN CAST(coalesce(n.nf, 0) AS INTEGER) ELSE 0 END AS n_findings,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN coalesce(n.texts, '') ELSE '' END AS finding_texts,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN round(coalesce(n.conf, 0.0), 6) ELSE 0.0 END AS confidence_sum,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN c.no_finding_reason END AS no_finding_reason,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN c.recommend_escalation ELSE false END AS recommend_escalation,
  CASE WHEN ({_PARSE_ERR}) IS NULL THEN c.escalation_reason END AS escalation_reason
FROM research_companies c LEFT JOIN {_NF} n ON c.company_id = n.company_id""")
def q_parse_research_result(spark, sf_dir):
    """Reply JSON -> typed result with defaults; malformed kept with reason."""
    p = R.parse_research_result(B.research_replies(_t(spark, sf_dir)))
    texts = F.transform("findings", lambda f: F.concat_ws("|", *[f[n] for n in _FINDING_TEXTS]))
    total = F.aggregate("findings", F.lit(0.0), lambda a, f: a + f["confidence"])
    return p.select("company_id", "parse_error", "genai_adoption_found",
                    F.size("findings").alias("n_findings"),
                    F.array_join(texts, ";").alias("finding_texts"),
                    F.round(total, 6).alias("confidence_sum"), "no_finding_reason",
                    "recommend_escalation", "escalation_reason")


_E1 = f"""SELECT c.company_id, c.company_name, c.homepage_url, c.industry, c.founded_year,
  c.research_stage_reached, c.online_presence_score, c.website_alive, c.research_cost_usd,
  TIMESTAMP '{RUN_TS}' AS researched_at,
  CAST(coalesce(f.ordinal, 1) AS INTEGER) AS finding_id,
  f.company_id IS NOT NULL AS genai_adoption_found,
  CASE WHEN f.company_id IS NULL THEN 0.0 ELSE f.confidence END AS adoption_confidence,
  f.tool_name, f.use_case, f.business_function, f.evidence_summary, f.source_url, f.source_type,
  CASE WHEN f.company_id IS NULL THEN coalesce(CASE WHEN NOT c.result_is_null THEN c.no_finding_reason END,
       'no_evidence') END AS no_finding_reason
FROM research_companies c LEFT JOIN finding_rows f ON c.company_id = f.company_id AND NOT c.result_is_null"""


def _expanded(spark, sf_dir):
    return FD.expand_findings(B.research_results(_t(spark, sf_dir)), RUN_TS)


@register("expand_findings", sql=f"""{_RJ}
{_E1}""")
def q_expand_findings(spark, sf_dir):
    """One row per finding; none -> one 'no finding' row."""
    return _expanded(spark, sf_dir)


@register("finding_ordinal", sql=f"""{_RJ}
SELECT company_id, finding_id, tool_name FROM ({_E1}) WHERE genai_adoption_found""")
def q_finding_ordinal(spark, sf_dir):
    """1-based finding number within a company."""
    return _expanded(spark, sf_dir).where("genai_adoption_found").select(
        "company_id", "finding_id", "tool_name")


@register("rows_written_stats", sql=f"""{_RJ}
SELECT count(DISTINCT company_id) AS companies, count(*) AS rows,
  count(CASE WHEN genai_adoption_found THEN 1 END) AS finding_rows FROM ({_E1})""")
def q_rows_written_stats(spark, sf_dir):
    """Companies and rows emitted by the expansion."""
    return FD.rows_written_stats(_expanded(spark, sf_dir))


@register("sink_fixed_csv", sql=f"""{_RJ}
{_E1}""")
def q_sink_fixed_csv(spark, sf_dir):
    """Write the finding rows as CSV with the fixed 20-column header into the
    shared scratch folder and read them back with their schema (S11)."""
    from tallyho.sources import sinks
    return sinks.roundtrip_fixed_csv(spark, _expanded(spark, sf_dir),
                                     S.FINDING_ROW_COLUMNS, "finding_rows")


@register("summarize_findings", sql=f"""{_RJ}
SELECT c.company_id,
  coalesce(n.nf, 0) > 0 AND NOT c.result_is_null AS has_adoption_evidence,
  CASE WHEN c.result_is_null THEN 0.0 ELSE coalesce(n.mx, 0.0) END AS highest_confidence,
  CASE WHEN c.result_is_null THEN 0 ELSE CAST(coalesce(n.nf, 0) AS INTEGER) END AS n_findings
FROM research_companies c LEFT JOIN
 (SELECT company_id, count(*) AS nf, max(confidence) AS mx FROM finding_rows GROUP BY company_id) n
 ON c.company_id = n.company_id""")
def q_summarize_findings(spark, sf_dir):
    """Any non-negative finding; highest confidence or 0.0."""
    return FD.summarize_findings(B.research_results(_t(spark, sf_dir)))


_TYPED = with_views("typed_finding_rows")


@register("summarize_typed_findings", sql=f"""{_TYPED}
SELECT c.company_id, coalesce(n.evidence, false) AS has_adoption_evidence, coalesce(n.best, 0.0) AS highest_confidence,
  CAST(coalesce(n.kept, 0) AS INTEGER) AS n_findings, CAST(coalesce(n.bad, 0) AS INTEGER) AS n_quarantined
FROM research_companies c LEFT JOIN (SELECT company_id, max(CASE WHEN reason IS NULL THEN confidence_score END) AS best,
    bool_or(reason IS NULL AND NOT list_contains({Q.arr(S.NEGATIVE_FINDING_TYPES)}, finding_type)) AS evidence,
    count(*) FILTER (WHERE reason IS NULL) AS kept, count(reason) AS bad FROM typed_finding_rows GROUP BY 1) n
  ON n.company_id = c.company_id""")
def q_summarize_typed_findings(spark, sf_dir):
    """Evidence by finding type and highest confidence; mistyped findings do not
    count (P26)."""
    return FD.summarize_typed_findings(FD.typed_findings(B.typed_finding_replies(_t(spark, sf_dir))))


@register("quarantine_findings", sql=f"""{_TYPED}
SELECT company_id, finding_id, reason, finding_type, description, source_url, source_title, confidence_score
FROM typed_finding_rows WHERE reason IS NOT NULL""")
def q_quarantine_findings(spark, sf_dir):
    """Findings whose type, description or confidence breaks its declaration."""
    return FD.quarantined_findings(FD.typed_findings(B.typed_finding_replies(_t(spark, sf_dir))))


@register("drop_low_confidence_findings", sql=f"""{_RJ}
SELECT c.company_id, CASE WHEN c.result_is_null THEN NULL ELSE CAST(coalesce(n.nf, 0) AS INTEGER) END AS n_kept,
  CASE WHEN NOT c.result_is_null THEN coalesce(n.texts, '') END AS kept_findings
FROM research_companies c LEFT JOIN
 (SELECT company_id, count(*) AS nf,
    string_agg(concat_ws('|', tool_name, use_case, business_function, evidence_summary, source_url, source_type), ';'
               ORDER BY ordinal) AS texts FROM finding_rows WHERE confidence >= 0.5 GROUP BY company_id) n
 ON c.company_id = n.company_id""")
def q_drop_low_confidence_findings(spark, sf_dir):
    """Findings below 0.5 confidence removed from each result."""
    r = FD.drop_low_confidence_findings(B.research_results(_t(spark, sf_dir)))
    texts = F.transform("result.findings", lambda f: F.concat_ws("|", *[f[n] for n in _FINDING_TEXTS]))
    return r.select("company_id", F.size("result.findings").alias("n_kept"),
                    F.array_join(texts, ";").alias("kept_findings"))


@register("normalize_citations", sql=f"""{_RJ}
SELECT c.company_id, CAST(coalesce(f.n, 0) AS INTEGER) AS n_citations, coalesce(f.n, 0) > 0 AS has_citations,
  coalesce(f.urls, '') AS urls, CAST(coalesce(f.n, 0) * 11 + 150 AS BIGINT) AS total_tokens,
  CAST(coalesce(f.titled, 0) AS INTEGER) AS n_titled, coalesce(f.citation_urls, []) AS citation_urls,
  coalesce(f.citation_titles, []) AS citation_titles, coalesce(f.citation_snippets, []) AS citation_snippets
FROM research_companies c LEFT JOIN (
  SELECT company_id, count(*) AS n, string_agg(source_url, ';' ORDER BY ordinal) AS urls,
    count(CASE WHEN k % 2 = 1 THEN 1 END) AS titled, list(source_url ORDER BY ordinal) AS citation_urls,
    list(CASE WHEN k % 2 = 1 THEN tool_name END ORDER BY ordinal) AS citation_titles,
    list(CASE WHEN k % 2 = 1 THEN evidence_summary END ORDER BY ordinal) AS citation_snippets FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ordinal) - 1 AS k
    FROM finding_rows WHERE source_url IS NOT NULL) GROUP BY company_id) f
  ON c.company_id = f.company_id AND NOT c.result_is_null""")
def q_normalize_citations(spark, sf_dir):
    """Mixed string / object citations -> typed array (its urls, titles and
    snippets as lists of one length), has_citations, urls and total tokens (P23)."""
    raw = B.research_api_responses(_t(spark, sf_dir))
    n = FD.normalize_citations(raw)
    return n.select("company_id", F.size("citations").alias("n_citations"), "has_citations",
                    F.array_join("urls", ";").alias("urls"), "total_tokens",
                    F.size(F.filter("citations", lambda c: c["title"].isNotNull()))
                    .alias("n_titled"),
                    *[F.col(f"citations.{n}").alias(f"citation_{n}s")
                      for n in ("url", "title", "snippet")])
