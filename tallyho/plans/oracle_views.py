"""DuckDB twins of ``tallyho.sources.bindings`` (used as CTEs by oracles).

Each entry is (dependencies, SELECT body).  ``with_views(names)`` returns a
WITH clause holding the requested views and everything they depend on.
"""

from __future__ import annotations

from tallyho import schemas as S


def _arr(values) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    return "[" + ", ".join(lit(v) for v in values) + "]"


VIEWS: dict[str, tuple[list[str], str]] = {}


def token_count(text: str, words) -> str:
    """SQL twin of the labeller's whole-token count: split on non-word
    characters and count tokens equal (case-insensitively) to a word."""
    return (f"len(list_filter(string_split_regex({text}, '[^A-Za-z0-9_]+'), "
            f"lambda w: list_contains({_arr(list(words))}, lower(w))))")

VIEWS["companies"] = ([], r"""
SELECT d.doc_id AS rcid,
  CASE WHEN d.doc_id % 50 = 11 THEN NULL
       ELSE 'org-' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') END AS org_uuid,
  CASE WHEN d.doc_id % 40 = 13 THEN '' ELSE 'Doc ' || CAST(d.doc_id AS VARCHAR) END AS name,
  CASE WHEN d.doc_id % 45 = 7 THEN 'not a url'
       ELSE 'https://directory.example.com/org/' || CAST(d.doc_id AS VARCHAR) END AS cb_url,
  CASE WHEN d.doc_id % 11 = 3 THEN NULL
       WHEN d.doc_id % 11 = 5 THEN 'www.doc' || CAST(d.doc_id AS VARCHAR) || '.example.org'
       ELSE 'https://doc' || CAST(d.doc_id AS VARCHAR) || '.example.com/' END AS homepage_url,
  CASE WHEN d.doc_id % 10 = 3 THEN NULL
       WHEN d.doc_id % 10 = 7 THEN '   '
       WHEN d.doc_id % 10 = 9 THEN chr(160) || split_part(d.text, chr(10), 1) || ' '
       ELSE split_part(d.text, chr(10), 1) END AS short_description,
  CASE WHEN d.doc_id % 4 = 1 THEN NULL ELSE d.text END AS long_description,
  CASE WHEN d.doc_id % 35 = 0 THEN NULL ELSE d.lang END AS category_list,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE d.source END AS category_groups_list,
  CAST(NULL AS VARCHAR) AS created_date,
  CASE WHEN d.doc_id % 5 = 0 THEN '01nov' || CAST(1995 + d.doc_id % 25 AS VARCHAR)
       WHEN d.doc_id % 5 = 1 THEN CAST(1995 + d.doc_id % 25 AS VARCHAR) || '-11-01'
       WHEN d.doc_id % 5 = 2 THEN ''
       WHEN d.doc_id % 5 = 3 THEN NULL
       ELSE 'founded ' || CAST(1995 + d.doc_id % 25 AS VARCHAR) END AS founded_date
FROM documents d
""")

VIEWS["runs_a"] = ([], r"""
SELECT CAST(o_orderkey AS VARCHAR) AS CompanyID,
  'Order ' || CAST(o_orderkey AS VARCHAR) AS CompanyName,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       WHEN o_orderkey % 89 = 0 THEN 'yes'
       WHEN o_orderstatus = 'F' THEN (CASE WHEN o_orderkey % 5 = 0 THEN '1.0' ELSE '1' END)
       ELSE '0' END AS AI_native,
  substr(o_orderpriority, 1, 1) AS Confidence_1to5,
  concat_ws(' | ', 'priority ' || o_orderpriority, 'status ' || o_orderstatus,
            'customer ' || CAST(o_custkey AS VARCHAR)) AS Reasons_3_points,
  'id;name;short_description' AS Sources_used,
  'consistent' AS Verification_critique
FROM orders
""")

VIEWS["runs_b"] = ([], r"""
SELECT CAST(l_orderkey AS VARCHAR) AS CompanyID,
  'Order ' || CAST(l_orderkey AS VARCHAR) AS CompanyName,
  CASE WHEN na * 2 > n THEN '1' ELSE '0' END AS AI_native,
  CAST(1 + (CAST(floor(q) AS BIGINT) % 5) AS VARCHAR) AS Confidence_1to5,
  concat_ws(' | ', 'lines ' || CAST(n AS VARCHAR), 'returned ' || CAST(na AS VARCHAR),
            'quantity ' || CAST(CAST(floor(q) AS BIGINT) AS VARCHAR)) AS Reasons_3_points,
  'id;name;keywords' AS Sources_used,
  'checked' AS Verification_critique
FROM (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS na,
             sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
""")

# typed + aligned comparison frame (ids are unique in both runs)
def _num(e):
    return f"(CASE WHEN isnan(TRY_CAST({e} AS DOUBLE)) THEN NULL ELSE TRY_CAST({e} AS DOUBLE) END)"


VIEWS["paired"] = (["runs_a", "runs_b"], f"""
SELECT a.CompanyID AS id, a.CompanyName AS name,
  {_num('a.AI_native')} AS label_a, {_num('b.AI_native')} AS label_b,
  {_num('a.Confidence_1to5')} AS conf_a, {_num('b.Confidence_1to5')} AS conf_b,
  a.Reasons_3_points AS reasons_a, b.Reasons_3_points AS reasons_b,
  coalesce({_num('a.AI_native')} = {_num('b.AI_native')}, false) AS agree
FROM runs_a a JOIN runs_b b ON a.CompanyID = b.CompanyID
""")

VIEWS["finding_rows"] = ([], rf"""
SELECT l_orderkey AS company_id,
  'tool-' || l_returnflag AS tool_name,
  'use-' || l_linestatus AS use_case,
  {_arr(S.FUNCTION_KEYWORDS)}[CAST(l_partkey % 14 AS INTEGER) + 1] AS business_function,
  'part ' || CAST(l_partkey AS VARCHAR) || ' supplier ' || CAST(l_suppkey AS VARCHAR) AS evidence_summary,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL
       ELSE 'https://evidence.example.com/' || CAST(l_partkey AS VARCHAR) END AS source_url,
  ['company_blog', 'news_article', 'job_posting', 'linkedin_post', 'press_release'][CAST(l_suppkey % 5 AS INTEGER) + 1] AS source_type,
  abs(l_discount) * 10.0 + CASE WHEN l_partkey % 61 = 5 THEN 1.0 ELSE 0.0 END AS confidence,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
     l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ordinal
FROM lineitem
""")

VIEWS["research_companies"] = ([], r"""
SELECT o_orderkey AS company_id,
  'Order ' || CAST(o_orderkey AS VARCHAR) AS company_name,
  'https://order' || CAST(o_orderkey AS VARCHAR) || '.example.com' AS homepage_url,
  o_orderpriority AS industry,
  CAST(year(o_orderdate) AS INTEGER) AS founded_year,
  ['1', '2A', '2B', '3'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS research_stage_reached,
  CAST(CASE WHEN o_orderkey % 59 = 7 THEN 140 ELSE o_custkey % 101 END AS INTEGER) AS online_presence_score,
  o_orderstatus <> 'P' AS website_alive,
  CAST([0.02, 0.04, 0.09, 0.5][CAST(o_orderkey % 4 AS INTEGER) + 1] AS DOUBLE) AS research_cost_usd,
  o_orderkey % 31 = 0 AS result_is_null,
  o_orderstatus = 'F' AS genai_adoption_found,
  CASE WHEN o_orderkey % 3 = 0 THEN 'no_evidence'
       WHEN o_orderkey % 3 = 1 THEN 'insufficient_information' END AS no_finding_reason,
  o_totalprice > 250000.0 AS recommend_escalation,
  CASE WHEN o_totalprice > 250000.0 THEN 'high value' END AS escalation_reason
FROM orders
""")

VIEWS["batch_error_rows"] = ([], """
SELECT CAST(floor(event_id / 500) AS INTEGER) AS batch_num,
  coalesce(CASE WHEN event_id % 7 = 6 THEN 'line_' || CAST(event_id AS VARCHAR)
    ELSE ['rate_limit_exceeded', 'server_error', 'invalid_request', 'rate_limit_exceeded', NULL,
          'token_limit_exceeded'][CAST(event_id % 7 AS INTEGER) + 1] END, 'unknown') AS code
FROM events WHERE event_type = 'error' AND floor(event_id / 500) % 10 <> 7 AND floor(event_id / 500) % 6 <> 5
""")

_KINDS = [*S.FINDING_TYPES, "gut_feeling", S.NEGATIVE_FINDING_TYPES[0].upper(), None, S.FINDING_TYPES[0]]
VIEWS["typed_finding_rows"] = (["finding_rows", "research_companies"], f"""
SELECT *, CASE WHEN finding_type IS NULL OR NOT list_contains({_arr(S.FINDING_TYPES)}, finding_type) THEN 'unknown_finding_type'
    WHEN description IS NULL THEN 'missing_description'
    WHEN NOT coalesce(confidence_score BETWEEN 0.0 AND 1.0, false) THEN 'confidence_out_of_range' END AS reason
FROM (SELECT f.company_id, CAST(f.ordinal AS INTEGER) AS finding_id,
  CASE WHEN f.company_id % 5 = 2 THEN {_arr(S.NEGATIVE_FINDING_TYPES)}[CAST((f.ordinal - 1) % 2 AS INTEGER) + 1]
       ELSE {_arr(_KINDS)}[CAST((f.company_id * 7 + (f.ordinal - 1) * 5) % {len(_KINDS)} AS INTEGER) + 1] END AS finding_type,
  CASE WHEN (f.company_id + f.ordinal - 1) % 13 <> 6 THEN f.evidence_summary END AS description,
  f.source_url, f.tool_name AS source_title, round(f.confidence, 2) AS confidence_score
FROM finding_rows f JOIN research_companies c ON c.company_id = f.company_id
WHERE NOT c.result_is_null AND f.company_id % 29 <> 0)
""")

VIEWS["batch_status"] = ([], r"""
SELECT CAST(user_id AS INTEGER) AS batch_num,
  CASE WHEN user_id % 9 = 4 THEN NULL ELSE 'batch_' || CAST(user_id AS VARCHAR) END AS batch_id,
  CASE WHEN completed + failed >= total THEN 'completed'
       WHEN event_type = 'signup' THEN 'validating'
       WHEN event_type = 'click' THEN 'finalizing'
       ELSE 'in_progress' END AS status,
  CAST(total AS BIGINT) AS total, CAST(completed AS BIGINT) AS completed,
  CAST(failed AS BIGINT) AS failed, created_at,
  CASE WHEN completed + failed >= total THEN ts END AS completed_at,
  user_id % 10 <> 3 AS has_jsonl,
  (completed + failed >= total) AND user_id % 7 <> 2 AS has_results,
  (completed + failed >= total) AND user_id % 7 <> 2 AS has_output,
  ts AS checked_at
FROM (SELECT *,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS completed,
  count(CASE WHEN event_type = 'error' THEN 1 END) OVER w AS failed,
  count(CASE WHEN event_type IN ('purchase', 'error') THEN 1 END) OVER (PARTITION BY user_id) + user_id % 5 AS total,
  min(ts) OVER (PARTITION BY user_id) AS created_at
  FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
""")

VIEWS["api_calls"] = ([], r"""
SELECT ['search', 'small_model', 'research'][CAST(user_id % 3 AS INTEGER) + 1] AS service,
  user_id AS caller_id, event_id AS call_id, ts,
  CASE WHEN event_type = 'error' THEN 503
       WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 429
       WHEN event_type = 'click' AND event_id % 9 = 0 THEN 400
       WHEN event_type = 'click' AND event_id % 11 = 0 THEN 401
       ELSE 200 END AS status_code,
  CASE WHEN event_type = 'view' AND event_id % 13 = 0 THEN 'ReadTimeout'
       WHEN event_type = 'view' AND event_id % 17 = 0 THEN 'ConnectError' END AS error_kind,
  CAST(event_id % 4 AS INTEGER) AS attempt
FROM events
""")

VIEWS["site_checks"] = ([], r"""
SELECT p.page_id AS rcid, p.url,
  CAST([200, 301, 404, 500, 200, 403, NULL][CAST(p.page_id % 7 AS INTEGER) + 1] AS INTEGER) AS status_code,
  CASE WHEN p.page_id % 3 = 0 THEN coalesce(n.url, p.url)
       WHEN p.page_id % 11 = 5 THEN NULL
       ELSE p.url END AS final_url,
  CASE WHEN p.page_id % 7 = 6 THEN
       (CASE WHEN p.page_id % 2 = 0 THEN 'ConnectTimeout: timed out'
             ELSE 'SSL: certificate verify failed' END) END AS error
FROM pages p LEFT JOIN pages n ON n.page_id - 1 = p.page_id
""")


def with_views(*names: str) -> str:
    """WITH clause holding ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)


# ---- rule labellers and replies (SQL twins) --------------------------------

WIDE_EXTRA = ["thing", "that"]


def _labeller_views():
    from tallyho.operators import labelers as L
    from tallyho.plans import sqlfn as Q

    text = (f"coalesce(concat_ws(' ', {Q.blank_to_null('short_description')}, "
            f"{Q.blank_to_null('long_description')}), '')")

    def occ(words):
        return token_count(text, words)

    kw = Q.merge_keywords("category_list", "category_groups_list")
    has_long = f"(NOT {Q.is_blank('long_description')})"
    has_short = f"(NOT {Q.is_blank('short_description')})"
    cid = (f"CASE WHEN {Q.is_blank('org_uuid')} THEN 'startup-row-' || CAST(rcid AS VARCHAR) "
           f"ELSE 'startup-' || {Q.strip_ws('org_uuid')} END")
    def u2_views(name, vocab=S.AI_VOCABULARY, min_hits=2, drop_long=False):
        src = "companies"
        if drop_long:
            VIEWS[name + "_src"] = (["companies"], "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS long_description) FROM companies")
            src = name + "_src"
        VIEWS[name + "_base"] = ([src], f"""
SELECT rcid, {cid} AS custom_id, {Q.null_to_na('org_uuid')} AS CompanyID,
  {Q.null_to_na('name')} AS CompanyName, {occ(vocab)} AS n,
  {has_long} AS has_long, {has_short} AS has_short, {kw} AS keywords
FROM {src}""")
        VIEWS[name] = ([name + "_base"], f"""
SELECT rcid, custom_id, CompanyID, CompanyName,
  CASE WHEN {insuff} THEN 0 WHEN n >= {min_hits} THEN 1 ELSE 0 END AS AI_native,
  CASE WHEN {insuff} THEN 1 WHEN NOT has_long THEN least({conf}, 4) ELSE {conf} END AS Confidence_1to5,
  CASE WHEN {insuff} THEN '' ELSE concat_ws(' | ', 'vocabulary matches: ' || CAST(n AS VARCHAR),
       CASE WHEN has_long THEN 'long description present' ELSE 'no long description' END,
       'keywords: ' || keywords) END AS Reasons_3_points,
  CASE WHEN {insuff} THEN '' ELSE concat_ws(';', CASE WHEN has_short THEN 'short_description' END,
       CASE WHEN has_long THEN 'long_description' END,
       CASE WHEN keywords <> 'N/A' THEN 'keywords' END) END AS Sources_used,
  CASE WHEN {insuff} THEN 'Insufficient information'
       ELSE 'Rule label from ' || CAST(n AS VARCHAR) || ' vocabulary matches.' END AS Verification_critique
FROM {name}_base""")

    insuff = "(NOT has_long AND NOT has_short AND keywords = 'N/A')"
    conf = ("(CASE WHEN n = 0 THEN 4 WHEN n = 1 THEN 2 WHEN n <= 3 THEN 3 ELSE 5 END)")
    u2_views("u2")
    u2_views("u2_short", drop_long=True)
    u2_views("u2_wide", vocab=S.AI_VOCABULARY + WIDE_EXTRA)

    def csvf(c):
        return (f"(CASE WHEN regexp_matches(coalesce({c}, ''), {Q.q(chr(91) + ',\"' + chr(92) + 'n' + chr(92) + 'r' + chr(93))}) "
                f"THEN '\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"' ELSE coalesce({c}, '') END)")

    def quoted(c):
        return f"('\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"')"

    line = (f"concat_ws(',', {csvf('CompanyID')}, {csvf('CompanyName')}, CAST(AI_native AS VARCHAR), "
            f"CAST(Confidence_1to5 AS VARCHAR), {quoted('Reasons_3_points')}, "
            f"{quoted('Sources_used')}, {quoted('Verification_critique')})")
    VIEWS["cls_responses"] = (["u2"], f"""
SELECT rcid, CAST(floor(rcid / 250) + 1 AS INTEGER) AS batch_num, custom_id,
  CASE WHEN rcid % 23 = 5 THEN 500 ELSE 200 END AS status_code,
  CASE WHEN rcid % 23 IN (5, 9) THEN 0 ELSE 1 END AS n_choices,
  CASE WHEN rcid % 23 IN (5, 9) THEN NULL
       WHEN rcid % 23 = 17 THEN 'I cannot classify this company.'
       WHEN rcid % 23 = 2 THEN concat_ws(',', CompanyID, CompanyName, '1', '6', '"only | two"', '"name"', '"ok"')
       WHEN rcid % 23 = 11 THEN concat_ws(',', CompanyID, CompanyName, '0', '3', '"a | b | c"', '"name;website"', '"checked"')
       WHEN rcid % 23 = 1 THEN concat_ws(',', CompanyID, CompanyName, '1', '2', '"x | y | z"', '"name"', '"{S.INSUFFICIENT_INFO}"')
       WHEN rcid % 23 = 4 THEN concat_ws(',', CompanyID, CompanyName, '0', '1', '""', '""', '"{S.INSUFFICIENT_INFO}"')
       WHEN rcid % 23 = 20 THEN 'Here is the answer:' || chr(10) || {line}
       WHEN rcid % 23 = 21 THEN {line} || chr(10) || {line}
       ELSE {line} END AS content,
  CASE WHEN rcid % 23 = 5 THEN 'Internal server error' END AS error_message
FROM u2 WHERE rcid % 23 <> 14""")
    fld = '(?:"(?:[^"]|"")*"[^,\\n]*|[^,\\n]*)'
    rec = f"regexp_extract({Q.strip_ws('content')}, {Q.q('^' + fld + '(?:,' + fld + ')*')}, 0)"
    VIEWS["cls_fields"] = (["cls_responses"], f"""
SELECT *, list_transform(regexp_extract_all(',' || {rec}, {Q.q(',(' + fld + ')')}, 1),
  lambda f: {Q.strip_ws("CASE WHEN starts_with(f, '\"') THEN replace(substr(f, 2, length(f) - 2), '\"\"', '\"') ELSE f END")}) AS fl
FROM cls_responses""")
    cols = ", ".join(f"CASE WHEN len(fl) >= 7 THEN fl[{i + 1}] ELSE '' END AS {c}"
                     for i, c in enumerate(S.REPLY_COLUMNS))
    VIEWS["cls_parsed"] = (["cls_fields"], f"""
SELECT rcid, batch_num, custom_id, status_code, n_choices, content, error_message, {cols},
  coalesce(len(fl) >= 7, false) AS csv_ok,
  CASE WHEN status_code IS NULL OR status_code <> 200 THEN 'http_error'
       WHEN n_choices = 0 THEN 'empty_choices'
       WHEN NOT coalesce(len(fl) >= 7, false) THEN 'bad_reply' END AS failure_kind
FROM cls_fields""")
    VIEWS["cls_submitted"] = (["companies"], f"""
SELECT CAST(floor(rcid / 250) + 1 AS INTEGER) AS batch_num, {cid} AS custom_id, rcid FROM companies""")

    # three-mode adoption labeller
    counts = {m: occ(w) for m, w in L.ADOPTION_VOCAB.items()}
    terms = ", ".join(f"{occ([t])} AS h_{t}" for t, _ in L.TERM_FUNCTION)
    VIEWS["u3_base"] = (["companies"], f"""
SELECT rcid, {cid} AS custom_id, {Q.null_to_na('org_uuid')} AS company_id,
  {Q.null_to_na('name')} AS company_name,
  {', '.join(f'{v} AS n_{m}' for m, v in counts.items())}, {terms}
FROM companies""")

    def lvl(n):
        return f"(CASE WHEN {n} >= 3 THEN 'High' WHEN {n} = 2 THEN 'Medium' ELSE 'Low' END)"

    modes = ", ".join(
        f"CASE WHEN n_{m} > 0 THEN 'Yes' ELSE 'No' END AS genai_{m}_label, {lvl('n_' + m)} AS genai_{m}_confidence"
        for m in S.ADOPTION_MODES)
    funcs_list = "concat_ws('; ', " + ", ".join(
        f"CASE WHEN h_{t} > 0 THEN '{fn}' END" for t, fn in L.TERM_FUNCTION) + ")"
    funcs_det = "concat_ws(' | ', " + ", ".join(
        f"CASE WHEN h_{t} > 0 THEN '{fn}: profile mentions {t}' END" for t, fn in L.TERM_FUNCTION) + ")"
    matched = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN h_{t} > 0 THEN '{t}' END" for t, _ in L.TERM_FUNCTION) + ")"
    VIEWS["u3"] = (["u3_base"], f"""
SELECT rcid, custom_id, company_id, company_name, {modes}, 'strict' AS primary_assessment,
  CASE WHEN n_lenient > 0 THEN 0 ELSE 1 END AS no_evidence_flag,
  {funcs_list} AS genai_functions_list, {funcs_det} AS genai_functions_details,
  'Matched terms: ' || {matched} || ' ' || 'Strict evidence count: ' || CAST(n_strict AS VARCHAR) AS reasoning,
  rcid % 19 AS m
FROM u3_base""")
    # flattened adoption replies as ingested (defaults applied per failure mode)
    VIEWS["adoption_ingested"] = (["u3"], """
SELECT CAST(floor(rcid / 250) + 1 AS INTEGER) AS batch_num, custom_id, company_id, company_name,
  CASE WHEN m = 13 THEN 'No' WHEN m = 5 THEN 'Yes' ELSE genai_strict_label END AS genai_strict_label,
  CASE WHEN m IN (5, 13) THEN 'Low' ELSE genai_strict_confidence END AS genai_strict_confidence,
  CASE WHEN m = 5 THEN 'No' ELSE genai_moderate_label END AS genai_moderate_label,
  CASE WHEN m = 5 THEN 'Low' ELSE genai_moderate_confidence END AS genai_moderate_confidence,
  genai_lenient_label, genai_lenient_confidence,
  CASE WHEN m = 6 THEN 'lenient' ELSE primary_assessment END AS primary_assessment,
  CASE WHEN m = 6 THEN 1 ELSE no_evidence_flag END AS no_evidence_flag,
  CASE WHEN m = 17 THEN '' ELSE genai_functions_list END AS genai_functions_list,
  CASE WHEN m = 17 THEN '' ELSE genai_functions_details END AS genai_functions_details,
  reasoning,
  CASE WHEN m = 11 THEN 'http_error' WHEN m = 3 THEN 'bad_reply' END AS failure_kind,
  CASE WHEN m = 11 THEN 500 ELSE 200 END AS status_code
FROM u3""")
    VIEWS["adoption_flat"] = (["adoption_ingested"], """
SELECT company_id, company_name, genai_strict_label, genai_strict_confidence,
  genai_moderate_label, genai_moderate_confidence, genai_lenient_label, genai_lenient_confidence,
  primary_assessment, no_evidence_flag, genai_functions_list, genai_functions_details, reasoning
FROM adoption_ingested WHERE failure_kind IS NULL""")


_labeller_views()


VIEWS["search_log_flat"] = (["companies"], r"""
SELECT rcid, name, CASE WHEN rcid % 13 = 4 THEN 'rate limited (429)' WHEN rcid % 13 = 5 THEN '' END AS error,
  strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(rcid), '%Y-%m-%dT%H:%M:%S') AS timestamp, 0 AS day
FROM companies WHERE rcid % 8 <> 7
UNION ALL
SELECT rcid, name, NULL AS error,
  strftime(TIMESTAMP '2026-01-02 00:00:00' + to_seconds(rcid), '%Y-%m-%dT%H:%M:%S') AS timestamp, 1 AS day
FROM companies WHERE rcid % 8 <> 7 AND rcid % 26 = 4
""")

VIEWS["search_hits"] = ([], r"""
SELECT conv_id AS rcid, turn, role || ' turn ' || CAST(turn AS VARCHAR) AS title,
  'https://search.example.com/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url,
  text AS content, 1.0 / (turn + 1) AS score,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rnk
FROM conversations
""")


def _priority_view():
    from tallyho.operators import labelers as L
    from tallyho.plans import sqlfn as Q
    text = (f"coalesce(concat_ws(' ', {Q.blank_to_null('short_description')}, "
            f"{Q.blank_to_null('long_description')}), '')")
    n = token_count(text, S.AI_VOCABULARY)
    has_long = f"CAST(NOT {Q.is_blank('long_description')} AS INTEGER)"
    web = "CAST(homepage_url IS NOT NULL AS INTEGER)"
    presence = "least(10, 1 + floor(log10(length(coalesce(long_description, '')) + 1) * 2))"
    VIEWS["priority_log"] = (["companies"], f"""
SELECT rcid, name,
  CAST(CASE WHEN rcid % 17 = 3 THEN 0 ELSE {presence} END AS INTEGER) AS online_presence_score,
  CAST(CASE WHEN rcid % 17 = 3 THEN 0 WHEN rcid % 53 = 2 THEN 7 ELSE least(5, {n} + {has_long} + {web}) END AS INTEGER) AS research_priority_score,
  CASE WHEN rcid % 17 = 3 THEN 'classification failed' ELSE 'vocabulary matches: ' || CAST({n} AS VARCHAR) END AS reasoning,
  CASE WHEN rcid % 17 = 3 THEN 'APIError: upstream unavailable' END AS error
FROM companies""")


_priority_view()
