"""Registered queries: contract checks, triage routing, costs, funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import cascade as CA
from tallyho.operators import findings as FD
from tallyho.operators import quality as QA
from tallyho.operators import rules as RU
from tallyho.operators import triage as TR
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.q_replies import RUN_TS, _E1, _NF, _PARSE_ERR, _adoption_flat, _cls_ingested
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources import sinks
from tallyho.sources.tables import Tables

_VOCAB = Q.arr(S.SOURCE_VOCABULARY)
_FUNCS = Q.arr(S.FUNCTION_KEYWORDS)


def _ok_replies(spark, sf_dir):
    return _cls_ingested(spark, sf_dir).where(F.col("failure_kind").isNull())


_CONTRACT = f"""concat_ws(';',
  CASE WHEN NOT coalesce(regexp_matches(Confidence_1to5, '^[1-5]$'), false) THEN 'confidence_not_1_to_5' END,
  CASE WHEN coalesce(len(string_split_regex(Reasons_3_points, ' \\| ')), 0) <> 3
       AND NOT coalesce(Verification_critique = 'Insufficient information' AND Reasons_3_points = '', false) THEN 'reasons_not_3' END,
  CASE WHEN len(list_filter(list_filter(string_split(Sources_used, ';'), lambda s: s <> ''),
       lambda s: NOT list_contains({_VOCAB}, s))) > 0 THEN 'unknown_source' END,
  CASE WHEN len(list_filter(string_split_regex(Verification_critique, '\\s+'), lambda w: w <> '')) > 30
       THEN 'critique_over_30_words' END)"""


@register("check_reply_contract", sql=f"""{with_views('cls_parsed')}
SELECT custom_id, {_CONTRACT} AS violations FROM cls_parsed WHERE failure_kind IS NULL""")
def q_check_reply_contract(spark, sf_dir):
    """Confidence 1-5, three reasons, known sources, short critique (Q1)."""
    return QA.check_reply_contract(_ok_replies(spark, sf_dir)).select("custom_id", "violations")


@register("violation_rollup", sql=f"""{with_views('cls_parsed')}
SELECT rule, count(*) AS n FROM (
  SELECT unnest(string_split({_CONTRACT}, ';')) AS rule FROM cls_parsed WHERE failure_kind IS NULL)
WHERE rule <> '' GROUP BY rule""")
def q_violation_rollup(spark, sf_dir):
    """Reply-contract violations counted per rule."""
    return QA.violation_rollup(QA.check_reply_contract(_ok_replies(spark, sf_dir)))


@register("check_confidence_cap", sql=f"""{with_views('cls_parsed', 'companies')}
SELECT p.custom_id, concat_ws(';', CASE WHEN {Q.is_blank('c.long_description')}
  AND TRY_CAST(p.Confidence_1to5 AS DOUBLE) > 4 THEN 'confidence_above_cap_without_long' END) AS violations
FROM cls_parsed p LEFT JOIN (SELECT *, CASE WHEN {Q.is_blank('org_uuid')} THEN 'startup-row-' || CAST(rcid AS VARCHAR)
  ELSE 'startup-' || {Q.strip_ws('org_uuid')} END AS cid FROM companies) c ON p.custom_id = c.cid
WHERE p.failure_kind IS NULL""")
def q_check_confidence_cap(spark, sf_dir):
    """No long description => confidence <= 4, checked against the source (Q2)."""
    checked = QA.check_confidence_cap(_ok_replies(spark, sf_dir),
                                      B.companies(Tables(spark, sf_dir)))
    return checked.select("custom_id", "violations")


@register("check_insufficient_info", sql=f"""{with_views('cls_parsed')}
SELECT custom_id, concat_ws(';',
  CASE WHEN Verification_critique = 'Insufficient information' AND AI_native <> '0' THEN 'insufficient_label_not_0' END,
  CASE WHEN Verification_critique = 'Insufficient information' AND Confidence_1to5 <> '1' THEN 'insufficient_confidence_not_1' END,
  CASE WHEN Verification_critique = 'Insufficient information' AND Reasons_3_points <> '' THEN 'insufficient_has_reasons' END,
  CASE WHEN Verification_critique = 'Insufficient information' AND Sources_used <> '' THEN 'insufficient_has_sources' END) AS violations
FROM cls_parsed WHERE failure_kind IS NULL""")
def q_check_insufficient_info(spark, sf_dir):
    """'Insufficient information' => label 0, confidence 1, empty lists (Q3)."""
    return QA.check_insufficient_info(_ok_replies(spark, sf_dir)).select("custom_id", "violations")


_ALL_NO = " AND ".join(f"genai_{m}_label = 'No'" for m in S.ADOPTION_MODES)
_KWS = (f"list_filter(list_transform(string_split(coalesce(genai_functions_list, ''), ';'), "
        f"lambda x: {Q.strip_ws('x')}), lambda x: x <> '')")


@register("check_adoption_invariants", sql=f"""{with_views('adoption_flat')}
SELECT company_id, concat_ws(';',
  CASE WHEN ({_ALL_NO}) AND no_evidence_flag <> 1 THEN 'all_no_without_no_evidence' END,
  CASE WHEN NOT ({_ALL_NO}) AND no_evidence_flag = 1 THEN 'no_evidence_with_yes' END,
  CASE WHEN ({_ALL_NO}) AND len({_KWS}) > 0 THEN 'all_no_with_functions' END,
  CASE WHEN primary_assessment <> 'strict' THEN 'primary_not_strict' END,
  CASE WHEN len(list_filter({_KWS}, lambda k: NOT list_contains({_FUNCS}, k))) > 0 THEN 'unknown_function_keyword' END) AS violations
FROM adoption_flat""")
def q_check_adoption_invariants(spark, sf_dir):
    """All-No <=> no evidence and no functions; primary 'strict'; known keywords (Q4)."""
    return QA.check_adoption_invariants(_adoption_flat(spark, sf_dir)).select(
        "company_id", "violations")


@register("check_mode_monotonic", sql=f"""{with_views('adoption_flat')}
SELECT company_id, concat_ws(';',
  CASE WHEN genai_strict_label = 'Yes' AND genai_moderate_label <> 'Yes' THEN 'strict_not_in_moderate' END,
  CASE WHEN genai_moderate_label = 'Yes' AND genai_lenient_label <> 'Yes' THEN 'moderate_not_in_lenient' END) AS violations
FROM adoption_flat""")
def q_check_mode_monotonic(spark, sf_dir):
    """strict => moderate => lenient (Q5)."""
    return QA.check_mode_monotonic(_adoption_flat(spark, sf_dir)).select("company_id", "violations")


_RJ = with_views("research_companies", "finding_rows")
_FAGG = """(SELECT company_id, count(*) AS n, max(confidence) AS best,
   bool_or(source_url IS NULL) AS missing_url, bool_or(source_url IS NOT NULL) AS any_url,
   bool_or(tool_name IS NULL OR use_case IS NULL) AS missing_detail,
   bool_or(NOT coalesce(confidence BETWEEN 0.0 AND 1.0, false)) AS bad_conf
   FROM finding_rows GROUP BY company_id)"""


@register("check_ranges", sql=f"""{_RJ}
SELECT c.company_id, concat_ws(';',
  CASE WHEN NOT (c.online_presence_score BETWEEN 0 AND 100) THEN 'presence_out_of_range' END,
  CASE WHEN NOT c.result_is_null AND coalesce(f.bad_conf, false) THEN 'confidence_out_of_range' END,
  CASE WHEN NOT list_contains({Q.arr(S.RESEARCH_STAGES)}, c.research_stage_reached) THEN 'unknown_stage' END) AS violations
FROM research_companies c LEFT JOIN {_FAGG} f ON c.company_id = f.company_id""")
def q_check_ranges(spark, sf_dir):
    """Presence 0-100, confidence 0-1, stage in its enum (Q6)."""
    return QA.check_ranges(B.research_results(Tables(spark, sf_dir))).select(
        "company_id", "violations")


@register("check_source_confidence_band", sql=f"""{_RJ},
e1 AS ({_E1}),
bands(source_type, band_min, band_max) AS (VALUES {', '.join(f"('{a}', {b}, {c})" for a, b, c in S.SOURCE_CONFIDENCE_BANDS)})
SELECT e1.company_id, e1.finding_id, e1.source_type, concat_ws(';',
  CASE WHEN b.band_min IS NOT NULL AND NOT (e1.adoption_confidence BETWEEN b.band_min AND b.band_max)
       THEN 'confidence_outside_band' END) AS violations
FROM e1 LEFT JOIN bands b ON e1.source_type = b.source_type""")
def q_check_source_confidence_band(spark, sf_dir):
    """Finding confidence within its source type's band (Q7)."""
    rows = FD.expand_findings(B.research_results(Tables(spark, sf_dir)), RUN_TS)
    return QA.check_source_confidence_band(rows).select(
        "company_id", "finding_id", "source_type", "violations")


_STAGE_BANDS = ", ".join(f"('{s}', '{t}', {a}, {b})" for s, t, a, b in S.STAGE_CONFIDENCE_BANDS)
_SOURCE_TYPES = Q.arr(list(dict.fromkeys(t for _, t, *_ in S.STAGE_CONFIDENCE_BANDS)))


@register("check_research_rules", sql=f"""{_RJ},
bands(stage, source_type, band_min, band_max) AS (VALUES {_STAGE_BANDS}),
marked AS (SELECT c.company_id,
    NOT coalesce(f.confidence BETWEEN 0.0 AND 1.0, false) AS bad_range,
    c.research_stage_reached IN (SELECT stage FROM bands) AND f.confidence < {S.FINDING_CONFIDENCE_FLOOR} AS low,
    b.band_min IS NOT NULL AND NOT (f.confidence BETWEEN b.band_min AND b.band_max) AS outside,
    NOT list_contains({_SOURCE_TYPES}, f.source_type) AS odd_source,
    NOT list_contains({_FUNCS}, f.business_function) AS odd_function
  FROM research_companies c JOIN finding_rows f ON c.company_id = f.company_id AND NOT c.result_is_null
  LEFT JOIN bands b ON b.stage = c.research_stage_reached AND b.source_type = f.source_type),
agg AS (SELECT company_id, bool_or(bad_range) AS bad_range, bool_or(low) AS low, bool_or(outside) AS outside,
    bool_or(odd_source) AS odd_source, bool_or(odd_function) AS odd_function FROM marked GROUP BY company_id)
SELECT c.company_id, c.research_stage_reached, concat_ws(';',
  CASE WHEN NOT coalesce(c.online_presence_score BETWEEN 0 AND 100, false) THEN 'presence_out_of_range' END,
  CASE WHEN NOT coalesce(list_contains({Q.arr(S.RESEARCH_STAGES)}, c.research_stage_reached), false) THEN 'unknown_stage' END,
  CASE WHEN a.bad_range THEN 'confidence_out_of_range' END, CASE WHEN a.low THEN 'confidence_below_floor' END,
  CASE WHEN a.outside THEN 'confidence_outside_band' END, CASE WHEN a.odd_source THEN 'unknown_source_type' END,
  CASE WHEN a.odd_function THEN 'unknown_business_function' END) AS violations
FROM research_companies c LEFT JOIN agg a ON c.company_id = a.company_id""")
def q_check_research_rules(spark, sf_dir):
    """Domains, ranges and stage bands of a research result, from a rule table (Q4, Q6, Q7)."""
    return RU.check_research_rules(B.research_results(Tables(spark, sf_dir))).select(
        "company_id", "research_stage_reached", "violations")


def _should_sql(stage: str) -> str:
    veto = (f"(coalesce(f.best >= {S.ESCALATE_CONFIDENCE_CLEAR}, false) OR coalesce(f.n, 0) = 0 "
            f"OR c.online_presence_score < {S.ESCALATE_PRESENCE_LOW})")
    s2a = (f"coalesce((f.best >= 0.5 AND f.best < 0.7) OR (c.online_presence_score >= "
           f"{S.ESCALATE_PRESENCE_HIGH} AND coalesce(f.missing_url, false)) OR "
           f"(coalesce(f.n, 0) >= 2 AND NOT coalesce(f.any_url, false)), false)")
    s2b = "coalesce((f.best >= 0.5 AND f.best <= 0.7) OR coalesce(f.missing_detail, false), false)"
    return (f"(CASE WHEN {stage} = '2A' THEN NOT {veto} AND {s2a} "
            f"WHEN {stage} = '2B' THEN NOT {veto} AND {s2b} ELSE false END)")


_FJOIN = f"research_companies c LEFT JOIN {_FAGG} f ON c.company_id = f.company_id AND NOT c.result_is_null"


@register("escalation_rule", sql=f"""{_RJ}
SELECT c.company_id, c.research_stage_reached, {_should_sql('c.research_stage_reached')} AS should_escalate,
  CASE WHEN c.result_is_null THEN false ELSE c.recommend_escalation END AS recommend_escalation,
  {_should_sql('c.research_stage_reached')} <> (CASE WHEN c.result_is_null THEN false ELSE c.recommend_escalation END) AS mismatch
FROM {_FJOIN}""")
def q_escalation_rule(spark, sf_dir):
    """Recomputed escalation flag vs the reply's recommendation (Q8)."""
    return QA.escalation_rule(B.research_results(Tables(spark, sf_dir)))


# ---- triage -------------------------------------------------------------------

def _priority(spark, sf_dir):
    return B.priority_log(Tables(spark, sf_dir))


def _priority_sql() -> str:
    return with_views("priority_log")


@register("route_by_score", sql=f"""{_priority_sql()}
SELECT rcid, research_priority_score, research_priority_score >= 3 AS should_deep_research,
  research_priority_score >= 4 AS is_high_priority FROM priority_log""")
def q_route_by_score(spark, sf_dir):
    """should_deep_research (>= 3) and is_high_priority (>= 4) (P25)."""
    return TR.route_by_score(_priority(spark, sf_dir))


def _dist_sql(reading: str, where: str) -> str:
    return f"""SELECT '{reading}' AS reading, s.score, s.label, coalesce(d.n, 0) AS n,
  round({Q.pct('coalesce(d.n, 0)', 't.total')}, 6) AS pct, round({Q.pct('t.ge3', 't.total')}, 6) AS pct_ge_3
FROM (SELECT unnest(range(0, 6)) AS score, unnest({Q.arr(TR.SCORE_LABELS)}) AS label) s
LEFT JOIN (SELECT research_priority_score AS score, count(*) AS n FROM priority_log WHERE {where} GROUP BY 1) d
  ON d.score = s.score
CROSS JOIN (SELECT count(*) AS total, count(CASE WHEN research_priority_score BETWEEN 3 AND 5 THEN 1 END) AS ge3
            FROM priority_log WHERE {where}) t"""


@register("score_distribution", sql=f"""{_priority_sql()}
{_dist_sql('all', 'true')}
UNION ALL {_dist_sql('without_errors', 'error IS NULL')}""")
def q_score_distribution(spark, sf_dir):
    """Count and % per priority score 0-5 (zero-filled) and share >= 3,
    with and without failed rows (A16)."""
    return TR.score_distribution(_priority(spark, sf_dir))


@register("cost_rollup", sql=f"""{_RJ},
reach AS (SELECT research_stage_reached AS s, count(*) AS n FROM research_companies GROUP BY 1),
stages(stage, ord, unit_min, unit_max) AS (VALUES {', '.join(f"('{st}', {i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for i, (st, lo, hi) in enumerate(TR.STAGE_UNIT_COSTS))}),
per AS (SELECT st.stage, st.ord, st.unit_min, st.unit_max,
  (SELECT coalesce(sum(r.n), 0) FROM reach r JOIN stages s2 ON s2.stage = r.s WHERE s2.ord >= st.ord) AS requests
  FROM stages st),
tot AS (SELECT count(*) AS companies FROM research_companies)
SELECT stage, CAST(requests AS BIGINT) AS requests, round(requests * unit_min, 6) AS cost_min,
  round(requests * unit_max, 6) AS cost_max,
  round(sum(requests * unit_max) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_max,
  round(sum(requests * unit_max) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tot.companies, 6) AS avg_per_company_max,
  sum(requests * unit_max) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tot.companies > {S.TARGET_AVG_COST_PER_COMPANY}
    OR sum(requests * unit_max) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > {S.HARD_BUDGET_LIMIT_USD} AS over_budget
FROM per CROSS JOIN tot""")
def q_cost_rollup(spark, sf_dir):
    """Requests x unit cost per stage, running total, average per company,
    over-budget flag (A20)."""
    return TR.cost_rollup(B.research_results(Tables(spark, sf_dir)))


@register("stage_funnel", sql=f"""{_RJ}
SELECT c.research_stage_reached AS stage, count(*) AS companies,
  CAST(sum(CASE WHEN c.result_is_null THEN 0 ELSE coalesce(f.n, 0) END) AS BIGINT) AS findings,
  count(CASE WHEN NOT c.result_is_null AND coalesce(f.n, 0) > 0 THEN 1 END) AS companies_with_findings
FROM research_companies c LEFT JOIN (SELECT company_id, count(*) AS n FROM finding_rows GROUP BY 1) f
  ON c.company_id = f.company_id GROUP BY 1""")
def q_stage_funnel(spark, sf_dir):
    """Companies per furthest stage reached and findings count."""
    return TR.stage_funnel(B.research_results(Tables(spark, sf_dir)))


def _prompt_sql():
    d, h = TR.PROMPT_DEFAULTS, TR.RESEARCH_HEADERS
    signal = "coalesce(f.tool_name, 'unknown tool') || ': ' || coalesce(f.use_case, 'unknown use')"
    earlier = f"{signal} || ' (' || coalesce(f.source_type, 'unknown source') || ', ' || coalesce(f.source_url, 'no link') || ')'"

    def joined(line, sep, missing):
        return (f"coalesce(string_agg({line}, {sep} ORDER BY f.ordinal) FILTER (WHERE f.company_id IS NOT NULL), "
                f"{Q.q(missing)})")

    return f"""{_RJ},
c AS (SELECT *, CASE WHEN company_id % 7 <> 2 THEN homepage_url END AS url,
  CASE WHEN founded_year % 3 <> 0 THEN industry || ', founded ' || CAST(founded_year AS VARCHAR) END AS about FROM research_companies),
p AS (SELECT c.company_id, any_value(c.research_stage_reached) AS stage, any_value(c.company_name) AS name,
  any_value(coalesce(' (website: ' || c.url || ')', '')) AS site, any_value(c.about) AS about,
  'Online presence: ' || CAST(any_value(c.online_presence_score) AS VARCHAR) || ' of 100' AS presence,
  coalesce(any_value(CASE WHEN NOT c.result_is_null THEN c.escalation_reason END), {Q.q(d["reason"])}) AS reason,
  {joined(signal, "'; '", d["signals"])} AS one_line,
  {joined("'- ' || " + signal, "chr(10)", d["signal_list"])} AS signals,
  {joined("'- ' || " + earlier, "chr(10)", d["earlier"])} AS earlier
  FROM c LEFT JOIN finding_rows f ON c.company_id = f.company_id AND NOT c.result_is_null GROUP BY c.company_id)
SELECT company_id, CASE
  WHEN stage = '3' THEN concat_ws(chr(10), {Q.q(h["3"])} || ' ' || name || site || '.', 'Earlier findings to verify and extend:',
    earlier, 'Background: ' || about)
  WHEN stage = '2B' THEN concat_ws(chr(10), {Q.q(h["2B"])} || ' ' || name || site || '.', presence, 'Escalated because: ' || reason,
    'Signals so far:', signals, 'Context: ' || about)
  ELSE concat_ws(chr(10), {Q.q(h["2A"])} || ' ' || name || '.', presence, 'Signals of the screening: ' || one_line,
    'Context: ' || about) END AS prompt
FROM p"""


@register("build_research_prompt", sql=_prompt_sql())
def q_build_research_prompt(spark, sf_dir):
    """Research prompt with a body for each stage: presence, signals, escalation
    reason, earlier findings, context (P14)."""
    r = B.research_results(Tables(spark, sf_dir))
    r = r.withColumn("homepage_url", F.when(F.col("company_id") % 7 != 2, F.col("homepage_url"))).withColumn(
        "about", F.when(F.col("founded_year") % 3 != 0,
                        F.concat("industry", F.lit(", founded "), F.col("founded_year").cast("string"))))
    return TR.build_research_prompt(r, "about")


@register("escalation_cascade", sql=f"""{_RJ},
x AS (SELECT c.company_id, floor(c.online_presence_score / 20) >= 3 AS routed,
  {_should_sql("'2A'")} AS esc_2a, {_should_sql("'2B'")} AS esc_2b FROM {_FJOIN}),
stages(stage, ord, unit_min, unit_max) AS (VALUES {', '.join(f"('{st}', {i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for i, (st, lo, hi) in enumerate(TR.STAGE_UNIT_COSTS))}),
n AS (SELECT count(*) AS n1, count(CASE WHEN routed THEN 1 END) AS n2a, count(CASE WHEN routed AND esc_2a THEN 1 END) AS n2b,
  count(CASE WHEN routed AND esc_2a AND esc_2b THEN 1 END) AS n3 FROM x)
SELECT s.stage, CASE s.stage WHEN '1' THEN n1 WHEN '2A' THEN n2a WHEN '2B' THEN n2b ELSE n3 END AS companies,
  round(s.unit_min * CASE s.stage WHEN '1' THEN n1 WHEN '2A' THEN n2a WHEN '2B' THEN n2b ELSE n3 END, 6) AS cost_min,
  round(s.unit_max * CASE s.stage WHEN '1' THEN n1 WHEN '2A' THEN n2a WHEN '2B' THEN n2b ELSE n3 END, 6) AS cost_max
FROM stages s CROSS JOIN n""")
def q_escalation_cascade(spark, sf_dir):
    """Route priority >= 3 to the quick check, escalate by rule to the deep
    check and to deep research; companies and cost per stage (U6)."""
    return TR.escalation_cascade(B.research_results(Tables(spark, sf_dir)))


# a company's reply at a stage is the stand-in reply of the company this many ids on
_REPLY_OF = {"2A": 0, "2B": 1, "3": 2}


def _cascade_sql() -> str:
    asked, parts = "(SELECT company_id, p FROM screened WHERE escalated)", []
    for stage, on in _REPLY_OF.items():
        name = f"stage_{stage.lower()}"
        parts.append(f"""{name} AS (SELECT c.company_id, c.online_presence_score AS p, e.err AS parse_error,
    CAST(CASE WHEN e.err IS NULL THEN coalesce(e.nf, 0) ELSE 0 END AS INTEGER) AS n_findings,
    e.err IS NULL AND {_should_sql(f"'{stage}'")} AS escalated
  FROM (SELECT company_id, p AS online_presence_score FROM {asked}) c
  LEFT JOIN said e ON e.company_id = c.company_id + {on} LEFT JOIN {_FAGG} f ON f.company_id = c.company_id + {on})""")
        asked = f"(SELECT company_id, p FROM {name} WHERE escalated)"
    rows = " UNION ALL ".join(f"SELECT '{s}' AS stage, company_id, parse_error, n_findings, escalated FROM stage_{s.lower()}"
                              for s in _REPLY_OF)
    return f"""{with_views("research_companies", "finding_rows", "priority_log")},
said AS (SELECT g.company_id, CASE WHEN c.company_id IS NULL THEN 'No JSON object found in response' ELSE {_PARSE_ERR} END AS err, n.nf
  FROM (SELECT rcid AS company_id FROM priority_log UNION SELECT rcid + 1 FROM priority_log UNION SELECT rcid + 2 FROM priority_log) g
  LEFT JOIN research_companies c ON c.company_id = g.company_id LEFT JOIN {_NF} n ON n.company_id = g.company_id),
screened AS (SELECT rcid AS company_id, online_presence_score * 10 AS p, research_priority_score >= 3 AS escalated FROM priority_log),
{", ".join(parts)},
cascade AS (SELECT '1' AS stage, company_id, CAST(NULL AS VARCHAR) AS parse_error, 0 AS n_findings, escalated FROM screened
  UNION ALL {rows})"""


def _replies_to(asked, replies):
    """The replies that some stage of the asked companies may take, written once:
    each part of a stage joins with these, not with the texts of all companies."""
    spark = replies.sparkSession
    keys = asked.select(F.explode(F.array(*[F.col("company_id") + on for on in _REPLY_OF.values()])).alias("company_id"))
    path = sinks.scratch_path(spark, "cascade_replies")
    replies.select("company_id", "reply").join(keys, "company_id", "left_semi").write.parquet(path)
    return spark.read.parquet(path)


def _cascade(spark, sf_dir):
    t = Tables(spark, sf_dir)
    screened = B.priority_log(t).select(
        F.col("rcid").alias("company_id"), (F.col("online_presence_score") * 10).alias("online_presence_score"),
        (F.col("research_priority_score") >= S.DEEP_RESEARCH_MIN_SCORE).alias("escalated"))
    replies = _replies_to(screened.where("escalated"), B.research_replies(t))

    def call(rows, stage):
        said = replies.select((F.col("company_id") - _REPLY_OF[stage]).alias("company_id"), "reply")
        return rows.join(said, "company_id", "left")

    stages = CA.run_cascade(screened.where("escalated").drop("escalated"), call, sinks.scratch_path(spark, "cascade"))
    return CA.cascade_rows(screened, stages)


@register("staged_cascade", sql=f"""{_cascade_sql()}
SELECT * FROM cascade""")
def q_staged_cascade(spark, sf_dir):
    """Score >= 3 to the quick check, then by the rule on the parsed replies to the
    deep check and to deep research; a row per company and stage (U6)."""
    return _cascade(spark, sf_dir)


@register("staged_cascade_costs", sql=f"""{_cascade_sql()},
stages(stage, unit_min, unit_max) AS (VALUES {', '.join(f"('{st}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for st, lo, hi in TR.STAGE_UNIT_COSTS)})
SELECT s.stage, count(c.company_id) AS companies, round(count(c.company_id) * any_value(s.unit_min), 6) AS cost_min,
  round(count(c.company_id) * any_value(s.unit_max), 6) AS cost_max
FROM stages s LEFT JOIN cascade c ON c.stage = s.stage GROUP BY s.stage""")
def q_staged_cascade_costs(spark, sf_dir):
    """Companies asked and cost of each stage of the run over replies."""
    return CA.cascade_costs(_cascade(spark, sf_dir))
