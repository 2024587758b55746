"""Triage: priority routing, score distribution, staged research prompts,
costs per stage, the stage funnel and the escalation cascade.

Roll-ups reduce to one aggregate row first and are reshaped with
``stack``; the only windows run over the four stage rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X
from tallyho.operators.quality import escalation_flag

# Labels of the 0-5 priority scale (ours).
SCORE_LABELS = ["none", "very_low", "low", "medium", "high", "very_high"]
# (stage, unit min USD, unit max USD), in stage order.
STAGE_UNIT_COSTS = [("1", 0.020, 0.020), ("2A", 0.02, 0.02), ("2B", 0.05, 0.10),
                    ("3", 0.41, 1.19)]
# Opening line of the staged research prompt (ours).
RESEARCH_HEADERS = {
    "2A": "Quick check of internal generative-AI tool use at",
    "2B": "Deep check of internal generative-AI tool use at",
    "3": "Deep research on internal generative-AI tool use at",
}

# What a prompt says where a part is absent (ours).
PROMPT_DEFAULTS = {
    "signals": "none",
    "signal_list": "- signs of AI use in general",
    "reason": "the screening looked promising",
    "earlier": "- none written down; the stages before saw signs without details",
}


def route_by_score(log: DataFrame, score: str = "research_priority_score") -> DataFrame:
    s = F.col(score)
    return log.select("rcid", score,
                      (s >= S.DEEP_RESEARCH_MIN_SCORE).alias("should_deep_research"),
                      (s >= S.HIGH_PRIORITY_MIN_SCORE).alias("is_high_priority"))


def _distribution(log: DataFrame, reading: str, cond, score: str) -> DataFrame:
    s = F.col(score)
    aggs = [F.count_if(s == i).alias(f"n{i}") for i in S.PRIORITY_SCORE_LEVELS]
    one = log.where(cond).agg(*aggs, F.count(F.lit(1)).alias("total"),
                              F.count_if(s.between(3, 5)).alias("ge3"))
    parts = ", ".join(f"{i}, '{SCORE_LABELS[i]}', n{i}" for i in S.PRIORITY_SCORE_LEVELS)
    return one.select(F.lit(reading).alias("reading"), "total", "ge3",
                      F.expr(f"stack({len(S.PRIORITY_SCORE_LEVELS)}, {parts}) as (score, label, n)")) \
        .select("reading", F.col("score").cast("bigint").alias("score"), "label", "n",
                F.round(X.safe_pct("n", "total"), 6).alias("pct"),
                F.round(X.safe_pct("ge3", "total"), 6).alias("pct_ge_3"))


def score_distribution(log: DataFrame, score: str = "research_priority_score") -> DataFrame:
    """Count and % per score 0-5, zero-filled; out-of-range scores count in
    the total but not in any level.  Two readings: failed rows (scored 0)
    included, and excluded."""
    return _distribution(log, "all", F.lit(True), score).unionByName(
        _distribution(log, "without_errors", F.col("error").isNull(), score))


def stage_costs(counts: DataFrame, n_cols: dict[str, str]) -> DataFrame:
    """One row of per-stage counts -> a row per stage with its costs."""
    parts = ", ".join(f"'{st}', {i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), {n_cols[st]}"
                      for i, (st, lo, hi) in enumerate(STAGE_UNIT_COSTS))
    return counts.select("*", F.expr(
        f"stack({len(STAGE_UNIT_COSTS)}, {parts}) as (stage, ord, unit_min, unit_max, requests)"))


def cost_rollup(results: DataFrame) -> DataFrame:
    """Requests x unit cost per stage (a company pays every stage up to the
    one it reached), running total, average per company, budget flag."""
    st = F.col("research_stage_reached")
    one = results.agg(F.count(F.lit(1)).alias("companies"),
                      *[F.count_if(st == s).alias(f"r{i}")
                        for i, (s, _, _) in enumerate(STAGE_UNIT_COSTS)])
    reach_at_least = {s: " + ".join(f"r{j}" for j in range(i, len(STAGE_UNIT_COSTS)))
                      for i, (s, _, _) in enumerate(STAGE_UNIT_COSTS)}
    per = stage_costs(one, reach_at_least)
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.sum(F.col("requests") * F.col("unit_max")).over(w)
    return per.select(
        "stage", F.col("requests").cast("bigint").alias("requests"),
        F.round(F.col("requests") * F.col("unit_min"), 6).alias("cost_min"),
        F.round(F.col("requests") * F.col("unit_max"), 6).alias("cost_max"),
        F.round(run, 6).alias("running_max"),
        F.round(run / F.col("companies"), 6).alias("avg_per_company_max"),
        ((run / F.col("companies") > S.TARGET_AVG_COST_PER_COMPANY)
         | (run > S.HARD_BUDGET_LIMIT_USD)).alias("over_budget"))


def stage_funnel(results: DataFrame) -> DataFrame:
    n = F.coalesce(F.size(F.col("result.findings")), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return results.groupBy(F.col("research_stage_reached").alias("stage")).agg(
        F.count(F.lit(1)).alias("companies"),
        F.sum(n).cast("bigint").alias("findings"),
        F.count_if(n > 0).alias("companies_with_findings"))


def _bullets(findings, line, missing: str) -> F.Column:
    return F.when(F.size(findings) == 0, F.lit(missing)).otherwise(
        F.array_join(F.transform(findings, lambda f: F.concat(F.lit("- "), line(f))), "\n"))


def _signal(f) -> F.Column:
    return F.concat(F.coalesce(f["tool_name"], F.lit("unknown tool")), F.lit(": "),
                    F.coalesce(f["use_case"], F.lit("unknown use")))


def _earlier(f) -> F.Column:
    return F.concat(_signal(f), F.lit(" ("), F.coalesce(f["source_type"], F.lit("unknown source")), F.lit(", "),
                    F.coalesce(f["source_url"], F.lit("no link")), F.lit(")"))


def build_research_prompt(results: DataFrame, context: str | None = None) -> DataFrame:
    """The prompt of the stage that a company reached, each stage with a body of
    its own: the quick check (also for stage 1) names the presence score and the
    signals in one line; the deep check adds website, reason of the escalation and
    the signals as a list; deep research lists the earlier findings with their
    sources instead.  ``context`` is an optional column of background text.
    Absent parts get a default or, website and context, are left out."""
    fs = F.coalesce(F.col("result.findings"),
                    F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>"))
    about = F.col(context) if context else F.lit(None).cast("string")
    name = F.coalesce("company_name", F.lit("the company"))
    site = F.coalesce(F.concat(F.lit(" (website: "), F.col("homepage_url"), F.lit(")")), F.lit(""))
    presence = F.concat(F.lit("Online presence: "), F.coalesce("online_presence_score", F.lit(0)).cast("string"), F.lit(" of 100"))
    reason = F.coalesce(F.col("result.escalation_reason"), F.lit(PROMPT_DEFAULTS["reason"]))
    one_line = F.when(F.size(fs) == 0, F.lit(PROMPT_DEFAULTS["signals"])).otherwise(
        F.array_join(F.transform(fs, _signal), "; "))

    def head(stage, tail):
        return F.concat(F.lit(RESEARCH_HEADERS[stage] + " "), name, tail, F.lit("."))

    quick = F.concat_ws("\n", head("2A", F.lit("")), presence, F.concat(F.lit("Signals of the screening: "), one_line),
                        F.concat(F.lit("Context: "), about))
    deep = F.concat_ws("\n", head("2B", site), presence, F.concat(F.lit("Escalated because: "), reason),
                       F.lit("Signals so far:"), _bullets(fs, _signal, PROMPT_DEFAULTS["signal_list"]),
                       F.concat(F.lit("Context: "), about))
    research = F.concat_ws("\n", head("3", site), F.lit("Earlier findings to verify and extend:"),
                           _bullets(fs, _earlier, PROMPT_DEFAULTS["earlier"]), F.concat(F.lit("Background: "), about))
    st = F.col("research_stage_reached")
    return results.select("company_id", F.when(st == "3", research).when(st == "2B", deep).otherwise(quick).alias("prompt"))


def escalation_cascade(results: DataFrame) -> DataFrame:
    """Route priority (presence / 20) >= 3 to the quick check; the rule
    escalates to the deep check and then to deep research.  Each stage only
    sees the rows the previous one escalated."""
    routed = F.floor(F.col("online_presence_score") / 20) >= S.DEEP_RESEARCH_MIN_SCORE
    x = results.select(routed.alias("routed"),
                       escalation_flag(results, "2A").alias("e2a"),
                       escalation_flag(results, "2B").alias("e2b"))
    one = x.agg(F.count(F.lit(1)).alias("n1"), F.count_if("routed").alias("n2a"),
                F.count_if(F.col("routed") & F.col("e2a")).alias("n2b"),
                F.count_if(F.col("routed") & F.col("e2a") & F.col("e2b")).alias("n3"))
    per = stage_costs(one, {"1": "n1", "2A": "n2a", "2B": "n2b", "3": "n3"})
    return per.select("stage", F.col("requests").alias("companies"),
                      F.round(F.col("requests") * F.col("unit_min"), 6).alias("cost_min"),
                      F.round(F.col("requests") * F.col("unit_max"), 6).alias("cost_max"))
