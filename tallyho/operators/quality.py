"""Contract checks: each adds ``violations`` (';'-joined rule names, '' when
clean); ``violation_rollup`` counts rows per rule.  All checks are
expressions or one equi-join; the band table is a fixed 5-row broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X


def _violations(rules: list[tuple[str, F.Column]]) -> F.Column:
    return F.concat_ws(";", *[F.when(F.coalesce(bad, F.lit(False)), F.lit(name))
                              for name, bad in rules])


def check_reply_contract(parsed: DataFrame) -> DataFrame:
    """Confidence integer 1-5 (a NULL one is a violation); exactly 3 reasons
    split by ' | ', or none in an 'Insufficient information' reply; sources a
    subset of the vocabulary; critique at most 30 words."""
    exempt = F.coalesce((F.col("Verification_critique") == S.INSUFFICIENT_INFO)
                        & (F.col("Reasons_3_points") == ""), F.lit(False))
    reasons = F.split(F.col("Reasons_3_points"), r" \| ")
    sources = F.filter(F.split(F.col("Sources_used"), S.SOURCE_SEPARATOR),
                       lambda s: s != "")
    vocab = F.array(*[F.lit(v) for v in S.SOURCE_VOCABULARY])
    words = F.size(F.filter(F.split(F.col("Verification_critique"), r"\s+"),
                            lambda w: w != ""))
    rules = [
        ("confidence_not_1_to_5", ~F.coalesce(F.col("Confidence_1to5").rlike("^[1-5]$"), F.lit(False))),
        ("reasons_not_3", ~exempt & (F.coalesce(F.size(reasons), F.lit(0)) != 3)),
        ("unknown_source", F.size(F.array_except(sources, vocab)) > 0),
        ("critique_over_30_words", words > S.CRITIQUE_MAX_WORDS),
    ]
    return parsed.withColumn("violations", _violations(rules))


def check_confidence_cap(parsed: DataFrame, companies: DataFrame) -> DataFrame:
    """No long description => confidence at most 4 (join to the source)."""
    src = companies.select(X.custom_id("org_uuid", "rcid").alias("custom_id"),
                           X.is_blank("long_description").alias("_no_long"))
    j = parsed.join(src, "custom_id", "left")
    conf = X.coerce_numeric("Confidence_1to5")
    return j.withColumn("violations", _violations([
        ("confidence_above_cap_without_long", F.col("_no_long") & (conf > 4))])).drop("_no_long")


def check_insufficient_info(parsed: DataFrame) -> DataFrame:
    """'Insufficient information' => label 0, confidence 1, no reasons or
    sources."""
    ins = F.col("Verification_critique") == S.INSUFFICIENT_INFO
    return parsed.withColumn("violations", _violations([
        ("insufficient_label_not_0", ins & (F.col("AI_native") != "0")),
        ("insufficient_confidence_not_1", ins & (F.col("Confidence_1to5") != "1")),
        ("insufficient_has_reasons", ins & (F.col("Reasons_3_points") != "")),
        ("insufficient_has_sources", ins & (F.col("Sources_used") != "")),
    ]))


def check_adoption_invariants(flat: DataFrame) -> DataFrame:
    """All No <=> no_evidence and no functions; primary is 'strict';
    function keywords from the 14-word vocabulary."""
    all_no = F.lit(True)
    for m in S.ADOPTION_MODES:
        all_no = all_no & (F.col(f"genai_{m}_label") == "No")
    kws = F.filter(F.transform(F.split(F.coalesce(F.col("genai_functions_list"), F.lit("")),
                                       ";"), lambda x: X.strip_ws(x)), lambda x: x != "")
    vocab = F.array(*[F.lit(v) for v in S.FUNCTION_KEYWORDS])
    return flat.withColumn("violations", _violations([
        ("all_no_without_no_evidence", all_no & (F.col("no_evidence_flag") != 1)),
        ("no_evidence_with_yes", ~all_no & (F.col("no_evidence_flag") == 1)),
        ("all_no_with_functions", all_no & (F.size(kws) > 0)),
        ("primary_not_strict", F.col("primary_assessment") != "strict"),
        ("unknown_function_keyword", F.size(F.array_except(kws, vocab)) > 0),
    ]))


def check_mode_monotonic(flat: DataFrame) -> DataFrame:
    """strict Yes => moderate Yes => lenient Yes."""
    y = {m: F.col(f"genai_{m}_label") == "Yes" for m in S.ADOPTION_MODES}
    return flat.withColumn("violations", _violations([
        ("strict_not_in_moderate", y["strict"] & ~y["moderate"]),
        ("moderate_not_in_lenient", y["moderate"] & ~y["lenient"]),
    ]))


def check_ranges(results: DataFrame) -> DataFrame:
    """Presence 0-100, finding confidence 0-1, stage in its domain."""
    fs = F.coalesce(F.col("result.findings"),
                    F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>"))
    stages = F.array(*[F.lit(s) for s in S.RESEARCH_STAGES])
    return results.withColumn("violations", _violations([
        ("presence_out_of_range", ~F.col("online_presence_score").between(0, 100)),
        ("confidence_out_of_range",
         F.exists(fs, lambda f: ~F.coalesce(f["confidence"].between(0.0, 1.0), F.lit(False)))),
        ("unknown_stage", ~F.array_contains(stages, F.col("research_stage_reached"))),
    ]))


def band_table(spark) -> DataFrame:
    return spark.createDataFrame(S.SOURCE_CONFIDENCE_BANDS,
                                 "source_type string, band_min double, band_max double")


def check_source_confidence_band(findings: DataFrame) -> DataFrame:
    """Each finding's confidence must lie in the band of its source type
    (equi-join on source_type to the fixed band table, then bounds)."""
    bands = F.broadcast(band_table(findings.sparkSession))
    j = findings.join(bands, "source_type", "left")
    bad = F.col("band_min").isNotNull() & ~F.col("adoption_confidence").between(
        F.col("band_min"), F.col("band_max"))
    return j.withColumn("violations", _violations([("confidence_outside_band", bad)]))


def escalation_flag(results: DataFrame, stage: str | None = None) -> F.Column:
    """Recomputed escalation (one fixed reading of the prose rules), at the
    row's own stage or at ``stage``."""
    fs = F.coalesce(F.col("result.findings"),
                    F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>"))
    best = F.array_max(F.transform(fs, lambda f: f["confidence"]))
    n = F.size(fs)
    presence = F.col("online_presence_score")
    veto = (F.coalesce(best >= S.ESCALATE_CONFIDENCE_CLEAR, F.lit(False)) | (n == 0)
            | (presence < S.ESCALATE_PRESENCE_LOW))
    missing_url = F.exists(fs, lambda f: f["source_url"].isNull())
    none_url = ~F.exists(fs, lambda f: f["source_url"].isNotNull())
    s2a = ((best >= S.ESCALATE_BAND_LOW) & (best < S.ESCALATE_BAND_HIGH)) | \
        ((presence >= S.ESCALATE_PRESENCE_HIGH) & missing_url) | ((n >= 2) & none_url)
    s2b = ((best >= S.ESCALATE_BAND_LOW) & (best <= S.ESCALATE_BAND_HIGH)) | \
        F.exists(fs, lambda f: f["tool_name"].isNull() | f["use_case"].isNull())
    stage = F.lit(stage) if stage else F.col("research_stage_reached")
    return (F.when(stage == "2A", ~veto & F.coalesce(s2a, F.lit(False)))
            .when(stage == "2B", ~veto & F.coalesce(s2b, F.lit(False)))
            .otherwise(F.lit(False)))


def escalation_rule(results: DataFrame) -> DataFrame:
    rec = F.coalesce(F.col("result.recommend_escalation"), F.lit(False))
    x = results.withColumn("should_escalate", escalation_flag(results))
    return x.select("company_id", "research_stage_reached", "should_escalate",
                    rec.alias("recommend_escalation"),
                    (F.col("should_escalate") != rec).alias("mismatch"))


def violation_rollup(checked: DataFrame) -> DataFrame:
    """Rows per violated rule (a row may violate several)."""
    rules = F.filter(F.split(F.col("violations"), ";"), lambda r: r != "")
    return (checked.select(F.explode(rules).alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n")))
