"""Research results: row expansion, summaries, evidence-quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators.replies import extract_json_span

_COMPANY_COLS = ["company_id", "company_name", "homepage_url", "industry",
                 "founded_year", "research_stage_reached",
                 "online_presence_score", "website_alive", "research_cost_usd"]


def expand_findings(results: DataFrame, researched_at: str,
                    result_col: str = "result") -> DataFrame:
    """One row per finding; a company with none gets exactly one row
    (found false, finding_id 1, confidence 0.0, reason or 'no_evidence').

    ``found`` follows the findings array, not the reply's own flag.  The
    expansion is a narrow ``posexplode_outer`` - no shuffle.
    """
    r = F.col(result_col)
    x = results.select(*_COMPANY_COLS,
                       F.to_timestamp_ntz(F.lit(researched_at)).alias("researched_at"),
                       r["no_finding_reason"].alias("_reason"),
                       F.posexplode_outer(r["findings"]).alias("_pos", "_f"))
    has = F.col("_f").isNotNull()
    f = F.col("_f")
    return x.select(
        *_COMPANY_COLS, "researched_at",
        F.when(has, F.col("_pos") + 1).otherwise(F.lit(1)).cast("int").alias("finding_id"),
        has.alias("genai_adoption_found"),
        F.when(has, f["confidence"]).otherwise(F.lit(0.0)).alias("adoption_confidence"),
        *[F.when(has, f[c]).alias(c) for c in
          ["tool_name", "use_case", "business_function", "evidence_summary",
           "source_url", "source_type"]],
        F.when(has, F.lit(None).cast("string"))
         .otherwise(F.coalesce(F.col("_reason"), F.lit(S.NO_EVIDENCE_REASON)))
         .alias("no_finding_reason"))


def rows_written_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("company_id").alias("companies"),
                    F.count(F.lit(1)).alias("rows"),
                    F.count_if("genai_adoption_found").alias("finding_rows"))


def summarize_findings(results: DataFrame, result_col: str = "result",
                       type_field: str = "tool_name") -> DataFrame:
    """has_adoption_evidence: any finding whose ``type_field`` is not one
    of the negative finding types; highest_confidence: max finding
    confidence or 0.0 (array functions, no shuffle)."""
    fs = F.coalesce(F.col(result_col)["findings"],
                    F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>"))
    neg = F.array(*[F.lit(v) for v in S.NEGATIVE_FINDING_TYPES])
    return results.select(
        "company_id",
        F.exists(fs, lambda f: ~F.coalesce(F.array_contains(neg, f[type_field]),
                                           F.lit(False))).alias("has_adoption_evidence"),
        F.coalesce(F.array_max(F.transform(fs, lambda f: f["confidence"])),
                   F.lit(0.0)).alias("highest_confidence"),
        F.size(fs).alias("n_findings"))


def drop_low_confidence_findings(results: DataFrame, result_col: str = "result",
                                 min_conf: float = S.MIN_FINDING_CONFIDENCE) -> DataFrame:
    """Findings below ``min_conf`` are not findings (array filter)."""
    r = F.col(result_col)
    return results.withColumn(
        result_col, F.when(r.isNotNull(), r.withField(
            "findings", F.filter(r["findings"],
                                 lambda f: F.coalesce(f["confidence"] >= min_conf,
                                                      F.lit(False))))))


CITATION_TYPE = "array<struct<url:string,title:string,snippet:string>>"


def normalize_citations(raw: DataFrame, json_col: str = "raw") -> DataFrame:
    """Mixed string / object citations -> array<struct<url,title,snippet>>;
    derived has_citations, urls and total_tokens (variant, no Python)."""
    v = F.try_parse_json(F.col(json_col))
    items = F.try_variant_get(v, "$.citations", "array<variant>")
    cites = F.transform(items, lambda x: F.when(
        F.schema_of_variant(x) == "STRING",
        F.struct(F.try_variant_get(x, "$", "string").alias("url"),
                 F.lit(None).cast("string").alias("title"),
                 F.lit(None).cast("string").alias("snippet")))
        .otherwise(F.struct(F.try_variant_get(x, "$.url", "string").alias("url"),
                            F.try_variant_get(x, "$.title", "string").alias("title"),
                            F.try_variant_get(x, "$.snippet", "string").alias("snippet"))))
    keep = [c for c in raw.columns if c != json_col]
    x = raw.select(*keep, F.coalesce(cites, F.array().cast(CITATION_TYPE)).alias("citations"),
                   (F.coalesce(F.try_variant_get(v, "$.usage.prompt_tokens", "bigint"), F.lit(0))
                    + F.coalesce(F.try_variant_get(v, "$.usage.completion_tokens", "bigint"),
                                 F.lit(0))).alias("total_tokens"))
    return x.select(*keep, "citations", (F.size("citations") > 0).alias("has_citations"),
                    F.transform("citations", lambda c: c["url"]).alias("urls"),
                    "total_tokens")


# ---- typed findings -----------------------------------------------------------

_TEXT_FIELDS = ["finding_type", "description", "source_url", "source_title"]


def _typed(item) -> F.Column:
    """A finding's declared fields; the confidence is NULL if it is absent or no number."""
    number = F.try_variant_get(item, "$.confidence_score", "string").try_cast("double")
    return F.struct(*[F.try_variant_get(item, f"$.{n}", "string").alias(n) for n in _TEXT_FIELDS],
                    number.alias("confidence_score"))


def _why_not(item, f) -> F.Column:
    """Why a finding is quarantined; NULL if it is not."""
    return (F.when(~F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False)), F.lit("no_object"))
            .when(~F.coalesce(f["finding_type"].isin(*S.FINDING_TYPES), F.lit(False)), F.lit("unknown_finding_type"))
            .when(f["description"].isNull(), F.lit("missing_description"))
            .when(~F.coalesce(f["confidence_score"].between(0.0, 1.0), F.lit(False)), F.lit("confidence_out_of_range")))


def typed_findings(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """Findings of a reply as typed columns.

    ``finding_type`` is one of a declared list, exactly as written; a finding of
    another type, without a description, with a confidence that is no number of
    0 to 1 (a number written as a text is one), or that is no object, is not
    coerced: it goes to ``quarantined`` (1-based place, reason, its fields).
    ``findings`` holds the others in their order.  A reply without JSON or
    without a list has neither.
    """
    keep = [c for c in replies.columns if c != text_col]
    items = F.try_variant_get(F.try_parse_json(extract_json_span(text_col)), "$.findings", "array<variant>")
    x = replies.select(*keep, items.alias("_items"))
    x = x.select(*keep, F.transform("_items", lambda v, i: F.struct(i.alias("i"), v.alias("v"), _typed(v).alias("f"))).alias("_f"))
    x = x.select(*keep, F.transform(F.coalesce("_f", F.array().cast(x.schema["_f"].dataType)), lambda e: F.struct(
        (e["i"] + 1).alias("finding_id"), _why_not(e["v"], e["f"]).alias("reason"), e["f"].alias("f"))).alias("_j"))
    return x.select(
        *keep, F.transform(F.filter("_j", lambda e: e["reason"].isNull()), lambda e: e["f"]).alias("findings"),
        F.filter("_j", lambda e: e["reason"].isNotNull()).alias("quarantined"))


def summarize_typed_findings(typed: DataFrame) -> DataFrame:
    """has_adoption_evidence: any finding of a type that is not negative;
    highest_confidence: of all findings, 0.0 without; array functions only."""
    negative = S.NEGATIVE_FINDING_TYPES
    return typed.select(
        "company_id",
        F.exists("findings", lambda f: ~f["finding_type"].isin(*negative)).alias("has_adoption_evidence"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["confidence_score"])), F.lit(0.0)).alias("highest_confidence"),
        F.size("findings").alias("n_findings"), F.size("quarantined").alias("n_quarantined"))


def quarantined_findings(typed: DataFrame) -> DataFrame:
    """One row per quarantined finding, with its place, reason and fields."""
    # a plain explode would have its lists tested for being empty first, by parsing every reply twice
    x = typed.select("company_id", F.explode_outer("quarantined").alias("_q")).where("_q is not null")
    return x.select("company_id", F.col("_q.finding_id").alias("finding_id"), F.col("_q.reason").alias("reason"),
                    *[F.col(f"_q.f.{n}").alias(n) for n in [*_TEXT_FIELDS, "confidence_score"]])
