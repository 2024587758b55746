"""Registered queries: the model seam and the two comparison experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import compare as C
from tallyho.operators import labelers as L
from tallyho.operators import profiles as P
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import WIDE_EXTRA, token_count, with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables


def _companies(spark, sf_dir):
    return B.companies(Tables(spark, sf_dir))


_MSG_CID = (f"CASE WHEN {Q.is_blank('org_uuid')} THEN 'startup-row-' || CAST(rcid AS VARCHAR) "
            f"ELSE 'startup-' || {Q.strip_ws('org_uuid')} END")


@register("apply_model", sql=f"""{with_views('companies')}
SELECT {_MSG_CID} AS custom_id,
  CAST({token_count(Q.profile_message(), S.AI_VOCABULARY)} AS VARCHAR) AS reply,
  CAST(NULL AS VARCHAR) AS error
FROM companies""")
def q_apply_model(spark, sf_dir):
    """Each request text through a vectorised model over Arrow batches
    (mapInPandas), set up once per task; failures become an error column (U1)."""
    c = _companies(spark, sf_dir)
    req = c.select(F.col("rcid"), L.X.custom_id("org_uuid", "rcid").alias("custom_id"),
                   P.profile_message(c).alias("message"))
    return L.apply_model(req, "message", factory=L.vocabulary_hits_model)


def _pair_sql(a: str, b: str) -> str:
    return f"""{with_views(a, b)},
paired AS (SELECT x.custom_id AS id, CAST(x.AI_native AS DOUBLE) AS label_a, CAST(y.AI_native AS DOUBLE) AS label_b,
  CAST(x.Confidence_1to5 AS DOUBLE) AS conf_a, CAST(y.Confidence_1to5 AS DOUBLE) AS conf_b,
  coalesce(CAST(x.AI_native AS DOUBLE) = CAST(y.AI_native AS DOUBLE), false) AS agree
  FROM {a} x JOIN {b} y ON x.custom_id = y.custom_id),
stats AS (SELECT count(*) AS total, count(CASE WHEN agree THEN 1 END) AS agreements, count(*) - count(CASE WHEN agree THEN 1 END) AS disagreements,
  count(CASE WHEN label_a = 1 AND label_b = 0 THEN 1 END) AS a1_b0, count(CASE WHEN label_a = 0 AND label_b = 1 THEN 1 END) AS a0_b1,
  sum(label_a) AS sum_a, sum(label_b) AS sum_b, avg(conf_a) AS mean_conf_a, avg(conf_b) AS mean_conf_b,
  stddev_samp(conf_a) AS std_conf_a, stddev_samp(conf_b) AS std_conf_b, corr(conf_a, conf_b) AS corr FROM paired)"""


def _summary_and_decision_sql() -> str:
    from tallyho.plans.q_compare import _ladder_sql
    rate = Q.pct("agreements", "total")
    return f"""SELECT total AS total_rows, agreements, disagreements, round({rate}, 6) AS agreement_rate,
  round({Q.pct('sum_a', 'total')}, 6) AS a_positive_rate, round({Q.pct('sum_b', 'total')}, 6) AS b_positive_rate,
  round(mean_conf_a, 6) AS a_conf_mean, round(mean_conf_b, 6) AS b_conf_mean, round(corr, 6) AS correlation,
  a1_b0 AS a_pos_b_neg, a0_b1 AS b_pos_a_neg,
  {_ladder_sql(rate, S.VERDICT_TIERS, S.VERDICT_FLOOR)} AS verdict,
  {_ladder_sql(rate, S.RECOMMENDATION_TIERS, S.RECOMMENDATION_FLOOR)} AS recommendation
FROM stats"""


def _experiment(run_a, run_b):
    """One comparison aggregate; the verdict is derived from its row."""
    p = C.paired(L.as_run(run_a), L.as_run(run_b))
    s = C.comparison_stats(p)
    rate = C.safe_pct("agreements", "total")
    dec = C.decision_columns(rate, C.safe_pct("sum_a", "total"), C.safe_pct("sum_b", "total"),
                             F.col("mean_conf_a"), F.col("mean_conf_b"))
    return s.select(
        F.col("total").alias("total_rows"), "agreements", "disagreements",
        F.round(rate, 6).alias("agreement_rate"),
        F.round(C.safe_pct("sum_a", "total"), 6).alias("a_positive_rate"),
        F.round(C.safe_pct("sum_b", "total"), 6).alias("b_positive_rate"),
        F.round("mean_conf_a", 6).alias("a_conf_mean"),
        F.round("mean_conf_b", 6).alias("b_conf_mean"),
        F.round("corr", 6).alias("correlation"),
        F.col("a1_b0").alias("a_pos_b_neg"), F.col("a0_b1").alias("b_pos_a_neg"),
        dec[0], dec[1])


@register("ablation_experiment", sql=f"""{_pair_sql('u2', 'u2_short')}
{_summary_and_decision_sql()}""")
def q_ablation_experiment(spark, sf_dir):
    """One labeller on full input and on input without the long
    description, then the comparison summary and verdict (U4)."""
    c = _companies(spark, sf_dir)
    full = L.lexical_ai_native(c)
    short = L.lexical_ai_native(c.withColumn("long_description", F.lit(None).cast("string")))
    return _experiment(full, short)


@register("two_model_comparison", sql=f"""{_pair_sql('u2', 'u2_wide')}
{_summary_and_decision_sql()}""")
def q_two_model_comparison(spark, sf_dir):
    """Two labeller configurations (narrow vs wide vocabulary) on the same
    rows, then the comparison summary and verdict (U5)."""
    c = _companies(spark, sf_dir)
    a = L.lexical_ai_native(c)
    b = L.lexical_ai_native(c, vocabulary=S.AI_VOCABULARY + WIDE_EXTRA)
    return _experiment(a, b)
