"""Registered queries: comparing two classification runs."""

from __future__ import annotations

from tallyho.operators import compare as C
from tallyho.plans.oracle_views import with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables


def pct(n: str, d: str) -> str:
    """SQL twin of ``safe_pct``."""
    return f"coalesce(CAST({n} AS DOUBLE) * 100.0 / CAST({d} AS DOUBLE), 0.0)"


def _paired(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.paired(B.runs_a(t), B.runs_b(t))


W_P = with_views("paired")
W_AB = with_views("runs_a", "runs_b")


@register("compare_runs_inner", sql=f"""{W_AB}
SELECT a.CompanyID,
  a.CompanyName AS CompanyName_a, a.AI_native AS AI_native_a,
  a.Confidence_1to5 AS Confidence_1to5_a, a.Reasons_3_points AS Reasons_3_points_a,
  a.Sources_used AS Sources_used_a, a.Verification_critique AS Verification_critique_a,
  b.CompanyName AS CompanyName_b, b.AI_native AS AI_native_b,
  b.Confidence_1to5 AS Confidence_1to5_b, b.Reasons_3_points AS Reasons_3_points_b,
  b.Sources_used AS Sources_used_b, b.Verification_critique AS Verification_critique_b
FROM runs_a a JOIN runs_b b ON a.CompanyID = b.CompanyID""")
def q_compare_runs_inner(spark, sf_dir):
    """Run A inner-join run B on CompanyID with suffixed columns."""
    t = Tables(spark, sf_dir)
    return C.compare_runs_inner(B.runs_a(t), B.runs_b(t))


@register("align_common_ids", sql=f"""{W_AB}
SELECT count(CASE WHEN a.na IS NOT NULL AND b.nb IS NOT NULL THEN 1 END) AS n_common,
  count(CASE WHEN b.nb IS NULL THEN 1 END) AS n_only_a, count(CASE WHEN a.na IS NULL THEN 1 END) AS n_only_b,
  CAST(coalesce(sum(a.na - 1), 0) AS BIGINT) AS n_repeated_a,
  CAST(coalesce(sum(b.nb - 1), 0) AS BIGINT) AS n_repeated_b
FROM (SELECT CompanyID AS id, count(*) AS na FROM runs_a GROUP BY 1) a
FULL OUTER JOIN (SELECT CompanyID AS id, count(*) AS nb FROM runs_b GROUP BY 1) b
ON a.id = b.id""")
def q_align_common_ids(spark, sf_dir):
    """Shared / A-only / B-only / repeated id counts via one full outer join."""
    t = Tables(spark, sf_dir)
    return C.align_common_ids(B.runs_a(t), B.runs_b(t))


@register("agreement_overall", sql=f"""{W_P}
SELECT count(*) AS total, count(CASE WHEN agree THEN 1 END) AS agreements,
  count(*) - count(CASE WHEN agree THEN 1 END) AS disagreements,
  round({pct('count(CASE WHEN agree THEN 1 END)', 'count(*)')}, 6) AS agreement_rate
FROM paired""")
def q_agreement_overall(spark, sf_dir):
    """Agreements, disagreements (NULL labels disagree) and rate (A5)."""
    return C.agreement_overall(_paired(spark, sf_dir))


_STATS = """count(*) AS total, count(CASE WHEN agree THEN 1 END) AS agreements,
  count(*) - count(CASE WHEN agree THEN 1 END) AS disagreements,
  count(CASE WHEN label_a = 1 AND label_b = 0 THEN 1 END) AS a1_b0,
  count(CASE WHEN label_a = 0 AND label_b = 1 THEN 1 END) AS a0_b1,
  sum(label_a) AS sum_a, sum(label_b) AS sum_b,
  avg(conf_a) AS mean_conf_a, avg(conf_b) AS mean_conf_b,
  stddev_samp(conf_a) AS std_conf_a, stddev_samp(conf_b) AS std_conf_b,
  corr(conf_a, conf_b) AS corr"""
W_STATS = f"{W_P}, stats AS (SELECT {_STATS} FROM paired)"


@register("disagreement_direction", sql=f"""{W_STATS}
SELECT disagreements, a1_b0, a0_b1, disagreements - a1_b0 - a0_b1 AS undetermined,
  round({pct('a1_b0', 'disagreements')}, 6) AS pct_a1_b0,
  round({pct('a0_b1', 'disagreements')}, 6) AS pct_a0_b1
FROM stats""")
def q_disagreement_direction(spark, sf_dir):
    """1->0 and 0->1 counts and their share of disagreements."""
    return C.disagreement_direction(_paired(spark, sf_dir))


@register("agreement_by_confidence", sql=f"""{W_P}
SELECT run, conf AS confidence_level, count(*) AS n, count(CASE WHEN agree THEN 1 END) AS n_agree,
  round({pct('count(CASE WHEN agree THEN 1 END)', 'count(*)')}, 6) AS agreement_rate
FROM (SELECT 'A' AS run, conf_a AS conf, agree FROM paired
      UNION ALL SELECT 'B' AS run, conf_b AS conf, agree FROM paired)
WHERE conf IS NOT NULL GROUP BY run, conf""")
def q_agreement_by_confidence(spark, sf_dir):
    """Agreement rate per run and confidence level."""
    return C.agreement_by_confidence(_paired(spark, sf_dir))


@register("confidence_stats", sql=f"""{W_STATS}
SELECT round(mean_conf_a, 6) AS mean_conf_a, round(mean_conf_b, 6) AS mean_conf_b,
  round(std_conf_a, 6) AS std_conf_a, round(std_conf_b, 6) AS std_conf_b,
  round(corr, 6) AS corr, round(mean_conf_b - mean_conf_a, 6) AS mean_diff
FROM stats""")
def q_confidence_stats(spark, sf_dir):
    """Mean, sample std, Pearson r and mean difference of confidence."""
    return C.confidence_stats(_paired(spark, sf_dir))


_STEP = repr(4.0 / 99)


@register("confidence_regression", sql=f"""{W_P},
fit AS (SELECT regr_slope(conf_b, conf_a) AS slope, regr_intercept(conf_b, conf_a) AS intercept FROM paired)
SELECT CAST(i AS INTEGER) AS i,
  round(1.0 + i * CAST('{_STEP}' AS DOUBLE), 6) AS x,
  round(slope * (1.0 + i * CAST('{_STEP}' AS DOUBLE)) + intercept, 6) AS y_fit,
  round(slope, 6) AS slope, round(intercept, 6) AS intercept
FROM fit CROSS JOIN range(100) r(i)""")
def q_confidence_regression(spark, sf_dir):
    """Degree-1 least squares of B on A and 100 fitted points on [1,5]."""
    return C.confidence_regression(_paired(spark, sf_dir))


@register("confidence_histogram", sql=f"""{W_P},
long AS (SELECT 'A' AS run, conf_a AS conf FROM paired UNION ALL SELECT 'B', conf_b FROM paired),
binned AS (SELECT run, CASE WHEN conf >= 0.5 AND conf < 5.5 THEN floor(conf + 0.5) END AS level FROM long),
tot AS (SELECT run, count(*) AS run_total FROM binned GROUP BY run)
SELECT c.run, CAST(c.level AS INTEGER) AS level, c.n, round({pct('c.n', 't.run_total')}, 6) AS pct
FROM (SELECT run, level, count(*) AS n FROM binned GROUP BY run, level) c JOIN tot t ON c.run = t.run
WHERE c.level IS NOT NULL""")
def q_confidence_histogram(spark, sf_dir):
    """Count and % per confidence level for each run (A10)."""
    return C.confidence_histogram(_paired(spark, sf_dir))


@register("rate_difference", sql=f"""{W_P}
SELECT count(*) AS total, count(CASE WHEN label_a = 1 THEN 1 END) AS n_pos_a, count(CASE WHEN label_b = 1 THEN 1 END) AS n_pos_b,
  round({pct('count(CASE WHEN label_a = 1 THEN 1 END)', 'count(*)')}, 6) AS rate_a,
  round({pct('count(CASE WHEN label_b = 1 THEN 1 END)', 'count(*)')}, 6) AS rate_b,
  round({pct('count(CASE WHEN label_b = 1 THEN 1 END)', 'count(*)')} - {pct('count(CASE WHEN label_a = 1 THEN 1 END)', 'count(*)')}, 6) AS rate_diff
FROM paired""")
def q_rate_difference(spark, sf_dir):
    """Positive-label rate per run and signed difference."""
    return C.rate_difference(_paired(spark, sf_dir))


@register("summary_metrics", sql=f"""{W_STATS}
SELECT total AS total_rows, sum_a AS a_positive_sum, sum_b AS b_positive_sum,
  round({pct('sum_a', 'total')}, 6) AS a_positive_rate,
  round({pct('sum_b', 'total')}, 6) AS b_positive_rate,
  agreements, disagreements, round({pct('agreements', 'total')}, 6) AS agreement_rate,
  round(mean_conf_a, 6) AS a_conf_mean, round(mean_conf_b, 6) AS b_conf_mean,
  round(std_conf_a, 6) AS a_conf_std, round(std_conf_b, 6) AS b_conf_std,
  round(corr, 6) AS correlation, a1_b0 AS a_pos_b_neg, a0_b1 AS b_pos_a_neg
FROM stats""")
def q_summary_metrics(spark, sf_dir):
    """The 15-field one-row comparison summary."""
    return C.summary_metrics(_paired(spark, sf_dir))


@register("disagreement_dataset", sql=f"""{W_P}
SELECT id, name, label_a, label_b, conf_a, conf_b, reasons_a, reasons_b,
  CASE WHEN label_a = 1 AND label_b = 0 THEN '{C.DIR_A}'
       WHEN label_a = 0 AND label_b = 1 THEN '{C.DIR_B}'
       ELSE 'undetermined' END AS direction,
  CASE WHEN coalesce(label_a = 1, false) THEN '{C.DIR_A}' ELSE '{C.DIR_B}' END AS reference_direction
FROM paired WHERE NOT agree""")
def q_disagreement_dataset(spark, sf_dir):
    """Row-level disagreements with both sides and a direction label."""
    return C.disagreement_dataset(_paired(spark, sf_dir))


@register("full_comparison_dataset", sql=f"""{W_P}
SELECT id, name, label_a, label_b, conf_a, conf_b, agree, conf_b - conf_a AS conf_diff
FROM paired""")
def q_full_comparison_dataset(spark, sf_dir):
    """Row-level side-by-side comparison."""
    return C.full_comparison_dataset(_paired(spark, sf_dir))


@register("duplicate_ids", sql=f"""{W_AB}
SELECT count(*) AS rows, count(DISTINCT CompanyID) AS distinct_ids,
  count(*) - count(DISTINCT CompanyID) AS duplicates
FROM (SELECT CompanyID FROM runs_a UNION ALL SELECT CompanyID FROM runs_b)""")
def q_duplicate_ids(spark, sf_dir):
    """Repeated ids in the concatenation of both runs' outputs."""
    t = Tables(spark, sf_dir)
    return C.duplicate_ids(C.rows_union_all(B.runs_a(t), B.runs_b(t)))


def _ladder_sql(x, tiers, floor_):
    parts = " ".join(f"WHEN {x} >= {th} THEN '{name}'" for th, name in tiers)
    return f"CASE {parts} ELSE '{floor_}' END"


from tallyho import schemas as S  # noqa: E402

_RATE = pct("agreements", "total")
_RA, _RB = pct("sum_a", "total"), pct("sum_b", "total")


@register("agreement_decision", sql=f"""{W_STATS}
SELECT round({_RATE}, 6) AS agreement_rate,
  {_ladder_sql(_RATE, S.VERDICT_TIERS, S.VERDICT_FLOOR)} AS verdict,
  {_ladder_sql(_RATE, S.RECOMMENDATION_TIERS, S.RECOMMENDATION_FLOOR)} AS recommendation,
  CASE WHEN abs({_RB} - {_RA}) < {S.RATE_SAME_TOLERANCE_POINTS} THEN 'same'
       WHEN {_RB} - {_RA} > 0 THEN 'b_more_positive' ELSE 'b_fewer_positive' END AS rate_note,
  CASE WHEN mean_conf_b < mean_conf_a THEN 'lower' WHEN mean_conf_b > mean_conf_a THEN 'higher'
       ELSE 'similar' END AS confidence_note
FROM stats""")
def q_agreement_decision(spark, sf_dir):
    """Verdict and recommendation tiers plus rate / confidence notes."""
    return C.agreement_decision(_paired(spark, sf_dir))


@register("headline_ratios", sql=f"""{W_STATS}
SELECT round(({_RB} - {_RA}) * 100.0 / nullif({_RA}, 0), 6) AS rate_lift_pct,
  round(CAST(a0_b1 AS DOUBLE) / nullif(a1_b0, 0), 6) AS direction_ratio,
  round((mean_conf_b - mean_conf_a) * 100.0 / nullif(mean_conf_a, 0), 6) AS conf_rel_diff_pct
FROM stats""")
def q_headline_ratios(spark, sf_dir):
    """Relative label-rate lift, direction ratio, relative confidence change."""
    return C.headline_ratios(_paired(spark, sf_dir))


@register("label_rates", sql=f"""{with_views('runs_a')}
SELECT count(*) AS total, count(CASE WHEN AI_native = '1' THEN 1 END) AS n_one, count(CASE WHEN AI_native = '0' THEN 1 END) AS n_zero,
  round({pct("count(CASE WHEN AI_native = '1' THEN 1 END)", 'count(*)')}, 6) AS pct_one,
  round({pct("count(CASE WHEN AI_native = '0' THEN 1 END)", 'count(*)')}, 6) AS pct_zero
FROM runs_a""")
def q_label_rates(spark, sf_dir):
    """Count and % of label '1' and '0' by string compare (A1)."""
    return C.label_rates(B.runs_a(Tables(spark, sf_dir)))


@register("ids_intersect", sql=f"""{W_AB}
SELECT CompanyID AS id FROM runs_a INTERSECT SELECT CompanyID FROM runs_b""")
def q_ids_intersect(spark, sf_dir):
    """Ids present in both runs."""
    t = Tables(spark, sf_dir)
    return C.ids_intersect(B.runs_a(t), B.runs_b(t))


@register("ids_only_a", sql=f"""{W_AB}
SELECT DISTINCT CompanyID AS id FROM runs_a
WHERE CompanyID NOT IN (SELECT CompanyID FROM runs_b WHERE CompanyID IS NOT NULL)""")
def q_ids_only_a(spark, sf_dir):
    """Ids only in run A."""
    t = Tables(spark, sf_dir)
    return C.ids_only(B.runs_a(t), B.runs_b(t))


@register("ids_only_b", sql=f"""{W_AB}
SELECT DISTINCT CompanyID AS id FROM runs_b
WHERE CompanyID NOT IN (SELECT CompanyID FROM runs_a WHERE CompanyID IS NOT NULL)""")
def q_ids_only_b(spark, sf_dir):
    """Ids only in run B."""
    t = Tables(spark, sf_dir)
    return C.ids_only(B.runs_b(t), B.runs_a(t))


@register("ids_union", sql=f"""{W_AB}
SELECT CompanyID AS id FROM runs_a UNION SELECT CompanyID FROM runs_b""")
def q_ids_union(spark, sf_dir):
    """Ids in either run."""
    t = Tables(spark, sf_dir)
    return C.ids_union(B.runs_a(t), B.runs_b(t))


@register("rows_union_all", sql=f"""{W_AB}
SELECT *, 'A' AS run FROM runs_a UNION ALL SELECT *, 'B' AS run FROM runs_b""")
def q_rows_union_all(spark, sf_dir):
    """Both runs' rows concatenated by name, duplicates kept."""
    t = Tables(spark, sf_dir)
    return C.rows_union_all(B.runs_a(t), B.runs_b(t))


@register("ids_distinct", sql=f"""{W_AB}
SELECT DISTINCT CompanyID AS id FROM (SELECT CompanyID FROM runs_a UNION ALL SELECT CompanyID FROM runs_b)""")
def q_ids_distinct(spark, sf_dir):
    """De-duplicated ids of the concatenated runs."""
    t = Tables(spark, sf_dir)
    return C.ids_distinct(C.rows_union_all(B.runs_a(t), B.runs_b(t)))


@register("sort_levels", sql=f"""{W_P}
SELECT DISTINCT run, conf AS confidence_level FROM
 (SELECT 'A' AS run, conf_a AS conf FROM paired UNION ALL SELECT 'B', conf_b FROM paired)
WHERE conf IS NOT NULL ORDER BY run, confidence_level""")
def q_sort_levels(spark, sf_dir):
    """Sorted distinct confidence levels per run (T4)."""
    return C.sort_levels(_paired(spark, sf_dir))


@register("restrict_to_cohort", sql=f"""{W_AB}
SELECT * FROM runs_a WHERE CompanyID IN (SELECT CompanyID FROM runs_b WHERE AI_native = '1')""")
def q_restrict_to_cohort(spark, sf_dir):
    """Run A rows whose id is in the cohort of B's positives (J3, semi join)."""
    t = Tables(spark, sf_dir)
    from pyspark.sql import functions as F
    cohort = B.runs_b(t).where(F.col("AI_native") == "1")
    return C.restrict_to_cohort(B.runs_a(t), cohort, "CompanyID")


@register("sort_by_id", sql=f"""{W_P}
SELECT id, label_a, label_b, conf_a, conf_b FROM paired ORDER BY id""")
def q_sort_by_id(spark, sf_dir):
    """The aligned comparison ordered by id for output (T3; a range-
    partitioned sort, no single-task ordering)."""
    return _paired(spark, sf_dir).select("id", "label_a", "label_b", "conf_a", "conf_b") \
        .orderBy("id")


@register("sink_metrics_json", sql=f"""{W_STATS}
SELECT total AS total_rows, sum_a AS a_positive_sum, sum_b AS b_positive_sum,
  round({pct('sum_a', 'total')}, 6) AS a_positive_rate,
  round({pct('sum_b', 'total')}, 6) AS b_positive_rate,
  agreements, disagreements, round({pct('agreements', 'total')}, 6) AS agreement_rate,
  round(mean_conf_a, 6) AS a_conf_mean, round(mean_conf_b, 6) AS b_conf_mean,
  round(std_conf_a, 6) AS a_conf_std, round(std_conf_b, 6) AS b_conf_std,
  round(corr, 6) AS correlation, a1_b0 AS a_pos_b_neg, a0_b1 AS b_pos_a_neg
FROM stats""")
def q_sink_metrics_json(spark, sf_dir):
    """Write the comparison summary as a one-row JSON document and read it
    back with its schema (S12)."""
    from tallyho.sources import sinks
    m = C.summary_metrics(_paired(spark, sf_dir))
    path = sinks.scratch_path(spark, "metrics")
    sinks.sink_metrics_json(m, path)
    return spark.read.schema(m.schema).json(path)
