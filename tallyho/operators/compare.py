"""Comparing two classification runs (agreement, direction, confidence).

A run is a reply table: ``CompanyID`` plus string columns ``AI_native`` and
``Confidence_1to5`` (coerced through double; unparseable -> NULL).  All
statistics are single aggregates over one inner join, so the plan is one
shuffle per side on the id and partial/final aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions.text import coerce_numeric, safe_pct

ID = "CompanyID"


def typed_run(run: DataFrame, id_col: str = ID) -> DataFrame:
    """Project a reply table to (id, name, label, conf, reasons)."""
    return run.select(
        F.col(id_col).alias("id"),
        F.col("CompanyName").alias("name"),
        coerce_numeric("AI_native").alias("label"),
        coerce_numeric("Confidence_1to5").alias("conf"),
        F.col("Reasons_3_points").alias("reasons"),
    )


def dedupe_by_id(run: DataFrame) -> DataFrame:
    """One row per id (repeated ids would misalign a positional compare).

    The kept row is the greatest struct, so the choice is deterministic.
    """
    cols = [c for c in run.columns if c != "id"]
    return (run.groupBy("id").agg(F.max(F.struct(*cols)).alias("r"))
            .select("id", *[F.col(f"r.{c}").alias(c) for c in cols]))


def compare_runs_inner(a: DataFrame, b: DataFrame, id_col: str = ID,
                       suffixes=("_a", "_b")) -> DataFrame:
    """Run A inner-join run B on the id; other columns get suffixes."""
    ra = a.select(F.col(id_col).alias(id_col),
                  *[F.col(c).alias(c + suffixes[0]) for c in a.columns
                    if c != id_col])
    rb = b.select(F.col(id_col).alias(id_col),
                  *[F.col(c).alias(c + suffixes[1]) for c in b.columns
                    if c != id_col])
    return ra.join(rb, id_col, "inner")


def paired(a: DataFrame, b: DataFrame, id_col: str = ID) -> DataFrame:
    """Typed, de-duplicated runs aligned on shared ids."""
    ta = dedupe_by_id(typed_run(a, id_col))
    tb = dedupe_by_id(typed_run(b, id_col))
    return ta.join(tb.select(*[F.col(c).alias(c + "_b") if c != "id" else
                               F.col(c) for c in tb.columns]), "id", "inner") \
        .select("id", "name", F.col("label").alias("label_a"), "label_b",
                F.col("conf").alias("conf_a"), "conf_b",
                F.col("reasons").alias("reasons_a"), "reasons_b")


def agree_col() -> F.Column:
    """NULL never agrees (NaN == NaN is False in the original code)."""
    return F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))


def align_common_ids(a: DataFrame, b: DataFrame, id_col: str = ID) -> DataFrame:
    """Counts of shared, A-only and B-only ids (one full outer join)."""
    ia = a.select(F.col(id_col).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("na"))
    ib = b.select(F.col(id_col).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("nb"))
    j = ia.join(ib, "id", "full_outer")
    return j.agg(
        F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull())
         .alias("n_common"),
        F.count_if(F.col("nb").isNull()).alias("n_only_a"),
        F.count_if(F.col("na").isNull()).alias("n_only_b"),
        F.coalesce(F.sum(F.col("na") - 1), F.lit(0)).cast("bigint")
         .alias("n_repeated_a"),
        F.coalesce(F.sum(F.col("nb") - 1), F.lit(0)).cast("bigint")
         .alias("n_repeated_b"),
    )


def _core_aggs():
    la, lb = F.col("label_a"), F.col("label_b")
    total = F.count(F.lit(1))
    agree = F.count_if(agree_col())
    return {
        "total": total,
        "agreements": agree,
        "disagreements": total - agree,
        "a1_b0": F.count_if((la == 1) & (lb == 0)),
        "a0_b1": F.count_if((la == 0) & (lb == 1)),
        "sum_a": F.sum(la),
        "sum_b": F.sum(lb),
        "mean_conf_a": F.avg("conf_a"),
        "mean_conf_b": F.avg("conf_b"),
        "std_conf_a": F.stddev_samp("conf_a"),
        "std_conf_b": F.stddev_samp("conf_b"),
        "corr": F.corr("conf_a", "conf_b"),
    }


def comparison_stats(p: DataFrame) -> DataFrame:
    """One row with every raw statistic of a paired frame."""
    return p.agg(*[v.alias(k) for k, v in _core_aggs().items()])


def agreement_overall(p: DataFrame) -> DataFrame:
    s = comparison_stats(p)
    return s.select("total", "agreements", "disagreements",
                    F.round(safe_pct("agreements", "total"), 6)
                    .alias("agreement_rate"))


def disagreement_direction(p: DataFrame) -> DataFrame:
    s = comparison_stats(p)
    return s.select(
        "disagreements", "a1_b0", "a0_b1",
        (F.col("disagreements") - F.col("a1_b0") - F.col("a0_b1"))
        .alias("undetermined"),
        F.round(safe_pct("a1_b0", "disagreements"), 6).alias("pct_a1_b0"),
        F.round(safe_pct("a0_b1", "disagreements"), 6).alias("pct_a0_b1"))


def agreement_by_confidence(p: DataFrame) -> DataFrame:
    """Per run and confidence level: rows and agreement rate."""
    long = p.select(agree_col().alias("agree"),
                    F.expr("stack(2, 'A', conf_a, 'B', conf_b) as (run, conf)"))
    return (long.where(F.col("conf").isNotNull())
            .groupBy("run", "conf")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if("agree").alias("n_agree"))
            .select("run", F.col("conf").alias("confidence_level"), "n",
                    "n_agree",
                    F.round(safe_pct("n_agree", "n"), 6).alias("agreement_rate")))


def confidence_stats(p: DataFrame) -> DataFrame:
    s = comparison_stats(p)
    return s.select(
        F.round("mean_conf_a", 6).alias("mean_conf_a"),
        F.round("mean_conf_b", 6).alias("mean_conf_b"),
        F.round("std_conf_a", 6).alias("std_conf_a"),
        F.round("std_conf_b", 6).alias("std_conf_b"),
        F.round("corr", 6).alias("corr"),
        F.round(F.col("mean_conf_b") - F.col("mean_conf_a"), 6)
        .alias("mean_diff"))


def confidence_regression(p: DataFrame, points: int = 100) -> DataFrame:
    """Least-squares line of B's confidence on A's, and ``points`` fitted
    values on [1, 5]."""
    fit = p.agg(F.regr_slope("conf_b", "conf_a").alias("slope"),
                F.regr_intercept("conf_b", "conf_a").alias("intercept"))
    step = 4.0 / (points - 1)
    grid = fit.select("slope", "intercept",
                      F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.lit(1.0) + F.col("i") * F.lit(step)
    return grid.select(
        F.col("i").cast("int").alias("i"),
        F.round(x, 6).alias("x"),
        F.round(F.col("slope") * x + F.col("intercept"), 6).alias("y_fit"),
        F.round("slope", 6).alias("slope"),
        F.round("intercept", 6).alias("intercept"))


def confidence_histogram(p: DataFrame) -> DataFrame:
    """Counts and % per level for each run (bins of width 1 on 0.5-5.5)."""
    long = p.select(F.expr("stack(2, 'A', conf_a, 'B', conf_b) as (run, conf)"))
    binned = long.select("run", F.when((F.col("conf") >= 0.5) & (F.col("conf") < 5.5),
                                       F.floor(F.col("conf") + 0.5))
                         .alias("level"))
    counts = binned.groupBy("run", "level").agg(F.count(F.lit(1)).alias("n"))
    tot = binned.groupBy("run").agg(F.count(F.lit(1)).alias("run_total"))
    return (counts.where(F.col("level").isNotNull()).join(tot, "run")
            .select("run", F.col("level").cast("int").alias("level"), "n",
                    F.round(safe_pct("n", "run_total"), 6).alias("pct")))


def rate_difference(p: DataFrame) -> DataFrame:
    la, lb = F.col("label_a"), F.col("label_b")
    s = p.agg(F.count(F.lit(1)).alias("total"),
              F.count_if(la == 1).alias("n_pos_a"),
              F.count_if(lb == 1).alias("n_pos_b"))
    return s.select("total", "n_pos_a", "n_pos_b",
                    F.round(safe_pct("n_pos_a", "total"), 6).alias("rate_a"),
                    F.round(safe_pct("n_pos_b", "total"), 6).alias("rate_b"),
                    F.round(safe_pct("n_pos_b", "total")
                            - safe_pct("n_pos_a", "total"), 6)
                    .alias("rate_diff"))


def summary_metrics(p: DataFrame) -> DataFrame:
    """The 15-field comparison summary (unrounded beyond 6 places)."""
    s = comparison_stats(p)
    return s.select(
        F.col("total").alias("total_rows"),
        F.col("sum_a").alias("a_positive_sum"),
        F.col("sum_b").alias("b_positive_sum"),
        F.round(safe_pct("sum_a", "total"), 6).alias("a_positive_rate"),
        F.round(safe_pct("sum_b", "total"), 6).alias("b_positive_rate"),
        "agreements", "disagreements",
        F.round(safe_pct("agreements", "total"), 6).alias("agreement_rate"),
        F.round("mean_conf_a", 6).alias("a_conf_mean"),
        F.round("mean_conf_b", 6).alias("b_conf_mean"),
        F.round("std_conf_a", 6).alias("a_conf_std"),
        F.round("std_conf_b", 6).alias("b_conf_std"),
        F.round("corr", 6).alias("correlation"),
        F.col("a1_b0").alias("a_pos_b_neg"),
        F.col("a0_b1").alias("b_pos_a_neg"),
    )


DIR_A = "A->AI, B->Not"
DIR_B = "B->AI, A->Not"


def disagreement_dataset(p: DataFrame) -> DataFrame:
    """Row-level disagreements with an explicit direction label.

    ``direction`` says 'undetermined' when a label is missing or not 0/1;
    ``reference_direction`` keeps the original else-branch labelling.
    """
    la, lb = F.col("label_a"), F.col("label_b")
    return p.where(~agree_col()).select(
        "id", "name", "label_a", "label_b", "conf_a", "conf_b", "reasons_a",
        "reasons_b",
        F.when((la == 1) & (lb == 0), F.lit(DIR_A))
         .when((la == 0) & (lb == 1), F.lit(DIR_B))
         .otherwise(F.lit("undetermined")).alias("direction"),
        F.when(F.coalesce(la == 1, F.lit(False)), F.lit(DIR_A))
         .otherwise(F.lit(DIR_B)).alias("reference_direction"))


def full_comparison_dataset(p: DataFrame) -> DataFrame:
    return p.select("id", "name", "label_a", "label_b", "conf_a", "conf_b",
                    agree_col().alias("agree"),
                    (F.col("conf_b") - F.col("conf_a")).alias("conf_diff"))


def duplicate_ids(run: DataFrame, id_col: str = ID) -> DataFrame:
    """Occurrences beyond the first, per run table."""
    return run.agg(F.count(F.lit(1)).alias("rows"),
                   F.count_distinct(id_col).alias("distinct_ids")) \
        .select("rows", "distinct_ids",
                (F.col("rows") - F.col("distinct_ids")).alias("duplicates"))


def _ladder(x, tiers, floor_) -> F.Column:
    out = None
    for threshold, name in tiers:
        cond = x >= threshold
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(floor_))


def decision_columns(rate, rate_a, rate_b, mean_a, mean_b) -> list[F.Column]:
    """Verdict, recommendation and the two notes from summary values."""
    diff = rate_b - rate_a
    return [
        _ladder(rate, S.VERDICT_TIERS, S.VERDICT_FLOOR).alias("verdict"),
        _ladder(rate, S.RECOMMENDATION_TIERS, S.RECOMMENDATION_FLOOR).alias("recommendation"),
        F.when(F.abs(diff) < S.RATE_SAME_TOLERANCE_POINTS, F.lit("same"))
         .when(diff > 0, F.lit("b_more_positive"))
         .otherwise(F.lit("b_fewer_positive")).alias("rate_note"),
        F.when(mean_b < mean_a, F.lit("lower")).when(mean_b > mean_a, F.lit("higher"))
         .otherwise(F.lit("similar")).alias("confidence_note")]


def agreement_decision(p: DataFrame) -> DataFrame:
    """Verdict tier, recommendation tier and the two notes."""
    s = comparison_stats(p).select(
        safe_pct("agreements", "total").alias("agreement_rate"),
        safe_pct("sum_a", "total").alias("rate_a"),
        safe_pct("sum_b", "total").alias("rate_b"),
        "mean_conf_a", "mean_conf_b")
    rate = F.col("agreement_rate")
    diff = F.col("rate_b") - F.col("rate_a")
    return s.select(
        F.round(rate, 6).alias("agreement_rate"),
        _ladder(rate, S.VERDICT_TIERS, S.VERDICT_FLOOR).alias("verdict"),
        _ladder(rate, S.RECOMMENDATION_TIERS, S.RECOMMENDATION_FLOOR)
        .alias("recommendation"),
        F.when(F.abs(diff) < S.RATE_SAME_TOLERANCE_POINTS, F.lit("same"))
         .when(diff > 0, F.lit("b_more_positive"))
         .otherwise(F.lit("b_fewer_positive")).alias("rate_note"),
        F.when(F.col("mean_conf_b") < F.col("mean_conf_a"), F.lit("lower"))
         .when(F.col("mean_conf_b") > F.col("mean_conf_a"), F.lit("higher"))
         .otherwise(F.lit("similar")).alias("confidence_note"))


def headline_ratios(p: DataFrame) -> DataFrame:
    s = comparison_stats(p).select(
        safe_pct("sum_a", "total").alias("rate_a"),
        safe_pct("sum_b", "total").alias("rate_b"),
        "a1_b0", "a0_b1", "mean_conf_a", "mean_conf_b")
    return s.select(
        F.round(F.try_divide((F.col("rate_b") - F.col("rate_a")) * 100.0,
                             F.col("rate_a")), 6).alias("rate_lift_pct"),
        F.round(F.try_divide(F.col("a0_b1").cast("double"), F.col("a1_b0")), 6)
         .alias("direction_ratio"),
        F.round(F.try_divide((F.col("mean_conf_b") - F.col("mean_conf_a")) * 100.0,
                             F.col("mean_conf_a")), 6).alias("conf_rel_diff_pct"))


def label_rates(run: DataFrame, label_col: str = "AI_native") -> DataFrame:
    """Count and % of label '1' and '0' by string compare."""
    s = run.agg(F.count(F.lit(1)).alias("total"),
                F.count_if(F.col(label_col) == "1").alias("n_one"),
                F.count_if(F.col(label_col) == "0").alias("n_zero"))
    return s.select("total", "n_one", "n_zero",
                    F.round(safe_pct("n_one", "total"), 6).alias("pct_one"),
                    F.round(safe_pct("n_zero", "total"), 6).alias("pct_zero"))


# ---- id-set operators -----------------------------------------------------

def ids_of(run: DataFrame, id_col: str = ID) -> DataFrame:
    return run.select(F.col(id_col).alias("id"))


def ids_intersect(a, b, id_col=ID):
    return ids_of(a, id_col).intersect(ids_of(b, id_col))


def ids_only(a, b, id_col=ID):
    """Distinct ids of ``a`` not in ``b`` (anti join)."""
    return ids_of(a, id_col).distinct().join(ids_of(b, id_col), "id", "left_anti")


def ids_union(a, b, id_col=ID):
    return ids_of(a, id_col).union(ids_of(b, id_col)).distinct()


def ids_distinct(a, id_col=ID):
    return ids_of(a, id_col).distinct()


def rows_union_all(a: DataFrame, b: DataFrame, tag_a="A", tag_b="B") -> DataFrame:
    """Concatenate two reply tables by column name, duplicates kept."""
    return (a.withColumn("run", F.lit(tag_a))
            .unionByName(b.withColumn("run", F.lit(tag_b)),
                         allowMissingColumns=True))


def sort_levels(p: DataFrame) -> DataFrame:
    """Distinct non-null confidence levels per run, sorted."""
    long = p.select(F.expr("stack(2, 'A', conf_a, 'B', conf_b) as (run, conf)"))
    return (long.where(F.col("conf").isNotNull()).distinct()
            .orderBy("run", "conf")
            .select("run", F.col("conf").alias("confidence_level")))


def restrict_to_cohort(df: DataFrame, cohort: DataFrame, key: str,
                       cohort_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in the cohort id set (semi join)."""
    ck = cohort_key or key
    return df.join(cohort.select(F.col(ck).alias(key)), key, "left_semi")

