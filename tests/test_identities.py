"""Identities between roll-ups, on the sf0.001 tables."""

from conftest import SMALL
from tallyho.plans.registry import QUERIES, load_all

load_all()


def q(spark, key):
    return QUERIES[key](spark, SMALL)


def test_agreements_plus_disagreements_is_total(spark):
    r = q(spark, "agreement_overall").first()
    assert r.agreements + r.disagreements == r.total
    d = q(spark, "disagreement_direction").first()
    assert d.a1_b0 + d.a0_b1 <= d.disagreements
    assert d.a1_b0 + d.a0_b1 + d.undetermined == d.disagreements


def test_confidence_by_mode_sums_to_yes_counts(spark):
    yes = {r.mode: r.n for r in q(spark, "adoption_by_mode").collect()}
    for r in q(spark, "confidence_by_mode").collect():
        assert r.low + r.medium + r.high == r.yes_total == yes[r.mode]


def test_lenient_yes_plus_no_evidence_is_total(spark):
    n = {r.mode: r.n for r in q(spark, "adoption_by_mode").collect()}
    flat = q(spark, "flatten_adoption_json")
    both = flat.where("genai_lenient_label = 'Yes' and no_evidence_flag = 1").count()   # replies that break the rule
    neither = flat.where("genai_lenient_label = 'No' and no_evidence_flag = 0").count()
    assert both > 0
    assert n["lenient"] + n["no_evidence"] - both + neither == flat.count()


def test_expansion_rows_are_sum_of_max_one_findings(spark):
    s = q(spark, "summarize_findings").toPandas()
    rows = q(spark, "expand_findings").count()
    assert rows == int(s.n_findings.clip(lower=1).sum())
    st = q(spark, "rows_written_stats").first()
    assert st.rows == rows and st.companies == len(s)


def test_failure_taxonomy_is_exclusive(spark):
    tax = {r.outcome: r.n for r in q(spark, "failure_taxonomy").collect()}
    submitted = q(spark, "build_batch_request").count()
    assert sum(tax.values()) == submitted
    failed = q(spark, "find_failed_requests").count()
    assert failed == submitted - tax.get("ok", 0)


def test_pass_status_covers_every_company(spark):
    st = q(spark, "pass_status").first()
    companies = q(spark, "scan_companies").count()
    assert st.n_logged + st.n_remaining == companies
    assert q(spark, "pending_work").count() == st.n_remaining


def test_even_plan_covers_all_rows_once(spark):
    plan = q(spark, "plan_even_batches")
    assert plan.count() == plan.select("rcid").distinct().count() == \
        q(spark, "scan_companies").count()
