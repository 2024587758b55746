"""Top values by buckets, typed findings, and the cascade taken up again."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import cascade as CA
from tallyho.operators import error_codes as EC
from tallyho.operators import findings as FD
from tallyho.sources import sinks


@pytest.mark.parametrize("buckets", [1, 3, 64, EC.BUCKETS])
@pytest.mark.parametrize("k", [1, 4, 10, 100])
def test_exact_top_equals_a_count(spark, buckets, k):
    codes = ["hot"] * 400 + ["b"] * 30 + ["a"] * 30 + [None] * 7 + ["c"] * 2 + [f"free_{i}" for i in range(60)]
    got = EC.exact_top(spark.createDataFrame([(c,) for c in codes], "code string"), "code", k, buckets).collect()
    want = sorted(collections.Counter(codes).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:k]
    assert [(r.code, r.n) for r in got] == want


def test_exact_top_counts_no_code_of_an_empty_bucket_list(spark):
    assert EC.exact_top(spark.createDataFrame([], "code string"), "code", 5).collect() == []


def test_error_lists(spark):
    error = "struct<data:array<struct<code:string>>>"
    rows = spark.createDataFrame([
        (1, 3, ([("x",), (None,), ("x",)],)), (2, 0, ([("x",)],)), (3, None, ([("y",)],)), (4, 5, None), (5, 5, (None,)), (6, 1, ([],))],
        f"batch_num int, failed long, errors {error}")
    assert [tuple(r) for r in EC.batch_error_codes(rows).orderBy("batch_num", "rank").collect()] == [
        (1, 1, "x", 2), (1, 2, "unknown", 1), (3, 1, "y", 1)]
    assert [tuple(r) for r in EC.top_batch_error_codes(rows).collect()] == [("x", 2), ("unknown", 1), ("y", 1)]


def _finding(kind, score=0.5, description="seen"):
    return {"finding_type": kind, "confidence_score": score, "description": description}


def test_typed_findings(spark):
    good, bad = S.FINDING_TYPES[0], S.NEGATIVE_FINDING_TYPES[0]
    replies = {
        1: [_finding(good, 0.4), _finding(bad, "0.9")], 2: [_finding(bad), _finding("else", 0.9)],
        3: [_finding(good, 1.5), _finding(good, "much"), _finding(good, None), _finding(good, 0.2, None), "no object", _finding(7)],
        4: [], 5: [_finding(good, 0), _finding(good, 1)]}
    rows = [(k, "Well: " + json.dumps({"findings": v})) for k, v in replies.items()]
    rows += [(6, "nothing"), (7, None), (8, '{"findings": "none"}'), (9, '{"findings": null}'), (10, "{broken}")]
    typed = FD.typed_findings(spark.createDataFrame(rows, "company_id long, reply string"))
    got = {r[0]: tuple(r)[1:] for r in FD.summarize_typed_findings(typed).collect()}
    assert got == {1: (True, 0.9, 2, 0), 2: (False, 0.5, 1, 1), 3: (False, 0.0, 0, 6), 4: (False, 0.0, 0, 0), 5: (True, 1.0, 2, 0),
                   **{k: (False, 0.0, 0, 0) for k in range(6, 11)}}
    why = {(r.company_id, r.finding_id): r.reason for r in FD.quarantined_findings(typed).collect()}
    assert why == {(2, 2): "unknown_finding_type", (3, 1): "confidence_out_of_range", (3, 2): "confidence_out_of_range",
                   (3, 3): "confidence_out_of_range", (3, 4): "missing_description", (3, 5): "no_object", (3, 6): "unknown_finding_type"}


def _reply(confidence):
    return json.dumps({"genai_adoption_found": True, "findings": [{"tool_name": "t", "use_case": "u", "source_url": "s", "confidence": confidence}]})


class Model:
    """Replies by id and stage; notes every row it is asked for, and can die."""

    def __init__(self, dies_at=()):
        self.asked, self.dies_at = collections.Counter(), set(dies_at)

    def __call__(self, rows, stage):
        ids = [r.company_id for r in rows.collect()]
        for i in ids:
            if (stage, i) in self.dies_at:
                self.dies_at.clear()
                raise RuntimeError("the model is gone")
        self.asked.update((stage, i) for i in ids)
        clear = {"2A": 3, "2B": 5, "3": 7}[stage]
        return rows.withColumn("reply", F.when(F.col("company_id") % 11 == 4, F.lit("no answer"))
                               .when(F.col("company_id") % clear == 0, F.lit(_reply(0.95))).otherwise(F.lit(_reply(0.6))))


def _expected(n):
    asked, out = list(range(n)), set()
    for stage, clear in (("2A", 3), ("2B", 5), ("3", 7)):
        out |= {(stage, i) for i in asked}
        asked = [i for i in asked if i % 11 != 4 and i % clear and stage != "3"]
    return out


def test_a_cascade_that_died_asks_each_row_once(spark):
    routed = spark.range(60).select(F.col("id").alias("company_id"), F.lit(50).alias("online_presence_score"))
    root, model = sinks.scratch_path(spark, "cascade-test"), Model(dies_at=[("2B", 17)])
    with pytest.raises(RuntimeError):
        CA.run_cascade(routed, model, root)
    before = dict(model.asked)
    assert {s for s, _ in before} == {"2A", "2B"} and 17 not in [i for s, i in before if s == "2B"]
    stages = CA.run_cascade(routed, model, root)
    screened = routed.withColumn("escalated", F.lit(True))
    rows = CA.cascade_rows(screened, stages).collect()
    assert set(model.asked) == _expected(60) and set(model.asked.values()) == {1}
    assert sorted((r.stage, r.company_id) for r in rows if r.stage != "1") == sorted(_expected(60))
    assert all(r.parse_error == S.NO_JSON_MESSAGE and not r.escalated for r in rows if r.stage != "1" and r.company_id % 11 == 4)
    again = CA.cascade_costs(CA.cascade_rows(screened, CA.run_cascade(routed, model, root)))
    assert set(model.asked.values()) == {1}
    assert {r.stage: r.companies for r in again.collect()} == {"1": 60, **collections.Counter(s for s, _ in _expected(60))}


def test_a_cascade_of_no_rows(spark):
    routed = spark.createDataFrame([], "company_id long, online_presence_score int")
    stages = CA.run_cascade(routed, Model(), sinks.scratch_path(spark, "cascade-empty"), parts=2)
    assert [stages[s].count() for s in CA.MODEL_STAGES] == [0, 0, 0]


def test_prompts_have_a_body_for_each_stage(spark):
    from tallyho.operators import triage as TR
    rows = [("1", None, None, None), ("2A", "u", "x", None), ("2B", None, None, None), ("3", "u", "x", None)]
    df = spark.createDataFrame([(i, "Co", u, c, s, 10 * i, None) for i, (s, u, c, _) in enumerate(rows)],
                               "company_id long, company_name string, homepage_url string, about string, "
                               f"research_stage_reached string, online_presence_score int, result {S.RESEARCH_RESULT_SCHEMA.simpleString()}")
    p = [r.prompt.split("\n") for r in TR.build_research_prompt(df, "about").orderBy("company_id").collect()]
    d = TR.PROMPT_DEFAULTS
    assert p[0] == [TR.RESEARCH_HEADERS["2A"] + " Co.", "Online presence: 0 of 100", "Signals of the screening: " + d["signals"]]
    assert p[1][-1] == "Context: x" and p[1][0].endswith("Co.")
    assert p[2] == [TR.RESEARCH_HEADERS["2B"] + " Co.", "Online presence: 20 of 100", "Escalated because: " + d["reason"],
                    "Signals so far:", d["signal_list"]]
    assert p[3] == [TR.RESEARCH_HEADERS["3"] + " Co (website: u).", "Earlier findings to verify and extend:", d["earlier"], "Background: x"]
