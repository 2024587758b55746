"""Rules as a table: every kind of rule fires and does not fire."""

import pytest
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators.rules import Rule, research_rules, violations

ROW = ("id long, stage string, score int, reasons array<string>, "
       "result struct<findings:array<struct<confidence:double,source_type:string,business_function:string>>>")


def _run(spark, rows, rules, stage="stage"):
    df = spark.createDataFrame(rows, ROW)
    return {r.id: r.v for r in df.select("id", violations(rules, stage).alias("v")).collect()}


def test_ranges_domains_and_cardinality(spark):
    rules = [Rule("score", "score", low=0, high=100, required=True), Rule("stage", "stage", domain=("2A", "3")),
             Rule("reasons", "reasons", least=2, most=5), Rule("some", "result.findings", least=1)]
    one = ([(0.9, "company_blog", "x")],)
    rows = [(1, "2A", 0, ["a", "b"], one), (2, "3", 100, list("abcde"), one), (3, "4", 101, ["a"], ([],)),
            (4, None, None, list("abcdef"), None), (5, "3", -1, None, (None,)), (6, "2A", 50, [], one)]
    assert _run(spark, rows, rules) == {1: "", 2: "", 3: "score;stage;reasons;some", 4: "score;reasons", 5: "score", 6: "reasons"}


def test_stage_and_sibling(spark):
    rules = [Rule("band", "result.findings[].confidence", low=0.7, high=0.8, stages=("2A",), where=("source_type", ("news",))),
             Rule("band", "result.findings[].confidence", low=0.7, high=0.9, stages=("3",), where=("source_type", ("news",))),
             Rule("there", "result.findings[].confidence", required=True)]
    rows = [(1, "2A", 0, None, ([(0.85, "news", "x")],)), (2, "3", 0, None, ([(0.85, "news", "x")],)),
            (3, "2A", 0, None, ([(0.85, "blog", "x"), (0.7, "news", "x")],)), (4, None, 0, None, ([(0.1, "news", "x")],)),
            (5, "3", 0, None, ([(0.8, "news", "x"), (0.95, "news", "x")],)), (6, "2A", 0, None, ([(0.1, None, "x"), (None, "news", "x")],)),
            (7, "2A", 0, None, None)]
    assert _run(spark, rows, rules) == {1: "band", 2: "", 3: "", 4: "", 5: "band", 6: "there", 7: ""}


def test_research_rules_fire_one_by_one(spark):
    df = spark.createDataFrame([
        (1, "2A", 50, [(0.75, "news_article", S.FUNCTION_KEYWORDS[0])]), (2, "2A", 50, [(0.85, "news_article", S.FUNCTION_KEYWORDS[0])]),
        (3, "3", 50, [(0.85, "news_article", S.FUNCTION_KEYWORDS[0])]), (4, "1", 50, [(0.3, "news_article", S.FUNCTION_KEYWORDS[0])]),
        (5, "2B", 50, [(0.3, "podcast", "juggling")]), (6, "9", 101, [(1.5, None, None)])],
        "id long, research_stage_reached string, online_presence_score int, f array<struct<confidence:double,source_type:string,business_function:string>>")
    df = df.withColumn("result", F.struct(F.col("f").alias("findings")))
    got = {r.id: r.v for r in df.select("id", violations(research_rules(), "research_stage_reached").alias("v")).collect()}
    assert got == {1: "", 2: "confidence_outside_band", 3: "", 4: "",
                   5: "confidence_below_floor;unknown_source_type;unknown_business_function",
                   6: "presence_out_of_range;unknown_stage;confidence_out_of_range"}


def test_rules_without_sense(spark):
    with pytest.raises(ValueError):
        violations([Rule("nothing", "score")])
    with pytest.raises(ValueError):
        violations([Rule("staged", "score", low=0, stages=("1",))])
    with pytest.raises(ValueError):
        Rule("sibling", "score", low=0, where=("a", ("b",)))


def test_rules_need_no_shuffle(spark):
    df = spark.createDataFrame([], ROW).withColumn("v", violations([Rule("score", "score", low=0)]))
    assert "Exchange" not in df._jdf.queryExecution().toString() and df.count() == 0
