"""The escalation cascade as a staged run that can be taken up again.

Each stage asks the model for the rows that the last one escalated, writes the
replies, parses them and applies the escalation rule to what they say.  Replies
are appended exactly once (``sources/commits.py``), some rows at a time, so a
run that died asks only for rows that have no reply yet.

    root/replies-<stage>/   one append a part of a stage's rows
    root/asked-<stage>/     the rows of a stage, written once a run, so that no
                            later stage works out the earlier ones again
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho.operators.quality import escalation_flag
from tallyho.operators.replies import parse_research_result
from tallyho.operators.triage import stage_costs
from tallyho.sources import commits

MODEL_STAGES = ["2A", "2B", "3"]
Call = Callable[[DataFrame, str], DataFrame]


def ask_pending(asked: DataFrame, key: str, stage: str, call: Call, root: str, parts: int = 4) -> DataFrame:
    """Replies (columns of ``asked`` and ``reply``) to all rows of ``asked``.

    Rows whose key has a reply in ``root`` are not asked again.  The others are
    asked in ``parts``, each appended when its replies are written.
    """
    spark, place = asked.sparkSession, f"{root}/replies-{stage}"
    schema = T.StructType([*asked.schema.fields, T.StructField("reply", T.StringType())])
    done = commits.read_committed(spark, place, schema)
    pending = asked.join(done.select(key), key, "left_anti")
    first = len(commits.commits(spark, place))
    for part in range(parts):
        rows = pending.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        commits.append_once(call(rows, stage).select(*schema.names), place, f"{first + part:06d}")
    replies = commits.read_committed(spark, place, schema)
    return replies.join(asked.select(key), key, "left_semi")


def judge_replies(replies: DataFrame, stage: str) -> DataFrame:
    """Parsed replies with ``escalated``: the rule at ``stage``, false for replies
    that cannot be read (``parse_error``)."""
    parsed = parse_research_result(replies)
    fields = ["genai_adoption_found", "findings", "no_finding_reason", "recommend_escalation", "escalation_reason"]
    parsed = parsed.withColumn("result", F.struct(*fields)).drop(*fields)
    ok = F.col("parse_error").isNull()
    return parsed.withColumn("escalated", ok & F.coalesce(escalation_flag(parsed, stage), F.lit(False)))


def run_cascade(routed: DataFrame, call: Call, root: str, key: str = "company_id", parts: int = 4) -> dict[str, DataFrame]:
    """Stage -> its judged rows.

    ``routed`` holds one row a key with ``online_presence_score`` (0 to 100);
    ``call(rows, stage)`` returns the rows with the model's text in ``reply``
    (NULL or no row: no answer; a row left out is asked again by the next run).
    """
    out, asked = {}, routed
    for stage in MODEL_STAGES:
        rows = f"{root}/asked-{stage}/{uuid.uuid4().hex}"
        asked.write.parquet(rows)
        asked = routed.sparkSession.read.schema(routed.schema).parquet(rows)
        judged = judge_replies(ask_pending(asked, key, stage, call, root, parts), stage)
        out[stage] = judged
        asked = judged.where("escalated").select(*routed.columns)
    return out


def cascade_rows(screened: DataFrame, stages: dict[str, DataFrame], key: str = "company_id") -> DataFrame:
    """(stage, key, parse_error, n_findings, escalated) of the screening (``screened``:
    key and ``escalated``) and of every stage."""
    rows = screened.select(F.lit("1").alias("stage"), key, F.lit(None).cast("string").alias("parse_error"),
                           F.lit(0).alias("n_findings"), "escalated")
    for stage, judged in stages.items():
        rows = rows.unionByName(judged.select(F.lit(stage).alias("stage"), key, "parse_error",
                                              F.size("result.findings").alias("n_findings"), "escalated"))
    return rows


def cascade_costs(rows: DataFrame) -> DataFrame:
    """Companies asked and their cost per stage."""
    names = ["1", *MODEL_STAGES]
    one = rows.agg(*[F.count_if(F.col("stage") == s).alias(f"n{i}") for i, s in enumerate(names)])
    per = stage_costs(one, {s: f"n{i}" for i, s in enumerate(names)})
    return per.select("stage", F.col("requests").alias("companies"),
                      F.round(F.col("requests") * F.col("unit_min"), 6).alias("cost_min"),
                      F.round(F.col("requests") * F.col("unit_max"), 6).alias("cost_max"))
