"""What the findings' inputs shuffle, and how their files are read back."""

import collections
import datetime

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators import findings as FD
from tallyho.plans import q_quality
from tallyho.sources import bindings as B
from tallyho.sources import sinks

LINE = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")


class Given:
    """Tables of a test's own rows."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def lines(spark):
    day = datetime.date(1995, 1, 1)
    rows = [(k, n % 4, n * 7 % 90, n * 3 % 11, 1.0 * n, 2.0, -0.04 if n % 5 == 0 else 0.07, 0.0, "A" if n % 2 else None, "F", day)
            for k in (1, 2, 2, 3, None) for n in range(6)]
    return spark.createDataFrame(rows + rows[:3], LINE), rows + rows[:3]


def test_finding_lists_hold_every_line_in_order(spark):
    li, rows = lines(spark)
    got = {r.company_id: r.findings for r in B.finding_lists(Given(lineitem=li)).collect()}
    per = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            per[r[0]].append(r)
    assert set(got) == set(per)
    for k, own in per.items():
        own.sort(key=lambda r: (r[1:8], r[8] is not None, r[8] or "", r[9:]))
        assert [f.evidence_summary for f in got[k]] == [f"part {r[2]} supplier {r[3]}" for r in own]
        assert [f.tool_name for f in got[k]] == [r[8] and f"tool-{r[8]}" for r in own]
        assert [f.source_url is None for f in got[k]] == [r[1] % 3 == 0 for r in own]


def test_findings_of_lines_with_null_columns(spark):
    li = spark.createDataFrame([(1, *[None] * 10), (1, 3, 20, None, *[None] * 7), (1, 4, None, 7, *[None] * 7)], LINE)
    found = B.finding_lists(Given(lineitem=li)).first().findings
    assert [f.business_function for f in found] == [S.FUNCTION_KEYWORDS[i] for i in (-1, 20 % 14, -1)]
    assert [f.source_type for f in found] == [B.SOURCE_TYPES[i] for i in (-1, -1, 7 % 5)]
    assert [f.confidence for f in found] == [None] * 3


def test_findings_are_collected_after_their_only_shuffle(spark):
    li, _ = lines(spark)
    plan = B.finding_lists(Given(lineitem=li))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "collect_list" not in below and "https://evidence" not in below


def test_quarantine_parses_each_reply_once(spark):
    replies = spark.createDataFrame([(1, '{"findings":[{"finding_type":"?"},{}]}'), (2, "none"), (3, '{"findings":[]}')],
                                    "company_id long, reply string")
    out = FD.quarantined_findings(FD.typed_findings(replies))
    assert [(r.company_id, r.finding_id) for r in out.orderBy("company_id", "finding_id").collect()] == [(1, 1), (1, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_fixed_csv_files_have_a_bounded_number_of_rows(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit('line "a"\nline '), F.col("id").cast("string")).alias("text"))
    path = sinks.scratch_path(spark, "csv-bounded")
    sinks.sink_fixed_csv(rows.coalesce(1), ["id", "text"], path, rows_per_file=100)
    back = sinks.read_fixed_csv(spark, path, rows.schema)
    assert sorted(back.collect()) == sorted(rows.collect())
    per_file = back.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 10 and all(r["count"] == 100 for r in per_file)


def test_cascade_takes_only_replies_that_a_stage_may_ask_for(spark):
    replies = spark.createDataFrame([(i, f"c{i}", f"reply {i}") for i in (1, 2, 3, 3, 4, 9, None)],
                                    "company_id long, company_name string, reply string")
    asked = spark.createDataFrame([(1,), (1,), (None,), (9,)], "company_id long")
    got = q_quality._replies_to(asked, replies).collect()
    assert sorted((r.company_id, r.reply) for r in got) == [(i, f"reply {i}") for i in (1, 2, 3, 3, 9)]
