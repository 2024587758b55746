"""Unit fixtures for the semantic traps and for the hand-built operators
(CSV replies, greedy packing, global index, windows), each against a
brute-force Python reference on a small input."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X
from tallyho.functions.csv_reply import parse_csv_reply, python_csv_fields
from tallyho.operators import batching as BT
from tallyho.operators import compare as C
from tallyho.operators import findings as FD
from tallyho.operators import monitor as M
from tallyho.operators import reconcile as RC
from tallyho.operators import replies as R


def one(spark, col_expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(col_expr("v").alias("r")).first()["r"]


# ---- text rules ---------------------------------------------------------------

@pytest.mark.parametrize("raw,year", [("01nov2016", "N/A"), ("2016-11-01", "2016"),
                                      ("founded 1999", "1999"), ("", "N/A"), (None, "N/A"),
                                      ("N/A", "N/A"), ("3001-01-01", "N/A")])
def test_extract_year(spark, raw, year):
    assert one(spark, X.extract_year, raw) == year


@pytest.mark.parametrize("raw,out", [("  x  ", "x"), ("   ", "N/A"), ("\t", "N/A"),
                                     (None, "N/A"), ("a b", "a b")])
def test_blank_to_na_handles_unicode_space(spark, raw, out):
    assert one(spark, X.blank_to_na, raw) == out


def test_strip_matches_python(spark):
    vals = ["　a b ", "​a", "\x1c x \x85", " é "]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(X.strip_ws("v")).collect()]
    assert got == [v.strip() for v in vals]


def test_merge_keywords(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), (" ", None)],
                               "c string, g string")
    got = [r[0] for r in df.select(X.merge_keywords("c", "g")).collect()]
    assert got == ["a, b", "a", "b", "N/A"]


def test_custom_id_fallback_uses_row_key(spark):
    df = spark.createDataFrame([(7, None), (8, " org-8 ")], "rcid long, org_uuid string")
    got = [r[0] for r in df.select(X.custom_id("org_uuid", "rcid")).collect()]
    assert got == ["startup-row-7", "startup-org-8"]


@pytest.mark.parametrize("a,b,redirect", [
    ("http://www.a.com", "https://a.com/x", False),
    ("http://a.com:8080/", "http://a.com/", True),
    ("http://shop.www.a.com", "http://shop.a.com", False),
    ("", "http://a.com", False),
    ("http://a.com", None, False),
    ("http://A.com", "http://b.com", True)])
def test_detect_redirect(spark, a, b, redirect):
    df = spark.createDataFrame([(a, b)], "u string, f string")
    assert df.select(X.detect_redirect("u", "f")).first()[0] is redirect


def test_sanitize_unicode(spark):
    src = "“Hi” — it’s… a b ·"
    assert one(spark, X.sanitize_unicode, src) == '"Hi" - it\'s... a b .'


# ---- comparisons: NULL and NaN never agree --------------------------------------

def test_null_and_nan_labels_are_disagreements(spark, tmp_path):
    a = spark.createDataFrame([("1", "N", "1", "3", ""), ("2", "N", None, "3", ""),
                               ("3", "N", "nan", "2", ""), ("4", "N", "1.0", "5", "")],
                              "CompanyID string, CompanyName string, AI_native string, "
                              "Confidence_1to5 string, Reasons_3_points string")
    b = spark.createDataFrame([("1", "N", "1", "4", ""), ("2", "N", None, "2", ""),
                               ("3", "N", "nan", "2", ""), ("4", "N", "0", "1", "")],
                              a.schema)
    p = C.paired(a, b)
    s = C.agreement_overall(p).first()
    assert (s.total, s.agreements, s.disagreements) == (4, 1, 3)
    d = {r.id: (r.direction, r.reference_direction)
         for r in C.disagreement_dataset(p).collect()}
    assert d["4"] == (C.DIR_A, C.DIR_A)
    assert d["2"] == ("undetermined", C.DIR_B)


def test_nan_becomes_null_at_scan(spark, tmp_path):
    from tallyho.sources.tables import read_table
    pd.DataFrame({"x": [1.0, float("nan")]}).to_parquet(tmp_path / "t.parquet")
    df = read_table(spark, str(tmp_path), "t")
    assert [r.x for r in df.collect()] == [1.0, None]


def test_repeated_ids_are_deduplicated_before_alignment(spark):
    a = spark.createDataFrame([("1", "N", "1", "3", ""), ("1", "N", "1", "3", "")],
                              "CompanyID string, CompanyName string, AI_native string, "
                              "Confidence_1to5 string, Reasons_3_points string")
    assert C.paired(a, a).count() == 1
    assert C.duplicate_ids(a).first().duplicates == 1


# ---- CSV replies ------------------------------------------------------------------

EDGE_REPLIES = [
    'id1,"Name, Inc",1,4,"a | b | c","id;name","ok ""quoted"""',
    'id1,Name,1,4,"a\nb | c | d",id,fine',
    "id1,N,0,3,a | b | c,id,x\nid2,N,1,5,a | b | c,id,y",
    'id1,7" tv,0,3,r,id,c',
    "id1,N,0,3,r1 | r2 | r3,name,c\\d",
    'id1,N, "x",3,r,id,c',
    "id1,,,,,,",
    "a,b,c",
    "a,b,c,d,e,f,g,h",
    'id1,"unclosed,1,4,r,id,c',
    'id1,"unclosed,,,,,,,,',
    'id1,"closed" tail,1,4,r,id,c',
    'id1,"back\\"slash",1,4,r,id,c',
    ",N,1,4,r,id,c",
    "",
    "  id1,N,1,4,r,id,c  \n",
    "id1\r\n,N,1,4,r,id,c",
]


def _spark_parse(spark, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, content string")
    out = {r.i: r for r in parse_csv_reply(df, "content").collect()}
    return [out[i] for i in range(len(replies))]


def test_csv_reply_edge_rows_match_python_csv(spark):
    rows = _spark_parse(spark, EDGE_REPLIES)
    for reply, row in zip(EDGE_REPLIES, rows):
        ref = python_csv_fields(reply)
        got = [row[c] for c in S.REPLY_COLUMNS] if row.csv_ok else None
        assert got == ref, reply


def test_csv_reply_fuzz_against_python_csv(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", " ", ",", ",", '"', '""', "\n", "\\", "x y", "|"]
    replies = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
               for _ in range(600)]
    rows = _spark_parse(spark, replies)
    for reply, row in zip(replies, rows):
        ref = python_csv_fields(reply)
        got = [row[c] for c in S.REPLY_COLUMNS] if row.csv_ok else None
        assert got == ref, repr(reply)


def test_csv_reply_keeps_huge_field(spark):
    reply = "id1,N,1,4," + "r" * 200_000 + ",id,c"
    row = _spark_parse(spark, [reply])[0]
    assert row.csv_ok and len(row.Reasons_3_points) == 200_000


# ---- JSON replies -------------------------------------------------------------------

def test_adoption_reply_defaults_and_failures(spark):
    good = ('{"genai_adoption_strict": null, "genai_adoption_moderate": {"label": "Yes"},'
            ' "genai_adoption_lenient": {"label": "Yes", "confidence": "High"},'
            ' "no_evidence_of_genai_use": false, "reasoning": "one string"}')
    rows = [("1", "x " + good + " y"), ("2", "no json"), ("3", '{"a": 1'),
            ("4", '{"genai_functions": [{"function_keyword": "sales"}], "reasoning": ["a", "b"]}')]
    df = spark.createDataFrame(rows, "company_id string, content string")
    out = {r.company_id: r for r in R.flatten_adoption_reply(df).collect()}
    r1 = out["1"]
    assert (r1.genai_strict_label, r1.genai_strict_confidence) == ("No", "Low")
    assert (r1.genai_moderate_label, r1.genai_moderate_confidence) == ("Yes", "Low")
    assert r1.reasoning == "one string" and r1.primary_assessment == "strict"
    assert r1.genai_functions_list == "" and r1.parse_error is None
    assert out["2"].parse_error == S.NO_JSON_MESSAGE
    assert out["3"].parse_error == S.NO_JSON_MESSAGE
    assert out["4"].genai_functions_list == "sales"
    assert out["4"].genai_functions_details == "sales: None"
    assert out["4"].reasoning == "a b"


def test_research_result_parse_errors_are_rows(spark):
    rows = [(1, 'pre {"genai_adoption_found": true, "findings": []} post'),
            (2, "nothing"), (3, '{"findings": [1, 2'), (4, None)]
    df = spark.createDataFrame(rows, "company_id long, reply string")
    out = {r.company_id: r for r in R.parse_research_result(df).collect()}
    assert out[1].parse_error is None and out[1].genai_adoption_found is True
    assert out[2].parse_error == S.NO_JSON_MESSAGE
    assert out[3].parse_error == S.NO_JSON_MESSAGE
    assert out[4].parse_error == S.NO_JSON_MESSAGE
    assert len(out) == 4


def test_reply_values_of_other_types(spark):
    f = '{"findings": [%s]}'
    rows = [(1, f % '{"tool_name": "t", "confidence": "0.9"}, {"confidence": 1e-1}, {"tool_name": 5}, {"confidence": null}'),
            (2, f % '{"confidence": "high"}'), (3, f % "7"), (4, '{"findings": "some"}'), (5, '{"findings": 0}'),
            (6, '{"findings": null, "genai_adoption_found": "false", "recommend_escalation": 1}'),
            (7, '{"findings": {}, "genai_adoption_found": "", "recommend_escalation": 0.0}'),
            (8, '{"genai_adoption_found": [], "recommend_escalation": {"a": 1}}'),
            (9, f % '{"confidence": "1d"}'), (10, f % '{"confidence": []}')]
    df = spark.createDataFrame(rows, "company_id long, reply string")
    out = {r.company_id: r for r in R.parse_research_result(df).collect()}
    assert [(x.tool_name, x.confidence) for x in out[1].findings] == [("t", 0.9), (None, 0.1), ("5", 0.0), (None, 0.0)]
    assert [k for k, r in out.items() if r.parse_error == "Parse error"] == [2, 3, 4, 5, 9, 10]
    assert all(out[k].findings == [] for k in out if k != 1)
    assert [(out[k].genai_adoption_found, out[k].recommend_escalation) for k in (6, 7, 8)] == [
        (True, True), (False, False), (False, True)]
    flags = [("1", 1), ("0", 0), ('"true"', 1), ('""', 0), ("true", 1), ("false", 0), ("null", 0), ("[0]", 1)]
    df = spark.createDataFrame([(v, '{"no_evidence_of_genai_use": %s}' % v) for v, _ in flags],
                               "company_id string, content string")
    got = {r.company_id: r.no_evidence_flag for r in R.flatten_adoption_reply(df).collect()}
    assert got == dict(flags)


# ---- findings expansion -------------------------------------------------------------

def _result(found, findings, reason=None):
    return Row(genai_adoption_found=found, findings=findings, no_finding_reason=reason,
               recommend_escalation=False, escalation_reason=None)


def _finding(tool, conf, url="https://x"):
    return Row(tool_name=tool, use_case="u", business_function="sales",
               evidence_summary="e", source_url=url, source_type="news_article",
               confidence=conf)


def test_expand_findings_row_counts(spark):
    schema = ("company_id long, company_name string, homepage_url string, industry string, "
              "founded_year int, research_stage_reached string, online_presence_score int, "
              "website_alive boolean, research_cost_usd double, result "
              + S.RESEARCH_RESULT_SCHEMA.simpleString())
    base = ("n", None, None, 2020, "2A", 50, True, 0.04)
    rows = [(1, *base, _result(True, [_finding("a", 0.9), _finding("b", 0.6)])),
            (2, *base, _result(True, [_finding("c", 0.8)])),
            (3, *base, _result(False, [], "no_evidence")),
            (4, *base, _result(False, [], "insufficient_information")),
            (5, *base, None),
            (6, *base, _result(False, [_finding("d", 0.7)]))]
    df = spark.createDataFrame(rows, schema)
    out = FD.expand_findings(df, "2026-01-01 00:00:00").collect()
    by = {}
    for r in out:
        by.setdefault(r.company_id, []).append(r)
    assert len(out) == 2 + 1 + 1 + 1 + 1 + 1
    assert [r.finding_id for r in by[1]] == [1, 2]
    assert by[3][0].no_finding_reason == "no_evidence" and by[3][0].adoption_confidence == 0.0
    assert by[4][0].no_finding_reason == "insufficient_information"
    assert by[5][0].no_finding_reason == "no_evidence"
    assert by[6][0].genai_adoption_found is True
    assert list(out[0].asDict()) == S.FINDING_ROW_COLUMNS


# ---- batching -------------------------------------------------------------------------

def test_global_index_equals_row_number(spark):
    rnd = random.Random(3)
    keys = rnd.sample(range(100_000), 1000)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.idx for r in BT.with_global_index(df, ["k"], n_parts=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_even_plan_sizes():
    assert BT.even_plan_cap() == 7211


def test_even_plan_batches(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    b = {r.k: r.batch_num for r in BT.plan_even_batches(df, ["k"], cap=300).collect()}
    sizes = pd.Series(list(b.values())).value_counts().sort_index().tolist()
    assert sizes == [250, 250, 250, 250]


def greedy_pack(sizes, max_count, max_bytes):
    """The sequential rule, one request after the other."""
    out, batch, count, used = [], 1, 0, 0
    for sz in sizes:
        if count > 0 and (count >= max_count or used + sz > max_bytes):
            batch, count, used = batch + 1, 0, 0
        out.append(batch)
        count += 1
        used += sz
    return out


@pytest.mark.parametrize("n, max_count, max_bytes, block_rows", [
    (500, 20, 400, None), (700, 15, 500, 15), (700, 15, 500, 120), (333, 7, 10 ** 9, 10),
    (9, 4, 60, 4), (1, 3, 10, 3), (0, 3, 10, 3)])
def test_greedy_plan_equals_the_sequential_rule(spark, n, max_count, max_bytes, block_rows):
    rnd = random.Random(n + max_count)
    sizes = [rnd.choice([0, 1, rnd.randint(1, 100), 1000]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, b long").repartition(3)
    rows = BT.plan_greedy_batches(df, "k", "b", max_count, max_bytes, block_rows, n_parts=8).collect()
    got = {r.k: (r.b, r.batch_num, r.oversize) for r in rows}
    assert len(rows) == n
    ref = greedy_pack(sizes, max_count, max_bytes)
    assert [got[i] for i in range(n)] == [(s, b, s > max_bytes) for s, b in zip(sizes, ref)]


def test_sample_n_seeded_is_exact_and_reproducible(spark):
    from tallyho.sources.readers import sample_n_seeded
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = [r.k for r in sample_n_seeded(df, "k", 37, 42).collect()]
    b = [r.k for r in sample_n_seeded(df.repartition(9), "k", 37, 42).collect()]
    assert len(a) == 37 and sorted(a) == sorted(b)


# ---- windows --------------------------------------------------------------------------

def test_sliding_rate_matches_brute_force(spark):
    rnd = random.Random(1)
    base = pd.Timestamp("2026-01-01")
    rows = []
    for i in range(400):
        svc = "hot" if i % 3 else rnd.choice(["a", "b"])
        rows.append((svc, i, base + pd.Timedelta(seconds=rnd.randint(0, 600))))
    rows.append(("hot", 1000, base + pd.Timedelta(seconds=100)))
    rows.append(("hot", 1001, base + pd.Timedelta(seconds=160)))  # exactly 60 s later
    df = spark.createDataFrame([(a, b, c.to_pydatetime()) for a, b, c in rows],
                               "service string, call_id long, ts timestamp_ntz")
    got = {(r.service, r.call_id): r.calls_in_window
           for r in M.sliding_request_rate(df, "service", "ts", "call_id", n_parts=5).collect()}
    pdf = pd.DataFrame(rows, columns=["service", "call_id", "ts"])
    for svc, cid, ts in rows:
        same = pdf[pdf.service == svc]
        earlier = same[(same.ts > ts - pd.Timedelta(seconds=60))
                       & ((same.ts < ts) | ((same.ts == ts) & (same.call_id <= cid)))]
        assert got[(svc, cid)] == len(earlier)
    assert got[("hot", 1001)] == len(pdf[(pdf.service == "hot")
                                         & (pdf.ts > base + pd.Timedelta(seconds=100))
                                         & ((pdf.ts < base + pd.Timedelta(seconds=160))
                                            | ((pdf.ts == base + pd.Timedelta(seconds=160))
                                               & (pdf.call_id <= 1001)))])


def stuck_loop(values):
    """The poll loop of one batch: a counter that grows while nothing changes."""
    out, stuck, last = [], 0, None
    for v in values:
        stuck = stuck + 1 if (last is not None and v == last) else 0
        out.append(stuck)
        last = v
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 60, 200_000])
def test_detect_stuck_matches_poll_loop(spark, block_rows):
    rnd = random.Random(2)
    base = dt.datetime(2026, 1, 1)
    polls = {b: [rnd.choice([0, 0, 1]) + i // 7 for i in range(60)] for b in (1, 2)}
    polls[3] = [5] * 130        # stuck for more than half of all polls, across many blocks
    polls[4] = [5]
    rows = [(b, base + dt.timedelta(minutes=2 * i), v) for b, vs in polls.items() for i, v in enumerate(vs)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "batch_num int, checked_at timestamp_ntz, completed long")
    out = M.detect_stuck(df, n_parts=5, block_rows=block_rows).collect()
    assert len(out) == len(rows)
    for b, values in polls.items():
        got = [r.no_progress_polls for r in sorted(out, key=lambda r: r.checked_at) if r.batch_num == b]
        assert got == stuck_loop(values)
    plan = M.detect_stuck(df)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan


# ---- reconciliation -------------------------------------------------------------------

def test_retried_id_counts_once_and_success_wins(spark):
    log = spark.createDataFrame([(1, "rate limited"), (1, None), (2, "boom"), (3, "")],
                                "rcid long, err string")
    uni = spark.createDataFrame([(i,) for i in range(1, 6)], "rcid long")
    st = RC.pass_status(log, uni, err_col="err").first()
    assert (st.n_ok, st.n_error, st.n_logged, st.n_remaining) == (2, 1, 3, 2)
    pend = {r.rcid for r in RC.pending_work(uni, log, err_col="err").collect()}
    retry = {r.rcid for r in RC.pending_work(uni, log, retry_errors=True,
                                             err_col="err").collect()}
    assert pend == {4, 5} and retry == {2, 4, 5}


def test_enrich_lookup_last_duplicate_wins(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    lk = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "k string, name string, seq int")
    out = {r.k: r.name for r in RC.enrich_lookup(df, lk, "k", "seq",
                                                 {"name": S.UNKNOWN_ID}).collect()}
    assert out == {"a": "new", "z": S.UNKNOWN_ID}


def test_jsonl_tolerant_counts_bad_lines(spark, tmp_path):
    from tallyho.sources.readers import scan_jsonl_tolerant
    p = tmp_path / "log.jsonl"
    p.write_text('{"rcid": 1, "name": "a"}\n\n   \n{"rcid": 2\nnot json\n{"rcid": 3}\n')
    good, bad = scan_jsonl_tolerant(spark, str(p), S.SEARCH_PASS_SCHEMA)
    assert sorted(r.rcid for r in good.collect()) == [1, 3]
    assert bad.count() == 2


def test_company_csv_with_quotes_commas_newlines(spark, tmp_path):
    from tallyho.sources.readers import scan_companies_csv
    p = tmp_path / "c.csv"
    header = ",".join(f.name for f in S.COMPANY_CSV_SCHEMA.fields)
    p.write_text(header + '\nabc,u1,"Acme, ""Inc""",,,"line1\nline2",  ,x,,,01nov2016\n')
    r = scan_companies_csv(spark, str(p)).first()
    assert r.rcid == "abc" and r.name == 'Acme, "Inc"'
    assert r.short_description == "line1\nline2" and r.long_description is None


def test_sliding_rate_wait_until_oldest_expires(spark):
    base = pd.Timestamp("2026-01-01")
    secs = [0, 10, 20, 30, 65, 66, 200]
    rows = [("s", i, (base + pd.Timedelta(seconds=t)).to_pydatetime()) for i, t in enumerate(secs)]
    df = spark.createDataFrame(rows, "service string, call_id long, ts timestamp_ntz")
    got = {r.call_id: (r.calls_in_window, r.over_limit, r.wait_sec)
           for r in M.sliding_request_rate(df, "service", "ts", "call_id", limit=2).collect()}
    for i, t in enumerate(secs):
        window = [u for u in secs[:i + 1] if u > t - 60]
        n = len(window)
        wait = (min(window) + 60 - t) if n > 2 else None
        assert got[i] == (n, n > 2, None if wait is None else float(wait))


def test_scan_latest_file_keeps_newest_version_only(spark, tmp_path):
    import os
    import time
    from tallyho.sources.readers import scan_latest_file
    p = str(tmp_path / "runs")
    spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string").write.parquet(p)
    time.sleep(1.1)
    spark.createDataFrame([(1, "new")], "id long, v string").write.mode("append").parquet(p)
    got = scan_latest_file(spark, p, "id long, v string").collect()
    assert [(r.id, r.v) for r in got] == [(1, "new")]
    assert os.path.isdir(p)


def test_scan_latest_file_keeps_whole_file_sets(spark, tmp_path):
    import os
    from pathlib import Path
    from tallyho.sources.readers import scan_latest_file
    p = str(tmp_path / "runs")
    for v, first in (("old", 1000), ("new", 2000)):
        before = set(Path(tmp_path).glob("runs/*.parquet"))
        spark.createDataFrame([(i, v) for i in range(4)], "id long, v string").repartition(4, "id").write.mode("append").parquet(p)
        for i, f in enumerate(sorted(set(Path(tmp_path).glob("runs/*.parquet")) - before)):
            os.utime(f, (first + 10 * i, first + 10 * i))   # parts finish at different times
    got = scan_latest_file(spark, p, "id long, v string").collect()
    assert sorted((r.id, r.v) for r in got) == [(i, "new") for i in range(4)]


def test_apply_model_failures_become_rows(spark):
    from tallyho.operators.labelers import apply_model
    df = spark.createDataFrame([("a", "ok"), ("b", "boom")], "custom_id string, text string")

    def make():
        def model(texts):
            if (texts == "boom").any():
                raise RuntimeError("model down")
            return texts.str.upper()
        return model

    out = {r.custom_id: r for r in apply_model(df.coalesce(1), "text", factory=make).collect()}
    assert (out["a"].reply, out["a"].error) == ("OK", None)   # only the failing row fails
    assert out["b"].reply is None and out["b"].error == "RuntimeError: model down"
    ok = {r.custom_id: r.reply for r in apply_model(df.where("text = 'ok'"), "text",
                                                    factory=make).collect()}
    assert ok == {"a": "OK"}


def test_validation_quarantines_instead_of_dropping(spark):
    from tallyho.operators.profiles import scan_quarantine, scan_validated
    rows = [("1", "u1", "", "https://x.example/1"),
            ("abc", "u2", "B", "https://x.example/2"),
            ("3", None, "C", "https://x.example/3"),
            ("4", "u4", "D", "not a url")]
    df = spark.createDataFrame(
        [(r, u, n, c, None, None, None, "en", None, None, "2016-11-01") for r, u, n, c in rows],
        S.COMPANY_CSV_SCHEMA)
    ok = scan_validated(df).collect()
    bad = {r.rcid: r.error for r in scan_quarantine(df).collect()}
    assert [(r.rcid, r.name, r.categories) for r in ok] == [(1, "Unknown", ["en"])]
    assert bad == {"abc": "rcid: not an integer", "3": "org_uuid: missing",
                   "4": "cb_url: not a URL"}


def _flat(spark, rows):
    cols = ["company_id", "company_name", "genai_strict_label", "genai_strict_confidence",
            "genai_moderate_label", "genai_moderate_confidence", "genai_lenient_label",
            "genai_lenient_confidence", "primary_assessment", "no_evidence_flag",
            "genai_functions_list", "genai_functions_details", "reasoning"]
    schema = ", ".join(f"{c} {'int' if c == 'no_evidence_flag' else 'string'}" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_function_lists_and_adoption_invariants(spark):
    from tallyho.operators.quality import check_adoption_invariants, check_mode_monotonic
    rows = [("1", "A", "No", "Low", "No", "Low", "No", "Low", "strict", 1, "", "", ""),
            ("2", "B", "Yes", "High", "No", "Low", "No", "Low", "strict", 0, "sales", "", ""),
            ("3", "C", "No", "Low", "No", "Low", "No", "Low", "strict", 1, "sales", "", ""),
            ("4", "D", "No", "Low", "Yes", "Low", "Yes", "Low", "strict", 0,
             "a_thing; ; marketing", "", ""),
            ("5", "E", "No", "Low", "No", "Low", "Yes", "Low", "lenient", 0, None, "", "")]
    flat = _flat(spark, rows)
    fn = sorted((r.company_id, r.function) for r in R.explode_function_list(flat).collect())
    assert fn == [("2", "sales"), ("3", "sales"), ("4", "a_thing"), ("4", "marketing")]
    top = [(r.function, r.n) for r in R.top_functions(flat, 2).collect()]
    assert top == [("sales", 2), ("a_thing", 1)]
    inv = {r.company_id: r.violations for r in check_adoption_invariants(flat).collect()}
    assert inv["1"] == "" and inv["3"] == "all_no_with_functions"
    assert inv["4"] == "unknown_function_keyword" and inv["5"] == "primary_not_strict"
    mono = {r.company_id: r.violations for r in check_mode_monotonic(flat).collect()}
    assert mono["2"] == "strict_not_in_moderate" and mono["4"] == ""


def test_low_confidence_findings_cut_at_half(spark):
    schema = "company_id long, result " + S.RESEARCH_RESULT_SCHEMA.simpleString()
    df = spark.createDataFrame([(1, _result(True, [_finding("a", 0.49), _finding("b", 0.5)])),
                                (2, None)], schema)
    out = {r.company_id: r.result for r in FD.drop_low_confidence_findings(df).collect()}
    assert [f.tool_name for f in out[1].findings] == ["b"] and out[2] is None


def test_citations_come_back_whole(spark, monkeypatch):
    from tallyho.plans import q_replies as Q
    cites = ["https://a;b", {"url": "u2", "title": "T \"2\", 2", "snippet": "line\nline"}, {"title": "no url"},
             {"url": "u4", "title": None, "snippet": "s" * 5000}, "https://a;b"]
    raws = [json.dumps({"citations": cites, "usage": {"prompt_tokens": 7, "completion_tokens": 4}}),
            '{"citations":[]}', '{"citations":null,"usage":{"prompt_tokens":3}}', "no JSON", None]
    raw = spark.createDataFrame(list(enumerate(raws)), "company_id long, raw string")
    monkeypatch.setattr(Q.B, "research_api_responses", lambda t: raw)
    got = {r.company_id: r for r in Q.q_normalize_citations(spark, "").collect()}
    objects = [{"url": c} if isinstance(c, str) else c for c in cites]
    for n in ("url", "title", "snippet"):
        assert got[0][f"citation_{n}s"] == [c.get(n) for c in objects]
        assert all(got[i][f"citation_{n}s"] == [] for i in range(1, 5))
    assert (got[0].n_citations, got[0].has_citations, got[0].n_titled) == (5, True, 2)
    assert got[0].urls == "https://a;b;u2;u4;https://a;b"
    assert [(got[i].n_citations, got[i].has_citations, got[i].urls) for i in range(1, 5)] == [(0, False, "")] * 4
    assert [got[i].total_tokens for i in range(5)] == [11, 0, 3, 0, 0]


def test_unmatchable_keys_bypass_the_join(spark):
    df = spark.createDataFrame([("a",), ("N/A",), (None,), ("N/A",)], "k string")
    lk = spark.createDataFrame([("a", "A", 1), (None, "ghost", 1)], "k string, name string, seq int")
    out = sorted((r.k or "", r.name) for r in RC.enrich_lookup(
        df, lk, "k", "seq", {"name": S.UNKNOWN_ID}).collect())
    assert out == [("", S.UNKNOWN_ID), ("N/A", S.UNKNOWN_ID), ("N/A", S.UNKNOWN_ID), ("a", "A")]
    src = spark.createDataFrame([("a", 1)], "sk string, rcid long")
    att = sorted((r.k or "", r.rcid) for r in RC.attach_source(df, src, "k", "sk").collect())
    assert att == [("", None), ("N/A", None), ("N/A", None), ("a", 1)]


def test_zero_denominators_are_safe(spark):
    import datetime as dt
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, "b1", "validating", 0, 0, 0, t0, None, True, False, False, t0),
            (2, "b2", "in_progress", 10, 4, 1, t0, None, True, False, False,
             t0 + dt.timedelta(seconds=100))]
    df = spark.createDataFrame(rows, S.BATCH_STATUS_SCHEMA.simpleString()
                               .replace("timestamp", "timestamp_ntz"))
    pct = [r[0] for r in df.select(X.safe_pct("completed", "total")).collect()]
    assert pct == [0.0, 40.0]
    eta = {r.batch_num: (r.per_sec, r.remaining, r.eta_sec) for r in M.throughput_eta(df).collect()}
    assert eta[1] == (0.0, 0, None) and eta[2] == (0.04, 5, 125.0)
