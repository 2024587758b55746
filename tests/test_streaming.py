"""Streaming jobs against the loops they stand for: runs that resume, polls
out of order inside a run, late polls, and files left by an earlier run."""

import datetime as dt
import random

from pyspark.sql import functions as F

from test_traps import stuck_loop
from tallyho.streaming import jobs as J

POLL = "batch_num int, checked_at timestamp_ntz, completed long"
BASE = dt.datetime(2026, 1, 1)


def test_stuck_counts_continue_across_runs_and_files(spark):
    rnd = random.Random(5)
    values = {1: [0, 0, 1, 1, 1, 2], 2: [rnd.choice([3, 3, 4]) for _ in range(24)], 3: [7] * 90}
    rows = [(b, BASE + dt.timedelta(minutes=i), v) for b, vs in values.items() for i, v in enumerate(vs)]
    rows.sort(key=lambda r: r[1])
    p = J.paths(spark, "stuck-test")
    schema = spark.createDataFrame([], POLL).schema
    for i in range(0, len(rows), 30):       # each run's polls come shuffled, in three files
        part = rows[i:i + 30]
        # a cut between runs never parts the polls of one minute
        rnd.shuffle(part)
        spark.createDataFrame(part, POLL).repartition(3).write.mode("append").parquet(p["src"])
        out = J.stream_stuck_batches(spark, p["src"], schema, p["out"], p["ckpt"])
    got = sorted(map(tuple, out.collect()))
    want = sorted((b, BASE + dt.timedelta(minutes=i), v, n)
                  for b, vs in values.items() for i, (v, n) in enumerate(zip(vs, stuck_loop(vs))))
    assert got == want
    assert J.late_polls(spark, p["out"]).count() == 0


def test_late_and_timeless_polls_are_kept_apart(spark):
    p = J.paths(spark, "late-test")
    schema = spark.createDataFrame([], POLL).schema

    def run(*polls, **kw):
        rows = [(b, None if m is None else BASE + dt.timedelta(minutes=m), v) for b, m, v in polls]
        spark.createDataFrame(rows, POLL).coalesce(1).write.mode("append").parquet(p["src"])
        return J.stream_stuck_batches(spark, p["src"], schema, p["out"], p["ckpt"], **kw)

    run((1, 0, 5), (1, 10, 5), (2, 10, 1))
    out = run((1, 5, 4), (1, 20, 5), (None, 20, 1), (2, None, 1), forget_after="5 minutes")
    late = sorted((r.batch_num, r.completed) for r in J.late_polls(spark, p["out"]).collect())
    assert late == [(1, 4), (2, 1)]
    assert [r.no_progress_polls for r in out.where("batch_num = 1").orderBy("checked_at").collect()] == [0, 1, 2]
    # batch 2 left the state: its next poll starts anew
    out = run((2, 30, 1), (1, 30, 5))
    assert [r.no_progress_polls for r in out.where("batch_num = 2").orderBy("checked_at").collect()] == [0, 0]
    assert [r.no_progress_polls for r in out.where("batch_num = 1").orderBy("checked_at").collect()] == [0, 1, 2, 3]


def test_late_calls_are_counted(spark):
    p = J.paths(spark, "rate-test")
    spec = "service string, call_id long, ts timestamp_ntz"
    schema = spark.createDataFrame([], spec).schema
    for minutes in ([0, 60], [1, 61]):      # the poll at minute 1 comes an hour late
        spark.createDataFrame([("s", m, BASE + dt.timedelta(minutes=m)) for m in minutes], spec) \
            .coalesce(1).write.mode("append").parquet(p["src"])
        out = J.stream_rate_window(spark, p["src"], schema, p["out"], p["ckpt"])
    assert out.agg(F.sum("n")).first()[0] == 3 * 6
    assert J.dropped_rows(spark, p["out"]).agg(F.sum("dropped")).first()[0] > 0
