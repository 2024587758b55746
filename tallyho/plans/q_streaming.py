"""Registered queries: Structured Streaming jobs replayed over the tables.

Each query replays a test table in slices of time or id order: a slice's
files arrive, the streaming job runs on them (availableNow) and stops, and
the next run resumes from its checkpoint.  The oracle is the batch
computation of the same result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.operators.monitor import epoch_micros
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables
from tallyho.streaming import jobs as J

COMPANY_COLS = ["rcid", "org_uuid", "name", "cb_url", "homepage_url", "short_description", "long_description"]

def replay(df, order_col, path, run, n_slices=4):
    """Stand-in for files that arrive over time: ``df`` is cut into slices of
    ``order_col``; each is written to the stream's folder by many tasks, and
    ``run()`` continues the job from its checkpoint.  Returns the last result."""
    spark = df.sparkSession
    order = (F.col(order_col).cast("double") if dict(df.dtypes)[order_col] != "timestamp_ntz"
             else epoch_micros(order_col).cast("double"))
    cut = J.scratch_path(spark, "slices")
    bounds = df.select(order.alias("_o")).approxQuantile("_o", [i / n_slices for i in range(1, n_slices)], 0.01)
    place = sum((F.coalesce(order >= b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    df.withColumn("_slice", place).write.partitionBy("_slice").parquet(cut)
    for i in range(len(bounds) + 1):
        part = spark.read.parquet(cut).where(F.col("_slice") == i).drop("_slice")
        part.write.mode("append").parquet(path)
        out = run()
    return out


@register("incremental_pass", sql=f"""{with_views('companies')}
SELECT {', '.join(COMPANY_COLS)} FROM companies""")
def q_incremental_pass(spark, sf_dir):
    """Resume a pass: stream all companies into a target that already holds
    the logged ones; each record ends up exactly once, whole (ST1)."""
    t = Tables(spark, sf_dir)
    p = J.paths(spark, "incremental")
    src = B.companies(t).select(*COMPANY_COLS)
    target = J.scratch_path(spark, "incremental-target")
    J.append_target(src.join(B.search_log(t).select("rcid"), "rcid", "left_semi"), target, "rcid")
    replay(src, "rcid", p["src"],
           lambda: J.incremental_pass(spark, p["src"], src.schema, target, "rcid", p["ckpt"]))
    return J.read_target(spark, target, src.schema).select(*COMPANY_COLS)


@register("stream_rate_window", sql=f"""{with_views('api_calls')},
w AS (SELECT service, epoch_us(ts) AS t FROM api_calls),
ww AS (SELECT service, CAST((floor(t / 10000000) - k) * 10000000 AS BIGINT) AS ws FROM w CROSS JOIN range(6) r(k))
SELECT service, make_timestamp(ws) AS window_start, make_timestamp(ws + 60000000) AS window_end, count(*) AS n
FROM ww GROUP BY service, ws""")
def q_stream_rate_window(spark, sf_dir):
    """60-second windows sliding by 10 s of calls per service, with a
    watermark, over a replayed call log (ST2)."""
    calls = B.api_calls(Tables(spark, sf_dir)).select("service", "call_id", "ts")
    p = J.paths(spark, "rate")
    return replay(calls, "ts", p["src"],
                  lambda: J.stream_rate_window(spark, p["src"], calls.schema, p["out"], p["ckpt"]))


@register("stream_stuck_batches", sql=f"""{with_views('batch_status')},
x AS (SELECT batch_num, checked_at, completed,
        lag(completed) OVER (PARTITION BY batch_num ORDER BY checked_at) AS prev FROM batch_status),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR completed <> prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY batch_num ORDER BY checked_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM x)
SELECT batch_num, checked_at, completed,
  CAST(row_number() OVER (PARTITION BY batch_num, island ORDER BY checked_at) - 1 AS INTEGER) AS no_progress_polls
FROM y""")
def q_stream_stuck_batches(spark, sf_dir):
    """No-progress poll counts per batch, continued from run to run (ST3)."""
    st = B.batch_status(Tables(spark, sf_dir)).select("batch_num", "checked_at", "completed")
    p = J.paths(spark, "stuck")
    return replay(st, "checked_at", p["src"],
                  lambda: J.stream_stuck_batches(spark, p["src"], st.schema, p["out"], p["ckpt"]))


@register("stream_latest_status", sql=f"""{with_views('batch_status')}
SELECT batch_num, status, completed, failed, total, checked_at FROM batch_status
QUALIFY row_number() OVER (PARTITION BY batch_num ORDER BY checked_at DESC) = 1""")
def q_stream_latest_status(spark, sf_dir):
    """Latest snapshot per batch as a streaming aggregate (ST4)."""
    st = B.batch_status(Tables(spark, sf_dir)).select(
        "batch_num", "status", "completed", "failed", "total", "checked_at")
    p = J.paths(spark, "latest")
    return replay(st, "checked_at", p["src"],
                  lambda: J.stream_latest_status(spark, p["src"], st.schema, p["out"], p["ckpt"]))


@register("stream_dedup_records", sql=f"""{with_views('search_log_flat')}
SELECT l.rcid, l.name, c.long_description AS description, c.homepage_url, l.timestamp, l.error,
  {Q.q(S.SEARCH_QUERY_PREFIX)} || coalesce(l.name, '') AS query
FROM search_log_flat l JOIN companies c USING (rcid)
QUALIFY row_number() OVER (PARTITION BY l.rcid ORDER BY l.timestamp) = 1""")
def q_stream_dedup_records(spark, sf_dir):
    """The first record of each id of the append-only log, whole, with retried
    records dropped (ST5)."""
    log = B.search_log(Tables(spark, sf_dir)).withColumn(
        "_ts", F.to_timestamp("timestamp").cast("timestamp_ntz"))
    p = J.paths(spark, "dedup")
    out = replay(log, "_ts", p["src"], lambda: J.stream_dedup_records(
        spark, p["src"], log.schema, p["out"], p["ckpt"], "rcid", "timestamp"))
    return out.select("rcid", "name", "description", "homepage_url", "timestamp",
                      F.col("tavily.error").alias("error"), F.col("tavily.query").alias("query"))
