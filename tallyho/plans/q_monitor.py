"""Registered queries: batch monitoring and call-rate windows."""

from __future__ import annotations

from tallyho import schemas as S
from tallyho.operators import monitor as M
from tallyho.plans import sqlfn as Q
from tallyho.plans.oracle_views import with_views
from tallyho.plans.registry import register
from tallyho.sources import bindings as B
from tallyho.sources.tables import Tables

W_BS = with_views("batch_status")
_LATEST = """(SELECT * FROM batch_status QUALIFY row_number() OVER (PARTITION BY batch_num ORDER BY checked_at DESC) = 1)"""


def _status(spark, sf_dir):
    return B.batch_status(Tables(spark, sf_dir))


@register("detect_stuck", sql=f"""{W_BS},
x AS (SELECT batch_num, checked_at, completed,
        lag(completed) OVER (PARTITION BY batch_num ORDER BY checked_at) AS prev FROM batch_status),
y AS (SELECT *, sum(CASE WHEN prev IS NULL OR completed <> prev THEN 1 ELSE 0 END)
        OVER (PARTITION BY batch_num ORDER BY checked_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY batch_num, island ORDER BY checked_at) - 1 AS np FROM y)
SELECT batch_num, checked_at, completed, coalesce(completed - prev, 0) AS delta,
  CAST(np AS INTEGER) AS no_progress_polls, np >= {S.STUCK_WARN_POLLS_SLOW} AS warn_slow_polls,
  np >= {S.STUCK_WARN_POLLS_FAST} AS warn_fast_polls FROM z""")
def q_detect_stuck(spark, sf_dir):
    """Consecutive no-progress polls per batch with 5 / 10 warnings."""
    return M.detect_stuck(_status(spark, sf_dir))


@register("sliding_request_rate", sql=f"""{with_views('api_calls')},
c AS (SELECT service, call_id, epoch_us(ts) AS t FROM api_calls)
SELECT a.service, a.call_id, count(*) AS calls_in_window, count(*) > 1 AS over_limit,
  CASE WHEN count(*) > 1 THEN (min(b.t) + {S.RATE_WINDOW_SEC * 1_000_000} - a.t) / 1e6 END AS wait_sec
FROM c a JOIN c b ON a.service = b.service AND b.t > a.t - {S.RATE_WINDOW_SEC * 1_000_000}
  AND (b.t < a.t OR (b.t = a.t AND b.call_id <= a.call_id))
GROUP BY a.service, a.call_id, a.t""")
def q_sliding_request_rate(spark, sf_dir):
    """Calls per service in the trailing 60 s, exact, skew-safe."""
    calls = B.api_calls(Tables(spark, sf_dir))
    return M.sliding_request_rate(calls, "service", "ts", "call_id", limit=1)


@register("throughput_eta", sql=f"""{W_BS}
SELECT batch_num, status,
  round(coalesce(completed / ((epoch_us(checked_at) - epoch_us(created_at)) / 1e6), 0.0), 9) AS per_sec,
  total - completed - failed AS remaining,
  round(CASE WHEN completed / ((epoch_us(checked_at) - epoch_us(created_at)) / 1e6) > 0
        THEN (total - completed - failed) / (completed / ((epoch_us(checked_at) - epoch_us(created_at)) / 1e6)) END, 3) AS eta_sec
FROM {_LATEST}""")
def q_throughput_eta(spark, sf_dir):
    """Completed per second since creation, remaining, ETA per batch."""
    return M.throughput_eta(_status(spark, sf_dir))


@register("batch_status_rollup", sql=f"""{W_BS}
SELECT status, count(*) AS n_batches, CAST(sum(total) AS BIGINT) AS total,
  CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed, round({Q.pct('sum(completed)', 'sum(total)')}, 6) AS progress_pct
FROM {_LATEST} GROUP BY status""")
def q_batch_status_rollup(spark, sf_dir):
    """Latest status per batch -> counts and progress by status."""
    return M.batch_status_rollup(_status(spark, sf_dir))


@register("all_batches_ready", sql=f"""{W_BS}
SELECT count(*) AS n_batches, count(CASE WHEN status = 'completed' THEN 1 END) AS n_completed,
  coalesce(bool_and(status = 'completed'), false) AS ready FROM {_LATEST}""")
def q_all_batches_ready(spark, sf_dir):
    """Ready flag: every batch's latest status is completed."""
    return M.all_batches_ready(_status(spark, sf_dir))


@register("filter_active_batches", sql=f"""{W_BS}
SELECT batch_num, batch_id, status FROM {_LATEST}
WHERE status IN ({', '.join(Q.q(s) for s in S.ACTIVE_BATCH_STATUSES)})""")
def q_filter_active_batches(spark, sf_dir):
    """Batches whose latest status is validating / in_progress / finalizing."""
    return M.filter_active_batches(_status(spark, sf_dir))
