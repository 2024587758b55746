"""Batch monitoring and request-rate windows.

Running sums and runs of equal values are skew-safe: rows get a global
position in the order, windows run over blocks of positions (a hot key is
split across many blocks), and what passes from block to block is one row a
block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X
from tallyho.operators.batching import with_global_index
from tallyho.operators.reconcile import latest_record_per_id


def epoch_micros(ts) -> F.Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp (no zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST({ts} AS TIMESTAMP_NTZ))")


def cumulative_sum(df: DataFrame, order_cols: list[str], weight_col,
                   out_col="cum", n_parts: int | None = None,
                   block_rows: int = 200_000) -> DataFrame:
    """Running sums of weight columns in ``order_cols`` order (inclusive of
    the row itself).  ``weight_col`` / ``out_col`` may be lists to compute
    several sums in one pass."""
    weights = [weight_col] if isinstance(weight_col, str) else list(weight_col)
    outs = [out_col] if isinstance(out_col, str) else list(out_col)
    x = with_global_index(df, order_cols, "_i", None, n_parts) \
        .withColumn("_b", F.floor(F.col("_i") / block_rows))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(weights)])
    carry = totals.select("_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}")
                                  for i in range(len(weights))])
    upto = Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(carry, "_b").select(
        *df.columns, *[(F.sum(c).over(upto) + F.col(f"_o{i}")).alias(out)
                       for i, (c, out) in enumerate(zip(weights, outs))])


def sliding_request_rate(calls: DataFrame, key: str, ts_col: str, id_col: str,
                         window_sec: int = S.RATE_WINDOW_SEC,
                         limit: int | None = None, n_parts: int | None = None
                         ) -> DataFrame:
    """Calls of the same ``key`` in the trailing window (t - w, t], exact to
    the microsecond; an event exactly ``w`` old is out of the window.

    count(t) = cum(t) - cum(t - w): each call contributes an event row and
    a probe row at t - w to one skew-safe cumulative count.  Ties at equal
    time are ordered by ``id_col``.  With ``limit``, also flags calls that
    exceed it and gives ``wait_sec``, the time until the oldest call in the
    window expires (that call is found by an equi-join on its cumulative
    position).
    """
    t = epoch_micros(ts_col)
    wu = window_sec * 1_000_000
    base = calls.select(F.col(key).alias("_k"), F.col(id_col).alias("_id"), t.alias("_t"))
    ev = base.select("_k", "_t", F.lit(0).alias("_kind"), "_id", F.lit(1).alias("_w"))
    pr = base.select("_k", (F.col("_t") - wu).alias("_t"), F.lit(1).alias("_kind"), "_id",
                     F.lit(0).alias("_w"))
    cum = cumulative_sum(ev.unionByName(pr), ["_k", "_t", "_kind", "_id"], "_w", "_cum",
                         n_parts)
    e = cum.where("_kind = 0").select("_k", "_id", "_t", F.col("_cum").alias("_ce"))
    p = cum.where("_kind = 1").select("_k", "_id", F.col("_cum").alias("_cp"))
    joined = e.join(p, ["_k", "_id"])
    out = joined.select(F.col("_k").alias(key), F.col("_id").alias(id_col),
                        (F.col("_ce") - F.col("_cp")).alias("calls_in_window"))
    if limit is None:
        return out
    oldest = e.select(F.col("_k").alias("_ok"), F.col("_ce").alias("_pos"),
                      F.col("_t").alias("_t_old"))
    w = joined.join(oldest, (F.col("_k") == F.col("_ok"))
                    & (F.col("_pos") == F.col("_cp") + 1), "left")
    n = F.col("_ce") - F.col("_cp")
    return w.select(
        F.col("_k").alias(key), F.col("_id").alias(id_col), n.alias("calls_in_window"),
        (n > limit).alias("over_limit"),
        F.when(n > limit, (F.col("_t_old") + wu - F.col("_t")) / 1e6).alias("wait_sec"))


def unchanged_runs(polls: DataFrame, key: str, ts: str, progress: str, base: str | None = None,
                   n_parts: int | None = None, block_rows: int = 200_000) -> DataFrame:
    """``polls`` with ``_prev`` (the counter of the batch's poll before) and
    ``no_progress_polls``, its place in the run of unchanged counters.

    ``base`` names a column with the place that a run's first poll has, if
    the run began before these polls; otherwise that place is 0.

    Polls get a global position in (key, time) order, and every window runs
    over blocks of ``block_rows`` positions, whatever their keys.  The poll
    before a block, and the last change before it, come from one row a
    block.  A batch with a third of all polls is spread over many tasks.
    """
    x = with_global_index(polls, [key, ts, progress], "_i", None, n_parts) \
        .withColumn("_b", F.floor(F.col("_i") / block_rows))
    w = Window.partitionBy("_b").orderBy("_i")
    own = F.struct(F.col(key).alias("k"), F.col(progress).alias("p"))
    ends = x.groupBy((F.col("_b") + 1).alias("_b")).agg(F.max_by(own, "_i").alias("_end"))
    before = F.when(F.col("_i") % block_rows == 0, F.col("_end")).otherwise(F.col("_lag"))
    first = F.col("_prev").isNull() | (F.col(progress) != F.col("_prev"))
    start_of = F.struct(F.col("_i").alias("i"), (F.col(base) if base else F.lit(0)).alias("place"))
    j = (x.withColumn("_lag", F.lag(own).over(w))
         .join(ends, "_b", "left").withColumn("_before", before)
         .withColumn("_prev", F.when(F.col("_before.k") == F.col(key), F.col("_before.p")))
         .withColumn("_s", F.when(first, start_of))
         .select(*polls.columns, "_i", "_b", "_prev", "_s").checkpoint(eager=True))
    # the last change before each block: a window over one row a block
    carry = j.groupBy("_b").agg(F.max("_s").alias("_m")).select("_b", F.max("_m").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    start = F.coalesce(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry"))
    return (j.join(carry, "_b").withColumn("_start", start)
            .select(*polls.columns, "_prev",
                    (F.col("_i") - F.col("_start.i") + F.col("_start.place")).cast("int").alias("no_progress_polls")))


def detect_stuck(status: DataFrame, key: str = "batch_num", ts: str = "checked_at",
                 progress: str = "completed", n_parts: int | None = None,
                 block_rows: int = 200_000) -> DataFrame:
    """Consecutive polls without progress (gaps and islands), skew-safe.

    ``no_progress_polls`` is 0 at a poll whose counter changed (or the
    first poll) and grows by one per unchanged poll; warnings at 5 and 10.
    See ``unchanged_runs``.
    """
    runs = unchanged_runs(status.select(key, ts, progress), key, ts, progress, None, n_parts, block_rows)
    return runs.select(
        key, ts, progress,
        F.coalesce(F.col(progress) - F.col("_prev"), F.lit(0)).alias("delta"),
        "no_progress_polls",
        (F.col("no_progress_polls") >= S.STUCK_WARN_POLLS_SLOW).alias("warn_slow_polls"),
        (F.col("no_progress_polls") >= S.STUCK_WARN_POLLS_FAST).alias("warn_fast_polls"))


def throughput_eta(status: DataFrame) -> DataFrame:
    """Per batch (latest poll): completed per second, remaining, ETA."""
    last = latest_record_per_id(status, "batch_num", "checked_at")
    elapsed = (epoch_micros("checked_at") - epoch_micros("created_at")) / 1e6
    rate = F.try_divide(F.col("completed").cast("double"), elapsed)
    remaining = F.col("total") - F.col("completed") - F.col("failed")
    return last.select(
        "batch_num", "status",
        F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("per_sec"),
        remaining.alias("remaining"),
        F.round(F.when(rate > 0, remaining / rate), 3).alias("eta_sec"))


def batch_status_rollup(status: DataFrame) -> DataFrame:
    """Latest status per batch -> counts and progress by status."""
    last = latest_record_per_id(status, "batch_num", "checked_at")
    return last.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("total").alias("total"), F.sum("completed").alias("completed"),
        F.sum("failed").alias("failed")) \
        .withColumn("progress_pct", F.round(X.safe_pct("completed", "total"), 6))


def all_batches_ready(status: DataFrame) -> DataFrame:
    """One row: every batch's latest status is 'completed'."""
    last = latest_record_per_id(status, "batch_num", "checked_at")
    return last.agg(F.count(F.lit(1)).alias("n_batches"),
                    F.count_if(F.col("status") == "completed").alias("n_completed"),
                    F.coalesce(F.bool_and(F.col("status") == "completed"), F.lit(False))
                    .alias("ready"))


def filter_active_batches(status: DataFrame,
                          active: list[str] = S.ACTIVE_BATCH_STATUSES) -> DataFrame:
    """Batches whose latest status is in the ``active`` set."""
    last = latest_record_per_id(status, "batch_num", "checked_at")
    return last.where(F.col("status").isin(active)).select("batch_num", "batch_id", "status")
