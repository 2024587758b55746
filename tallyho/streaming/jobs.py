"""Structured Streaming jobs: incremental passes, rate windows, stuck
batches, latest status and de-duplication of an append-only log.

Every job takes a file-stream source (parquet) and keeps its checkpoint in
the shared checkpoint folder.  By default it runs to completion with
``trigger(availableNow=True)``; pass ``trigger={"processingTime": "1
minute"}`` (any ``DataStreamWriter.trigger`` keywords) to leave it running
in the background: the jobs that return a DataFrame then return a reader
over what the query has written so far, ``incremental_pass`` returns the
running query.  Aggregations in update mode are written through
``foreachBatch`` to an ``update_log``, which merges the rows of earlier
micro-batches so that the latest value per key costs keys and not history.
Files of a micro-batch count once a commit entry or a snapshot, written last,
names them, so a micro-batch replayed after a failure changes nothing twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho.operators.monitor import epoch_micros, unchanged_runs
from tallyho.sources import commits, file_index
from tallyho.sources.sinks import scratch_path
from tallyho.streaming import update_log


#: Options of the file sources.  All files that are there make one micro-batch
#: unless the caller sets ``maxFilesPerTrigger`` here.
SOURCE_OPTIONS: dict[str, str] = {}


def _file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).options(**SOURCE_OPTIONS).parquet(path)


TRIGGER: dict = {"availableNow": True}


def _run(writer, checkpoint: str, trigger: dict | None = None):
    q = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER)).start()
    if not (trigger or TRIGGER).get("availableNow"):
        return q
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def dropped_by_watermark(query) -> int:
    """Rows that a query's stateful operators dropped as late, over the
    progress reports that Spark still holds (``numRecentProgressUpdates``).
    For a windowed aggregate Spark counts partial sums, not single rows."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def _note_dropped(spark: SparkSession, query, out: str) -> None:
    """One row a finished run, beside its output."""
    if not query.isActive:
        (spark.range(1).select(F.lit(str(query.runId)).alias("run_id"),
                               F.lit(dropped_by_watermark(query)).cast("long").alias("dropped"))
         .coalesce(1).write.mode("append").parquet(f"{out}-dropped"))


def dropped_rows(spark: SparkSession, out: str) -> DataFrame:
    """``run_id, dropped``: late rows that each finished run left out of ``out``."""
    return spark.read.parquet(f"{out}-dropped")


def append_target(df: DataFrame, target: str, key: str) -> None:
    """Append rows to a pass target, with a Bloom filter of the keys of each file."""
    file_index.append_indexed(df, target, key)


def incremental_pass(spark: SparkSession, source: str, schema: T.StructType,
                     target: str, key: str, checkpoint: str, trigger: dict | None = None):
    """Append only rows whose key is not in the target yet (resume).

    Each micro-batch asks the target's file index which files may hold one of
    its keys, anti-joins those, and appends the rest under a commit of its own,
    so a batch replayed after a failure adds nothing twice.
    """
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        commit = f"{query}-{batch_id:012d}"
        if not commits.committed(batch.sparkSession, target, commit):
            file_index.append_indexed(file_index.without_known(batch, target, key), target, key, commit)

    return _run(_file_stream(spark, source, schema).writeStream.foreachBatch(upsert),
                checkpoint, trigger)


def read_target(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return commits.read_committed(spark, target, schema)


def _append_updates(out: str, keys: list[str]):
    def write(batch: DataFrame, batch_id: int) -> None:
        update_log.append(batch, batch_id, out, keys)
    return write


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Latest emitted value per key of an update-mode output."""
    latest = update_log.read_latest(spark, out, keys)
    if latest is None:
        raise ValueError(f"no micro-batch has been written to {out} yet")
    return latest


def stream_rate_window(spark: SparkSession, source: str, schema: T.StructType,
                       out: str, checkpoint: str, key: str = "service",
                       ts: str = "ts", length: str = "60 seconds",
                       slide: str = "10 seconds", delay: str = "10 minutes",
                       trigger: dict | None = None) -> DataFrame:
    """Sliding-window call counts per key with a watermark (update mode).
    Calls later than ``delay`` are left out and counted (``dropped_rows``)."""
    s = _file_stream(spark, source, schema).withColumn("_et", F.col(ts).cast("timestamp"))
    agg = (s.withWatermark("_et", delay)
           .groupBy(F.window("_et", length, slide).alias("w"), key)
           .agg(F.count(F.lit(1)).alias("n"))
           .select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                   F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n"))
    q = _run(agg.writeStream.outputMode("update").foreachBatch(
        _append_updates(out, [key, "window_start", "window_end"])), checkpoint, trigger)
    _note_dropped(spark, q, out)
    return latest_updates(spark, out, [key, "window_start", "window_end"])


def stream_stuck_batches(spark: SparkSession, source: str, schema: T.StructType,
                         out: str, checkpoint: str, trigger: dict | None = None,
                         forget_after: str | None = None) -> DataFrame:
    """Consecutive no-progress polls per batch, carried across micro-batches.

    A micro-batch is put in time order and counted by ``unchanged_runs``,
    which splits a batch that has most of the polls over many tasks; whatever
    chunks or files the polls came in, the counts are those of the ordered
    polls.  The state is an update log of one row a batch number (its last
    time, counter and count): a micro-batch writes the batch numbers it saw and
    its snapshot makes it count, so a replayed one changes nothing.  With
    ``forget_after`` (an interval) batch numbers whose last poll is that much
    older than the newest one leave the state.  Polls that are not later than
    the last one counted of their batch, or that have no time, are kept in
    ``late_polls``.
    """
    key, ts, progress = "batch_num", "checked_at", "completed"
    fields = {f.name: f.dataType.simpleString() for f in schema.fields}
    known = f"{key} {fields[key]}, {ts} {fields[ts]}, {progress} {fields[progress]}, no_progress_polls int"

    def count(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = update_log.snapshot(session, f"{out}-state")
        if batch_id <= before["batch"]:
            return
        state = update_log.read_latest(session, f"{out}-state", [key])
        state = session.createDataFrame([], known) if state is None else state
        oldest = before["note"]     # microseconds; what is older was forgotten
        if oldest is not None:
            state = state.where(epoch_micros(ts) >= oldest)
        last = state.select(F.col(key).alias("_key"), F.col(ts).alias("_last"))
        polls = batch.select(key, ts, progress).join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
        late = F.col(ts).isNull() | F.coalesce(F.col(ts) <= F.col("_last"), F.lit(False))
        polls.where(late).select(key, ts, progress).write.mode("overwrite").parquet(f"{out}-late/_batch={batch_id}")
        asked = batch.select(F.col(key).alias("_key")).distinct()
        rows = (polls.where(~late).select(key, ts, progress, F.lit(0).alias("_base"), F.lit(False).alias("_state"))
                .unionByName(state.join(asked, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
                             .withColumnRenamed("no_progress_polls", "_base").withColumn("_state", F.lit(True))))
        counted = f"{out}/_batch={batch_id}"
        (unchanged_runs(rows, key, ts, progress, "_base").drop("_base", "_prev")
         .write.mode("overwrite").parquet(counted))
        done = session.read.parquet(counted)
        new = (done.groupBy(key).agg(F.max_by(F.struct(ts, progress, "no_progress_polls"), F.struct(ts, progress)).alias("v"))
               .select(key, "v.*"))
        if forget_after:
            span = F.expr(f"unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {forget_after})")
            newest = state.select(ts).unionByName(done.select(ts)).agg((F.max(epoch_micros(ts)) - span).alias("o")).first()[0]
            oldest = max((x for x in (oldest, newest) if x is not None), default=None)
        keep = None if oldest is None else epoch_micros(ts) >= oldest
        update_log.append(new, batch_id, f"{out}-state", [key], oldest, keep)

    _run(_file_stream(spark, source, schema).select(key, ts, progress).writeStream.foreachBatch(count),
         checkpoint, trigger)
    return (spark.read.schema(f"{known}, _state boolean, _batch long").parquet(out)
            .where(F.col("_batch") <= update_log.snapshot(spark, f"{out}-state")["batch"]).where("not _state")
            .select(key, ts, progress, "no_progress_polls"))


def late_polls(spark: SparkSession, out: str) -> DataFrame:
    """Polls that ``stream_stuck_batches`` left out, with their micro-batch."""
    return spark.read.parquet(f"{out}-late")


def stream_latest_status(spark: SparkSession, source: str, schema: T.StructType,
                         out: str, checkpoint: str, trigger: dict | None = None) -> DataFrame:
    """Latest snapshot per batch as a streaming max_by (update mode)."""
    s = _file_stream(spark, source, schema)
    agg = s.groupBy("batch_num").agg(
        F.max_by(F.struct("status", "completed", "failed", "total", "checked_at"),
                 "checked_at").alias("v")).select("batch_num", "v.*")
    _run(agg.writeStream.outputMode("update").foreachBatch(_append_updates(out, ["batch_num"])), checkpoint,
         trigger)
    return latest_updates(spark, out, ["batch_num"])


def stream_dedup_records(spark: SparkSession, source: str, schema: T.StructType,
                         out: str, checkpoint: str, key: str, ts: str,
                         within: str = "2 days", trigger: dict | None = None) -> DataFrame:
    """The first record of each key, whole; nothing is left out unseen.

    The clock is the newest time of the micro-batches before.  Records older
    than the clock by more than ``within``, or without a time, go to
    ``late_records``.  Of the others, the earliest of a key in a micro-batch is
    kept (ties by the record's text) unless the key is remembered; a key is
    remembered until the clock is twice ``within`` past its record.  All other
    records are repeats, counted by key in ``repeated_records``.  A key with
    most of the records is grouped map-side and never lands whole in a task.

    ``out/_batch=N`` holds the kept records and counts of a micro-batch,
    ``out-late/_batch=N`` its late ones, and ``out-seen`` is an update log of
    the remembered keys whose snapshot, written last, makes them count.
    """
    def dedup(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = update_log.snapshot(session, f"{out}-seen")
        if batch_id <= state["batch"]:
            return
        clock = F.lit(state["note"]).cast("long")        # microseconds, null at first
        at = F.to_timestamp(ts).cast("timestamp_ntz")
        micros = F.expr(f"unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {within})")
        timed = batch.withColumn("_time", at).withColumn("_at", epoch_micros("_time")).drop("_time")
        late = F.col("_at").isNull() | F.coalesce(F.col("_at") < clock - micros, F.lit(False))
        timed.where(late).drop("_at").write.mode("overwrite").parquet(f"{out}-late/_batch={batch_id}")
        record = F.struct(*schema.fieldNames())
        first = (timed.where(~late).groupBy(F.col(key).alias("_key"))
                 .agg(F.min_by(F.struct("_at", record.alias("r")), F.struct("_at", F.to_json(record))).alias("f"),
                      F.count(F.lit(1)).alias("_n")))
        seen = update_log.read_latest(session, f"{out}-seen", ["_key"])
        if seen is not None:
            known = seen.where(F.col("_at") >= clock - 2 * micros).select(F.col("_key").alias("_known"), F.lit(True).alias("_old"))
            first = first.join(known, F.col("_key").eqNullSafe(F.col("_known")), "left")
        old = F.coalesce(F.col("_old"), F.lit(False)) if seen is not None else F.lit(False)
        path = f"{out}/_batch={batch_id}"
        (first.select((~old).alias("_kept"), (F.col("_n") - (~old).cast("int")).alias("_repeats"), "_key",
                      F.col("f._at").alias("_at"), "f.r.*").write.mode("overwrite").parquet(path))
        kept = session.read.parquet(path).where("_kept").select("_key", "_at")
        newest = timed.agg(F.max("_at")).first()[0]
        clock_now = max((x for x in (state["note"], newest) if x is not None), default=None)
        oldest = F.lit(clock_now).cast("long") - 2 * micros
        update_log.append(kept, batch_id, f"{out}-seen", ["_key"], clock_now, F.coalesce(F.col("_at") >= oldest, F.lit(True)))

    _run(_file_stream(spark, source, schema).writeStream.foreachBatch(dedup), checkpoint, trigger)
    return _deduped(spark, out).where("_kept").select(*schema.fieldNames())


def _deduped(spark: SparkSession, out: str, suffix: str = "") -> DataFrame:
    """Rows of the micro-batches that count."""
    last = update_log.snapshot(spark, f"{out}-seen")["batch"]
    return spark.read.parquet(f"{out}{suffix}").where(F.col("_batch") <= last)


def late_records(spark: SparkSession, out: str) -> DataFrame:
    """Records that ``stream_dedup_records`` judged too late, with their micro-batch."""
    return _deduped(spark, out, "-late")


def repeated_records(spark: SparkSession, out: str, key: str) -> DataFrame:
    """``key, repeats``: records left out because the key was kept already."""
    return (_deduped(spark, out).where("_repeats > 0").groupBy(F.col("_key").alias(key))
            .agg(F.sum("_repeats").alias("repeats")))


def paths(spark: SparkSession, name: str) -> dict[str, str]:
    return {k: scratch_path(spark, f"{name}-{k}") for k in ("src", "out", "ckpt")}
