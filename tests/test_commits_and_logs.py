"""Exactly-once appends, the file index, the update log and the de-duplicating
stream: writers that die half-way, replays, late and repeated records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyho.sources import commits, file_index, sinks
from tallyho.streaming import jobs as J
from tallyho.streaming import update_log

BASE = dt.datetime(2026, 1, 1)


def test_a_writer_that_died_before_its_commit_leaves_one_copy(spark):
    root = sinks.scratch_path(spark, "log-test")
    lines = spark.range(50).select(F.col("id").alias("n"))
    schema = "n long"
    commits.write_files(lines, root, "a", "json")             # died here
    assert commits.read_committed(spark, root, schema, "json").count() == 0
    assert commits.append_once(lines.repartition(3), root, "a", "json")
    assert not commits.append_once(lines, root, "a", "json")  # a retry of a finished job
    commits.append_once(lines, root, "b", "json")
    got = commits.read_committed(spark, root, schema, "json")
    assert got.count() == 100 and got.distinct().count() == 50


def test_only_files_that_may_hold_a_key_are_read(spark):
    root = sinks.scratch_path(spark, "index-test")
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    file_index.append_indexed(rows.where("k < 19000").repartitionByRange(180, "k"), root, "k")
    file_index.append_indexed(rows.where("k >= 19000").repartitionByRange(20, "k"), root, "k")
    written = commits.read_committed(spark, root, rows.schema)
    assert len(written.inputFiles()) == 200
    asked = rows.where("k in (3, 7000, 7001, 19999)").unionByName(
        spark.createDataFrame([(-5, "x"), (None, "y")], "k long, v string"))
    holding = {r[0] for r in written.where("k in (3, 7000, 7001, 19999)").select("_metadata.file_path").distinct().collect()}
    files = file_index.files_holding(asked, root, "k")
    assert {f.split("/")[-1] for f in holding} <= {f.split("/")[-1] for f in files}
    assert len(files) <= len(holding) + 20                    # six keys, 200 files, one in a hundred
    new = file_index.without_known(asked, root, "k")
    assert sorted(str(r.k) for r in new.collect()) == ["-5", "None"]


def test_uncommitted_files_of_a_target_are_no_rows(spark):
    root = sinks.scratch_path(spark, "index-crash")
    rows = spark.range(30).select(F.col("id").alias("k"))
    commits.write_files(rows, root, "dead")
    assert file_index.files_holding(rows, root, "k") == []
    file_index.append_indexed(rows, root, "k", "dead")
    file_index.append_indexed(rows, root, "k", "dead")
    assert commits.read_committed(spark, root, rows.schema).count() == 30


def test_incremental_pass_resumes_and_replays(spark):
    p = J.paths(spark, "pass-test")
    target = J.scratch_path(spark, "pass-target")
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    J.append_target(rows.where("k < 50"), target, "k")
    for lo, hi in ((0, 120), (100, 200), (100, 200)):
        rows.where(f"k >= {lo} and k < {hi}").write.mode("append").parquet(p["src"])
        J.incremental_pass(spark, p["src"], rows.schema, target, "k", p["ckpt"])
    got = J.read_target(spark, target, rows.schema)
    assert got.count() == 200 and got.distinct().count() == 200


def test_many_micro_batches_leave_few_runs(spark, monkeypatch):
    monkeypatch.setattr(update_log, "FANOUT", 3)
    out = sinks.scratch_path(spark, "updates")
    want = {}
    for i in range(30):
        rows = [(f"k{(i * 7 + j) % 11}", i * 10 + j) for j in range(4)]
        want.update(rows)
        update_log.append(spark.createDataFrame(rows, "k string, v long").coalesce(1), i, out, ["k"])
        assert len(update_log.snapshot(spark, out)["runs"]) <= 2 * 4
        assert len(commits.names(spark, f"{out}/runs")) <= 2 * 2 * 4 + 3
        assert len(commits.names(spark, f"{out}/snapshots")) <= 2
    assert dict(map(tuple, update_log.read_latest(spark, out, ["k"]).collect())) == want


def test_a_crash_before_the_snapshot_loses_and_repeats_nothing(spark, monkeypatch):
    monkeypatch.setattr(update_log, "FANOUT", 2)
    out = sinks.scratch_path(spark, "updates-crash")
    make = lambda i: spark.createDataFrame([("a", i), (f"b{i}", i)], "k string, v long").coalesce(1)
    update_log.append(make(0), 0, out, ["k"])
    plain = update_log._publish
    monkeypatch.setattr(update_log, "_publish", lambda *x: 1 / 0)       # dies between the merged run and the snapshot
    with pytest.raises(ZeroDivisionError):
        update_log.append(make(1), 1, out, ["k"])
    monkeypatch.setattr(update_log, "_publish", plain)
    read = lambda: dict(map(tuple, update_log.read_latest(spark, out, ["k"]).collect()))
    assert read() == {"a": 0, "b0": 0}
    assert update_log.append(make(1), 1, out, ["k"])
    assert not update_log.append(make(7), 1, out, ["k"])                # a replay of a counted micro-batch
    assert read() == {"a": 1, "b0": 0, "b1": 1}


def test_records_are_kept_late_or_repeats(spark):
    p = J.paths(spark, "dedup-test")
    spec = "k long, at string, body struct<x: string, tags: array<string>>"
    schema = spark.createDataFrame([], spec).schema

    def record(k, hours, x):
        at = None if hours is None else (BASE + dt.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S")
        return (k, at, (x, [x, x]))

    batches = [[record(1, 5, "b"), record(1, 4, "a"), record(2, 0, "c"), record(None, 1, "n"), record(None, 2, "m")],
               [record(1, 30, "again"), record(3, 60, "d"), record(3, 60, "e"), record(4, None, "timeless")],
               [record(5, 20, "late"), record(3, 61, "again"), record(6, 200, "f")] + [record(6, 201, "hot")] * 40,
               [record(1, 201, "forgotten, so new"), record(6, 202, "again")]]
    for rows in batches:
        spark.createDataFrame(rows, spec).coalesce(2).write.mode("append").parquet(p["src"])
        out = J.stream_dedup_records(spark, p["src"], schema, p["out"], p["ckpt"], "k", "at", "24 hours")
    kept = sorted((str(r.k), r.body.x, len(r.body.tags)) for r in out.collect())
    assert kept == [("1", "a", 2), ("1", "forgotten, so new", 2), ("2", "c", 2), ("3", "d", 2), ("6", "f", 2), ("None", "n", 2)]
    late = J.late_records(spark, p["out"])
    assert sorted(r.body.x for r in late.collect()) == ["late", "timeless"]
    repeats = {r.k: r.repeats for r in J.repeated_records(spark, p["out"], "k").collect()}
    assert repeats == {1: 2, None: 1, 3: 2, 6: 41}
    assert len(kept) + late.count() + sum(repeats.values()) == sum(map(len, batches))


def test_a_replayed_micro_batch_of_records_changes_nothing(spark):
    p = J.paths(spark, "dedup-replay")
    rows = spark.createDataFrame([(i % 4, f"2026-01-01T00:00:{i:02d}") for i in range(20)], "k long, at string")
    rows.write.parquet(p["src"])
    run = lambda ckpt: J.stream_dedup_records(spark, p["src"], rows.schema, p["out"], ckpt, "k", "at")
    first = sorted(map(tuple, run(p["ckpt"]).collect()))
    # a lost commit of the stream: the same micro-batch comes again
    assert sorted(map(tuple, run(p["ckpt"] + "-again").collect())) == first == sorted((i, f"2026-01-01T00:00:0{i}") for i in range(4))
