"""The latest value of each key of a stream, kept as a log of sorted-out runs.

Each micro-batch adds a run (the rows it emitted, with its number).  When
``FANOUT`` runs of one level have come together they are merged into one of
the next level, which holds the latest row of each key, so the number of runs
grows with the logarithm of the number of micro-batches and reading costs
about as much as there are keys.  A snapshot, written last, names the runs
that count; runs and snapshots that neither the newest nor the one before
names are removed.

    out/runs/<level>-<first>-<last>/    rows with ``_batch``
    out/snapshots/<batch>               one line of JSON, moved into place

A micro-batch that is replayed because its writer died before the snapshot
overwrites its run; one that the newest snapshot includes changes nothing.  A
log belongs to one streaming query with one checkpoint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho.sources.commits import get_text, names, put_text, remove

FANOUT = 16


def snapshot(spark: SparkSession, out: str) -> dict:
    """The newest snapshot: ``batch`` (-1 before the first), ``runs`` and ``note``."""
    taken = [n for n in names(spark, f"{out}/snapshots") if not n.startswith(".")]
    return json.loads(get_text(spark, f"{out}/snapshots/{taken[-1]}")) if taken else {"batch": -1, "runs": [], "note": None}


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]))


def append(batch: DataFrame, batch_id: int, out: str, keys: list[str], note: object = None,
           keep: Column | None = None) -> bool:
    """Add what a micro-batch emitted (at most one row a key); tells if it was new.

    ``note`` (any JSON value) is kept in the snapshot.  Merges leave out rows for which
    ``keep`` does not hold."""
    spark = batch.sparkSession
    before = snapshot(spark, out)
    if batch_id <= before["batch"]:
        return False
    run = f"0-{batch_id:012d}-{batch_id:012d}"
    rows = batch.withColumn("_batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").parquet(f"{out}/runs/{run}")
    runs, level = [*before["runs"], run], 0
    while len(full := [r for r in runs if r.startswith(f"{level}-")]) >= FANOUT:
        merged = f"{level + 1}-{full[0].split('-')[1]}-{full[-1].split('-')[2]}"
        latest = _latest(spark.read.schema(rows.schema).parquet(*[f"{out}/runs/{r}" for r in full]), keys)
        (latest if keep is None else latest.where(keep)).write.mode("overwrite").parquet(f"{out}/runs/{merged}")
        runs, level = [*[r for r in runs if r not in full], merged], level + 1
    _publish(spark, out, {"batch": batch_id, "runs": runs, "note": note})
    _sweep(spark, out, {*runs, *before["runs"]}, {f"{batch_id:012d}", f"{before['batch']:012d}"})
    return True


def _publish(spark: SparkSession, out: str, state: dict) -> None:
    put_text(spark, f"{out}/snapshots/{state['batch']:012d}", json.dumps(state))


def _sweep(spark: SparkSession, out: str, runs: set[str], snapshots: set[str]) -> None:
    for folder, kept in (("runs", runs), ("snapshots", snapshots)):
        for name in names(spark, f"{out}/{folder}"):
            if name not in kept:
                remove(spark, f"{out}/{folder}/{name}")


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame | None:
    """The latest row of each key, without ``_batch``; None before the first micro-batch."""
    runs = snapshot(spark, out)["runs"]
    if not runs:
        return None
    return _latest(spark.read.parquet(*[f"{out}/runs/{r}" for r in runs]), keys).drop("_batch")
