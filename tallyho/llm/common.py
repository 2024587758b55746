"""Small helpers that the llm operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho.session import checkpoint_dir
from tallyho.sources.tables import table_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the given tables."""
    return spark.read.parquet(table_path(sf_dir, name))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written table cuts the lineage: an executor lost later costs only
    the tasks that read from it, and expensive columns are computed once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(docs: DataFrame, fields: dict[str, pa.DataType], start: Callable[[], Callable]) -> DataFrame:
    """``doc_id`` and ``fields`` for each row of ``docs``.

    ``start`` is called once in a task and gives a function from a list of
    texts (None for null) to one list a field.  Ids pass as they are, so null
    ids take nothing from the precision of others.
    """
    def task(batches):
        work = start()
        for b in batches:
            made = work(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x, t) for x, t in zip(made, fields.values())]],
                ["doc_id", *fields])

    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string",
             pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    schema = ", ".join(["doc_id long", *[f"{k} {names[t]}" for k, t in fields.items()]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def worker_cache(key: str, build: Callable[[], Any]) -> Any:
    """An object kept for the life of a Python worker process.

    Task code is shipped by value, so its own globals are new in every task;
    a registered module is not.
    """
    home = sys.modules.setdefault("tallyho_worker_cache",
                                  types.ModuleType("tallyho_worker_cache"))
    if not hasattr(home, key):
        setattr(home, key, build())
    return getattr(home, key)


def labelled_sample(labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, chosen by hash order.

    Repeated labels of one id are merged by their maximum; null ids and null
    labels are left out.  The bound makes the sample safe to broadcast.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    parts = [one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
             for y in (0, 1)]
    return parts[0].unionByName(parts[1])
