"""Reading the base parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; floating NaN becomes NULL at the scan.

    Spark treats NaN = NaN as true, which would turn two unknown values into
    an agreement; the original workload's pandas code treats them as
    unequal, so NaN must not survive the scan.  The projection is a plain
    Project over the scan, so column pruning and filter pushdown still reach
    the parquet reader.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    cols = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
                        .alias(f.name))
            changed = True
        else:
            cols.append(F.col(f.name))
    return df.select(*cols) if changed else df


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
