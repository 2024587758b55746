"""Materialise a derived input once per session as parquet.

Model replies arrive as files; their stand-ins here are derived from the
test tables.  Writing a stand-in once to the shared scratch folder and
scanning it back makes downstream jobs read a real file (with column
pruning and filter pushdown at the scan) instead of re-deriving it, and
cuts the lineage so a lost executor does not recompute the derivation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple, str] = {}


def staged(spark: SparkSession, name: str, key: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    from tallyho.sources.sinks import scratch_path
    k = (spark.sparkContext.applicationId, name, key)
    if k not in _STAGED:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STAGED[k] = path
    return spark.read.parquet(_STAGED[k])
