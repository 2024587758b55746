"""Sinks: JSON lines, per-batch request files, fixed-order CSV, metrics.

All writers are distributed DataFrame writes (one file set per task); no
data passes through the driver.  ``scratch_path`` places intermediate
output under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho.session import checkpoint_dir
from tallyho.sources.commits import append_once, read_committed


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/out-{name}-{uuid.uuid4().hex[:12]}"


def sink_jsonl_append(df: DataFrame, path: str, commit: str | None = None) -> bool:
    """Append records, one JSON object per line, exactly once.

    ``commit`` names the append (a job's own id); one that was appended before,
    or whose writer died before it was entered in the log, leaves one copy.
    Without a name each call appends.  Read back with ``read_jsonl_log``."""
    return append_once(df, path, commit or uuid.uuid4().hex, "json")


def read_jsonl_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of all appends that were entered in the log."""
    return read_committed(spark, path, schema, "json")


def sink_request_jsonl(requests: DataFrame, path: str,
                       batch_col: str = "batch_num",
                       request_col: str = "request") -> None:
    """One request-file set per batch id (S10): ``path/batch_num=N/part-*``.

    Rows are clustered by batch first so each batch is written by few tasks.
    """
    (requests.select(batch_col, F.col(request_col).alias("value"))
     .repartition(batch_col)
     .write.mode("overwrite").partitionBy(batch_col).text(path))


ROWS_PER_CSV = 100_000   # rows of a file; records may span lines, so one task reads a whole file


def sink_fixed_csv(df: DataFrame, columns: list[str], path: str, rows_per_file: int = ROWS_PER_CSV) -> None:
    """CSV with a header and the declared column order (S11), in files of at
    most ``rows_per_file`` rows."""
    (df.select(*columns).write.mode("overwrite")
     .option("maxRecordsPerFile", rows_per_file)
     .option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_fixed_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a fixed-order CSV back; with ``schema`` no type is inferred."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def roundtrip_fixed_csv(spark: SparkSession, df: DataFrame, columns: list[str],
                        name: str) -> DataFrame:
    """Write ``df`` as fixed-order CSV and read it back with its own schema."""
    path = scratch_path(spark, name)
    sink_fixed_csv(df, columns, path)
    return read_fixed_csv(spark, path, df.select(*columns).schema)


def sink_metrics_json(metrics: DataFrame, path: str) -> None:
    """A one-row metrics document."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def failure_log_sink(failures: DataFrame, path: str) -> None:
    """Failed items written beside the results."""
    failures.write.mode("overwrite").json(path)
