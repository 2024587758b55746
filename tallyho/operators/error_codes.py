"""Error codes of batches: the breakdown of each batch's own error list, and
the most frequent codes of all batches.

Codes are free text, so their number has no bound.  ``exact_top`` never counts
all of them: it adds up rows by hash bucket first (a table of at most
``buckets`` numbers), counts the values of the fullest buckets to learn how
often the k-th value occurs at least, and then counts only values whose bucket
holds that many rows.  A value never occurs more often than its bucket holds
rows, so none of the first k is lost, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_CODE = "unknown"
BUCKETS = 65_536


def explode_error_codes(batches: DataFrame) -> DataFrame:
    """One row (batch_num, code) per error in a batch's list.

    Batches that report no failed request, and batches without a list, have no
    rows; an error without a code has the code 'unknown'.
    """
    failed = F.coalesce(F.col("failed") != 0, F.lit(True))
    return (batches.where(failed)
            .select("batch_num", F.explode("errors.data").alias("_e"))
            .select("batch_num", F.coalesce(F.col("_e")["code"], F.lit(UNKNOWN_CODE)).alias("code")))


def batch_error_codes(batches: DataFrame) -> DataFrame:
    """Codes of each batch by count, descending (ties: code ascending)."""
    counts = explode_error_codes(batches).groupBy("batch_num", "code").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("batch_num").orderBy(F.desc("n"), "code")
    return counts.select("batch_num", F.row_number().over(w).alias("rank"), "code", "n")


def exact_top(df: DataFrame, key: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The ``k`` most frequent values of ``key`` with their counts, exactly
    (ties: smaller value; NULL counts as a value)."""
    rows = df.select(F.col(key), F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"))
    totals = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))

    def counted(chosen: DataFrame) -> DataFrame:
        # at most ``buckets`` numbers
        own = rows.join(F.broadcast(chosen.select("_bucket")), "_bucket", "left_semi")
        return own.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    fullest = totals.orderBy(F.desc("_rows"), "_bucket").limit(k)
    first = counted(fullest).orderBy(F.desc("n")).limit(k)
    least = first.agg(F.when(F.count(F.lit(1)) == k, F.min("n")).otherwise(F.lit(0)))
    return counted(totals.where(F.col("_rows") >= least.scalar())).orderBy(F.desc("n"), key).limit(k)


def top_batch_error_codes(batches: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent error codes over all batches' lists."""
    return exact_top(explode_error_codes(batches), "code", k)
