"""Packing requests into batches: global row index, even plan, greedy plan.

A global position in id order is computed without an un-partitioned
window: rows are range-partitioned on the order key and sorted inside each
partition, the ranged frame is checkpointed (reliable, in the shared
checkpoint folder) so partition contents are fixed, every row gets its
in-partition ordinal from ``monotonically_increasing_id`` (partition id in
the high bits), the per-partition counts - one row per partition - are
prefix-summed, and the offsets are broadcast back (their size is the
partition count, not the data size).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import schemas as S
from tallyho.session import checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _n_parts(df: DataFrame, n_parts: int | None) -> int:
    if n_parts:
        return n_parts
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ranged_checkpoint(df: DataFrame, order_cols: list[str],
                      n_parts: int | None = None) -> DataFrame:
    """Range-partition + sort within partitions, then a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return (df.repartitionByRange(_n_parts(df, n_parts), *order_cols)
            .sortWithinPartitions(*order_cols)
            .checkpoint(eager=True))


def with_global_index(df: DataFrame, order_cols: list[str], index_col: str = "idx",
                      total_col: str | None = "n_total",
                      n_parts: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (+ row total)."""
    ranged = ranged_checkpoint(df, order_cols, n_parts)
    x = ranged.withColumn("_mid", F.monotonically_increasing_id())
    x = x.select("*", F.shiftright("_mid", 33).alias("_pid"),
                 F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)).alias("_local"))
    counts = x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_tot"))
    out = x.join(F.broadcast(offsets), "_pid")
    cols = [c for c in df.columns] + [(F.col("_off") + F.col("_local")).alias(index_col)]
    if total_col:
        cols.append(F.col("_tot").alias(total_col))
    return out.select(*cols)


def even_plan_cap(token_cap: int = S.EVEN_PLAN_TOKEN_CAP,
                  tokens_per_request: int = S.EVEN_PLAN_TOKENS_PER_REQUEST,
                  max_file_mb: float = S.EVEN_PLAN_MAX_FILE_MB,
                  kb_per_request: float = S.EVEN_PLAN_KB_PER_REQUEST,
                  max_requests: int = S.MAX_REQUESTS_PER_BATCH) -> int:
    """Most restrictive of the token, file-size and request-count limits."""
    by_tokens = token_cap // tokens_per_request
    by_size = int(max_file_mb / (kb_per_request / 1024))
    return min(by_tokens, by_size, max_requests)


def plan_even_batches(df: DataFrame, order_cols: list[str], cap: int | None = None,
                      n_parts: int | None = None) -> DataFrame:
    """n = ceil(N / cap) batches of N // n rows; the last takes the rest.

    Adds ``batch_num`` (1-based) next to the input columns.
    """
    cap = cap or even_plan_cap()
    x = with_global_index(df, order_cols, "_idx", "_N", n_parts)
    n_batches = F.greatest(F.ceil(F.col("_N") / F.lit(cap)), F.lit(1))
    size = F.greatest(F.floor(F.col("_N") / n_batches), F.lit(1))
    batch = F.least(F.floor(F.col("_idx") / size) + 1, n_batches)
    return x.select(*df.columns, batch.cast("int").alias("batch_num"))


def chunk_fixed(df: DataFrame, order_cols: list[str], size: int,
                n_parts: int | None = None) -> DataFrame:
    """Fixed-size chunks in order; the last one may be short."""
    x = with_global_index(df, order_cols, "_idx", None, n_parts)
    return x.select(*df.columns, (F.floor(F.col("_idx") / size) + 1).cast("int")
                    .alias("chunk"))


def slice_rows(df: DataFrame, order_cols: list[str], start: int, limit: int,
               n_parts: int | None = None) -> DataFrame:
    """Rows [start, start+limit) in order, selected in parallel."""
    x = with_global_index(df, order_cols, "_idx", None, n_parts)
    return x.where((F.col("_idx") >= start) & (F.col("_idx") < start + limit)) \
        .select(*df.columns)


# ---- greedy packing ----------------------------------------------------------

def _next_start(sizes: np.ndarray, max_count: int, max_bytes: int) -> np.ndarray:
    """For each row the first row after the batch that starts with it."""
    total = np.cumsum(sizes)
    i = np.arange(len(sizes))
    full = np.searchsorted(total, total - sizes + max_bytes, side="right")
    return np.minimum(np.maximum(full, i + 1), i + max_count)


def _block_map(block: int, sizes: np.ndarray, rows: int, max_count: int, max_bytes: int
               ) -> pd.DataFrame:
    """For a first start at each of the offsets below ``max_count``: the offset
    of the first start in the following block, and the batches begun here.
    ``sizes`` holds the ``rows`` of the block and then the next ``max_count``."""
    jump = np.append(_next_start(sizes, max_count, max_bytes)[:rows], rows)
    begun = np.append(np.ones(rows, np.int64), 0)
    out = np.maximum(jump - rows, 0)         # where the chain lands once it has left
    inside = np.minimum(jump, rows)
    while (inside < rows).any():
        out = np.where(inside < rows, out[inside], out)
        begun = begun + begun[inside]
        inside = inside[inside]
    entry = np.arange(max_count)
    here = np.minimum(entry, rows)
    return pd.DataFrame({"_block": [block], "_exit": [out[here].astype("int32")],
                         "_n": [begun[here].astype("int64")]})


def _block_entries(maps: DataFrame, n_blocks: int) -> DataFrame:
    """``_block, _entry, _off``: offset of the first start in each block and the
    batches begun before it, by composing the maps of neighbours in a tree."""
    levels = [maps]
    while n_blocks > 1:
        half = F.shiftright("_block", 1).alias("_block")
        left = levels[-1].where("_block % 2 = 0").select(half, "_exit", "_n")
        right = levels[-1].where("_block % 2 = 1").select(
            half, F.col("_exit").alias("_exit2"), F.col("_n").alias("_n2"))
        alone = F.col("_exit2").isNull()
        both = left.join(right, "_block", "left").select(
            "_block",
            F.when(alone, F.col("_exit")).otherwise(
                F.transform("_exit", lambda x: F.get("_exit2", x))).alias("_exit"),
            F.when(alone, F.col("_n")).otherwise(
                F.zip_with("_exit", "_n", lambda x, n: n + F.get("_n2", x))).alias("_n"))
        levels.append(both.checkpoint(eager=True))
        n_blocks = (n_blocks + 1) // 2
    entries = levels.pop().select("_block", F.lit(0).alias("_entry"), F.lit(0).cast("long").alias("_off"))
    for level in reversed(levels):
        left = level.where("_block % 2 = 0").select(
            F.shiftright("_block", 1).alias("_up"), "_exit", "_n")
        at = F.col("_entry")
        pair = F.array(
            F.struct((F.col("_up") * 2).alias("_block"), at.alias("_entry"), F.col("_off").alias("_off")),
            F.struct((F.col("_up") * 2 + 1).alias("_block"), F.get("_exit", at).alias("_entry"),
                     (F.col("_off") + F.get("_n", at)).alias("_off")))
        entries = (entries.withColumnRenamed("_block", "_up").join(left, "_up")
                   .select(F.inline(pair)).checkpoint(eager=True))
    return entries


def plan_greedy_batches(requests: DataFrame, order_col: str, bytes_col: str,
                        max_count: int = S.GREEDY_MAX_REQUESTS,
                        max_bytes: int = S.GREEDY_MAX_FILE_MB * 1024 * 1024,
                        block_rows: int | None = None,
                        n_parts: int | None = None) -> DataFrame:
    """Greedy count/byte packing, equal to the sequential rule at any size.

    Rows are cut into consecutive blocks of ``block_rows`` (at least
    ``max_count``, which bounds how far a batch reaches into the next block).
    1. A block, with the rows that follow it, becomes a map from where its
       first batch starts to where the next block's first batch starts.
    2. Neighbouring maps are composed pairwise, in as many steps as the number
       of blocks has binary digits; going back down gives each block its entry.
    3. Each block numbers its rows from its entry, one hop a batch.
    ``block_rows`` bounds every Python group and has no influence on the
    result.  Returns (order key, bytes, batch_num, oversize); join back to
    the requests by the key when more columns are needed.
    """
    block_rows = max(block_rows or max(8 * max_count, 200_000), max_count)
    slim = requests.select(order_col, F.col(bytes_col).cast("long").alias(bytes_col))
    x = with_global_index(slim, [order_col], "_idx", None, n_parts) \
        .withColumn("_block", F.floor(F.col("_idx") / block_rows)).checkpoint(eager=True)

    def to_map(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        rows = int((pdf["_idx"] // block_rows == key[0]).sum())
        return _block_map(key[0], pdf[bytes_col].to_numpy(np.int64), rows, max_count, max_bytes)

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        sizes = pdf[bytes_col].to_numpy(np.int64)
        after = _next_start(sizes, max_count, max_bytes)
        begins = np.zeros(len(pdf), np.int64)
        at = int(pdf["_entry"].iloc[0])
        while at < len(pdf):
            begins[at] = 1
            at = int(after[at])
        return pd.DataFrame({order_col: pdf[order_col].values, bytes_col: sizes,
                             "batch_num": (pdf["_off"].to_numpy() + begins.cumsum()).astype("int32"),
                             "oversize": sizes > max_bytes})

    halo = (F.col("_block") > 0) & (F.col("_idx") % block_rows < max_count)
    around = x.select("_idx", bytes_col, F.explode(
        F.when(halo, F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block")))
        .alias("_block"))
    maps = around.groupBy("_block").applyInPandas(
        to_map, "_block long, _exit array<int>, _n array<long>").checkpoint(eager=True)
    entries = _block_entries(maps, maps.count())
    schema = T.StructType([T.StructField(order_col, slim.schema[order_col].dataType),
                           T.StructField(bytes_col, T.LongType()),
                           T.StructField("batch_num", T.IntegerType()),
                           T.StructField("oversize", T.BooleanType())])
    return x.join(entries, "_block").groupBy("_block").applyInPandas(number, schema)


def token_budget(rows: DataFrame, designs: list[tuple[str, int]],
                 daily_limit: int) -> DataFrame:
    """Total tokens per input design, saving against the first, and % of
    the daily enqueued-token limit (requests x tokens per request)."""
    n = rows.agg(F.count(F.lit(1)).alias("requests"))
    base = designs[0][1]
    parts = ", ".join(f"'{name}', CAST({tpr} AS BIGINT)" for name, tpr in designs)
    return n.select("requests", F.expr(f"stack({len(designs)}, {parts}) as (design, tokens_per_request)")) \
        .select("design", "requests", "tokens_per_request",
                (F.col("requests") * F.col("tokens_per_request")).alias("total_tokens"),
                (F.col("requests") * (F.lit(base) - F.col("tokens_per_request")))
                .alias("tokens_saved"),
                F.round(F.col("requests") * F.col("tokens_per_request") * 100.0
                        / F.lit(daily_limit), 6).alias("pct_of_daily_limit"))

