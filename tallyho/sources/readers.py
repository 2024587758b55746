"""Sources: company CSV, tolerant JSON lines, batch outputs, run versions,
row slices and seeded samples.  Every reader declares its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import schemas as S
from tallyho.operators.profiles import normalize_blanks

CORRUPT = "_corrupt_record"


def scan_companies_csv(spark: SparkSession, path: str,
                       schema: T.StructType = S.COMPANY_CSV_SCHEMA) -> DataFrame:
    """Company CSV (quoted commas, doubled quotes and newlines inside
    fields); empty / whitespace-only values become NULL (S1)."""
    df = (spark.read.schema(schema).option("header", True)
          .option("multiLine", True).option("escape", '"').csv(path))
    return normalize_blanks(df)


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType
                        ) -> tuple[DataFrame, DataFrame]:
    """JSON lines: (parsed good rows, malformed lines) (S3).

    Blank lines are skipped; a line is malformed when it does not parse as
    JSON (``try_parse_json``), and is returned as text so it can be counted
    - never silently lost.  Each output is a filtered text scan; nothing is
    cached.
    """
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "")
    ok = F.try_parse_json(F.col("value")).isNotNull()
    good = lines.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*")
    bad = lines.where(~ok).select(F.col("value").alias(CORRUPT))
    return good, bad


def merge_batch_outputs(spark: SparkSession, path: str,
                        columns: list[str] = S.REPLY_COLUMNS) -> DataFrame:
    """All per-batch output CSVs under ``path`` in one scan, in the fixed
    column order, with the file each row came from (S5).

    Missing columns in older files come back as NULL; the merge order of
    files carries no meaning.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("recursiveFileLookup", False).csv(path))
    return df.select(*columns, F.col("_metadata.file_path").alias("source_file"))


def scan_latest_version(df: DataFrame, key_cols: list[str], version_col: str
                        ) -> DataFrame:
    """Rows of the newest version only (S6): keep the rows whose version
    equals the maximum (one aggregate joined back, no collect)."""
    latest = df.agg(F.max(version_col).alias("_v"))
    return df.join(F.broadcast(latest), F.col(version_col) == F.col("_v"), "left_semi")


_WRITE_ID = r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def scan_latest_file(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the most recently finished file set(s) under ``path`` only (S6,
    file form).  A set is the files of one Spark write (the id in their
    names), else those of one folder whose names differ in the part number
    only; its time is that of its last file.  One scan with ``_metadata``,
    one row a set, and a semi join on the newest."""
    file = F.col("_metadata.file_path")
    write = F.regexp_extract(file, rf"part-[0-9]+-({_WRITE_ID})[^/]*$", 1)
    df = spark.read.schema(schema).parquet(path).select(
        "*", F.col("_metadata.file_modification_time").alias("_mtime"),
        F.when(write != "", write).otherwise(F.regexp_replace(file, r"part-[0-9]+([^/]*)$", "part$1")).alias("_set"))
    sets = df.groupBy("_set").agg(F.max("_mtime").alias("_mtime"))
    newest = sets.join(F.broadcast(sets.agg(F.max("_mtime").alias("_mtime"))), "_mtime", "left_semi")
    return df.join(F.broadcast(newest.select("_set")), "_set", "left_semi").drop("_mtime", "_set")


_P31 = 2147483647  # 2^31 - 1


def seeded_hash(key, seed: int) -> F.Column:
    """A seeded integer mix of an integral key, exact in 64-bit arithmetic
    (every product stays below 2^62): two MINSTD steps, each followed by a
    squaring, modulo 2^31 - 1.  Portable, so any SQL engine can repeat it."""
    k = F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(_P31))
    h = F.pmod(k * 48271 + seed, F.lit(_P31))
    h = F.pmod(h * h, F.lit(_P31))
    h = F.pmod(h * 48271 + seed, F.lit(_P31))
    return F.pmod(h * h, F.lit(_P31))


def sample_n_seeded(df: DataFrame, key_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, reproducible for a seed (S8): the ``n`` smallest
    seeded hashes of the key (ties by key) - a TakeOrdered, no full sort.
    Integral keys use ``seeded_hash``; other keys ``xxhash64``."""
    integral = isinstance(df.schema[key_col].dataType,
                          (T.LongType, T.IntegerType, T.ShortType))
    h = seeded_hash(key_col, seed) if integral else F.xxhash64(F.col(key_col), F.lit(seed))
    return df.withColumn("_h", h).orderBy("_h", key_col).limit(n).drop("_h")


def latest_per_key(df: DataFrame, key_cols: list[str], order_col: str) -> DataFrame:
    """Keep the last row per key (dict-overwrite semantics) (W7) with a
    partial ``max_by`` aggregate (skew-safe, no window)."""
    cols = [c for c in df.columns if c not in key_cols]
    return (df.groupBy(*key_cols).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
            .select(*key_cols, *[F.col(f"_r.{c}").alias(c) for c in cols]))
