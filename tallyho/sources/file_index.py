"""A table that knows which of its files may hold a key.

Appends go through the commit log of ``commits``; each also writes a Bloom
filter of the keys of each of its files to a small index table:

    root/index/words=<W>/commit=<c>/   file, word, bits

A filter has W words of 64 bits (a power of two, at least 16 bits for each row
of the append's average file); a key sets four bits of one word.  To find the
files that may hold some keys, each key makes one probe for every W in use and
the probes are joined to the index on (W, word).  The join shuffles index rows
(one for about four keys) and never the table; a file that holds a key is
never missed, others are read with a chance of about one in a hundred a key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyho.sources import commits as C

BITS_PER_KEY = 16
_SET = 4   # bits that a key sets in its word


def _word(key: str, words: int | Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(words) - 1)


def _mask(key: str) -> Column:
    picks, one = F.xxhash64(key, F.lit(1)), F.lit(1).cast("long")
    out = F.lit(0).cast("long")
    for i in range(_SET):
        place = F.shiftrightunsigned(picks, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", one, place))
    return out


def append_indexed(df: DataFrame, root: str, key: str, commit: str | None = None) -> None:
    """Append rows once under ``commit`` (a new name if none is given), with their index."""
    spark = df.sparkSession
    commit = commit or uuid.uuid4().hex
    if C.committed(spark, root, commit):
        return
    counted = Observation()
    path = C.write_files(df.observe(counted, F.count(F.lit(1)).alias("n")), root, commit)
    keys = spark.read.schema(df.schema).parquet(path).select(F.col(key).alias("_k"), F.col("_metadata.file_name").alias("file"))
    rows, files = counted.get["n"], sum(n.startswith("part-") for n in C.names(spark, path))
    if rows:
        words = 1 << max(0, (rows * BITS_PER_KEY // (64 * files) - 1).bit_length())
        (keys.groupBy("file", _word("_k", words).alias("word")).agg(F.bit_or(_mask("_k")).alias("bits"))
         .write.mode("overwrite").parquet(f"{root}/index/words={words}/commit={commit}"))
    C.publish(spark, root, commit)


def files_holding(keys: DataFrame, root: str, key: str) -> list[str]:
    """Paths of the committed files that may hold one of ``keys``.

    The driver gets file names, of which Spark's file listing holds more."""
    spark = keys.sparkSession
    done = set(C.commits(spark, root))
    found: list[str] = []
    sizes = {int(n.split("=")[1]): f"{root}/index/{n}" for n in C.names(spark, f"{root}/index")}
    parts = {w: [n for n in C.names(spark, path) if n.split("=")[1] in done] for w, path in sizes.items()}
    paths = [f"{sizes[w]}/{n}" for w, of in parts.items() for n in of]
    if not paths:
        return found
    index = (spark.read.schema("file string, word long, bits long, words int, commit string")
             .option("basePath", f"{root}/index").parquet(*paths))
    probes = (keys.select(F.col(key).alias("_k")).distinct()
              .withColumn("words", F.explode(F.array(*[F.lit(w) for w in sorted(sizes)])))
              .select("words", _word("_k", F.col("words")).alias("word"), _mask("_k").alias("mask")))
    hits = (index.join(probes, ["words", "word"])
            .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("commit", "file").distinct())
    return [f"{root}/data/{r['commit']}/{r['file']}" for r in hits.collect()]


def without_known(rows: DataFrame, root: str, key: str) -> DataFrame:
    """One row for each key of ``rows`` that no committed row has."""
    files = files_holding(rows, root, key)
    new = rows.dropDuplicates([key])
    if not files:
        return new
    known = rows.sparkSession.read.schema(rows.select(key).schema).parquet(*files)
    return new.alias("n").join(known.alias("k"), F.col(f"n.{key}").eqNullSafe(F.col(f"k.{key}")), "left_anti")
