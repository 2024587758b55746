"""Exactly-once appends: a folder an append, and a commit log that names them.

An append writes its files to a folder of its own and then its name to the
commit log.  Readers take the folders that the log names and nothing else, so
files of a writer that died before it committed are never seen; the writer run
again under the same name overwrites them.  An append whose name is in the log
already does nothing, so a retried job leaves one copy.

    root/data/<commit>/part-*     the files
    root/commits/<commit>         the log: an empty file an append, moved into place
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    fs, place = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, with what is in it."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def put_text(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file that is there whole or not at all: written beside its place, then moved.

    One that was there before is replaced."""
    fs, place = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, True)
    fs.rename(beside, place)


def get_text(spark: SparkSession, path: str) -> str:
    """What ``put_text`` wrote."""
    fs, place = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def committed(spark: SparkSession, root: str, commit: str) -> bool:
    return exists(spark, f"{root}/commits/{commit}")


def commits(spark: SparkSession, root: str) -> list[str]:
    return [c for c in names(spark, f"{root}/commits") if not c.startswith(".")]


def write_files(df: DataFrame, root: str, commit: str, fmt: str = "parquet") -> str:
    """The first half of an append: files that no reader sees yet."""
    path = f"{root}/data/{commit}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def publish(spark: SparkSession, root: str, commit: str) -> None:
    """The second half: the commit's entry in the log."""
    put_text(spark, f"{root}/commits/{commit}")


def append_once(df: DataFrame, root: str, commit: str, fmt: str = "parquet") -> bool:
    """Append ``df`` under ``root`` unless ``commit`` was appended before; tells if it did."""
    spark = df.sparkSession
    if committed(spark, root, commit):
        return False
    write_files(df, root, commit, fmt)
    publish(spark, root, commit)
    return True


def read_committed(spark: SparkSession, root: str, schema: T.StructType | str, fmt: str = "parquet",
                   only: list[str] | None = None) -> DataFrame:
    """Rows of all committed appends (or of ``only`` those)."""
    done = commits(spark, root) if only is None else only
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load([f"{root}/data/{c}" for c in done])
