"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants: AQE re-plans joins and coalesces small shuffle
# partitions at run time, and splits skewed join partitions.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # checkpoint files of frames that nothing refers to any more are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tallyho", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    A default is applied only when the submit configuration does not set
    the key; ``master``, ``shuffle_partitions`` and ``extra`` are explicit
    and always applied (``master`` and ``shuffle_partitions`` are meant for
    local runs).
    """
    from pyspark import SparkConf, SparkContext

    SparkContext._ensure_initialized()  # start the JVM so submitted conf is visible
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    submitted = SparkConf()  # what spark-submit / spark-defaults already set
    conf = {k: v for k, v in _DEFAULT_CONF.items() if not submitted.contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it up if needed.

    On a cluster the folder must be the shared one named by
    ``spark.checkpoint.dir``.  Only a local-mode session with no setting gets
    a private folder (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster job needs a shared "
                "checkpoint folder")
        configured = tempfile.mkdtemp(prefix="tallyho-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
