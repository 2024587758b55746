"""Website-check and API-call classification over probe / call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X


def error_category(err) -> F.Column:
    """Network error text -> the small fixed set of categories."""
    e = X.col_(err)
    return (F.when(e.isNull(), F.lit(None).cast("string"))
            .when(e.contains("Timeout") | e.contains("timed out"), F.lit("Timeout"))
            .when(e.contains("Name or service not known")
                  | e.contains("getaddrinfo failed"), F.lit("DNS lookup failed"))
            .when(e.contains("Connection refused"), F.lit("Connection refused"))
            .when(e.startswith("Connect"), F.lit("Connection failed"))
            .when(F.lower(e).contains("redirect"), F.lit("Too many redirects"))
            .otherwise(e))


def classify_liveness(checks: DataFrame) -> DataFrame:
    """alive iff 200 <= status < 400; error text -> category; URL checks."""
    url = X.normalize_url("url")
    return checks.select(
        "rcid",
        F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce((F.col("status_code") >= 200) & (F.col("status_code") < 400),
                   F.lit(False)).alias("is_alive"),
        "status_code",
        F.when(url.isNull(), F.lit(S.NO_URL_MESSAGE))
         .otherwise(error_category("error")).alias("error"),
        X.detect_redirect(url, "final_url").alias("is_redirect"),
    )


RETRYABLE_ERROR_KINDS = ["ReadTimeout", "ConnectTimeout", "ConnectError",
                         "RemoteProtocolError"]


def retryable(status, error_kind) -> F.Column:
    s, k = X.col_(status), X.col_(error_kind)
    return F.coalesce(s.isin(S.RETRYABLE_STATUS_CODES), F.lit(False)) | \
        F.coalesce(k.isin(RETRYABLE_ERROR_KINDS), F.lit(False))


def classify_retryable(calls: DataFrame) -> DataFrame:
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 300) & \
        F.col("error_kind").isNull()
    return calls.select(
        "call_id", "service", "status_code", "error_kind",
        ok.alias("ok"),
        (~ok & retryable("status_code", "error_kind")).alias("retryable"))


def backoff_schedule(calls: DataFrame, base: float = S.RETRY_BASE_DELAY_SEC,
                     max_retries: int = S.RETRY_MAX_ATTEMPTS) -> DataFrame:
    """Each retryable failure -> its retries with delay base * 2^attempt."""
    c = classify_retryable(calls).where("retryable")
    return c.select("call_id", "service",
                    F.explode(F.sequence(F.lit(0), F.lit(max_retries - 1)))
                    .alias("retry")) \
        .withColumn("delay_sec", F.lit(base) * F.pow(F.lit(2.0), F.col("retry")))
