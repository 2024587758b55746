"""Reconciling work: what is done, what failed, what to retry, lookups.

Set logic is expressed as semi / anti joins on per-id aggregates, so a
retried id (error first, success later) counts once - success wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X


def record_ok(err_col: str = "tavily.error") -> F.Column:
    """A record is usable when its error is NULL or '' (truthiness)."""
    return F.coalesce(F.col(err_col), F.lit("")) == ""


def filter_usable_records(log: DataFrame, err_col: str = "tavily.error") -> DataFrame:
    return log.where(record_ok(err_col))


def id_status(log: DataFrame, key: str = "rcid",
              err_col: str = "tavily.error") -> DataFrame:
    """Per id: any success, any error (partial aggregation, skew-safe)."""
    ok = record_ok(err_col)
    return log.groupBy(key).agg(F.bool_or(ok).alias("any_ok"),
                                F.bool_or(~ok).alias("any_error"))


def pass_status(log: DataFrame, universe: DataFrame, key: str = "rcid",
                err_col: str = "tavily.error") -> DataFrame:
    """Distinct ids ok / errored (never succeeded) / remaining."""
    st = id_status(log, key, err_col)
    done = st.agg(F.count_if("any_ok").alias("n_ok"),
                  F.count_if(~F.col("any_ok") & F.col("any_error")).alias("n_error"),
                  F.count(F.lit(1)).alias("n_logged"))
    remaining = universe.select(key).distinct().join(st.select(key), key, "left_anti") \
        .agg(F.count(F.lit(1)).alias("n_remaining"))
    # two one-row aggregates combined into one row
    return done.unionByName(remaining, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ["n_ok", "n_error", "n_logged", "n_remaining"]])


def pending_work(universe: DataFrame, log: DataFrame, key: str = "rcid",
                 retry_errors: bool = False, err_col: str = "tavily.error") -> DataFrame:
    """Rows still to process.  Normal resume skips ids with any record;
    ``retry_errors`` skips only ids that already succeeded."""
    st = id_status(log, key, err_col)
    done = st.where("any_ok") if retry_errors else st
    return universe.join(done.select(key), key, "left_anti")


def latest_record_per_id(log: DataFrame, key: str, order_col: str) -> DataFrame:
    """Keep the last record per key (dict-overwrite semantics).

    ``max_by`` aggregates partially before the shuffle, so a key with many
    records never lands whole in one task.
    """
    cols = [c for c in log.columns if c != key]
    return (log.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


SENTINEL_KEYS = (S.NA,)


def _unmatchable(key_col: str, sentinels) -> F.Column:
    """Keys that can never find a partner: NULL or a placeholder value.
    Such rows are routed around a join instead of all hashing to one
    partition (a 'N/A' id can be a large share of the rows)."""
    c = F.col(key_col)
    return c.isNull() | c.isin(list(sentinels)) if sentinels else c.isNull()


def attach_source(results: DataFrame, source: DataFrame, result_key: str,
                  source_key: str, drop: list[str] | None = None,
                  sentinels=SENTINEL_KEYS) -> DataFrame:
    """Results left-join their source rows; duplicate columns dropped.
    Results whose key is NULL or a sentinel skip the join (NULL source
    columns), so they never form a hot partition."""
    src = source.drop(*(drop or []))
    miss = _unmatchable(result_key, sentinels)
    joined = results.where(~miss).join(src, F.col(result_key) == src[source_key], "left")
    bypass = results.where(miss).select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in src.schema.fields
               if f.name not in results.columns])
    return joined.unionByName(bypass)


def enrich_lookup(df: DataFrame, lookup: DataFrame, key: str, seq_col: str,
                  attrs: dict[str, str], sentinels=SENTINEL_KEYS) -> DataFrame:
    """Key -> attributes with the last duplicate winning (by ``seq_col``);
    a missing key gets each attribute's default.  ``attrs`` maps attribute
    -> default.  The lookup is reduced to one row per key first; rows whose
    key is NULL or a sentinel take the defaults without entering the join."""
    last = lookup.where(~_unmatchable(key, sentinels)).groupBy(key).agg(
        F.max_by(F.struct(*attrs.keys()), F.col(seq_col)).alias("_a"))
    miss = _unmatchable(key, sentinels)
    j = df.where(~miss).join(last, key, "left").select(
        *df.columns, *[F.coalesce(F.col(f"_a.{a}"), F.lit(d)).alias(a)
                       for a, d in attrs.items()])
    bypass = df.where(miss).select(*df.columns, *[F.lit(d).alias(a)
                                                  for a, d in attrs.items()])
    return j.unionByName(bypass)


def find_failed_requests(submitted: DataFrame, ingested: DataFrame,
                         keys=("batch_num", "custom_id")) -> DataFrame:
    """submitted - successful (malformed and failed replies included),
    distinct, per batch."""
    ok = ingested.where(F.col("failure_kind").isNull()).select(*keys)
    return submitted.select(*keys).distinct().join(ok, list(keys), "left_anti")


def build_retry_batch(source: DataFrame, failed: DataFrame, system_prompt: str,
                      model: str) -> DataFrame:
    """Source rows of the failed ids -> new JSON-mode adoption requests."""
    src = source.withColumn("custom_id", X.custom_id("org_uuid", "rcid"))
    retry = src.join(failed.select("custom_id").distinct(), "custom_id", "left_semi")
    from tallyho.operators.profiles import build_requests
    return build_requests(retry, system_prompt, model, json_mode=True, adoption=True)


def latest_batch_status(status: DataFrame) -> DataFrame:
    """Latest snapshot per batch (max_by over checked_at)."""
    return latest_record_per_id(status, "batch_num", "checked_at")


def batches_not_uploaded(latest: DataFrame) -> DataFrame:
    """Request files that never got a remote batch id."""
    files = latest.where("has_jsonl").select("batch_num")
    uploaded = latest.where(F.col("batch_id").isNotNull()).select("batch_num")
    return files.join(uploaded, "batch_num", "left_anti")


def results_not_downloaded(latest: DataFrame) -> DataFrame:
    """Completed batches without a results file."""
    done = latest.where(F.col("status") == "completed").select("batch_num", "batch_id")
    got = latest.where("has_results").select("batch_num")
    return done.join(got, "batch_num", "left_anti")

