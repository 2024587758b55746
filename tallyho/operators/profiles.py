"""Company-profile operators: validation, filters, lookups, coverage, and
request construction (one request per row, all Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import schemas as S
from tallyho.functions import text as X


def normalize_blanks(df: DataFrame) -> DataFrame:
    """Every string column: NULL / blank -> NULL (the 'empty -> null' scan)."""
    return df.select(*[X.blank_to_null(f.name).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def _url_ok(c) -> F.Column:
    return F.coalesce(F.col(c).rlike(r"^https?://[^\s/?#]+"), F.lit(False))


def with_violations(df: DataFrame) -> DataFrame:
    """Add ``errors array<string>`` (typed validation of a company row)."""
    rcid_num = F.col("rcid").cast("string").try_cast("bigint")
    checks = [
        (F.col("rcid").isNull(), "rcid: missing"),
        (F.col("rcid").isNotNull() & rcid_num.isNull(), "rcid: not an integer"),
        (X.is_blank("org_uuid"), "org_uuid: missing"),
        (~_url_ok("cb_url"), "cb_url: not a URL"),
    ]
    errs = F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]),
                    lambda e: e.isNotNull())
    return df.withColumn("errors", errs)


def scan_validated(df: DataFrame) -> DataFrame:
    """Rows passing validation, typed; an empty name becomes 'Unknown'."""
    v = with_violations(df)
    return (v.where(F.size("errors") == 0)
            .select(F.col("rcid").cast("string").try_cast("bigint").alias("rcid"),
                    X.strip_ws("org_uuid").alias("org_uuid"),
                    F.when(X.is_blank("name"), F.lit(S.UNKNOWN_NAME))
                     .otherwise(X.strip_ws("name")).alias("name"),
                    "cb_url", "homepage_url", "short_description",
                    "long_description",
                    X.parse_categories("category_list").alias("categories"),
                    "founded_date"))


def scan_quarantine(df: DataFrame) -> DataFrame:
    """Rows failing validation: (rcid, name, error) - never silently dropped."""
    v = with_violations(df)
    return (v.where(F.size("errors") > 0)
            .select(F.col("rcid").cast("string").alias("rcid"), "name",
                    F.array_join("errors", "; ").alias("error")))


def filter_both_descriptions(df: DataFrame) -> DataFrame:
    return df.where(~X.is_blank("short_description")
                    & ~X.is_blank("long_description"))


def search_by_name(df: DataFrame, pattern: str, exact: bool = False,
                   literal: bool = False) -> DataFrame:
    """Exact match, or case-insensitive regex *contains*; NULL never matches.

    ``literal=True`` quotes the pattern so metacharacters are plain text.
    """
    if exact:
        return df.where(F.col("name") == F.lit(pattern))
    pat = pattern
    if literal:
        pat = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch
                      for ch in pattern)
    return df.where(F.col("name").rlike("(?i)" + pat))


def lookup_by_key(df: DataFrame, key_col: str, key) -> DataFrame:
    """One row with the key; when the key repeats, the smallest row in
    column order (the filter is pushed to the scan; only matching rows are
    ordered, as a TakeOrdered of one)."""
    orderable = [f.name for f in df.schema.fields
                 if not isinstance(f.dataType, T.MapType)]
    return df.where(F.col(key_col) == F.lit(key)).orderBy(*orderable).limit(1)


def description_coverage(df: DataFrame) -> DataFrame:
    has_s = ~X.is_blank("short_description")
    has_l = ~X.is_blank("long_description")
    s = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(has_s).alias("has_short"),
               F.count_if(has_l).alias("has_long"),
               F.count_if(has_s & has_l).alias("has_both"))
    return s.select("*", F.round(X.safe_pct("has_both", "total"), 6)
                    .alias("pct_retained"))


def profile_message(df: DataFrame, fields=X.PROFILE_FIELDS) -> F.Column:
    return X.build_profile_message("org_uuid", "name", "short_description",
                                   "long_description", "category_list",
                                   "category_groups_list", "founded_date",
                                   fields=fields)


def build_requests(df: DataFrame, system_prompt: str, model: str,
                   fields=X.PROFILE_FIELDS, json_mode: bool = False,
                   adoption: bool = False) -> DataFrame:
    """One serialised request per company: (rcid, custom_id, request, bytes)."""
    msg = (X.build_adoption_message("name", "short_description",
                                    "long_description", "category_list")
           if adoption else profile_message(df, fields))
    cid = X.custom_id("org_uuid", "rcid")
    req = F.to_json(X.build_batch_request(cid, F.lit(system_prompt), msg, model,
                                          json_mode=json_mode))
    return (df.select("rcid", cid.alias("custom_id"), req.alias("request"))
            .withColumn("request_bytes", X.request_bytes("request")))
