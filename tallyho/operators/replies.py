"""Ingesting model replies: batch responses -> typed rows + failure kinds.

Nothing is dropped silently: every response ends up either as a parsed row
or as a row with a ``failure_kind`` (http_error / empty_choices /
bad_reply), and submitted requests with no response are 'missing'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X
from tallyho.functions.csv_reply import parse_csv_reply


def scan_batch_responses(resp: DataFrame) -> DataFrame:
    """Nested response -> (custom_id, status_code, content, error_message)."""
    r = F.col("response")
    choices = r["body"]["choices"]
    keep = [c for c in resp.columns if c not in ("response",)]
    return resp.select(
        *keep,
        r["status_code"].alias("status_code"),
        F.coalesce(F.size(choices), F.lit(0)).cast("int").alias("n_choices"),
        F.get(choices, 0)["message"]["content"].alias("content"),
        r["body"]["error"]["message"].alias("error_message"))


def transport_failure(status, n_choices) -> F.Column:
    """http_error / empty_choices / NULL (transport ok)."""
    return (F.when(F.coalesce(X.col_(status) != 200, F.lit(True)), F.lit("http_error"))
            .when(X.col_(n_choices) == 0, F.lit("empty_choices")))


def ingest_classification_replies(resp: DataFrame) -> DataFrame:
    """Flat responses + the seven CSV fields + ``failure_kind``."""
    flat = scan_batch_responses(resp)
    parsed = parse_csv_reply(flat, "content")
    kind = F.coalesce(transport_failure("status_code", "n_choices"),
                      F.when(~F.col("csv_ok"), F.lit("bad_reply")))
    return parsed.withColumn("failure_kind", kind)


# ---- JSON replies ----------------------------------------------------------

def extract_json_span(text) -> F.Column:
    """Text from the first '{' to the last '}' (NULL when there is none)."""
    span = F.regexp_extract(F.coalesce(X.col_(text), F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(span != "", span)


def json_parse_error(text) -> F.Column:
    """NULL when the span parses; otherwise the reason."""
    span = extract_json_span(text)
    return (F.when(span.isNull(), F.lit(S.NO_JSON_MESSAGE))
            .when(F.try_parse_json(span).isNull(), F.lit("Invalid JSON")))


def truthy(value, path: str) -> F.Column:
    """Whether the JSON value at ``path`` of a variant counts as true: numbers
    other than 0, and texts, lists and objects that hold anything, do; an absent
    value or NULL does not."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    yes = (F.when(kind == "BOOLEAN", text == "true")
           .when(kind == "STRING", text != "")
           .when(kind.startswith("ARRAY"), text != "[]")
           .when(kind.startswith("OBJECT"), text != "{}")
           .otherwise(text.try_cast("double") != 0))
    return F.coalesce(yes, F.lit(False))


_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _confidence(item) -> F.Column:
    """A finding's confidence: numbers and texts that read as one; 0 if absent or
    NULL; NULL if it is neither."""
    kind = F.schema_of_variant(F.try_variant_get(item, "$.confidence", "variant"))
    text = F.try_variant_get(item, "$.confidence", "string")
    return (F.when(kind.isNull() | (kind == "VOID"), F.lit(0.0))
            .when(kind == "BOOLEAN", (text == "true").cast("double"))
            .when(text.rlike(_NUMBER), F.trim(text).try_cast("double")))


def parse_research_result(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """Reply text -> typed research result with defaults; malformed replies
    keep a row with ``parse_error`` set (never dropped).

    Flags count by truthiness and a confidence may be a text.  A confidence that
    is no number, findings that are no list, and a finding that is no object
    make the reply a 'Parse error' with the defaults.
    """
    keep = [c for c in replies.columns if c != text_col]
    st = replies.withColumn("_span", extract_json_span(text_col)) \
        .withColumn("_v", F.try_parse_json("_span")) \
        .withColumn("_kind", F.schema_of_variant(F.try_variant_get("_v", "$.findings", "variant"))) \
        .withColumn("_items", F.try_variant_get("_v", "$.findings", "array<variant>"))
    names = [f.name for f in S.FINDING_SCHEMA.fields if f.name != "confidence"]
    st = st.withColumn("_findings", F.transform("_items", lambda x: F.struct(
        *[F.try_variant_get(x, f"$.{n}", "string").alias(n) for n in names],
        _confidence(x).alias("confidence"))))
    no_list = (F.col("_kind").isNotNull() & ~F.col("_kind").startswith("ARRAY") & (F.col("_kind") != "VOID")
               & truthy("_v", "$.findings"))
    bad = (F.exists("_findings", lambda f: f["confidence"].isNull())
           | F.exists("_items", lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))))
    # zeros and false are no list either, however they count
    no_list = no_list | F.col("_kind").rlike("^(BIGINT|BOOLEAN|DECIMAL|DOUBLE|FLOAT)")
    st = st.withColumn("_err", F.when(F.col("_span").isNull(), F.lit(S.NO_JSON_MESSAGE))
                       .when(F.col("_v").isNull(), F.lit("Invalid JSON"))
                       .when(no_list | bad, F.lit("Parse error")))
    ok = F.col("_err").isNull()
    empty = F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>")
    text = {n: F.when(ok, F.try_variant_get("_v", f"$.{n}", "string")).alias(n)
            for n in ("no_finding_reason", "escalation_reason")}
    return st.select(
        *keep, F.col("_err").alias("parse_error"),
        (ok & truthy("_v", "$.genai_adoption_found")).alias("genai_adoption_found"),
        F.when(ok, F.coalesce("_findings", empty)).otherwise(empty).alias("findings"),
        text["no_finding_reason"],
        (ok & truthy("_v", "$.recommend_escalation")).alias("recommend_escalation"),
        text["escalation_reason"])


ADOPTION_FLAT_COLUMNS = [
    "company_id", "company_name",
    "genai_strict_label", "genai_strict_confidence",
    "genai_moderate_label", "genai_moderate_confidence",
    "genai_lenient_label", "genai_lenient_confidence",
    "primary_assessment", "no_evidence_flag",
    "genai_functions_list", "genai_functions_details", "reasoning",
]


def join_function_lists(funcs) -> tuple[F.Column, F.Column]:
    """'; '-joined keywords and ' | '-joined 'kw: description' (P18)."""
    f = F.coalesce(X.col_(funcs),
                   F.array().cast("array<struct<function_keyword:string,"
                                  "short_description:string,confidence:string>>"))
    kws = F.array_join(F.transform(f, lambda x: F.coalesce(x["function_keyword"],
                                                           F.lit(""))), "; ")
    det = F.array_join(F.transform(f, lambda x: F.concat(
        F.coalesce(x["function_keyword"], F.lit("None")), F.lit(": "),
        F.coalesce(x["short_description"], F.lit("None")))), " | ")
    return kws, det


def flatten_adoption_reply(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Three-mode JSON reply -> the 13 flat columns (+ parse_error).

    Defaults: label 'No', confidence 'Low', primary 'strict', no_evidence 0
    (1 for any value that counts as true);
    an explicit NULL mode object gets the same defaults; reasoning given as
    a string instead of a list is kept as that string.
    """
    keep = list(df.columns)
    st = df.withColumn("_span", extract_json_span(content_col))
    st = st.withColumn("_v", F.try_parse_json("_span")) \
        .withColumn("_p", F.from_json("_span", S.ADOPTION_REPLY_SCHEMA))
    p = F.col("_p")
    cols = []
    for m in S.ADOPTION_MODES:
        mode = p[f"genai_adoption_{m}"]
        cols += [F.coalesce(mode["label"], F.lit("No")).alias(f"genai_{m}_label"),
                 F.coalesce(mode["confidence"], F.lit("Low"))
                 .alias(f"genai_{m}_confidence")]
    kws, det = join_function_lists(p["genai_functions"])
    reasoning = F.coalesce(F.array_join(p["reasoning"], " "),
                           F.get_json_object("_span", "$.reasoning"), F.lit(""))
    err = (F.when(F.col("_span").isNull(), F.lit(S.NO_JSON_MESSAGE))
           .when(F.col("_v").isNull(), F.lit("Invalid JSON")))
    return st.select(
        *keep, err.alias("parse_error"), *cols,
        F.coalesce(p["primary_assessment"], F.lit("strict")).alias("primary_assessment"),
        truthy("_v", "$.no_evidence_of_genai_use").cast("int").alias("no_evidence_flag"),
        kws.alias("genai_functions_list"), det.alias("genai_functions_details"),
        reasoning.alias("reasoning"))


def ingest_adoption_replies(resp: DataFrame) -> DataFrame:
    flat = scan_batch_responses(resp)
    out = flatten_adoption_reply(flat, "content")
    kind = F.coalesce(transport_failure("status_code", "n_choices"),
                      F.when(F.col("parse_error").isNotNull(), F.lit("bad_reply")))
    return out.withColumn("failure_kind", kind)


def adoption_table(resp: DataFrame) -> DataFrame:
    """Successful adoption rows in the fixed 13-column order."""
    return ingest_adoption_replies(resp).where(F.col("failure_kind").isNull()) \
        .select(*ADOPTION_FLAT_COLUMNS)


# ---- roll-ups over the flat adoption table -----------------------------------

def modes_to_rows(flat: DataFrame) -> DataFrame:
    """3 modes wide -> long (company_id, mode, label, confidence)."""
    parts = ", ".join(f"'{m}', genai_{m}_label, genai_{m}_confidence"
                      for m in S.ADOPTION_MODES)
    return flat.select("company_id", F.expr(
        f"stack({len(S.ADOPTION_MODES)}, {parts}) as (mode, label, confidence)"))


def adoption_by_mode(flat: DataFrame) -> DataFrame:
    """Yes-count and % per mode, and the no-evidence count, in one pass."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(f"genai_{m}_label") == "Yes").alias(m)
             for m in S.ADOPTION_MODES]
    aggs.append(F.count_if(F.col("no_evidence_flag") == 1).alias("no_evidence"))
    one = flat.agg(*aggs)
    names = S.ADOPTION_MODES + ["no_evidence"]
    parts = ", ".join(f"'{n}', {n}" for n in names)
    return one.select("total", F.expr(f"stack({len(names)}, {parts}) as (mode, n)")) \
        .select("mode", "n", F.round(X.safe_pct("n", "total"), 6).alias("pct"))


def confidence_by_mode(flat: DataFrame) -> DataFrame:
    """Low/Medium/High counts and % among Yes rows, per mode, zero-filled."""
    long = modes_to_rows(flat).where(F.col("label") == "Yes")
    piv = long.groupBy("mode").pivot("confidence", S.ADOPTION_CONFIDENCES).count()
    modes = flat.sparkSession.createDataFrame([(m,) for m in S.ADOPTION_MODES],
                                              "mode string")
    out = F.broadcast(modes).join(piv, "mode", "left")
    cnt = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in S.ADOPTION_CONFIDENCES}
    yes = sum(cnt.values(), F.lit(0))
    return out.select("mode", *[v.alias(k.lower()) for k, v in cnt.items()],
                      yes.alias("yes_total"),
                      *[F.round(X.safe_pct(v, yes), 6).alias(f"pct_{k.lower()}")
                        for k, v in cnt.items()])


def explode_function_list(flat: DataFrame) -> DataFrame:
    """'; ' list -> one row per non-blank keyword (null lists skipped)."""
    parts = F.transform(F.split(F.col("genai_functions_list"), ";"),
                        lambda x: X.strip_ws(x))
    return flat.where(F.col("genai_functions_list").isNotNull()) \
        .select("company_id", F.explode(F.filter(parts, lambda x: x != ""))
                .alias("function"))


def top_functions(flat: DataFrame, k: int = 10) -> DataFrame:
    """Top-k business functions by count (ties: keyword ascending)."""
    return (explode_function_list(flat).groupBy("function")
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("function")).limit(k))


def sample_adopters(flat: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` strict adopters by id, 3 columns; empty list -> 'N/A'."""
    return (flat.where(F.col("genai_strict_label") == "Yes")
            .orderBy("company_id").limit(n)
            .select("company_id", "company_name",
                    F.when(X.is_blank("genai_functions_list"), F.lit(S.NA))
                    .otherwise(F.col("genai_functions_list"))
                    .alias("genai_functions_list")))


# ---- failures -------------------------------------------------------------------

def with_missing(ingested: DataFrame, submitted: DataFrame,
                 keys=("batch_num", "custom_id")) -> DataFrame:
    """Add a 'missing' row for every submitted request with no response."""
    missing = submitted.select(*keys).join(ingested.select(*keys), list(keys),
                                           "left_anti")
    return ingested.unionByName(missing.withColumn("failure_kind", F.lit("missing")),
                                allowMissingColumns=True)


def failure_taxonomy(ingested: DataFrame) -> DataFrame:
    """Mutually exclusive outcome counts, largest first."""
    return (ingested.select(F.coalesce("failure_kind", F.lit("ok")).alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "outcome"))


def top_error_codes(ingested: DataFrame) -> DataFrame:
    """HTTP status codes of non-200 responses by count, descending."""
    return (ingested.where(F.col("status_code") != 200)
            .groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "status_code"))


def failure_log(ingested: DataFrame) -> DataFrame:
    """Failed items with id, kind, error text and the whole reply."""
    return ingested.where(F.col("failure_kind").isNotNull()).select(
        "batch_num", "custom_id", "failure_kind", "status_code",
        F.coalesce("error_message", F.col("failure_kind")).alias("error"),
        "content")


def drop_unidentified(parsed: DataFrame) -> DataFrame:
    """Replies whose CompanyID is empty are dropped."""
    return parsed.where(F.col("CompanyID") != "")
