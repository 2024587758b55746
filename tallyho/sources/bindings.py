"""Bind the workload's entities to the test tables.

The test data holds no company or reply tables, so each entity is a
deterministic view over the given tables.  These views only produce rows in
the schema a job expects (with the edge values the original data shows:
blank text, missing ids, odd date formats, malformed replies ...); none of
them does a job's work.  The same definitions are written as DuckDB CTEs in
``tallyho.plans.oracle`` so the oracle reads identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.sources.staging import staged
from tallyho.sources.tables import Tables

NBSP = "\u00a0"


def _pick(values, idx_col) -> F.Column:
    """values[idx] for a 0-based integer column (idx already in range)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (idx_col + 1).cast("int"))


def companies(t: Tables) -> DataFrame:
    """Company profiles from ``documents``: one narrow projection, no join,
    so no query built on it moves the document text through a shuffle.
    The homepage is missing for some ids and lacks a scheme for others."""
    d = t.documents
    k = F.col("doc_id")
    first_line = F.substring_index(F.col("text"), "\n", 1)
    year = (F.lit(1995) + k % 25).cast("string")
    homepage = (F.when(k % 11 == 3, F.lit(None).cast("string"))
                .when(k % 11 == 5, F.concat(F.lit("www.doc"), k.cast("string"),
                                            F.lit(".example.org")))
                .otherwise(F.concat(F.lit("https://doc"), k.cast("string"),
                                    F.lit(".example.com/"))))
    return (d.withColumn("homepage_url", homepage)
            .select(
                k.alias("rcid"),
                F.when(k % 50 == 11, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("org-"),
                                     F.lpad(k.cast("string"), 8, "0")))
                 .alias("org_uuid"),
                F.when(k % 40 == 13, F.lit(""))
                 .otherwise(F.concat(F.lit("Doc "), k.cast("string")))
                 .alias("name"),
                F.when(k % 45 == 7, F.lit("not a url"))
                 .otherwise(F.concat(F.lit("https://directory.example.com/org/"),
                                     k.cast("string"))).alias("cb_url"),
                F.col("homepage_url"),
                F.when(k % 10 == 3, F.lit(None).cast("string"))
                 .when(k % 10 == 7, F.lit("   "))
                 .when(k % 10 == 9, F.concat(F.lit(NBSP), first_line, F.lit(" ")))
                 .otherwise(first_line).alias("short_description"),
                F.when(k % 4 == 1, F.lit(None).cast("string"))
                 .otherwise(F.col("text")).alias("long_description"),
                F.when(k % 35 == 0, F.lit(None).cast("string"))
                 .otherwise(F.col("lang")).alias("category_list"),
                F.when(k % 6 == 0, F.lit(None).cast("string"))
                 .otherwise(F.col("source")).alias("category_groups_list"),
                F.lit(None).cast("string").alias("created_date"),
                F.when(k % 5 == 0, F.concat(F.lit("01nov"), year))
                 .when(k % 5 == 1, F.concat(year, F.lit("-11-01")))
                 .when(k % 5 == 2, F.lit(""))
                 .when(k % 5 == 3, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("founded "), year))
                 .alias("founded_date"),
            ))


def runs_a(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_runs_a``."""
    return staged(t.spark, "runs_a", t.sf_dir, lambda: _runs_a(t))


def _runs_a(t: Tables) -> DataFrame:
    """Classification run A (reply columns as strings) from ``orders``."""
    o = t.orders
    k = F.col("o_orderkey")
    label = (F.when(k % 97 == 0, F.lit(None).cast("string"))
             .when(k % 89 == 0, F.lit("yes"))
             .when(F.col("o_orderstatus") == "F",
                   F.when(k % 5 == 0, F.lit("1.0")).otherwise(F.lit("1")))
             .otherwise(F.lit("0")))
    return o.select(
        k.cast("string").alias("CompanyID"),
        F.concat(F.lit("Order "), k.cast("string")).alias("CompanyName"),
        label.alias("AI_native"),
        F.substring("o_orderpriority", 1, 1).alias("Confidence_1to5"),
        F.concat_ws(" | ",
                    F.concat(F.lit("priority "), F.col("o_orderpriority")),
                    F.concat(F.lit("status "), F.col("o_orderstatus")),
                    F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
                    ).alias("Reasons_3_points"),
        F.lit("id;name;short_description").alias("Sources_used"),
        F.lit("consistent").alias("Verification_critique"),
    )


def runs_b(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_runs_b``."""
    return staged(t.spark, "runs_b", t.sf_dir, lambda: _runs_b(t))


def _runs_b(t: Tables) -> DataFrame:
    """Classification run B from ``lineitem`` aggregated per order."""
    g = (t.lineitem.groupBy("l_orderkey")
         .agg(F.count(F.lit(1)).alias("n"),
              F.count_if(F.col("l_returnflag") == "A").alias("na"),
              F.sum("l_quantity").alias("q")))
    k = F.col("l_orderkey")
    qi = F.floor(F.col("q"))
    return g.select(
        k.cast("string").alias("CompanyID"),
        F.concat(F.lit("Order "), k.cast("string")).alias("CompanyName"),
        F.when(F.col("na") * 2 > F.col("n"), F.lit("1")).otherwise(F.lit("0"))
         .alias("AI_native"),
        (F.lit(1) + F.pmod(qi, F.lit(5))).cast("string").alias("Confidence_1to5"),
        F.concat_ws(" | ",
                    F.concat(F.lit("lines "), F.col("n").cast("string")),
                    F.concat(F.lit("returned "), F.col("na").cast("string")),
                    F.concat(F.lit("quantity "), qi.cast("string"))
                    ).alias("Reasons_3_points"),
        F.lit("id;name;keywords").alias("Sources_used"),
        F.lit("checked").alias("Verification_critique"),
    )


SOURCE_TYPES = ["company_blog", "news_article", "job_posting", "linkedin_post",
                "press_release"]
STAGE_COSTS = [0.02, 0.04, 0.09, 0.5]


_ORD = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]


def _finding(li) -> F.Column:
    """The finding of a line item; ``li(name)`` is a column of its."""
    def pick(values, name):   # a null key takes the last value, as element_at gave in a projection
        return F.when(li(name).isNull(), F.lit(values[-1])).otherwise(_pick(values, F.pmod(li(name), F.lit(len(values)))))

    return F.struct(
        F.concat(F.lit("tool-"), li("l_returnflag")).alias("tool_name"),
        F.concat(F.lit("use-"), li("l_linestatus")).alias("use_case"),
        pick(S.FUNCTION_KEYWORDS, "l_partkey").alias("business_function"),
        F.concat(F.lit("part "), li("l_partkey").cast("string"),
                 F.lit(" supplier "), li("l_suppkey").cast("string"))
         .alias("evidence_summary"),
        F.when(li("l_linenumber") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("https://evidence.example.com/"),
                             li("l_partkey").cast("string")))
         .alias("source_url"),
        pick(SOURCE_TYPES, "l_suppkey").alias("source_type"),
        (F.abs(li("l_discount")) * 10.0
         + F.when(li("l_partkey") % 61 == 5, F.lit(1.0)).otherwise(F.lit(0.0))).alias("confidence"))


def finding_lists(t: Tables) -> DataFrame:
    """Findings of each order in a total order (line numbers repeat).

    Only the line items' own columns are shuffled, dealt out by order before
    they are collected: collecting ahead of the shuffle would sort, and spill,
    every task's rows to join up the few that share an order.  The texts are
    made from the collected columns.
    """
    own = (t.lineitem.where("l_orderkey is not null")
           .select(F.col("l_orderkey").alias("company_id"), *_ORD).repartition("company_id"))
    fs = own.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(*_ORD))).alias("_li"))
    return fs.select("company_id", F.transform("_li", lambda x: _finding(lambda n: x[n])).alias("findings"))


def research_results(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_research_results``."""
    return staged(t.spark, "research_results", t.sf_dir, lambda: _research_results(t))


def _research_results(t: Tables) -> DataFrame:
    """One research result per company (nested, as a reply arrives).

    Built from ``orders`` left-joined to its line items; a result holds the
    findings of one reply, so the array is bounded by one reply's size.
    """
    o = t.orders
    f = finding_lists(t).withColumnRenamed("findings", "fs")
    k = F.col("o_orderkey")
    stage_idx = F.pmod(k, F.lit(4))
    findings = F.coalesce("fs", F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>"))
    result = F.struct(
        (F.col("o_orderstatus") == "F").alias("genai_adoption_found"),
        findings.alias("findings"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit("no_evidence"))
         .when(F.pmod(k, F.lit(3)) == 1, F.lit("insufficient_information"))
         .otherwise(F.lit(None).cast("string")).alias("no_finding_reason"),
        (F.col("o_totalprice") > 250000.0).alias("recommend_escalation"),
        F.when(F.col("o_totalprice") > 250000.0, F.lit("high value"))
         .otherwise(F.lit(None).cast("string")).alias("escalation_reason"),
    )
    return (o.join(f, o.o_orderkey == f.company_id, "left")
            .select(
                k.alias("company_id"),
                F.concat(F.lit("Order "), k.cast("string")).alias("company_name"),
                F.concat(F.lit("https://order"), k.cast("string"),
                         F.lit(".example.com")).alias("homepage_url"),
                F.col("o_orderpriority").alias("industry"),
                F.year("o_orderdate").alias("founded_year"),
                _pick(S.RESEARCH_STAGES, stage_idx).alias("research_stage_reached"),
                F.when(k % 59 == 7, F.lit(140)).otherwise(F.pmod(F.col("o_custkey"), F.lit(101)))
                 .cast("int").alias("online_presence_score"),
                (F.col("o_orderstatus") != "P").alias("website_alive"),
                _pick(STAGE_COSTS, stage_idx).alias("research_cost_usd"),
                F.when(k % 31 == 0, F.lit(None).cast(S.RESEARCH_RESULT_SCHEMA))
                 .otherwise(result).alias("result"),
            ))


def batch_status(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_batch_status``."""
    return staged(t.spark, "batch_status", t.sf_dir, lambda: _batch_status(t))


def _batch_status(t: Tables) -> DataFrame:
    """Batch status snapshots from ``events``: one batch per user, one
    poll per event; progress counts purchases (completed) and errors
    (failed) so far; batches of users with user_id % 5 != 0 never finish.

    The running counts are one skew-safe cumulative sum in (user, time)
    order minus each user's starting offset.  The offsets are a written
    table, so the join with them shuffles both sides and adaptive execution
    may split a user with a third of all events.
    """
    from tallyho.operators.monitor import cumulative_sum
    from tallyho.sources.sinks import scratch_path
    e = t.events.select(
        "user_id", "ts", "event_id", "event_type",
        (F.col("event_type") == "purchase").cast("long").alias("_p"),
        (F.col("event_type") == "error").cast("long").alias("_e"))
    c = cumulative_sum(e, ["user_id", "ts", "event_id"], ["_p", "_e"], ["_cp", "_ce"])
    per_user = c.groupBy("user_id").agg(
        F.min(F.col("_cp") - F.col("_p")).alias("_p0"),
        F.min(F.col("_ce") - F.col("_e")).alias("_e0"),
        (F.sum("_p") + F.sum("_e")).alias("_pe"),
        F.min("ts").alias("created_at"))
    path = scratch_path(t.spark, "per_user")
    per_user.write.parquet(path)
    per_user = t.spark.read.parquet(path)
    u = F.col("user_id")
    x = c.join(per_user, "user_id").select(
        u.cast("int").alias("batch_num"),
        F.when(u % 9 == 4, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("batch_"), u.cast("string"))).alias("batch_id"),
        F.col("event_type"), F.col("ts"),
        (F.col("_cp") - F.col("_p0")).alias("completed"),
        (F.col("_ce") - F.col("_e0")).alias("failed"),
        (F.col("_pe") + u % 5).alias("total"),
        F.col("created_at"))
    done = (F.col("completed") + F.col("failed")) >= F.col("total")
    status = (F.when(done, F.lit("completed"))
              .when(F.col("event_type") == "signup", F.lit("validating"))
              .when(F.col("event_type") == "click", F.lit("finalizing"))
              .otherwise(F.lit("in_progress")))
    return x.select(
        "batch_num", "batch_id", status.alias("status"),
        F.col("total").cast("bigint").alias("total"),
        F.col("completed").cast("bigint").alias("completed"),
        F.col("failed").cast("bigint").alias("failed"),
        "created_at",
        F.when(done, F.col("ts")).alias("completed_at"),
        (F.col("batch_num") % 10 != 3).alias("has_jsonl"),
        (done & (F.col("batch_num") % 7 != 2)).alias("has_results"),
        (done & (F.col("batch_num") % 7 != 2)).alias("has_output"),
        F.col("ts").alias("checked_at"),
    )


def api_calls(t: Tables) -> DataFrame:
    """One API call per event."""
    e = t.events
    et = F.col("event_type")
    return e.select(
        _pick(["search", "small_model", "research"],
              F.pmod(F.col("user_id"), F.lit(3))).alias("service"),
        F.col("user_id").alias("caller_id"),
        F.col("event_id").alias("call_id"),
        F.col("ts"),
        F.when(et == "error", F.lit(503))
         .when((et == "signup") & (F.col("event_id") % 4 == 0), F.lit(429))
         .when((et == "click") & (F.col("event_id") % 9 == 0), F.lit(400))
         .when((et == "click") & (F.col("event_id") % 11 == 0), F.lit(401))
         .otherwise(F.lit(200)).alias("status_code"),
        F.when((et == "view") & (F.col("event_id") % 13 == 0),
               F.lit("ReadTimeout"))
         .when((et == "view") & (F.col("event_id") % 17 == 0),
               F.lit("ConnectError"))
         .otherwise(F.lit(None).cast("string")).alias("error_kind"),
        F.pmod(F.col("event_id"), F.lit(4)).cast("int").alias("attempt"),
    )


def site_checks(t: Tables) -> DataFrame:
    """Website probe results from ``pages``: every third page redirects to
    the next page's URL; status cycles through a fixed list."""
    p = t.pages.select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("prev_id"),
                   F.col("url").alias("next_url"))
    k = F.col("page_id")
    status = _pick([200, 301, 404, 500, 200, 403, None], F.pmod(k, F.lit(7)))
    return (p.join(nxt, p.page_id == nxt.prev_id, "left")
            .select(
                k.alias("rcid"), F.col("url"),
                status.cast("int").alias("status_code"),
                F.when(k % 3 == 0, F.coalesce(F.col("next_url"), F.col("url")))
                 .when(k % 11 == 5, F.lit(None).cast("string"))
                 .otherwise(F.col("url")).alias("final_url"),
                F.when(status.isNull(),
                       F.when(k % 2 == 0, F.lit("ConnectTimeout: timed out"))
                       .otherwise(F.lit("SSL: certificate verify failed")))
                 .alias("error"),
            ))


# ---- replies ---------------------------------------------------------------

def _batch_of(k) -> F.Column:
    """Request file a company was submitted in (250 companies per file)."""
    return (F.floor(k / 250) + 1).cast("int")


def submitted_requests(t: Tables) -> DataFrame:
    """(batch_num, custom_id, rcid) of every submitted request."""
    from tallyho.functions.text import custom_id
    c = companies(t)
    return c.select(_batch_of(F.col("rcid")).alias("batch_num"),
                    custom_id("org_uuid", "rcid").alias("custom_id"), "rcid")


def classification_responses(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_classification_responses``."""
    return staged(t.spark, "classification_responses", t.sf_dir, lambda: _classification_responses(t))


def _classification_responses(t: Tables) -> DataFrame:
    """Batch responses (nested, as downloaded) carrying CSV replies made by
    the rule labeller; some rows are failures: HTTP 500, empty choices,
    missing response, non-CSV text, text before the CSV line, two lines;
    two variants break the reply contract (confidence 6 with two reasons,
    an unknown source); two say that the information is insufficient, one of
    them against the rules of that form."""
    from tallyho.operators.labelers import lexical_ai_native, reply_line
    lab = lexical_ai_native(companies(t))
    k = F.col("rcid")
    m = k % 23
    line = reply_line(lab)
    bad_conf = F.concat_ws(",", F.col("CompanyID"), F.col("CompanyName"), F.lit("1"),
                           F.lit("6"), F.lit('"only | two"'), F.lit('"name"'), F.lit('"ok"'))
    bad_src = F.concat_ws(",", F.col("CompanyID"), F.col("CompanyName"), F.lit("0"),
                          F.lit("3"), F.lit('"a | b | c"'), F.lit('"name;website"'),
                          F.lit('"checked"'))
    ins = F.lit(f'"{S.INSUFFICIENT_INFO}"')
    bad_ins = F.concat_ws(",", F.col("CompanyID"), F.col("CompanyName"), F.lit("1"),
                          F.lit("2"), F.lit('"x | y | z"'), F.lit('"name"'), ins)
    good_ins = F.concat_ws(",", F.col("CompanyID"), F.col("CompanyName"), F.lit("0"),
                           F.lit("1"), F.lit('""'), F.lit('""'), ins)
    content = (F.when(m == 17, F.lit("I cannot classify this company."))
               .when(m == 2, bad_conf)
               .when(m == 11, bad_src)
               .when(m == 1, bad_ins)
               .when(m == 4, good_ins)
               .when(m == 20, F.concat(F.lit("Here is the answer:\n"), line))
               .when(m == 21, F.concat(line, F.lit("\n"), line))
               .otherwise(line))
    choice_t = "array<struct<message:struct<content:string>>>"
    choices = (F.when(m == 5, F.lit(None).cast(choice_t))
               .when(m == 9, F.array().cast(choice_t))
               .otherwise(F.array(F.struct(F.struct(content.alias("content"))
                                           .alias("message")))))
    error = F.when(m == 5, F.struct(F.lit("Internal server error").alias("message")))
    return (lab.where(m != 14)
            .select(_batch_of(k).alias("batch_num"), "custom_id",
                    F.struct(F.when(m == 5, F.lit(500)).otherwise(F.lit(200))
                             .alias("status_code"),
                             F.struct(choices.alias("choices"),
                                      error.alias("error")).alias("body"))
                    .alias("response")))


def adoption_responses(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_adoption_responses``."""
    return staged(t.spark, "adoption_responses", t.sf_dir, lambda: _adoption_responses(t))


def _adoption_responses(t: Tables) -> DataFrame:
    """Batch responses whose content is the three-mode JSON reply; some are
    malformed, wrapped in text, HTTP errors, a null mode object, missing
    the functions key, or carry reasoning as a string; some break the rules
    (strict without moderate; no evidence, but another primary mode)."""
    from tallyho.operators.labelers import lexical_adoption_modes
    lab = lexical_adoption_modes(companies(t))
    k = F.col("rcid")
    m = k % 19
    keep_nulls = {"ignoreNullFields": "false"}
    a = F.col("adoption")
    full = F.to_json(a, keep_nulls)
    null_strict = F.to_json(a.withField("genai_adoption_strict",
                                        F.lit(None).cast("struct<label:string,confidence:string>")),
                            keep_nulls)
    no_funcs = F.to_json(a.dropFields("genai_functions"), keep_nulls)
    reason_str = F.to_json(a.withField("reasoning", F.array_join(a["reasoning"], " ")),
                           keep_nulls)
    def mode(label):
        return F.struct(F.lit(label).alias("label"), F.lit("Low").alias("confidence"))

    not_nested = F.to_json(a.withField("genai_adoption_strict", mode("Yes"))
                           .withField("genai_adoption_moderate", mode("No")), keep_nulls)
    contrary = F.to_json(a.withField("primary_assessment", F.lit("lenient"))
                         .withField("no_evidence_of_genai_use", F.lit(True)), keep_nulls)
    content = (F.when(m == 3, F.lit("Sorry, no JSON today."))
               .when(m == 5, not_nested)
               .when(m == 6, contrary)
               .when(m == 7, F.concat(F.lit("Result: "), full, F.lit(" -- end")))
               .when(m == 13, null_strict)
               .when(m == 17, no_funcs)
               .when(m == 18, reason_str)
               .otherwise(full))
    choice_t = "array<struct<message:struct<content:string>>>"
    return lab.select(
        _batch_of(k).alias("batch_num"), "custom_id", "company_id", "company_name",
        F.struct(F.when(m == 11, F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
                 F.struct(F.when(m == 11, F.lit(None).cast(choice_t))
                          .otherwise(F.array(F.struct(F.struct(content.alias("content"))
                                                      .alias("message"))))
                          .alias("choices"),
                          F.when(m == 11, F.struct(F.lit("Bad gateway").alias("message")))
                          .alias("error")).alias("body")).alias("response"))


def research_replies(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_research_replies``."""
    return staged(t.spark, "research_replies", t.sf_dir, lambda: _research_replies(t))


def _research_replies(t: Tables) -> DataFrame:
    """Research replies as text: the JSON of each result, sometimes wrapped
    in prose, truncated (no closing brace) or with no JSON at all; some have
    confidences as texts, or flags that are no booleans."""
    r = research_results(t)
    k = F.col("company_id")
    js = F.to_json(F.col("result"), {"ignoreNullFields": "false"})
    number = r'"confidence":([-+0-9.E]+)'
    js = (F.when(k % 43 == 1, F.regexp_replace(js, number, r'"confidence":"$1"'))
          .when(k % 47 == 2, F.regexp_replace(js, number, r'"confidence":"high"'))
          .when(k % 53 == 3, F.regexp_replace(F.regexp_replace(
              js, '"genai_adoption_found":true', '"genai_adoption_found":"yes"'),
              '"recommend_escalation":true', '"recommend_escalation":1'))
          .otherwise(js))
    text = (F.when(F.col("result").isNull(), F.lit("No findings."))
            .when(k % 29 == 0, F.lit("I could not find anything useful."))
            .when(k % 37 == 0, F.regexp_replace(js, r"\}$", ""))
            .when(k % 41 == 0, F.concat(F.lit("Here you go: "), js, F.lit(" Thanks!")))
            .otherwise(js))
    return r.select("company_id", "company_name", text.alias("reply"))


# ---- pass logs -------------------------------------------------------------

RUN_START = "2026-01-01 00:00:00"  # start of the logged runs


def _search_results(t: Tables) -> DataFrame:
    """Search hits per company: the turns of conversation ``conv_id = rcid``
    (title, url, content, score), in turn order."""
    c = t.conversations
    hit = F.struct(
        F.concat(F.col("role"), F.lit(" turn "), F.col("turn").cast("string")).alias("title"),
        F.concat(F.lit("https://search.example.com/"), F.col("conv_id").cast("string"),
                 F.lit("/"), F.col("turn").cast("string")).alias("url"),
        F.col("text").alias("content"),
        (F.lit(1.0) / (F.col("turn") + 1)).alias("score"))
    return (c.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", hit.alias("h")))).alias("hs"))
            .select(F.col("conv_id").alias("rcid"),
                    F.transform("hs", lambda x: x["h"]).alias("results")))


def search_log(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_search_log``."""
    return staged(t.spark, "search_log", t.sf_dir, lambda: _search_log(t))


def _search_log(t: Tables) -> DataFrame:
    """Search-pass records (nested, one JSON line each).  Companies with
    rcid % 8 == 7 were not reached yet; rcid % 13 == 4 errored, and half of
    those were retried successfully a day later; rcid % 13 == 5 logged an
    empty error string."""
    from tallyho.functions.text import normalize_url
    co = companies(t).where(F.col("rcid") % 8 != 7)
    sc = site_checks(t).select(F.col("rcid").alias("_pid"), F.struct(
        "url", (F.col("status_code").between(200, 399)).alias("is_alive"),
        "status_code", "final_url", "error").alias("website_check"))
    res = _search_results(t)
    j = co.join(res, "rcid", "left").join(sc, co.rcid == sc._pid, "left")
    k = F.col("rcid")
    results = F.coalesce(F.col("results"),
                         F.array().cast(f"array<{S.SEARCH_RESULT_SCHEMA.simpleString()}>"))
    answer = F.concat(F.lit("Summary of "), F.coalesce(F.col("name"), F.lit("")))
    website = F.coalesce(F.col("website_check"), F.struct(
        normalize_url("homepage_url").alias("url"), F.lit(False).alias("is_alive"),
        F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("final_url"),
        F.lit(S.NO_URL_MESSAGE).alias("error")))

    def record(err, day):
        ok = err.isNull() | (err == "")
        return F.struct(
            k.alias("rcid"), F.col("name"), F.col("short_description"),
            F.col("long_description").alias("description"), F.col("homepage_url"),
            website.alias("website_check"),
            F.struct(F.concat(F.lit(S.SEARCH_QUERY_PREFIX), F.coalesce(F.col("name"), F.lit("")))
                     .alias("query"),
                     F.when(ok & (k % 3 != 0), answer).alias("answer"),
                     F.when(ok, F.size(results)).otherwise(F.lit(0)).alias("result_count"),
                     F.when(ok, F.struct(answer.alias("answer"), results.alias("results")))
                     .alias("raw_response"),
                     err.alias("error")).alias("tavily"),
            F.date_format(F.lit(RUN_START).cast("timestamp_ntz")
                          + F.make_dt_interval(F.lit(day), F.lit(0), F.lit(0), k),
                          "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))

    first_err = (F.when(k % 13 == 4, F.lit("rate limited (429)"))
                 .when(k % 13 == 5, F.lit("")).otherwise(F.lit(None).cast("string")))
    first = j.select(record(first_err, 0).alias("r"))
    retry = j.where(k % 26 == 4).select(record(F.lit(None).cast("string"), 1).alias("r"))
    return first.unionByName(retry).select("r.*")


def priority_log(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_priority_log``."""
    return staged(t.spark, "priority_log", t.sf_dir, lambda: _priority_log(t))


def _priority_log(t: Tables) -> DataFrame:
    """Priority-pass records: presence 1-10 and research priority 0-5 from
    the rule labeller's evidence; rcid % 17 == 3 failed (score 0 with an
    error), rcid % 53 == 2 carries an out-of-range score 7."""
    from tallyho.operators.labelers import _staged_text, occurrences
    st = _staged_text(companies(t)).select(
        "rcid", "name", "_has_long", F.col("homepage_url").isNotNull().alias("_web"),
        occurrences("_text", S.AI_VOCABULARY).alias("_n"),
        F.length(F.coalesce(F.col("long_description"), F.lit(""))).alias("_len"))
    k = F.col("rcid")
    score = F.least(F.lit(5), F.col("_n") + F.col("_has_long").cast("int")
                    + F.col("_web").cast("int"))
    presence = F.least(F.lit(10), F.lit(1) + F.floor(F.log10(F.col("_len") + 1) * 2))
    err = k % 17 == 3
    return st.select(
        "rcid", "name",
        F.when(err, F.lit(0)).otherwise(presence).cast("int").alias("online_presence_score"),
        F.when(err, F.lit(0)).when(k % 53 == 2, F.lit(7)).otherwise(score).cast("int")
        .alias("research_priority_score"),
        F.when(err, F.lit("classification failed"))
         .otherwise(F.concat(F.lit("vocabulary matches: "), F.col("_n").cast("string")))
         .alias("reasoning"),
        F.when(err, F.lit("APIError: upstream unavailable")).alias("error"))


def research_api_responses(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_research_api_responses``."""
    return staged(t.spark, "research_api_responses", t.sf_dir,
                  lambda: _research_api_responses(t))


def _research_api_responses(t: Tables) -> DataFrame:
    """Raw research-API responses as JSON text: ``citations`` mixes plain URL
    strings and {url, title, snippet} objects (one per sourced finding), and
    ``usage`` carries token counts."""
    r = research_results(t)
    fs = F.filter(F.coalesce(F.col("result.findings"),
                             F.array().cast(f"array<{S.FINDING_SCHEMA.simpleString()}>")),
                  lambda f: f["source_url"].isNotNull())
    cites = F.transform(fs, lambda f, i: F.when(
        i % 2 == 0, F.regexp_replace(F.to_json(F.array(f["source_url"])), r"^\[|\]$", ""))
        .otherwise(F.to_json(F.struct(f["source_url"].alias("url"),
                                      f["tool_name"].alias("title"),
                                      f["evidence_summary"].alias("snippet")))))
    n = F.size(fs)
    body = F.concat(F.lit('{"citations":['), F.array_join(cites, ","),
                    F.lit('],"usage":{"prompt_tokens":'), (n * 10 + 100).cast("string"),
                    F.lit(',"completion_tokens":'), (n + 50).cast("string"), F.lit("}}"))
    return r.select("company_id", body.alias("raw"))


ERROR_CODES = ["rate_limit_exceeded", "server_error", "invalid_request", "rate_limit_exceeded",
               None, "token_limit_exceeded"]
EVENTS_PER_BATCH = 500


def batch_errors(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_batch_errors``."""
    return staged(t.spark, "batch_errors", t.sf_dir, lambda: _batch_errors(t))


def _batch_errors(t: Tables) -> DataFrame:
    """A batch's own error list, from the error events of each run of
    ``EVENTS_PER_BATCH`` event ids: some errors have no code, every seventh a
    free-form one; every sixth batch has no list, and some claim no failure."""
    k = F.col("event_id")
    code = F.when(k % 7 == 6, F.concat(F.lit("line_"), k.cast("string"))).otherwise(
        _pick([*ERROR_CODES, None], F.pmod(k, F.lit(7))))
    error = F.struct(k.alias("line"), code.alias("code"), F.concat(F.lit("event "), k.cast("string")).alias("message"))
    b = F.floor(k / EVENTS_PER_BATCH).cast("int")
    per = t.events.groupBy(b.alias("batch_num")).agg(
        F.count_if(F.col("event_type") == "error").alias("_failed"),
        F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", error))).alias("_data"))
    return per.select(
        "batch_num", F.when(F.col("batch_num") % 10 == 7, F.lit(0)).otherwise(F.col("_failed")).cast("bigint").alias("failed"),
        F.when(F.col("batch_num") % 6 != 5, F.struct(F.col("_data").alias("data"))).alias("errors"))


def typed_finding_replies(t: Tables) -> DataFrame:
    """Staged once per session as parquet; built by ``_typed_finding_replies``."""
    return staged(t.spark, "typed_finding_replies", t.sf_dir, lambda: _typed_finding_replies(t))


def _typed_finding_replies(t: Tables) -> DataFrame:
    """Replies with typed findings as JSON text: some of unknown or absent type,
    some companies with negative types only, confidences beyond 1 or as texts,
    absent descriptions, and replies without JSON."""
    r = research_results(t)
    k = F.col("company_id")
    kinds = [*S.FINDING_TYPES, "gut_feeling", S.NEGATIVE_FINDING_TYPES[0].upper(), None, S.FINDING_TYPES[0]]

    def finding(f, i):
        kind = F.when(k % 5 == 2, _pick(S.NEGATIVE_FINDING_TYPES, i % 2)).otherwise(
            _pick(kinds, F.pmod(k * 7 + i * 5, F.lit(len(kinds)))))
        score = F.to_json(F.struct(F.round(f["confidence"], 2).alias("x")))
        number = F.regexp_extract(score, "[0-9.]+", 0)
        number = F.when(F.pmod(k + i, F.lit(9)) == 4, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
        rest = F.to_json(F.struct(kind.alias("finding_type"),
                                  F.when(F.pmod(k + i, F.lit(13)) != 6, f["evidence_summary"]).alias("description"),
                                  f["source_url"].alias("source_url"), f["tool_name"].alias("source_title")))
        return F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(',"confidence_score":'), number, F.lit("}"))

    body = F.concat(F.lit('{"findings":['), F.array_join(F.transform("result.findings", finding), ","), F.lit("]}"))
    return r.select("company_id", F.when(F.col("result").isNull() | (k % 29 == 0), F.lit("Nothing to report."))
                    .when(k % 17 == 3, F.concat(F.lit("Findings: "), body)).otherwise(body).alias("reply"))
