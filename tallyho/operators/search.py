"""Search-pass records: rebuild, flatten, explode, evidence prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X

TOP_RESULTS = 5


def rebuild_search_struct(raw: DataFrame, json_col: str) -> DataFrame:
    """Raw JSON lines -> the typed record; ``answer`` falls back to the raw
    response's answer, missing counts default to the array size / 0."""
    p = raw.select(F.from_json(json_col, S.SEARCH_PASS_SCHEMA).alias("r")).select("r.*")
    tv = F.col("tavily")
    results = F.coalesce(tv["raw_response"]["results"],
                         F.array().cast(f"array<{S.SEARCH_RESULT_SCHEMA.simpleString()}>"))
    return p.withColumn("tavily", F.struct(
        tv["query"].alias("query"),
        F.coalesce(tv["answer"], tv["raw_response"]["answer"]).alias("answer"),
        F.coalesce(tv["result_count"], F.size(results)).alias("result_count"),
        results.alias("results"),
        tv["error"].alias("error")))


def flatten_top_results(log: DataFrame, n: int = TOP_RESULTS) -> DataFrame:
    """Up to ``n`` nested results -> 3*n wide columns (missing -> '')."""
    res = F.col("tavily.raw_response.results")
    cols = []
    for i in range(n):
        r = F.get(res, i)
        for f in ("title", "url", "content"):
            cols.append(F.coalesce(r[f], F.lit("")).alias(f"result_{i + 1}_{f}"))
    answer = F.coalesce(F.col("tavily.answer"), F.col("tavily.raw_response.answer"),
                        F.lit(""))
    return log.select("rcid", "name", answer.alias("answer"),
                      F.coalesce(F.size(res), F.lit(0)).alias("result_count"), *cols)


def explode_snippets(log: DataFrame) -> DataFrame:
    """One row per search hit with its 1-based rank (narrow posexplode)."""
    return log.select("rcid", F.posexplode(F.col("tavily.raw_response.results"))
                      .alias("pos", "hit")) \
        .select("rcid", (F.col("pos") + 1).alias("rank"),
                F.col("hit.title").alias("title"), F.col("hit.url").alias("url"),
                F.col("hit.score").alias("score"))


def build_evidence_prompt(log: DataFrame) -> DataFrame:
    """Profile section + website line + optional summary + numbered snippets.

    Branches: the search errored / returned nothing / returned hits.
    """
    tv = F.col("tavily")
    res = F.coalesce(tv["raw_response"]["results"],
                     F.array().cast(f"array<{S.SEARCH_RESULT_SCHEMA.simpleString()}>"))
    profile = F.concat_ws("\n",
                          F.concat(F.lit("Company: "), X.null_to_na("name")),
                          F.concat(F.lit("Description: "), X.blank_to_na("short_description")),
                          F.concat(F.lit("About: "), X.blank_to_na("description")),
                          F.concat(F.lit("Homepage: "), X.blank_to_na("homepage_url")))
    wc = F.col("website_check")
    website = F.concat(F.lit("Website: "),
                       F.when(wc["is_alive"], F.concat(F.lit("reachable (status "), F.coalesce(
                           wc["status_code"].cast("string"), F.lit("unknown")), F.lit(")")))
                       .otherwise(F.concat(F.lit("unreachable ("),
                                           F.coalesce(wc["error"], F.lit("no response")),
                                           F.lit(")"))))
    answer = F.coalesce(tv["answer"], tv["raw_response"]["answer"])
    summary = F.when(answer.isNotNull() & (answer != ""),
                     F.concat(F.lit("Search summary: "), answer))
    snippets = F.array_join(F.transform(res, lambda r, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.coalesce(r["title"], F.lit("")),
        F.lit("\n"), F.coalesce(r["url"], F.lit("")), F.lit("\n"),
        F.coalesce(r["content"], F.lit("")))), "\n\n")
    evidence = (F.when(F.coalesce(tv["error"], F.lit("")) != "",
                       F.concat(F.lit("Search failed: "), tv["error"]))
                .when(F.size(res) == 0, F.lit("No search results found."))
                .otherwise(F.concat(F.lit("Search results ("), F.size(res).cast("string"),
                                    F.lit(" found):\n"), snippets)))
    return log.select("rcid", "timestamp", F.concat_ws("\n\n", profile, website, summary,
                                                      evidence).alias("prompt"))


def build_pass_record(companies: DataFrame, checks: DataFrame, hits: DataFrame,
                      run_ts: str) -> DataFrame:
    """Compose the nested search-pass record of each company from its
    profile, its website check and its search hits (two joins)."""
    j = companies.join(checks, "rcid", "left").join(hits, "rcid", "left")
    results = F.coalesce(F.col("results"),
                         F.array().cast(f"array<{S.SEARCH_RESULT_SCHEMA.simpleString()}>"))
    return j.select(
        "rcid", "name", "short_description",
        F.col("long_description").alias("description"), "homepage_url",
        F.struct(X.normalize_url("homepage_url").alias("url"),
                 F.coalesce(F.col("is_alive"), F.lit(False)).alias("is_alive"),
                 F.col("status_code"), F.col("final_url"),
                 F.when(F.col("homepage_url").isNull(), F.lit(S.NO_URL_MESSAGE))
                 .otherwise(F.col("error")).alias("error")).alias("website_check"),
        F.struct(X.build_search_query("name").alias("query"),
                 F.lit(None).cast("string").alias("answer"),
                 F.size(results).alias("result_count"),
                 F.struct(F.lit(None).cast("string").alias("answer"),
                          results.alias("results")).alias("raw_response"),
                 F.lit(None).cast("string").alias("error")).alias("tavily"),
        F.lit(run_ts).alias("timestamp"))
