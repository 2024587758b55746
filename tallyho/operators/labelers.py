"""The model seam and deterministic rule labellers.

``apply_model`` runs a caller-supplied vectorised function over Arrow
batches (``mapInPandas``); failures become an error column, never an
exception.  ``lexical_ai_native`` and ``lexical_adoption_modes`` are
deterministic stand-ins for a hosted model, written as Catalyst
expressions, so their replies can be checked by SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import schemas as S
from tallyho.functions import text as X

# A vocabulary word counts where it stands as a whole token: the characters
# around it are not [A-Za-z0-9_].  The lookarounds do not consume the
# neighbours, so adjacent words are all counted; one regex pass per text
# finds every term of every vocabulary.
_WORD = "[A-Za-z0-9_]"


def word_pattern(words) -> str:
    # the leading one-character lookahead rejects most positions before the
    # lookbehind and the alternation are tried
    first = "".join(sorted({w[0].lower() for w in words}))
    return f"(?i)(?=[{first}])(?<!{_WORD})(" + "|".join(words) + f")(?!{_WORD})"


def term_hits(text, terms) -> F.Column:
    """Lower-cased whole-token matches of ``terms`` in ``text`` (one pass)."""
    return F.transform(F.regexp_extract_all(F.coalesce(X.col_(text), F.lit("")),
                                            F.lit(word_pattern(terms)), 1),
                       lambda x: F.lower(x))


def count_in(hits, words) -> F.Column:
    """Number of hits that are in ``words``."""
    arr = F.array(*[F.lit(w) for w in words])
    return F.size(F.filter(X.col_(hits), lambda x: F.array_contains(arr, x)))


def occurrences(text, words) -> F.Column:
    """Whole-token occurrences of any of ``words`` in ``text``."""
    return F.size(term_hits(text, words))


def csv_field(c) -> F.Column:
    """Quote a CSV field when it holds a comma, quote or line break."""
    c = F.coalesce(X.col_(c), F.lit(""))
    return F.when(c.rlike('[,"\\n\\r]'),
                  F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')),
                           F.lit('"'))).otherwise(c)


def quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(X.col_(c), F.lit("")),
                                          F.lit('"'), F.lit('""')), F.lit('"'))


def _staged_text(companies: DataFrame) -> DataFrame:
    """Blank flags, then the description text, each computed once.

    Separate projections keep every full-text regex to one evaluation per
    row (Catalyst does not re-inline an expensive alias used twice).
    """
    flags = companies.select(
        "*", (~X.is_blank("short_description")).alias("_has_short"),
        (~X.is_blank("long_description")).alias("_has_long"))
    return flags.withColumn(
        "_text", F.concat_ws(" ", F.when(F.col("_has_short"), F.col("short_description")),
                             F.when(F.col("_has_long"), F.col("long_description"))))


def lexical_ai_native(companies: DataFrame, vocabulary=S.AI_VOCABULARY,
                      min_hits: int = 2) -> DataFrame:
    """Rule labeller in the reply form (one CSV line per company).

    Label 1 when the vocabulary occurs at least ``min_hits`` times in the
    descriptions (AI is the core of the product, not a mention); confidence
    grows with the evidence and is capped at 4 without a long description;
    no text and no keywords -> 'Insufficient information' (label 0,
    confidence 1).
    """
    st = _staged_text(companies).select(
        "rcid", "org_uuid", "name", "_has_short", "_has_long",
        X.merge_keywords("category_list", "category_groups_list").alias("_kw"),
        occurrences("_text", vocabulary).alias("_n"))
    n, has_long, has_short = F.col("_n"), F.col("_has_long"), F.col("_has_short")
    keywords = F.col("_kw")
    insufficient = ~has_long & ~has_short & (keywords == S.NA)
    label = F.when(n >= min_hits, F.lit(1)).otherwise(F.lit(0))
    conf = (F.when(n == 0, F.lit(4)).when(n == 1, F.lit(2))
            .when(n <= 3, F.lit(3)).otherwise(F.lit(5)))
    conf = F.when(~has_long, F.least(conf, F.lit(4))).otherwise(conf)
    reasons = F.concat_ws(
        S.REASON_SEPARATOR,
        F.concat(F.lit("vocabulary matches: "), n.cast("string")),
        F.when(has_long, F.lit("long description present"))
         .otherwise(F.lit("no long description")),
        F.concat(F.lit("keywords: "), keywords))
    sources = F.concat_ws(
        S.SOURCE_SEPARATOR,
        F.when(has_short, F.lit("short_description")),
        F.when(has_long, F.lit("long_description")),
        F.when(keywords != S.NA, F.lit("keywords")))
    critique = F.concat(F.lit("Rule label from "), n.cast("string"),
                        F.lit(" vocabulary matches."))
    return st.select(
        "rcid", X.custom_id("org_uuid", "rcid").alias("custom_id"),
        X.null_to_na("org_uuid").alias("CompanyID"),
        X.null_to_na("name").alias("CompanyName"),
        F.when(insufficient, F.lit(0)).otherwise(label).alias("AI_native"),
        F.when(insufficient, F.lit(1)).otherwise(conf).alias("Confidence_1to5"),
        F.when(insufficient, F.lit("")).otherwise(reasons).alias("Reasons_3_points"),
        F.when(insufficient, F.lit("")).otherwise(sources).alias("Sources_used"),
        F.when(insufficient, F.lit(S.INSUFFICIENT_INFO)).otherwise(critique)
         .alias("Verification_critique"))


def reply_line(labels: DataFrame) -> F.Column:
    """The seven fields as one CSV line (text fields always quoted)."""
    return F.concat_ws(",", csv_field("CompanyID"), csv_field("CompanyName"),
                       F.col("AI_native").cast("string"),
                       F.col("Confidence_1to5").cast("string"),
                       quoted("Reasons_3_points"), quoted("Sources_used"),
                       quoted("Verification_critique"))


# Nested vocabularies of the three adoption modes (ours; drawn from frequent
# tokens of the test text): each mode contains the one above it.
ADOPTION_VOCAB = {
    "strict": ["antion"],
    "moderate": ["antion", "erble"],
    "lenient": ["antion", "erble", "ertion"],
}
# business function reported for each lenient term
TERM_FUNCTION = [("antion", "marketing"), ("erble", "customer_support"),
                 ("ertion", "software_development")]


def _conf_level(n) -> F.Column:
    return (F.when(n >= 3, F.lit("High")).when(n == 2, F.lit("Medium"))
            .otherwise(F.lit("Low")))


def lexical_adoption_modes(companies: DataFrame) -> DataFrame:
    """Three-strictness rule labeller: one nested adoption struct per row."""
    terms = sorted({w for ws in ADOPTION_VOCAB.values() for w in ws})
    hits = _staged_text(companies).select(
        "rcid", "org_uuid", "name", term_hits("_text", terms).alias("_hits"))
    st = hits.select(
        "rcid", "org_uuid", "name",
        *[count_in("_hits", w).alias(f"_n_{m}") for m, w in ADOPTION_VOCAB.items()],
        *[count_in("_hits", [t]).alias(f"_h_{t}") for t, _ in TERM_FUNCTION])
    modes = []
    for m in S.ADOPTION_MODES:
        n = F.col(f"_n_{m}")
        modes.append(F.struct(
            F.when(n > 0, F.lit("Yes")).otherwise(F.lit("No")).alias("label"),
            _conf_level(n).alias("confidence")).alias(f"genai_adoption_{m}"))
    term_cols = [(t, fn, F.col(f"_h_{t}")) for t, fn in TERM_FUNCTION]
    funcs = F.filter(F.array(*[
        F.when(h > 0, F.struct(F.lit(fn).alias("function_keyword"),
                               F.lit(f"profile mentions {t}").alias("short_description"),
                               _conf_level(h).alias("confidence")))
        for t, fn, h in term_cols]), lambda x: x.isNotNull())
    matched = F.filter(F.array(*[F.when(h > 0, F.lit(t)) for t, _, h in term_cols]),
                       lambda x: x.isNotNull())
    any_yes = F.col("_n_lenient") > 0
    result = F.struct(
        *modes,
        F.lit("strict").alias("primary_assessment"),
        (~any_yes).alias("no_evidence_of_genai_use"),
        funcs.alias("genai_functions"),
        F.array(F.concat(F.lit("Matched terms: "), F.array_join(matched, ", ")),
                F.concat(F.lit("Strict evidence count: "),
                         F.col("_n_strict").cast("string"))).alias("reasoning"))
    return st.select("rcid", X.custom_id("org_uuid", "rcid").alias("custom_id"),
                     X.null_to_na("org_uuid").alias("company_id"),
                     X.null_to_na("name").alias("company_name"),
                     result.alias("adoption"))


def apply_model(df: DataFrame, text_col: str,
                fn: Callable[[pd.Series], pd.Series] | None = None,
                id_col: str = "custom_id",
                factory: Callable[[], Callable[[pd.Series], pd.Series]] | None = None
                ) -> DataFrame:
    """Run a model (texts -> replies) over Arrow batches of each partition.

    Give either ``fn`` or ``factory``; a factory is called once per task,
    inside the executor, so clients, sessions or loaded model files are set
    up once per partition rather than per row or on the driver.  Returns
    (id, reply, error).  When the model raises on a batch, its halves are tried
    again, down to single rows, so that only rows on which it raises by
    themselves carry the error text; the job goes on.
    """
    if (fn is None) == (factory is None):
        raise ValueError("give exactly one of fn or factory")

    def run(batches):
        model = fn if factory is None else factory()
        def answers(texts: pd.Series) -> list[tuple]:
            try:
                return [(r, None) for r in pd.Series(model(texts), index=texts.index)]
            except Exception as e:  # noqa: BLE001 - becomes data
                if len(texts) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                half = len(texts) // 2
                return answers(texts.iloc[:half]) + answers(texts.iloc[half:])

        for pdf in batches:
            out = answers(pdf[text_col].fillna("")) if len(pdf) else []
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "reply": [r for r, _ in out],
                                "error": [e for _, e in out]})

    return (df.select(id_col, text_col)
            .mapInPandas(run, f"{id_col} string, reply string, error string"))


def as_run(labels: DataFrame, id_col: str = "custom_id") -> DataFrame:
    """Labeller output as a reply table keyed by a unique id (strings)."""
    return labels.select(F.col(id_col).alias("CompanyID"), "CompanyName",
                         F.col("AI_native").cast("string").alias("AI_native"),
                         F.col("Confidence_1to5").cast("string").alias("Confidence_1to5"),
                         "Reasons_3_points", "Sources_used", "Verification_critique")


def vocabulary_hits_model(vocabulary=S.AI_VOCABULARY) -> Callable[[pd.Series], pd.Series]:
    """A tiny vectorised stand-in model for ``apply_model``: the reply is the
    number of vocabulary words in the text."""
    import re
    rx = re.compile(word_pattern(vocabulary).replace("(?i)", ""), re.IGNORECASE | re.ASCII)

    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: str(len(rx.findall(t))))
    return model
