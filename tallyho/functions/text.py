"""Column -> Column builders for request text and small scalar rules.

All builders are Catalyst expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyho import schemas as S

# Whitespace as Python's str.strip() sees it: ASCII whitespace plus the
# Unicode space separators (NBSP, narrow NBSP, ideographic space, ...).
# Written with \x{..} escapes so Java regex and RE2 read it the same way.
WS_CLASS = (r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# any character that is not whitespace (a find stops at the first one)
NON_WS = "[^" + WS_CLASS[1:]
YEAR_PATTERN = r"\b(19|20)\d{2}\b"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same 29 characters as a plain string (what Python's str.isspace()
# accepts): trimming a character set only looks at the two ends of a text.
WS_CHARS = "".join(chr(c) for c in [9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32,
                                    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip_ws(c) -> Column:
    """Trim leading/trailing whitespace, Unicode spaces included."""
    return F.trim(col_(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """NULL, empty or whitespace-only."""
    c = col_(c)
    return c.isNull() | ~c.rlike(NON_WS)


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(c)


def blank_to_na(c) -> Column:
    """NULL / blank -> 'N/A', otherwise the trimmed text."""
    c = col_(c)
    return F.when(is_blank(c), F.lit(S.NA)).otherwise(strip_ws(c))


def null_to_na(c) -> Column:
    """NULL -> 'N/A', otherwise trimmed (blank stays blank)."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(S.NA)).otherwise(strip_ws(c))


def extract_year(c) -> Column:
    """First standalone 19xx/20xx year, else 'N/A'.

    ``\\b`` needs a non-word neighbour, so ``01nov2016`` gives 'N/A'.
    """
    c = col_(c)
    y = F.regexp_extract(strip_ws(c), YEAR_PATTERN, 0)
    return (F.when(c.isNull() | (c == "") | (c == S.NA), F.lit(S.NA))
            .when(y == "", F.lit(S.NA)).otherwise(y))


def merge_keywords(cat, groups) -> Column:
    """'cat, groups' / whichever exists / 'N/A'."""
    a = F.coalesce(strip_ws(col_(cat)), F.lit(""))
    b = F.coalesce(strip_ws(col_(groups)), F.lit(""))
    return (F.when((a != "") & (b != ""), F.concat(a, F.lit(", "), b))
            .when(a != "", a).when(b != "", b).otherwise(F.lit(S.NA)))


def parse_categories(c) -> Column:
    """Comma list -> array of trimmed, non-empty entries; NULL -> []."""
    parts = F.transform(F.split(F.coalesce(col_(c), F.lit("")), ","),
                        lambda x: strip_ws(x))
    return F.filter(parts, lambda x: x != "")


def sanitize_unicode(c) -> Column:
    """Typographic characters -> ASCII (fixed table in schemas)."""
    one_to_one = [(a, b) for a, b in S.UNICODE_REPLACEMENTS if len(b) == 1]
    out = F.translate(col_(c), "".join(a for a, _ in one_to_one),
                      "".join(b for _, b in one_to_one))
    for a, b in S.UNICODE_REPLACEMENTS:
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


PROFILE_FIELDS = ("id", "name", "short", "long", "keywords", "year")


def build_profile_message(id_col, name, short, long, cat, groups, founded,
                          fields=PROFILE_FIELDS) -> Column:
    """The multi-line request text; ``fields`` drops lines (ablation)."""
    lines = {
        "id": F.concat(F.lit("CompanyID: "), null_to_na(id_col)),
        "name": F.concat(F.lit("CompanyName: "), null_to_na(name)),
        "short": F.concat(F.lit("Short Description: "), blank_to_na(short)),
        "long": F.concat(F.lit("Long Description: "), blank_to_na(long)),
        "keywords": F.concat(F.lit("Keywords: "), merge_keywords(cat, groups)),
        "year": F.concat(F.lit("YearFounded: "), extract_year(founded)),
    }
    return F.concat_ws("\n", F.lit("INPUT:"), *[lines[f] for f in PROFILE_FIELDS
                                                 if f in fields])


def build_adoption_message(name, short, long, categories) -> Column:
    """Four-line variant: Name / Short / Long / Categories."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), null_to_na(name)),
        F.concat(F.lit("Short Description: "), null_to_na(short)),
        F.concat(F.lit("Long Description: "), null_to_na(long)),
        F.concat(F.lit("Categories: "), null_to_na(categories)))


def custom_id(org_uuid, fallback_key) -> Column:
    """'startup-<uuid>'; a missing uuid falls back to the row's own key.

    A row position means nothing in a distributed table, so the fallback is
    ``startup-row-<key>``, stable across runs and re-partitioning.
    """
    u = strip_ws(col_(org_uuid))
    fb = F.concat(F.lit("row-"), col_(fallback_key).cast("string"))
    return F.concat(F.lit(S.CUSTOM_ID_PREFIX),
                    F.when(is_blank(org_uuid), fb).otherwise(u))


def build_batch_request(cid, system_prompt, user_message, model: str,
                        json_mode: bool = False) -> Column:
    """Nested request struct (serialise with ``to_json``)."""
    body = [F.lit(model).alias("model"),
            F.array(F.struct(F.lit("system").alias("role"),
                             col_(system_prompt).alias("content")),
                    F.struct(F.lit("user").alias("role"),
                             col_(user_message).alias("content"))
                    ).alias("messages")]
    if json_mode:
        body.append(F.struct(F.lit("json_object").alias("type"))
                    .alias("response_format"))
    return F.struct(col_(cid).alias("custom_id"),
                    F.lit(S.REQUEST_METHOD).alias("method"),
                    F.lit(S.REQUEST_URL).alias("url"),
                    F.struct(*body).alias("body"))


def request_bytes(request_json) -> Column:
    """Bytes of one serialised request line (newline included)."""
    return (F.octet_length(col_(request_json)) + F.lit(1)).cast("bigint")


def build_search_query(name) -> Column:
    return F.concat(F.lit(S.SEARCH_QUERY_PREFIX), F.coalesce(col_(name),
                                                             F.lit("")))


def normalize_url(url) -> Column:
    """Prefix https:// when no http(s) scheme; blank -> NULL."""
    u = strip_ws(col_(url))
    return (F.when(is_blank(url), F.lit(None).cast("string"))
            .when(F.lower(u).startswith("http://")
                  | F.lower(u).startswith("https://"), u)
            .otherwise(F.concat(F.lit("https://"), u)))


# scheme://authority - the authority is everything up to the first / ? #
AUTHORITY_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def url_host(url) -> Column:
    """Lower-cased authority (port kept) with every 'www.' removed."""
    return F.replace(F.lower(F.regexp_extract(col_(url), AUTHORITY_PATTERN, 1)),
                     F.lit("www."), F.lit(""))


def detect_redirect(url, final_url) -> Column:
    """Hosts differ; false when either URL is empty."""
    return (F.when(is_blank(url) | is_blank(final_url), F.lit(False))
            .otherwise(~F.coalesce(url_host(url) == url_host(final_url),
                                   F.lit(False))))


def coerce_numeric(c) -> Column:
    """Unparseable -> NULL (through double, so '4.0' -> 4.0).  'nan' also
    becomes NULL: Spark holds NaN = NaN true, a missing value must never
    agree with another one."""
    x = col_(c).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def coerce_int(c) -> Column:
    return coerce_numeric(c).try_cast("int")


def safe_pct(num, den) -> Column:
    """100*num/den, 0 when den is 0 or NULL."""
    return F.coalesce(F.try_divide(col_(num).cast("double") * 100.0,
                                   col_(den).cast("double")), F.lit(0.0))


def safe_ratio(num, den) -> Column:
    return F.coalesce(F.try_divide(col_(num).cast("double"),
                                   col_(den).cast("double")), F.lit(0.0))
