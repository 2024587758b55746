"""SQL-text twins of the column builders, for the DuckDB oracles."""

from __future__ import annotations

from tallyho import schemas as S
from tallyho.functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return f"trim({e}, {q(X.WS_CHARS)})"


def is_blank(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, {q(X.NON_WS)}))"


def blank_to_na(e: str) -> str:
    return f"(CASE WHEN {is_blank(e)} THEN 'N/A' ELSE {strip_ws(e)} END)"


def null_to_na(e: str) -> str:
    return f"(CASE WHEN {e} IS NULL THEN 'N/A' ELSE {strip_ws(e)} END)"


def blank_to_null(e: str) -> str:
    return f"(CASE WHEN {is_blank(e)} THEN NULL ELSE {e} END)"


def extract_year(e: str) -> str:
    y = f"regexp_extract({strip_ws(e)}, {q(X.YEAR_PATTERN)}, 0)"
    return (f"(CASE WHEN {e} IS NULL OR {e} = '' OR {e} = 'N/A' THEN 'N/A' "
            f"WHEN {y} = '' THEN 'N/A' ELSE {y} END)")


def merge_keywords(cat: str, groups: str) -> str:
    a = f"coalesce({strip_ws(cat)}, '')"
    b = f"coalesce({strip_ws(groups)}, '')"
    return (f"(CASE WHEN {a} <> '' AND {b} <> '' THEN {a} || ', ' || {b} "
            f"WHEN {a} <> '' THEN {a} WHEN {b} <> '' THEN {b} ELSE 'N/A' END)")


def parse_categories(e: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({e}, ''), ','), "
            f"lambda x: {strip_ws('x')}), lambda x: x <> '')")


def profile_message(fields=X.PROFILE_FIELDS, t: str = "") -> str:
    p = t + "." if t else ""
    lines = {
        "id": f"'CompanyID: ' || {null_to_na(p + 'org_uuid')}",
        "name": f"'CompanyName: ' || {null_to_na(p + 'name')}",
        "short": f"'Short Description: ' || {blank_to_na(p + 'short_description')}",
        "long": f"'Long Description: ' || {blank_to_na(p + 'long_description')}",
        "keywords": "'Keywords: ' || " + merge_keywords(p + "category_list",
                                                        p + "category_groups_list"),
        "year": f"'YearFounded: ' || {extract_year(p + 'founded_date')}",
    }
    return ("concat_ws(chr(10), 'INPUT:', "
            + ", ".join(lines[f] for f in X.PROFILE_FIELDS if f in fields) + ")")


def adoption_message(t: str = "") -> str:
    p = t + "." if t else ""
    return ("concat_ws(chr(10), "
            f"'Name: ' || {null_to_na(p + 'name')}, "
            f"'Short Description: ' || {null_to_na(p + 'short_description')}, "
            f"'Long Description: ' || {null_to_na(p + 'long_description')}, "
            f"'Categories: ' || {null_to_na(p + 'category_list')})")


def url_host(e: str) -> str:
    return (f"replace(lower(regexp_extract({e}, {q(X.AUTHORITY_PATTERN)}, 1)), "
            "'www.', '')")


def normalize_url(e: str) -> str:
    u = strip_ws(e)
    return (f"(CASE WHEN {is_blank(e)} THEN NULL "
            f"WHEN lower({u}) LIKE 'http://%' OR lower({u}) LIKE 'https://%' THEN {u} "
            f"ELSE 'https://' || {u} END)")


def detect_redirect(url: str, final: str) -> str:
    return (f"(CASE WHEN {is_blank(url)} OR {is_blank(final)} THEN false "
            f"ELSE NOT coalesce({url_host(url)} = {url_host(final)}, false) END)")


def pct(n: str, d: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) * 100.0 / CAST({d} AS DOUBLE), 0.0)"


def ratio(n: str, d: str) -> str:
    return f"coalesce(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE), 0.0)"


def sanitize(e: str) -> str:
    one = [(a, b) for a, b in S.UNICODE_REPLACEMENTS if len(b) == 1]
    out = f"translate({e}, {q(''.join(a for a, _ in one))}, {q(''.join(b for _, b in one))})"
    for a, b in S.UNICODE_REPLACEMENTS:
        if len(b) != 1:
            out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def arr(values) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return repr(v)
    return "[" + ", ".join(lit(v) for v in values) + "]"


def coerce_numeric(e: str) -> str:
    """SQL twin of ``coerce_numeric`` (NaN -> NULL)."""
    return f"(CASE WHEN isnan(TRY_CAST({e} AS DOUBLE)) THEN NULL ELSE TRY_CAST({e} AS DOUBLE) END)"
