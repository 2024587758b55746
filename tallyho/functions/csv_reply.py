"""Parse a one-line CSV classification reply held in a string column.

Semantics follow Python's ``csv.reader`` on the stripped reply: only the
first record counts, it needs at least 7 fields, the first 7 are taken and
each is stripped; otherwise all seven fields are ''.

Well-formed records (every field either plainly unquoted or fully quoted)
are cut and unquoted with Catalyst regex expressions.  Records with odd
quoting (text after a closing quote, an unclosed quote, ...) are rare; only
those rows go through an Arrow ``pandas_udf`` around the ``csv`` module, so
the common path never leaves the JVM.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import schemas as S
from tallyho.functions import text as X

# one field: a quoted run (quote special only at field start) or plain text
FIELD = r'(?:"(?:[^"]++|"")*+"[^,\n]*+|[^,\n]*+)'
FIRST_RECORD = rf"^{FIELD}(?:,{FIELD})*+"
# a well-formed field: fully quoted and followed by a delimiter/end, or
# unquoted text not starting with a quote
WELL_FORMED_FIELD = r'(?:"(?:[^"]++|"")*+"(?=,|$)|(?!")[^,\n]*+)'
WELL_FORMED = rf"^{WELL_FORMED_FIELD}(?:,{WELL_FORMED_FIELD})*+$"
N_FIELDS = len(S.REPLY_COLUMNS)


def first_record(reply) -> F.Column:
    return F.regexp_extract(X.strip_ws(reply), FIRST_RECORD, 0)


def is_well_formed(reply) -> F.Column:
    return first_record(reply).rlike(WELL_FORMED)


def _catalyst_fields(rec) -> F.Column:
    """Fields of a well-formed first record, unquoted and stripped."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), X.col_(rec)),
                               F.lit(",(" + FIELD + ")"), 1)
    unq = F.transform(raw, lambda f: X.strip_ws(
        F.when(f.startswith('"'),
               F.replace(F.substring(f, F.lit(2), F.length(f) - 2),
                         F.lit('""'), F.lit('"')))
        .otherwise(f)))
    return F.when(F.size(unq) >= N_FIELDS, F.slice(unq, 1, N_FIELDS))


def python_csv_fields(text: str | None) -> list[str] | None:
    """Reference behaviour for one reply (used for odd quoting and tests)."""
    if text is None:
        return None
    try:
        rows = list(csv.reader(io.StringIO(text.strip())))
    except csv.Error:
        return None
    if rows and len(rows[0]) >= N_FIELDS:
        return [v.strip() for v in rows[0][:N_FIELDS]]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _python_fields(s: pd.Series) -> pd.Series:
    return s.map(python_csv_fields)


def parse_csv_reply(df: DataFrame, reply_col: str = "content") -> DataFrame:
    """Add the seven reply columns plus ``csv_ok`` and ``odd_quoting``.

    Rows with an unparseable reply keep all seven fields as ''.
    """
    st = df.withColumn("_rec", first_record(reply_col))
    # replies that never came (NULL) have no fields and need no Python
    st = st.withColumn("_well", F.col(reply_col).isNull()
                       | F.coalesce(F.col("_rec").rlike(WELL_FORMED), F.lit(False)))
    a = (st.where("_well").withColumn("_f", F.when(F.col(reply_col).isNotNull(),
                                                   _catalyst_fields("_rec")))
         .withColumn("odd_quoting", F.lit(False)))
    b = (st.where(~F.col("_well")).withColumn("_f", _python_fields(F.col(reply_col)))
         .withColumn("odd_quoting", F.col(reply_col).isNotNull()))
    u = a.unionByName(b)
    cols = [F.coalesce(F.col("_f")[i], F.lit("")).alias(c)
            for i, c in enumerate(S.REPLY_COLUMNS)]
    return u.select(*[c for c in df.columns], *cols,
                    F.col("_f").isNotNull().alias("csv_ok"), "odd_quoting")
