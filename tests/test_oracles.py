"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, column names and an order-insensitive value hash)."""

import duckdb
import pytest
from pyspark.sql import types as T

from conftest import SMALL
from scripts_oracle import digest
from tallyho.plans.registry import ORACLES, QUERIES, load_all
from tallyho.sources.tables import TABLES, table_path

load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SMALL, t)}')")
    return c


_DUCK = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
         T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP"}


def duck_type(dt) -> str:
    if isinstance(dt, T.ArrayType):
        return duck_type(dt.elementType) + "[]"
    for k, v in _DUCK.items():
        if isinstance(dt, k):
            return v
    return dt.simpleString()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[key])
    o_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    o_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {f.name: duck_type(f.dataType) for f in df.schema.fields} == o_types
    assert len(s_rows) == len(o_rows)
    assert digest(df.columns, s_rows)[0] == digest(rel.columns, o_rows)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, key):
    assert QUERIES[key](spark, SMALL).count() >= 0


def test_every_query_has_a_docstring():
    from tallyho.plans.registry import DOCS
    assert all(DOCS[k] for k in QUERIES)


@pytest.mark.parametrize("key, column", [
    ("check_reply_contract", "violations"), ("check_insufficient_info", "violations"),
    ("check_adoption_invariants", "violations"), ("check_mode_monotonic", "violations"),
    ("check_ranges", "violations"), ("check_source_confidence_band", "violations"),
    ("check_research_rules", "violations"), ("summarize_typed_findings", "has_adoption_evidence"),
    ("staged_cascade", "escalated"), ("staged_cascade", "parse_error"), ("quarantine_findings", "reason"),
    ("sliding_request_rate", "over_limit"), ("plan_even_batches", "batch_num"),
    ("plan_greedy_batches", "batch_num"), ("escalation_rule", "mismatch")])
def test_checks_have_both_outcomes(key, column):
    """A rule that never, or always, fires would be told apart from a right one."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path('/root/testdata/sf0.01', t)}')")
    assert len(c.sql(f"SELECT DISTINCT {column} FROM ({ORACLES[key]})").fetchall()) > 1
