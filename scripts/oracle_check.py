"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python scripts/oracle_check.py [--sf-dir DIR] [key ...]

Compares row count, column names and an order-insensitive hash of the
values (floats rounded to 6 places), as the build's correctness gate does.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tallyho.session import get_spark  # noqa: E402
from tallyho.sources.tables import TABLES, table_path  # noqa: E402
from tallyho.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: norm(x) for k, x in v.asDict(recursive=False).items()}
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([norm(r[i]) for i in order], default=str,
                              ensure_ascii=False) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()

    load_all()
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(args.sf_dir, t)}')")

    keys = args.keys or sorted(QUERIES)
    ok = bad = skipped = 0
    for k in keys:
        t0 = time.time()
        try:
            df = QUERIES[k](spark, args.sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in ORACLES:
            print(f"SKIP  {k}: no oracle ({len(s_rows)} rows, {ts:.1f}s)")
            skipped += 1
            continue
        try:
            rel = con.sql(ORACLES[k])
            o_cols = rel.columns
            o_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        problems = []
        if sorted(s_cols) != sorted(o_cols):
            problems.append(f"cols spark={sorted(s_cols)} oracle={sorted(o_cols)}")
        if len(s_rows) != len(o_rows):
            problems.append(f"rows spark={len(s_rows)} oracle={len(o_rows)}")
        if not problems:
            hs, ls = digest(s_cols, s_rows)
            ho, lo = digest(o_cols, o_rows)
            if hs != ho:
                diff_s = [x for x in ls if x not in set(lo)][: args.show]
                diff_o = [x for x in lo if x not in set(ls)][: args.show]
                problems.append("values differ\n   spark : " + "\n   spark : ".join(
                    d[:300] for d in diff_s) + "\n   oracle: " + "\n   oracle: ".join(
                    d[:300] for d in diff_o))
        if problems:
            bad += 1
            print(f"FAIL  {k}: " + "; ".join(problems))
        else:
            ok += 1
            print(f"OK    {k}: {len(s_rows)} rows ({ts:.1f}s)")
    print(f"ok={ok} fail={bad} no_oracle={skipped}")
    spark.stop()


if __name__ == "__main__":
    main()
