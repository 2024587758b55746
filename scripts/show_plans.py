"""Print the formatted physical plan of registered queries.

Usage: python scripts/show_plans.py [--sf-dir DIR] key [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyho.plans.registry import QUERIES, load_all  # noqa: E402
from tallyho.session import get_spark  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="+")
    args = ap.parse_args()
    load_all()
    spark = get_spark("local[8]", 16)
    for k in args.keys:
        print(f"===== {k}")
        QUERIES[k](spark, args.sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
