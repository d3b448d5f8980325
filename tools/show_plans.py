"""Print the formatted physical plan of registered queries (for plan review).

usage: python tools/show_plans.py [sf_dir] key [key ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ratelens.plans.registry import QUERIES  # noqa: E402
from ratelens.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_spark()
    for k in args or ["faceted_filter", "outcome_rate", "describe", "roc_auc"]:
        print(f"===== {k}")
        QUERIES[k](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
