"""Print a condensed physical plan per query: operators, exchanges, scans.

Usage: python tools/plans.py [sf_dir] name ...
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from moodspark.plans.registry import queries  # noqa: E402
from moodspark.session import build_session  # noqa: E402


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    qs = queries()
    for name in names or list(qs):
        df = qs[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"=== {name}")
        for line in plan.splitlines():
            line = re.sub(r"#\d+L?", "", line)
            if any(k in line for k in ("Exchange", "Scan", "Window", "Aggregate", "Join", "Generate",
                                       "Sort", "MapInPandas", "Limit", "Union")):
                print("   ", line[:220])
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
