"""Run one registered query: ``python -m moodspark <query> <tables_dir> [options]``.

  --out PATH        write the result (overwrite) instead of printing it
  --format FMT      parquet (default) or csv (header, RFC 4180 quoting)
  --show N          print the first N rows (default 20 when --out is absent)
  --list            list the registered queries
  --master URL      Spark master when not launched by spark-submit
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="moodspark")
    ap.add_argument("query", nargs="?")
    ap.add_argument("tables_dir", nargs="?")
    ap.add_argument("--out")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--show", type=int)
    ap.add_argument("--list", action="store_true")
    ap.add_argument("--master")
    args = ap.parse_args(argv)

    from moodspark.plans.registry import queries
    qs = queries()
    if args.list or not args.query:
        print("\n".join(sorted(qs)))
        return 0
    if args.query not in qs or not args.tables_dir:
        ap.error(f"unknown query or missing tables_dir (try --list): {args.query}")

    from moodspark.session import build_session
    spark = build_session(args.master)
    df = qs[args.query](spark, args.tables_dir)
    if args.out:
        if args.format == "csv":
            from moodspark.sources.csv_io import write_csv
            write_csv(df, args.out)
        else:
            df.write.mode("overwrite").parquet(args.out)
    if args.show or not args.out:
        df.show(args.show or 20, truncate=80)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
