"""Local correctness gate: each registered Spark query vs its DuckDB oracle.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares column names, row counts and an order-insensitive multiset of
normalised rows (floats rounded to 6 places).
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from moodspark.plans.registry import oracle_sql, queries  # noqa: E402
from moodspark.session import build_session  # noqa: E402
from moodspark.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            s_cols = df.columns
            s_types = [f.dataType.simpleString() for f in df.schema.fields]
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark error {str(exc)[:800]}")
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(s_rows)} rows ({dt:.1f}s) no oracle")
            continue
        try:
            res = con.execute(sqls[name])
            d_cols = [d[0] for d in res.description]
            d_types = [str(d[1]) for d in res.description]
            d_rows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: duckdb error {str(exc)[:800]}")
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"cols spark={s_cols} duck={d_cols}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        if not problems:
            a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                problems.append(f"values differ e.g. {str(diff)[:600]}")
        types = dict(zip(s_cols, s_types)), dict(zip(d_cols, d_types))
        if problems:
            bad += 1
            print(f"FAIL {name}: {'; '.join(problems)} types={types}")
        else:
            print(f"ok   {name}: {len(s_rows)} rows ({dt:.1f}s) types={types}")
    print(f"{bad} failures")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
