"""Run queries on Spark and their oracle SQL on DuckDB and compare the results.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows
(floats rounded to 6 places), like the driver's correctness gate.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from webcorpus.plans import catalog  # noqa: E402
from webcorpus.plans.verify import canonical  # noqa: E402
from webcorpus.session import get_session  # noqa: E402
from webcorpus.sources.tables import TABLES  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    catalog.load_all()
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    names = names or list(catalog.QUERIES)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = catalog.QUERIES[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = catalog.ORACLES.get(name)
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sql)
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        a, b = canonical(scols, srows), canonical(dcols, drows)
        if a == b:
            print(f"OK   {name}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            only_s = [r for r in a if r not in sb][:2]
            only_d = [r for r in b if r not in sa][:2]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}\n  spark-only {str(only_s)[:700]}\n  duck-only  {str(only_d)[:700]}")
    spark.stop()
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
