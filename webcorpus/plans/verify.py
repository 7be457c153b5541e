"""Compare a catalogue query with its DuckDB oracle: row count, column names and an
order-insensitive multiset of rows (floats rounded to 6 places)."""

from __future__ import annotations

import math
import os

from ..sources.tables import TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def canonical(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def duck_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark_df, con, sql: str):
    """Return (ok, message)."""
    scols, srows = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns spark={scols} duck={dcols}"
    a, b = canonical(scols, srows), canonical(dcols, drows)
    if a != b:
        sb, sa = set(b), set(a)
        return False, (f"rows spark={len(a)} duck={len(b)} spark-only={[r for r in a if r not in sb][:2]} "
                       f"duck-only={[r for r in b if r not in sa][:2]}")[:1500]
    return True, f"{len(a)} rows"
