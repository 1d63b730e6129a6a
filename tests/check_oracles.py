"""Compare every query with its SQL: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None or v != v:
        return "~"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def compare(spark_df, con, sql: str) -> str | None:
    """None if rows agree, else a description of the first difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = [tuple(row) for row in spark_df.collect()]
    cols = spark_df.columns
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}"
    order_got = [cols.index(c) for c in sorted(cols)]
    order_want = [names.index(c) for c in sorted(names)]
    a = sorted(tuple(normal(row[i]) for i in order_got) for row in got)
    b = sorted(tuple(normal(row[i]) for i in order_want) for row in want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} of {len(a)} rows differ, first {sorted(cols)}\n   spark {different[0][0]}\n   sql   {different[0][1]}"
    return None


def main() -> int:
    from tablewise.session import local_session

    from tablewise.plans import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            verdict = compare(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
        except Exception as error:
            verdict = f"ERROR {type(error).__name__}: {str(error)[:500]}"
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - start:6.2f}s {verdict or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} fine")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
