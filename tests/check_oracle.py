"""Compare queries with their SQL twins: python tests/check_oracle.py [sf] [name prefix or names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise the first difference."""
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    bad = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    return f"{len(bad)} of {len(left[1])} rows differ, first {bad[0]}" if bad else None


def main(args):
    from conftest import make_session

    import __spark_entry__ as entry

    sf = args[0] if args else "0.01"
    wanted = args[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                diff = compare(df, con, oracle[name])
                note = "same rows" if diff is None else f"DIFFERENT: {diff}"
            else:
                diff, note = None, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            diff = note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += diff is not None
        print(f"{name:32s} {time.time() - t:6.1f}s  {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.join(ROOT, "tests"))
    sys.exit(1 if main(sys.argv[1:]) else 0)
