"""Side-by-side comparison of registered queries with their SQL in DuckDB.

    python -m tests.oracle [--dir SF_DIR] [NAME...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} rows / {len(want)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return "" if got else "no rows on either side"


def main() -> int:
    import __spark_entry__ as entry
    from engramlake.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        sf_dir, args = args[1], args[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        began = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracle[name], sf_dir) if name in oracle else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
