"""Run queries next to their SQL and compare schema, rows and values.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One comparable form per value, strict about type families."""
    if isinstance(value, float):
        return ("num", float(f"{value:.10g}"))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, decimal.Decimal)):
        return ("num", float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return ("time", str(value))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    if isinstance(value, dict):
        return ("map", tuple((k, plain(v)) for k, v in sorted(value.items())))
    return ("null",) if value is None else ("str", value)


def rows_of(names: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL, {took:.1f}s"
    res = con.execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows, {took:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} against {want[0]}"
    extra = [r for r in got[1] if r not in set(want[1])][:2]
    lacking = [r for r in want[1] if r not in set(got[1])][:2]
    return False, f"{len(got[1])} rows against {len(want[1])}\n   ours: {str(extra)[:1500]}\n   SQL:  {str(lacking)[:1500]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    import __spark_entry__ as entry
    from tessella.session import local_session

    spark, con = local_session(), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
