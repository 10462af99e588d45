"""Run registered queries beside their DuckDB twins and compare rows.

    python tests/check.py [name ...]        all queries, or those whose name starts with one given
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    import datetime

    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def compare(left_cols, left, right_cols, right) -> str | None:
    """None when both sides hold the same rows, else what differs."""
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} != {sorted(right_cols)}"
    order = sorted(left_cols)
    li, ri = [left_cols.index(c) for c in order], [right_cols.index(c) for c in order]
    a = sorted(tuple(normal(r[i]) for i in li) for r in left)
    b = sorted(tuple(normal(r[i]) for i in ri) for r in right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} | {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)} of {len(a)} rows differ {order}: {bad[:2]}"


def types(df, con, sql) -> str:
    """Type differences, for information."""
    want = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}/{want.get(f.name)}" for f in df.schema if want.get(f.name) != same.get(f.dataType.simpleString()))


def main() -> int:
    import __spark_entry__ as entry
    from linelens.session import get_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(os.environ.get("CHECK_CPUS", "8"))
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if len(sys.argv) < 2 or any(n.startswith(p) for p in sys.argv[1:])]
    failed = 0
    for n in names:
        start = time.time()
        try:
            df = queries[n](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if n in oracles:
                cur = con.execute(oracles[n])
                cols, want = [d[0] for d in cur.description], cur.fetchall()
                diff = compare(df.columns, rows, cols, want)
                note = types(df, con, oracles[n])
                print(("FAIL" if diff else "ok  "), n, f"{len(rows)} rows {took:.1f}s", diff or "", ("types " + note) if note else "", flush=True)
                failed += bool(diff)
            else:
                print("rows", n, f"{len(rows)} rows {took:.1f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            failed += 1
            print("ERR ", n, type(exc).__name__, str(exc)[:600].replace("\n", " "), flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
