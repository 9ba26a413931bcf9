"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name-part ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tabloom.plans.registry import TABLES  # noqa: E402


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v):
    return "null" if v is None else type(v).__name__


def compare(df, con, sql: str) -> str | None:
    """None when rows, names and values agree; otherwise a short description."""
    cols = sorted(df.columns)
    ours = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    con.execute(sql)
    names = [d[0] for d in con.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    theirs = [tuple(_norm(r[p]) for p in pos) for r in con.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    key = lambda r: tuple((_kind(v), str(v)) for v in r)
    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key)):
        if a != b or [_kind(v) for v in a] != [_kind(v) for v in b]:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y or _kind(x) != _kind(y)]
            return f"differs: {bad[:3]} in {a}"
    return None


def main() -> int:
    from conftest import make_session
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con, sql = make_session(), duck(folder), entry.oracle_sql()
    failed = []
    for name, q in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                note = compare(q(spark, folder), con, sql[name])
            else:
                rows = q(spark, folder).collect()
                note = None
                print(f"      {len(rows)} rows, e.g. {rows[:2]}"[:400])
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'FAIL' if note else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in sql else '(rows only)'} {note or ''}", flush=True)
        if note:
            failed.append(name)
    print(f"failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
