"""Run a query and its SQL side by side and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "is_integer") and not isinstance(value, int):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if isinstance(value, int):
        return str(value)
    return "~" if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, build, sql, sf_dir):
    """Return (row count, problem text or None)."""
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None if got else "no rows"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return len(got), f"columns {sorted(df.columns)} against {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if len(a) != len(b):
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return len(got), f"{len(a)} rows against {len(b)}; only here/there: {str(only)[:700]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        only = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
        return len(got), f"{len(bad)} rows differ; only here/there: {str(only)[:900]}"
    if not got:
        return 0, "no rows"
    return len(got), None
