"""Run registered queries against their SQL oracles: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr), [columns[i] for i in order]


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want, wcols = rows_of(cols, res.fetchall())
    if gcols != wcols:
        return f"columns {gcols} != {wcols}"
    types = [type(x).__name__ for x in (got[0] if got else ())]
    wtypes = [type(x).__name__ for x in (want[0] if want else ())]
    if len(got) != len(want):
        gs, ws = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} != {len(want)}; only spark {sorted(gs - ws)[:2]}; only sql {sorted(ws - gs)[:2]}"
    if got != want:
        gs, ws = set(map(repr, got)), set(map(repr, want))
        a, b = sorted(gs - ws), sorted(ws - gs)
        return f"{gcols}: {len(a)} rows differ; spark {str(a[:2])[:900]} sql {str(b[:2])[:900]}"
    if types != wtypes:
        return f"types {types} != {wtypes}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from quizmill.session import local_session

    sf = argv[0] if argv else "0.01"
    names = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                msg = compare(df, con, oracles[name])
                kind = "ok" if msg is None else "DIFF " + msg
            else:
                kind = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            kind = "ERROR " + str(e)[:1200]
        bad += kind.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - t:6.2f}s {kind}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
