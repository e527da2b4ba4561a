"""Run the queries against their SQL twins: ``python -m workload.check [sf] [prefix ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from siftline.session import local_session
from workload import all_queries
from workload.registry import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{float(v):.6f}"
        if type(v).__name__ in ("Timestamp", "datetime", "date", "datetime64"):
            return str(pd.Timestamp(v))
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[cols].itertuples(index=False))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for x, y in zip(a, b):
        if x != y:
            cols = sorted(got.columns)
            diff = [(c, p[:200], q[:200]) for c, p, q in zip(cols, x, y) if p != q]
            return f"first difference: {diff}"
    return None


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    picks = argv[1:]
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    con = connect(sf)
    bad = 0
    for name, fn in all_queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            t = time.time()
            got = fn(spark, sf).toPandas()
            t1 = time.time() - t
            if name not in ORACLES:
                print(f"rows {name:28s} {len(got):7d} rows {t1:6.2f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(ORACLES[name]).fetchdf()
            problem = compare(got, want)
            mark = "ok  " if problem is None else "BAD "
            print(f"{mark} {name:28s} {len(got):7d} rows {t1:6.2f}s sql {time.time() - t:5.2f}s {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
