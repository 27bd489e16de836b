"""Run every query against DuckDB on the same files and report differences.

    python -m checks.compare [sf_dir] [name part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

from checks import QUERIES, SQL, load
from perkwise.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        kind = out[c].dtype.kind
        if kind == "M":
            out[c] = out[c].dt.tz_localize(None).astype("datetime64[us]")
        elif kind in "iu":
            out[c] = out[c].astype("int64")
        elif out[c].dtype == object or str(out[c].dtype) in ("str", "string"):
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NA or v != v else v).astype(object)
    keys = [c for c in out.columns if out[c].dtype.kind != "f"] + [c for c in out.columns if out[c].dtype.kind == "f"]
    return out.sort_values(keys, kind="stable", na_position="first").reset_index(drop=True) if keys else out


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """Why two results differ, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = _plain(got), _plain(want)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"type of {c}: {a[c].dtype} / {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            return f"{c}: {(~same).sum()} differ, e.g. {a[c][i]!r} / {b[c][i]!r}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    load()
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in SQL:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                if not len(got):
                    bad += 1
                continue
            problem = differences(got, con.execute(SQL[name]).df())
        except Exception as exc:  # report and go on with the next query
            problem, took = f"{type(exc).__name__}: {str(exc)[:600]}", time.time() - started
            got = []
        print(f"{'ok   ' if problem is None else 'BAD  '} {name}: {problem or len(got)} {took:.1f}s", flush=True)
        bad += problem is not None
    print(f"{bad} problems")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
