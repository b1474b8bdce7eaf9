"""Holds a query's rows against its oracle's, as multisets of rows with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names = sorted(found.columns)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {names}"
    at = [found.columns.index(n) for n in names]
    want = Counter(tuple(_value(r[i]) for i in at) for r in found.fetchall())
    got = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; ours alone {list((got - want).items())[:3]}; oracle alone {list((want - got).items())[:3]}"
