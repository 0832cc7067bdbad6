"""Runs a registered query and its SQL twin and compares the rows as multisets."""

from __future__ import annotations

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _cell(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _cell(x.asDict())
    return x


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        source = f"{p}/*.parquet" if Path(p).is_dir() else p
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{source}'")
    return con


def differences(spark, con, sf_dir: str, query, sql: str) -> tuple[int, int, list, list]:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = Counter(tuple(_cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols, (sorted(names), cols)
    order = [names.index(c) for c in cols]
    theirs = Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())
    return sum(ours.values()), sum(theirs.values()), list((ours - theirs).items())[:5], list((theirs - ours).items())[:5]
