"""Running a query beside its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v).tz_localize(None))
    return v


def connection(folder: str):
    con = duckdb.connect()
    for p in glob.glob(folder + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(df) -> tuple[list[str], list]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    done = con.execute(sql)
    names = [x[0] for x in done.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in done.fetchall()), key=repr)
