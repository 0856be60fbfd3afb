"""Rows of a query and of its SQL in a comparable form."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np


def views(path):
    con = duckdb.connect()
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, np.bool_)):
        return v if v is None else ("bool", bool(v))
    if isinstance(v, decimal.Decimal):
        return ("decimal", float(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return str(v)[:19]
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return str(v)


def compare(df, con, sql):
    q = con.execute(sql)
    names = [c[0] for c in q.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
    return len(ours)
