"""Runs a query and its SQL on the same tables and compares all rows."""

import glob

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if isinstance(value, pd.Timestamp):
        value = value.to_pydatetime()
    if hasattr(value, "date") and callable(value.date):
        value = value.date()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def differences(df, con, sql):
    """Text of the first differences, or an empty one."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    own = [tuple(_plain(row[c]) for c in order) for row in df.select(*order).collect()]
    at = [names.index(c) for c in order]
    other = [tuple(_plain(row[k]) for k in at) for row in result.fetchall()]
    key = lambda row: tuple((x is not None, str(type(x)) if not isinstance(x, (int, float)) else "n", str(x) if not isinstance(x, (int, float)) else f"{x:030.6f}") for x in row)
    own, other = sorted(own, key=key), sorted(other, key=key)
    if own == other:
        return ""
    a, b = set(own) - set(other), set(other) - set(own)
    return f"{len(own)} and {len(other)} rows; columns {order}; only here: {sorted(a, key=key)[:3]}; only in SQL: {sorted(b, key=key)[:3]}"
