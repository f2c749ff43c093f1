"""Compare one query with its SQL twin, as rows without an order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def normalized(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(keyed, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(df, con, sql: str) -> str | None:
    """None if both sides agree, else a short report."""
    columns = df.columns
    mine = normalized([tuple(r) for r in df.collect()], columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = normalized(result.fetchall(), names)
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(columns)}\n spark  {a!r:.600}\n duckdb {b!r:.600}"
    return None
