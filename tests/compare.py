"""Order-insensitive comparison of a Spark result with a DuckDB query."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def _kind(name: str) -> str:
    name = name.lower()
    if name in ("bigint", "integer", "int", "long", "smallint"):
        return "int"
    if name.startswith("decimal") or name in ("hugeint",):
        return name
    return {"varchar": "string", "float": "double", "bool": "boolean"}.get(name, name)


def compare(df, con, sql: str | None) -> tuple[int, str]:
    """(rows, problem); an empty problem means the results are equal."""
    mine = df.collect()
    if sql is None:
        return len(mine), ""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = [str(c[1]) for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(mine), f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    for n, k in zip(names, kinds):
        if _kind(k) != spark_kinds[n]:
            return len(mine), f"type of {n}: spark {spark_kinds[n]} oracle {_kind(k)}"
    at = [df.columns.index(n) for n in names]
    a = sorted(tuple(_plain(row[i]) for i in at) for row in mine)
    b = sorted(tuple(_plain(v) for v in row) for row in theirs)
    if a == b:
        return len(mine), ""
    set_a, set_b = set(a), set(b)
    only_a = [x for x in a if x not in set_b][:3]
    only_b = [x for x in b if x not in set_a][:3]
    return len(mine), f"spark {len(a)} rows, oracle {len(b)}; only spark {str(only_a)[:900]}; only oracle {str(only_b)[:900]}"
