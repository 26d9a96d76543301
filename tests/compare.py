"""Runs registered queries against DuckDB on the same Parquet files."""

from __future__ import annotations

import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def mismatch(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    mine_cols, mine = table_of(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    result = con.execute(sql)
    cols, theirs = table_of([d[0] for d in result.description], result.fetchall())
    if mine_cols != cols:
        return f"columns {mine_cols} != {cols}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}; mine {mine[:2]} theirs {theirs[:2]}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{a} != {b} ({sum(x != y for x, y in zip(mine, theirs))} rows)"
    return None
