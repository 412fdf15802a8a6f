"""Compares a query's rows with those of its SQL in DuckDB."""
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def compare(spark, query, sql):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, rel = query(spark, str(DATA)), con.sql(sql)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
