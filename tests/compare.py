"""Spark results against DuckDB results over the same files."""

from __future__ import annotations

import os

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        if os.path.exists(f):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def rows(pdf) -> list[str]:
    """The rows as sorted strings, columns by name, whole floats as integers."""
    plain = lambda x: None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else x
    names = sorted(pdf.columns)
    return sorted(str([plain(v) for v in r]) for r in pdf[names].astype(object).values.tolist())


def same(spark_df, con, sql: str) -> None:
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
