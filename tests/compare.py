"""Compares a Spark result with DuckDB's on the same tables, as sorted rows."""

import math

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names: list[str], found: list[tuple]) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else str(v) if not isinstance(v, (int, float, str, bool, type(None))) else v
    return sorted(repr([tidy(r[i]) for i in order]) for r in found)


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    df, con = query(spark, sf_dir), connect(sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())
