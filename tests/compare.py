"""Spark's rows against DuckDB's over the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def difference(spark_rows, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and rows in any order."""
    cursor = connection.execute(sql)
    names = [x[0] for x in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_rows.columns) != sorted(names):
        return f"columns {sorted(spark_rows.columns)} and {sorted(names)}"
    at = [names.index(c) for c in spark_rows.columns]
    key = lambda r: tuple("" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
    mine, theirs = sorted(key(r) for r in spark_rows.collect()), sorted(key([r[i] for i in at]) for r in theirs)
    if mine == theirs:
        return ""
    odd = next(((a, b) for a, b in zip(mine, theirs, strict=False) if a != b), None)
    return f"{len(mine)} and {len(theirs)} rows, first difference {odd}"
