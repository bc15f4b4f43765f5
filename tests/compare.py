"""Query results against DuckDB's, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or nothing."""
    names = sorted(spark_df.columns)
    got = sorted(tuple(_plain(v) for v in r) for r in spark_df.select(*names).collect())
    cursor = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql}) q")
    want = sorted(tuple(_plain(v) for v in r) for r in cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b, strict=True))]
    return f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else ""
