"""Compare a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(x) -> str:
    if isinstance(x, (float, Decimal)):
        return repr(round(float(x), 5) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(shown, x)) + "]"
    return repr(x)


def canonical(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted("|".join(shown(r[k]) for k in order) for r in rows)


def same(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    expected = con.sql(sql)
    columns = expected.columns
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, expected.fetchall())
