"""Compare a query with its SQL: column names, row count and values in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_table, connection, sql: str) -> str | None:
    """What differs, or None."""
    wanted = connection.sql(sql)
    if sorted(spark_table.columns) != sorted(wanted.columns):
        return f"columns {sorted(spark_table.columns)} against {sorted(wanted.columns)}"
    got = _rows(spark_table.columns, spark_table.collect())
    expected = _rows(wanted.columns, wanted.fetchall())
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    if not got:
        return "no rows on either side"
    for mine, other in zip(got, expected):
        if mine != other:
            return f"{str(mine)[:400]} against {str(other)[:400]}"
    return None
