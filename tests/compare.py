"""Comparing a Spark result with DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, Decimal)):
        return ("n", int(value)) if value == int(value) else ("f", float(value))
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("f", round(value, 6))
    if isinstance(value, datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, date):
        return ("d", value.isoformat())
    return ("s", str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    return normalise(df.columns, df.collect())


def duck_result(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return normalise(columns, cur.fetchall())


# DuckDB type -> Spark type of a result column.
TYPES = {
    "BOOLEAN": "boolean",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
}


def duck_types(con, sql):
    return {
        name: TYPES.get(str(kind), str(kind))
        for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall()
    }
