"""Comparing a query's rows with those its check SQL gives."""

from __future__ import annotations

import datetime as dt
import math
import os
from collections import Counter
from typing import Any

import duckdb
from pyspark.sql import DataFrame

RAW_TABLES = ("region", "nation", "customer", "part", "orders", "events")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in RAW_TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[place]) for place in order) for row in rows)


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, or nothing."""
    cursor = connection.execute(sql)
    columns = [column[0] for column in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(columns)}"
    found, expected = _bag(df.columns, df.collect()), _bag(columns, cursor.fetchall())
    if found == expected:
        return None
    extra, missing = found - expected, expected - found
    return (
        f"{found.total()} rows instead of {expected.total()};"
        f" {extra.total()} unexpected like {list(extra)[:2]}; {missing.total()} missing like {list(missing)[:2]}"
    )
