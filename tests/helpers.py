"""Small literal frames and how to look at results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from runledger.model import TABLE_SCHEMAS
from runledger.sources.tables import JobTables


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def frame(spark: SparkSession, schema: str, *rows: dict) -> DataFrame:
    """A frame of a DDL schema; columns a row leaves out are null."""
    empty = spark.createDataFrame([], schema)
    filled = [tuple(row.get(name) for name in empty.columns) for row in rows]
    return spark.createDataFrame(filled, empty.schema)


def table(spark: SparkSession, name: str, *rows: dict) -> DataFrame:
    return frame(spark, TABLE_SCHEMAS[name].replace(" not null", ""), *rows)


def tables(spark: SparkSession, **rows: list[dict]) -> JobTables:
    """All job tables, empty but for the rows given."""
    return JobTables.of(**{name: table(spark, name, *rows.get(name, [])) for name in TABLE_SCHEMAS})


def dicts(df: DataFrame, *columns: str) -> list[dict]:
    return [row.asDict(recursive=True) for row in (df.select(*columns) if columns else df).collect()]


def by(df: DataFrame, key: str) -> dict:
    return {row[key]: row.asDict(recursive=True) for row in df.collect()}


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
