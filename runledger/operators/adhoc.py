"""A caller's own SQL over the job tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from runledger.sources.tables import JobTables


def adhoc_sql(
    spark: SparkSession, tables: JobTables, text: str, args: Mapping[str, Any] | None = None
) -> DataFrame:
    """Run one query that names the job tables; anything but a query is refused.

    Table names may be in any case. Values belong in ``args`` (``:name`` in the text).
    Wrapping the text in a subquery is the check: only a query can stand there, so
    statements that change or define something fail to parse before they run. The tables
    are views for the length of the call only; views of their names are put back after it.
    """
    query = text.strip().rstrip(";")
    if not query:
        raise ValueError("the query is missing")
    named = [name for name in tables.names() if re.search(rf"\b{name}\b", query, re.IGNORECASE)]
    before = {name: spark.table(name) for name in named if _is_view(spark, name)}
    try:
        for name in named:
            getattr(tables, name).createOrReplaceTempView(name)
        # Analysed while the views stand; the plan refers to the tables' own plans from then on.
        spark.sql(f"select * from (\n{query}\n) checked", args=dict(args or {}))
        return spark.sql(query, args=dict(args or {}))
    finally:
        for name in named:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(table.name == name and table.isTemporary for table in spark.catalog.listTables(pattern=name))
