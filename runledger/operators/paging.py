"""Ordered pages of a result."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from runledger.session import work_path

DEFAULT_ROWS = 10
# A page that ends within so many rows is a top-k; beyond, only the ranges that hold it are sorted.
TOP_ROWS = 100_000


def _order(column: str, direction: str | None) -> Column:
    if (direction or "").lower() == "desc":
        return F.desc_nulls_first(column)
    return F.asc_nulls_last(column)


def sort_page(
    df: DataFrame,
    key: str,
    column: str | None = None,
    direction: str | None = None,
    page: int | None = None,
    limit: int | None = None,
    allowed: Collection[str] | None = None,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Rows of one page, counted from 1, ordered by a column and then by the unique key.

    Order, offset and limit together are planned as one top-k: every task keeps at
    most ``page * limit`` rows and no full sort takes place. A page that ends beyond
    ``top_rows`` is found by ranges, see ``_deep_page``; the rows are the same.
    """
    column = column or key
    if column not in (allowed if allowed is not None else df.columns):
        raise ValueError(f"cannot order by {column}")
    rows = limit or DEFAULT_ROWS
    skipped = ((page or 1) - 1) * rows
    if skipped + rows > top_rows:
        return _deep_page(df, key, column, direction, skipped, rows)
    ordered = df.orderBy(_order(column, direction), F.asc(key))
    return ordered.offset(skipped).limit(rows) if skipped else ordered.limit(rows)


def _deep_page(df: DataFrame, key: str, column: str, direction: str | None, skipped: int, rows: int) -> DataFrame:
    """A page far down, without any task that holds all rows above it.

    The order columns alone are dealt into ranges of the order and written by range. The rows of
    each range, counted, tell which hold the page; only these are opened and sorted, and the
    page's keys meet the other columns after that. The key, unique and not null, is part of the
    order, so a value of many rows is split over ranges too.
    """
    spark = df.sparkSession
    by = [_order("value", direction), F.asc("id")]
    ranges = df.select(F.col(column).alias("value"), F.col(key).alias("id")).repartitionByRange(*by)
    path = work_path(spark, "page-ranges")
    ranges.withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(path)
    written = spark.read.schema(f"{_ddl(ranges)}, range int").parquet(path)
    # One row per range, so they may come to the driver.
    before, chosen, offset = 0, [], 0
    for number, size in sorted(written.groupBy("range").count().collect()):
        if before + size > skipped and before < skipped + rows:
            if not chosen:
                offset = skipped - before
            chosen.append(number)
        before += size
    held = written.where(F.col("range").isin(chosen) if chosen else F.lit(False)).orderBy(*by)
    page = (held.offset(offset) if offset else held).limit(rows).select(F.col("id").alias(key))
    return df.join(page, key, "left_semi").select(*df.columns).orderBy(_order(column, direction), F.asc(key))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in df.schema)


def page_info(total: DataFrame, page: int | None = None, limit: int | None = None) -> DataFrame:
    """Page size, current page and total records beside a one-row count."""
    return total.select(
        F.lit(limit or DEFAULT_ROWS).cast("bigint").alias("page_size"),
        F.lit(page or 1).cast("bigint").alias("current_page"),
        F.col("total_record"),
    )
