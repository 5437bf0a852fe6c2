"""The days of a queue table that still hold unfinished rows, kept beside the table.

A queue keeps all its history, and what is in flight is on few of its days. The index has one
row per such day; whoever asks for unfinished rows opens those day folders alone. The change
writer keeps it: days it is about to touch are listed before the table changes and counted
after, so a write that breaks off leaves days too many, never one too few.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.model import DAY_COLUMN, IN_FLIGHT_STATUSES, JOB_QUEUE

# The folder of rows without a creation time.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
INDEX_SCHEMA = f"{DAY_COLUMN} date, open_rows bigint"


def _index(location: str) -> str:
    return f"{location.rstrip('/')}-open-days"


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def _versions(spark: SparkSession, location: str) -> list[int]:
    """The finished versions of an index, oldest first."""
    files, folder = _folder(spark, _index(location))
    if not files.exists(folder):
        return []
    names = [found.getPath().getName() for found in files.listStatus(folder)]
    numbers = sorted(int(name.split("=")[1]) for name in names if name.startswith("version="))
    return [number for number in numbers if _exists(spark, os.path.join(_index(location), f"version={number}", "_SUCCESS"))]


def _write(days: DataFrame, location: str) -> None:
    """A new version; the last one stays for readers that have it open."""
    spark = days.sparkSession
    before = _versions(spark, location)
    number = before[-1] + 1 if before else 0
    days.select(DAY_COLUMN, "open_rows").coalesce(1).write.mode("overwrite").parquet(os.path.join(_index(location), f"version={number}"))
    for old in before[:-1]:
        files, folder = _folder(spark, os.path.join(_index(location), f"version={old}"))
        files.delete(folder, True)


def _unfinished() -> Column:
    return F.col("job_status").isin(*IN_FLIGHT_STATUSES)


def _counted(queue: DataFrame) -> DataFrame:
    return queue.where(_unfinished()).groupBy(DAY_COLUMN).agg(F.count("*").alias("open_rows"))


def _queue(spark: SparkSession, location: str, fmt: str) -> DataFrame:
    return spark.read.schema(f"{JOB_QUEUE}, {DAY_COLUMN} date").format(fmt).load(location)


def index_open_days(spark: SparkSession, location: str, fmt: str = "parquet") -> None:
    """Make a queue table's index from its rows."""
    _write(_counted(_queue(spark, location, fmt)), location)


def drop_index(spark: SparkSession, location: str) -> None:
    files, folder = _folder(spark, _index(location))
    files.delete(folder, True)


def open_days(spark: SparkSession, location: str) -> DataFrame | None:
    """Days with unfinished rows and how many each has, or nothing where there is no index."""
    versions = _versions(spark, location)
    if not versions:
        return None
    return spark.read.schema(INDEX_SCHEMA).parquet(os.path.join(_index(location), f"version={versions[-1]}"))


def open_rows(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """The unfinished rows of a written queue; with an index, only days that have some are opened.

    The days are looked up when this is called: open it anew after a change.
    """
    listed = open_days(spark, location)
    if listed is None:
        return _queue(spark, location, fmt).where(_unfinished()).drop(DAY_COLUMN)
    # One row per day, so they may come to the driver. Folders of other days are not even listed.
    names = [row[0].isoformat() if row[0] else _NO_DAY for row in listed.select(DAY_COLUMN).collect()]
    paths = [os.path.join(location, f"{DAY_COLUMN}={name}") for name in names]
    there = [path for path in paths if _exists(spark, path)]
    if not there:
        return spark.createDataFrame([], JOB_QUEUE.replace(" not null", ""))
    reader = spark.read.schema(f"{JOB_QUEUE}, {DAY_COLUMN} date").format(fmt).option("basePath", location)
    return reader.load(there).where(_unfinished()).drop(DAY_COLUMN)


def announce(spark: SparkSession, location: str, touched: DataFrame) -> None:
    """List the days that are about to change beside those listed already; nothing without an index."""
    listed = open_days(spark, location)
    if listed is not None:
        new = touched.select(DAY_COLUMN, F.lit(None).cast("bigint").alias("open_rows"))
        _write(listed.unionByName(new).groupBy(DAY_COLUMN).agg(F.max("open_rows").alias("open_rows")), location)


def settle(spark: SparkSession, location: str, touched: DataFrame, rows: DataFrame) -> None:
    """Count the changed days anew from their rows; nothing without an index."""
    listed = open_days(spark, location)
    if listed is not None:
        same = listed[DAY_COLUMN].eqNullSafe(touched[DAY_COLUMN])
        kept = listed.join(touched.select(DAY_COLUMN), same, "left_anti")
        _write(kept.unionByName(_counted(rows)), location)
