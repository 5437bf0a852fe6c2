"""Starting stream queries and reading what their batches wrote."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from runledger.model import DAY_COLUMN

BATCH_COLUMN = "batch_no"
# So many folders of one level are merged into one of the next.
FANOUT = 8
# The day folder of rows without a time of their own.
NO_DAY = "1970-01-01"


def batch_path(output: str, batch_no: int) -> str:
    return os.path.join(output, f"{BATCH_COLUMN}={batch_no}")


def start(writer: DataStreamWriter, output: str, available_now: bool, interval: str) -> StreamingQuery:
    """Start a query with its checkpoint beside its output folder."""
    writer = writer.option("checkpointLocation", f"{output}-checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def start_batches(
    stream: DataFrame,
    step: Callable[[DataFrame, int], None],
    output: str,
    available_now: bool = False,
    interval: str = "60 seconds",
    mode: str = "append",
) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``step``."""
    return start(stream.writeStream.outputMode(mode).foreachBatch(step), output, available_now, interval)


def write_new_rows(batch: DataFrame, output: str, batch_no: int, key: str, schema: str, created: str) -> None:
    """Write the batch's rows that no earlier batch wrote, each key once.

    Rows are laid out by the day they were created, and a repeat is looked for among the
    days of the batch alone - however old they are, so a late row is as good as any other.
    A batch that is repeated overwrites what it wrote.
    """
    spark = batch.sparkSession
    day = F.coalesce(F.to_date(created), F.lit(NO_DAY).cast("date"))
    rows = batch.dropDuplicates([key]).withColumn(DAY_COLUMN, day)
    if batch_no > 0:
        # One row per day, so they may come to the driver; the filter prunes all other days' folders.
        days = [row[0] for row in rows.select(DAY_COLUMN).distinct().collect()]
        if days:
            earlier = read_batches(spark, output, f"{schema}, {DAY_COLUMN} date")
            earlier = earlier.where(F.col(DAY_COLUMN).isin(days) & (F.col(BATCH_COLUMN) < batch_no))
            rows = rows.join(earlier.select(key, DAY_COLUMN), [key, DAY_COLUMN], "left_anti")
    rows.write.mode("overwrite").partitionBy(DAY_COLUMN).parquet(batch_path(output, batch_no))


def read_batches(spark: SparkSession, output: str, schema: str) -> DataFrame:
    """Everything the batches wrote, with the number of the batch."""
    return spark.read.schema(f"{schema}, {BATCH_COLUMN} bigint").parquet(output)


def _level_path(output: str, level: int, number: int) -> str:
    return batch_path(output if level == 0 else os.path.join(f"{output}-merged", f"level={level}"), number)


def _complete(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in names_in(spark, path)


def write_partials(
    rows: DataFrame, output: str, batch_no: int, merge: Callable[[DataFrame], DataFrame], fanout: int = FANOUT
) -> None:
    """Write a batch's partial results, and merge the last ``fanout`` folders of a level into one of the next.

    What is merged stays where it is, so a reader never meets a gap, and a repeated batch writes
    and merges the same again. ``merge`` keeps the columns of ``rows``, in its own order of merging.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(batch_path(output, batch_no))
    level, number = 0, batch_no
    while (number + 1) % fanout == 0:
        parts = [_level_path(output, level, number - back) for back in range(fanout)]
        if not all(_complete(spark, part) for part in parts):
            return
        level, number = level + 1, (number + 1) // fanout - 1
        merge(spark.read.schema(rows.schema).parquet(*parts)).write.mode("overwrite").parquet(_level_path(output, level, number))


def live_folders(spark: SparkSession, output: str, fanout: int = FANOUT) -> list[str]:
    """The fewest finished folders that together hold each batch once: ``fanout`` - 1 a level at most.

    A merge that is not finished counts as absent, and its parts stand for it.
    """
    numbers = [int(name.split("=")[1]) for name in names_in(spark, output) if name.startswith(f"{BATCH_COLUMN}=")]
    after, at, found = max(numbers, default=-1) + 1, 0, []
    while at < after:
        level = 0
        while at % fanout ** (level + 1) == 0 and at + fanout ** (level + 1) <= after:
            level += 1
        while not _complete(spark, path := _level_path(output, level, at // fanout**level)):
            if level == 0:
                return found  # being written
            level -= 1
        found.append(path)
        at += fanout**level
    return found


def read_partials(spark: SparkSession, output: str, schema: str, fanout: int = FANOUT) -> DataFrame:
    """The partial results of all batches, merged as far as they are."""
    folders = live_folders(spark, output, fanout)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders of a folder; none if it does not exist."""
    files, folder = _folder(spark, path)
    return [found.getPath().getName() for found in files.listStatus(folder)] if files.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)
