"""One loader and writer for the job tables, whatever format holds them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.model import DAILY_TABLES, DAY_COLUMN, TABLE_SCHEMAS
from runledger.session import work_path
from runledger.sources import open_days


class JobTables:
    """The job tables, each opened the first time it is used.

    ``tables.job_queue`` and the like are DataFrames. Operators take the whole set
    and touch only what they need, so a query opens no file it does not read.
    """

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, **frames: DataFrame) -> "JobTables":
        return cls({name: (lambda frame=frame: frame) for name, frame in frames.items()})

    def replacing(self, **frames: DataFrame) -> "JobTables":
        """The same set with some tables exchanged; another queue has other unfinished rows."""
        kept = {name: opener for name, opener in self._openers.items() if name != "open_queue" or "job_queue" not in frames}
        return JobTables({**kept, **JobTables.of(**frames)._openers})

    def unfinished_rows(self) -> DataFrame:
        """A frame with all unfinished rows of the queue: those of its open days, or the whole queue."""
        return self.open_queue if "open_queue" in self._openers else self.job_queue

    def names(self) -> list[str]:
        return sorted(self._openers)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._openers:
            raise AttributeError(f"no table named {name}")
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]


def read_table(
    spark: SparkSession,
    name: str,
    location: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Open one job table.

    ``fmt`` is ``table`` for a catalog table, ``jdbc`` for a database (``location``
    is then the table name there) or any file format. Files get the known schema, so
    nothing is inferred. For ``jdbc`` give ``partitionColumn`` with its bounds to read
    a large table in parallel.
    """
    options = dict(options or {})
    if fmt == "table":
        return spark.read.table(location)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        if "preferTimestampNTZ" not in options:
            reader = reader.option("preferTimestampNTZ", "true")
        return reader.option("dbtable", location).load()
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
        reader = reader.option("enforceSchema", options.get("enforceSchema", "false"))
    return reader.schema(TABLE_SCHEMAS[name]).load(location)


def read_tables(
    spark: SparkSession,
    base: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    names: tuple[str, ...] = tuple(TABLE_SCHEMAS),
) -> JobTables:
    """All job tables below one folder (``base/<name>``) or schema (``base.<name>``)."""
    separator = "." if fmt in ("table", "jdbc") else "/"

    def opener(name: str) -> Callable[[], DataFrame]:
        return lambda: read_table(spark, name, f"{base}{separator}{name}", fmt, options)

    openers = {name: opener(name) for name in names}
    if fmt == "parquet" and "job_queue" in names:
        openers["open_queue"] = lambda: open_days.open_rows(spark, f"{base}/job_queue")
    return JobTables(openers)


def write_table(df: DataFrame, name: str, location: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write one job table; tables that only grow are split by creation day.

    Rows are rebalanced by day before the write: small days share a task and a day that
    holds a third of the rows is split over many. Overwriting replaces the days given.
    A whole table can't be overwritten by rows read from it: see ``write_changes``. A queue's
    index of open days is dropped; make it again with ``index_open_days``.
    """
    if mode == "overwrite" and name not in DAILY_TABLES and _reads_from(df, location):
        raise ValueError(f"{name} at {location} is read by the rows to be written; use write_changes")
    if name not in DAILY_TABLES:
        df.write.mode(mode).format(fmt).save(location)
        return
    if name == "job_queue":
        open_days.drop_index(df.sparkSession, location)
    _write_days(df, location, fmt, mode)


def _write_days(df: DataFrame, location: str, fmt: str, mode: str = "overwrite") -> None:
    dated = df.withColumn(DAY_COLUMN, F.to_date("date_created")).hint("rebalance", DAY_COLUMN)
    writer = dated.write.mode(mode).format(fmt).partitionBy(DAY_COLUMN)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(location)


def replace_rows(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The table after a change set: changed rows replace those with their key, new keys are added."""
    if DAY_COLUMN in current.columns and DAY_COLUMN not in changed.columns:
        changed = changed.withColumn(DAY_COLUMN, F.to_date("date_created"))
    kept = current.join(changed.select(key), key, "left_anti")
    return kept.unionByName(changed.select(current.columns))


def _reads_from(df: DataFrame, location: str) -> bool:
    base = location.rstrip("/").removeprefix("file:").replace("//", "/") + "/"
    return any(base in file.replace("//", "/") for file in df.inputFiles())


def _last_changes(changed: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the one with the highest ``order``. Without an order, a key that is changed twice is refused."""
    if order is None:
        if not changed.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"several changes of one {key}: name a column that orders them")
        return changed
    row = F.struct(*changed.columns)
    return changed.groupBy(F.col(key).alias("of")).agg(F.max_by(row, F.col(order)).alias("row")).select("row.*")


def write_changes(
    spark: SparkSession, changed: DataFrame, name: str, location: str, key: str, fmt: str = "parquet", order: str | None = None
) -> None:
    """Merge a change set into a written table; the change set may be computed from that table.

    Of several changes of a key the one with the highest ``order`` counts, a column of the change
    set that need not be one of the table; without ``order`` they are refused before anything is
    written. No file is overwritten while it is read. The change set, then the rows it touches,
    are written to the shared folder first. A table laid out by day gets only the days with
    changed rows anew, and a day that has lost its last row is dropped after that: until then
    readers see such a row on both days, and a write that ends there is completed by writing the
    same change set again. A queue's index of open days is kept up to date. Any other table gets a new version beside the old one, and the two
    change places at the end. A write that fails before that leaves the table as it was.
    """
    current = read_table(spark, name, location, fmt)
    columns = [field.name for field in current.schema if field.name != DAY_COLUMN]
    staged = work_path(spark, f"{name}-changes")
    wanted = columns if order is None or order in columns else [*columns, order]
    changed.select(wanted).write.parquet(staged)
    changed = _last_changes(spark.read.schema(changed.select(wanted).schema).parquet(staged), key, order)
    changed = changed.select(*(F.col(field.name).cast(field.dataType) for field in current.select(columns).schema))
    if name in DAILY_TABLES:
        current = spark.read.schema(f"{TABLE_SCHEMAS[name]}, {DAY_COLUMN} date").format(fmt).load(location)
        changed = changed.withColumn(DAY_COLUMN, F.to_date("date_created"))
        old_days = current.join(changed.select(key), key, "left_semi").select(DAY_COLUMN)
        days = old_days.union(changed.select(DAY_COLUMN)).distinct()
        merged = replace_rows(current.join(days, DAY_COLUMN, "left_semi"), changed, key)
        # One row per day, so they may come to the driver.
        left = merged.select(DAY_COLUMN).distinct()
        emptied = [row[0] for row in days.join(left, DAY_COLUMN, "left_anti").collect()]
    else:
        merged = replace_rows(current, changed, key)
    whole = work_path(spark, f"{name}-merged")
    merged.select(columns).write.parquet(whole)
    ready = spark.read.schema(merged.select(columns).schema).parquet(whole)
    if name in DAILY_TABLES:
        if name == "job_queue":
            # The days of the rows to be written and those that lose their last row.
            lost = spark.createDataFrame([(day,) for day in emptied], f"{DAY_COLUMN} date")
            fresh = ready.withColumn(DAY_COLUMN, F.to_date("date_created"))
            touched = fresh.select(DAY_COLUMN).distinct().union(lost)
            open_days.announce(spark, location, touched)
        _write_days(ready, location, fmt)
        _drop_days(spark, location, emptied)
        if name == "job_queue":
            open_days.settle(spark, location, touched, fresh)
        return
    version = f"{location.rstrip('/')}.new-{uuid.uuid4().hex}"
    ready.write.format(fmt).save(version)
    _change_places(spark, version, location)


def _drop_days(spark: SparkSession, location: str, days: list) -> None:
    """Remove the folders of days that have no rows any more."""
    for day in filter(None, days):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}/{DAY_COLUMN}={day.isoformat()}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _change_places(spark: SparkSession, version: str, location: str) -> None:
    """Put a finished version in a table's place; the old one goes only after that."""
    jvm = spark._jvm
    new, here = jvm.org.apache.hadoop.fs.Path(version), jvm.org.apache.hadoop.fs.Path(location)
    old = jvm.org.apache.hadoop.fs.Path(f"{location.rstrip('/')}.old-{uuid.uuid4().hex}")
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(here, old):
        raise OSError(f"{location} can't be moved")
    if not files.rename(new, here):
        files.rename(old, here)
        raise OSError(f"{version} can't be moved")
    files.delete(old, True)
