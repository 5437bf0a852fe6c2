"""Schedules laid out by the time of their next run, in coarse and fine buckets.

Whoever looks for due schedules opens the buckets of the window alone, and an advance moves
only schedules that ran: buckets without one of them, old or new, keep their files.
"""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.functions.predicates import moment
from runledger.model import SCHEDULER
from runledger.operators.schedule import due_by_time, schedule_advance
from runledger.session import work_path

# The first characters of a time's label that name its bucket. No label has a colon, for it names a folder.
BUCKETS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH"}
COARSE, FINE = "due_coarse", "due_fine"
_SCHEMA = f"{SCHEDULER}, {COARSE} string, {FINE} string"

When = str | datetime


class DueWheel:
    """A written table of schedules in buckets; schedules without a next run have one of their own.

    ``coarse`` and ``fine`` are units of ``BUCKETS``, the same whenever a location is opened.
    """

    def __init__(self, spark: SparkSession, location: str, coarse: str = "day", fine: str = "hour"):
        if list(BUCKETS).index(coarse) >= list(BUCKETS).index(fine):
            raise ValueError(f"buckets of a {fine} are not finer than those of a {coarse}")
        self.spark, self.location = spark, location.rstrip("/")
        self._journal = f"{self.location}-moves"
        self._moves_schema = f"{_SCHEMA}, old_coarse string, old_fine string".replace(" not null", "")
        self._formats = {COARSE: BUCKETS[coarse], FINE: BUCKETS[fine]}

    def _label(self, name: str, time: Column) -> Column:
        return F.date_format(time, self._formats[name])

    def _placed(self, schedules: DataFrame) -> DataFrame:
        return schedules.withColumns({name: self._label(name, F.col("recurrence_time")) for name in (COARSE, FINE)})

    def _write(self, placed: DataFrame) -> None:
        """Replace the buckets of the rows by the rows; a full bucket is written by many tasks."""
        rows = placed.hint("rebalance", COARSE, FINE)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(COARSE, FINE).parquet(self.location)

    def write(self, schedules: DataFrame) -> None:
        """Lay out all schedules at a new location."""
        schedules.transform(self._placed).hint("rebalance", COARSE, FINE).write.partitionBy(COARSE, FINE).parquet(self.location)

    def _folder(self, *below: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.location, *below))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, folders: list[str]) -> DataFrame:
        """The rows below some folders; others are not listed."""
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA.replace(" not null", ""))
        paths = [os.path.join(self.location, folder) for folder in folders]
        return self.spark.read.schema(_SCHEMA).option("basePath", self.location).parquet(*paths)

    def schedules(self) -> DataFrame:
        """All schedules."""
        return self.spark.read.schema(_SCHEMA).parquet(self.location).drop(COARSE, FINE)

    def _in_window(self, last_run: When, now: When) -> DataFrame:
        # A single row of labels; folder names are compared as the labels sort by time.
        ends = [self._label(COARSE, moment(time)) for time in (last_run, now)]
        low, high = self.spark.range(1).select(*(end.alias(f"c{n}") for n, end in enumerate(ends))).first()
        files, root = self._folder()
        names = [found.getPath().getName() for found in files.listStatus(root)]
        wanted = [name for name in names if name.startswith(f"{COARSE}=") and low <= name.split("=", 1)[1] <= high]
        fine = F.col(FINE).between(self._label(FINE, moment(last_run)), self._label(FINE, moment(now)))
        return due_by_time(self._read(wanted).where(fine), last_run, now, strict=False)

    def due(self, last_run: When, now: When) -> DataFrame:
        """Schedules with a run from the last check to now, both included; only their buckets are opened."""
        return self._in_window(last_run, now).drop(COARSE, FINE)

    def advance(self, last_run: When, now: When) -> None:
        """Move the schedules due in a window to their next run; those without one stay.

        The moves are written beside the wheel before any bucket changes. If an advance breaks
        off, ``mend`` or the next advance completes it; until then a schedule may stand in two buckets.
        """
        self.mend()
        self._moves(last_run, now).write.mode("overwrite").parquet(self._journal)
        self.mend()

    def mend(self) -> None:
        """Complete an advance that broke off after its moves were written; else nothing."""
        if not self._exists(os.path.join(self._journal, "_SUCCESS")):
            return
        moved = self.spark.read.schema(self._moves_schema).parquet(self._journal)
        froms = moved.select(F.col("old_coarse").alias(COARSE), F.col("old_fine").alias(FINE)).distinct()
        gaining = moved.select(COARSE, FINE).distinct()
        # One row per bucket, so they may come to the driver.
        gains = [tuple(row) for row in gaining.collect()]
        losses = sorted({tuple(row) for row in froms.collect()}.difference(gains))
        arrived = moved.drop("old_coarse", "old_fine")
        left = self._left(gains, moved).unionByName(arrived.select(self._read([]).columns))
        # Buckets that gain schedules are written before buckets that only lose some: none is missing in between.
        if gains:
            self._write(self._stored(left, "due-gained"))
        if losses:
            rest = self._stored(self._left(losses, moved), "due-kept")
            kept = {tuple(row) for row in rest.select(COARSE, FINE).distinct().collect()}
            self._write(rest)
            for bucket in set(losses).difference(kept):
                files, folder = self._folder(self._name(bucket))
                files.delete(folder, True)
        files, journal = self._folder(self._journal)
        files.delete(journal, True)

    def _moves(self, last_run: When, now: When) -> DataFrame:
        due = self._in_window(last_run, now).withColumnsRenamed({COARSE: "old_coarse", FINE: "old_fine"})
        moved = self._placed(schedule_advance(due).where(~F.col("exhausted")).drop("exhausted"))
        return moved.select(*self._read([]).columns, "old_coarse", "old_fine")

    def _left(self, buckets: list[tuple[str, str]], moved: DataFrame) -> DataFrame:
        """The rows of some buckets without the moved schedules."""
        there = [name for name in map(self._name, buckets) if self._exists(name)]
        return self._read(there).join(moved.select("scheduler_id"), "scheduler_id", "left_anti")

    def _exists(self, name: str) -> bool:
        files, folder = self._folder(name)
        return files.exists(folder)

    @staticmethod
    def _name(bucket: tuple[str, str]) -> str:
        return os.path.join(f"{COARSE}={bucket[0]}", f"{FINE}={bucket[1]}")

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
