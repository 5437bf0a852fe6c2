"""Dispatching waiting queue rows: taken in as they arrive, sent step by step.

Rows taken in are segments that are never changed, one per batch. Steps work in eras: an era
starts with a mark, up to which all segments are behind it, and the few rows of those that were
still waiting. A step opens the rows carried over, the segments above the mark and what its own
era planned. Once at least half of the opened rows are planned, the rest is carried into a new
era. So a step reads at most about twice the rows that wait, however many were ever sent, and
each row is carried less than once for each row planned.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.model import DAY_COLUMN, JOB_QUEUE
from runledger.operators.dispatch import dispatch_plan, planned_records, waiting_rows
from runledger.sources.tables import JobTables
from runledger.streaming.runs import BATCH_COLUMN, batch_path, names_in, remove, start_batches, write_new_rows

PLAN_SCHEMA = (
    "job_queue_id bigint, job_id bigint, outcome string, failure_text string, topic string, partition int,"
    " key string, value string"
)
_QUEUE_COLUMNS = tuple(part.split()[0] for part in JOB_QUEUE.split(", "))
MARK_SCHEMA = "mark bigint, steps string, last bigint"
# Steps of a timer and steps asked for are numbered apart, so neither overwrites the other.
TIMER, ASKED = "timer", "asked"

Tables = Callable[[], JobTables]


def start_intake(queue_rows: DataFrame, output: str, available_now: bool = False) -> StreamingQuery:
    """Keep every waiting row of a stream once; a row seen again, however late, changes nothing."""
    rows = waiting_rows(queue_rows).select(*_QUEUE_COLUMNS)

    def step(batch: DataFrame, batch_no: int) -> None:
        write_new_rows(batch, os.path.join(output, "waiting"), batch_no, "job_queue_id", JOB_QUEUE, "date_created")

    return start_batches(rows, step, os.path.join(output, "waiting"), available_now)


def _written(spark: SparkSession, output: str) -> DataFrame:
    """Everything planned so far, with its era and the kind and number of its step."""
    path = os.path.join(output, "plan")
    spark.createDataFrame([], PLAN_SCHEMA).write.mode("ignore").parquet(batch_path(os.path.join(path, "era=0", "steps=none"), 0))
    return spark.read.schema(f"{PLAN_SCHEMA}, era bigint, steps string, batch_no bigint").parquet(path)


@dataclass(frozen=True)
class Era:
    """Where the steps stand: segments up to ``mark`` are behind, ``last`` has the highest step of each kind by then."""

    number: int
    mark: int
    last: dict[str, int]


def _numbers(spark: SparkSession, path: str, label: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in names_in(spark, path) if name.startswith(f"{label}="))


def _era_path(output: str, number: int, part: str = "") -> str:
    return os.path.join(output, "eras", f"era={number}", part)


def current_era(spark: SparkSession, output: str) -> Era:
    """The newest era whose marks are written; rows carried by one that was not finished do not count."""
    for number in reversed(_numbers(spark, os.path.join(output, "eras"), "era")):
        marks = _era_path(output, number, "marks")
        if "_SUCCESS" in names_in(spark, marks):
            found = spark.read.schema(MARK_SCHEMA).parquet(marks).collect()  # one row per kind of step
            return Era(number, found[0]["mark"], {row["steps"]: row["last"] for row in found})
    return Era(0, -1, {})


def _opened(spark: SparkSession, output: str, era: Era) -> tuple[DataFrame, int]:
    """The rows an era still has to look at, and its newest segment.

    A segment that is being written ends the list: it and what follows are for a later step.
    """
    waiting = os.path.join(output, "waiting")
    ready: list[int] = []
    for number in _numbers(spark, waiting, BATCH_COLUMN):
        if number > era.mark:
            if "_SUCCESS" not in names_in(spark, batch_path(waiting, number)):
                break
            ready.append(number)
    rows = spark.createDataFrame([], JOB_QUEUE.replace(" not null", ""))
    if ready:
        reader = spark.read.schema(f"{JOB_QUEUE}, {DAY_COLUMN} date, {BATCH_COLUMN} bigint").option("basePath", waiting)
        rows = reader.parquet(*(batch_path(waiting, number) for number in ready)).select(*_QUEUE_COLUMNS)
    if era.number:
        rows = rows.union(spark.read.schema(JOB_QUEUE).parquet(_era_path(output, era.number, "rows")).select(*_QUEUE_COLUMNS))
    return rows, ready[-1] if ready else era.mark


def _planned(spark: SparkSession, output: str, era: Era) -> DataFrame:
    """What the steps of an era have planned."""
    path = os.path.join(output, "plan", f"era={era.number}")
    schema = f"{PLAN_SCHEMA}, steps string, batch_no bigint"
    if not names_in(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def unsent_rows(spark: SparkSession, output: str) -> DataFrame:
    """Rows taken in that no step has planned yet."""
    era = current_era(spark, output)
    return _opened(spark, output, era)[0].join(_planned(spark, output, era).select("job_queue_id"), "job_queue_id", "left_anti")


def _carry(spark: SparkSession, output: str, era: Era, opened: DataFrame, top: int) -> None:
    """Begin a new era with the rows that still wait; the one before the last is no longer needed."""
    planned = _planned(spark, output, era)
    left = opened.join(planned.select("job_queue_id"), "job_queue_id", "left_anti")
    left.select(*_QUEUE_COLUMNS).write.mode("overwrite").parquet(_era_path(output, era.number + 1, "rows"))
    last = era.last | {row["steps"]: row["last"] for row in planned.groupBy("steps").agg(F.max("batch_no").alias("last")).collect()}
    marks = [(top, steps, number) for steps, number in sorted(last.items())]
    spark.createDataFrame(marks, MARK_SCHEMA).coalesce(1).write.mode("overwrite").parquet(_era_path(output, era.number + 1, "marks"))
    if era.number > 1:
        remove(spark, _era_path(output, era.number - 1))


def dispatch_step(
    spark: SparkSession,
    output: str,
    open_tables: Tables,
    limit: int | None = None,
    by_priority: bool = False,
    steps: str = ASKED,
    number: int | None = None,
) -> int:
    """Plan the first ``limit`` unsent rows, by id or by priority first, and write their records.

    Gives the number of rows taken. Steps run one after the other, and those of a kind in
    ascending numbers. A step repeated with its number plans anew only what it had planned, and
    nothing once its era is over. The job tables are opened in every step, so a job switched off
    meanwhile is not sent.
    """
    era = current_era(spark, output)
    planned = _planned(spark, output, era)
    if number is None:
        here = planned.where(F.col("steps") == steps).agg(F.max("batch_no")).head()[0] or 0
        number = max(here, era.last.get(steps, 0)) + 1
    elif number <= era.last.get(steps, -1):
        return _written(spark, output).where((F.col("steps") == steps) & (F.col("batch_no") == number)).count()
    tables = open_tables()
    others = planned.where((F.col("steps") != steps) | (F.col("batch_no") != number)).select("job_queue_id")
    opened, top = _opened(spark, output, era)
    rows = opened.join(others, "job_queue_id", "left_anti")
    if limit is not None and by_priority:
        priorities = tables.source_job.select("job_id", "priority")
        rows = rows.join(priorities, "job_id", "left").orderBy(F.asc_nulls_last("priority"), "job_queue_id").limit(limit).drop("priority")
    elif limit is not None:
        rows = rows.orderBy("job_queue_id").limit(limit)
    target = batch_path(os.path.join(output, "plan", f"era={era.number}", f"steps={steps}"), number)
    planned_records(dispatch_plan(rows, tables)).write.mode("overwrite").parquet(target)
    taken = spark.read.schema(PLAN_SCHEMA).parquet(target).count()
    # Both counts come from the files' footers.
    seen = opened.count()
    if taken and 2 * (seen - _planned(spark, output, era).count()) <= seen:
        _carry(spark, output, era, opened, top)
    return taken


def start_steps(
    spark: SparkSession, output: str, open_tables: Tables, limit: int | None = None, by_priority: bool = False, interval: str = "60 seconds"
) -> StreamingQuery:
    """A step at every interval, whether or not new rows have come."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(batch: DataFrame, batch_no: int) -> None:
        dispatch_step(batch.sparkSession, output, open_tables, limit, by_priority, TIMER, batch_no)

    return start_batches(clock, step, os.path.join(output, "steps"), interval=interval)


def send_all(spark: SparkSession, output: str, open_tables: Tables, limit: int | None = None, by_priority: bool = False) -> int:
    """Steps until no row is left; gives their number."""
    done = 0
    while dispatch_step(spark, output, open_tables, limit, by_priority):
        done += 1
    return done


def plans_so_far(spark: SparkSession, output: str) -> DataFrame:
    """Outcome of every row taken so far, with the record of those sent."""
    return _written(spark, output)


def records_so_far(spark: SparkSession, output: str) -> DataFrame:
    """The records of all steps, as a sink takes them."""
    sent = plans_so_far(spark, output).where("outcome = 'sent'")
    return sent.select("job_queue_id", "topic", "partition", "key", "value")
