"""Counts over jobs and queue rows.

Only counts are asked for, so every query is a partial count in the scan's stage
followed by a shuffle of one row per group and task: a job or hour that holds a
third of all rows weighs no more there than any other.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.predicates import all_of, created_within
from runledger.model import IN_FLIGHT_STATUSES, LIVE_STATUSES, MATRIX_STATUSES
from runledger.sources.tables import JobTables


def _count_by(df: DataFrame, column: str, alias: str = "total_count") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(alias))


def job_status_counts(tables: JobTables) -> DataFrame:
    return _count_by(tables.source_job, "job_status")


def job_running_counts(tables: JobTables) -> DataFrame:
    live = tables.source_job.where(F.col("job_running_status").isin(*LIVE_STATUSES))
    return _count_by(live, "job_running_status")


def runs_by_weekday(tables: JobTables, start: str | date, end: str | date) -> DataFrame:
    """Queue rows per weekday; the weeks of the range are added up."""
    rows = created_within(tables.job_queue, start, end)
    by_day = rows.groupBy(F.to_date("date_created").alias("day")).agg(F.count("*").alias("runs"))
    return by_day.groupBy(F.date_format("day", "EEE").alias("daycode")).agg(F.sum("runs").alias("total_count"))


def runs_by_weekday_hour(tables: JobTables, start: str | date, end: str | date) -> DataFrame:
    """Queue rows per date and hour, with the date's weekday name."""
    created = F.col("date_created")
    counts = (
        created_within(tables.job_queue, start, end)
        .groupBy(F.to_date(created).alias("date"), F.hour(created).cast("bigint").alias("hr"))
        .agg(F.count("*").alias("total_count"))
    )
    return counts.select(F.date_format("date", "EEEE").alias("daycode"), "hr", "date", "total_count")


def _matrix_counts() -> list[Column]:
    per_status = [
        F.count(F.when(F.col("job_status") == status, F.lit(1))).alias(status.lower()) for status in MATRIX_STATUSES
    ]
    return [*per_status, F.count("*").alias("total")]


MATRIX_COLUMNS = [*(status.lower() for status in MATRIX_STATUSES), "total"]


def _counts_of_known_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts per job, then the job's name: the join sees one row per job."""
    counts = rows.groupBy("job_id").agg(*_matrix_counts())
    return counts.join(jobs.select("job_id", "job_name"), "job_id").select("job_id", "job_name", *MATRIX_COLUMNS)


def run_status_matrix(tables: JobTables, day: str | date, hour: int) -> DataFrame:
    """Counts by status of each job in one hour, and a last row with their totals.

    The total row has no job and is there, with zeros, even if nothing ran.
    """
    rows = created_within(tables.job_queue, day, day, hour)
    per_job = _counts_of_known_jobs(rows, tables.source_job)
    totals = per_job.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in MATRIX_COLUMNS))
    totals = totals.withColumns({"job_id": F.lit(None).cast("bigint"), "job_name": F.lit(None).cast("string")})
    return per_job.unionByName(totals).orderBy(F.asc_nulls_last("job_id"))


def job_run_statistics(tables: JobTables, job_id: int | None = None) -> DataFrame:
    """The same counts over all time: of one job, which may be zeros, or of every job that ran."""
    if job_id is None:
        return _counts_of_known_jobs(tables.job_queue, tables.source_job).drop("job_name")
    known = tables.source_job.where(F.col("job_id") == job_id).select("job_id")
    rows = tables.job_queue.where(F.col("job_id") == job_id).join(known, "job_id", "left_semi")
    return rows.agg(*_matrix_counts()).select(F.lit(job_id).cast("bigint").alias("job_id"), *MATRIX_COLUMNS)


def queue_status_counts(tables: JobTables) -> DataFrame:
    """Over the whole queue; the log search shows these beside any filter."""
    return _count_by(tables.job_queue, "job_status")


def tasks_per_type(tables: JobTables) -> DataFrame:
    """Every task type with the number of its tasks, zero included."""
    linked = _count_by(tables.source_task, "source_task_type_id", "linked")
    types = tables.source_task_type.join(linked, "source_task_type_id", "left")
    return types.select(
        "source_task_type_id",
        "description",
        "task_type_status",
        "queue_topic_partition",
        "service_name",
        F.coalesce("linked", F.lit(0)).alias("total_task_link"),
        "is_schema_register",
        "schema_payload",
    ).orderBy("source_task_type_id")


def in_flight_per_job(tables: JobTables) -> DataFrame:
    """Unfinished rows per job, from the queue's open days where these are known."""
    waiting = tables.unfinished_rows().where(F.col("job_status").isin(*IN_FLIGHT_STATUSES))
    return _count_by(waiting, "job_id", "in_flight")


def runs_per_job(tables: JobTables) -> DataFrame:
    return _count_by(tables.job_queue, "job_id", "runs")


def queue_log(
    tables: JobTables,
    start: str | date,
    end: str | date,
    job_ids: list[int] | None = None,
    queue_ids: list[int] | None = None,
    statuses: list[str] | None = None,
) -> DataFrame:
    """Queue rows of a date range, newest first. Both dates are required."""
    if not start or not end:
        raise ValueError("queue_log needs a start and an end date")
    wanted = all_of(
        F.col("job_id").isin(job_ids) if job_ids else None,
        F.col("job_queue_id").isin(queue_ids) if queue_ids else None,
        F.col("job_status").isin(statuses) if statuses else None,
    )
    return created_within(tables.job_queue, start, end).where(wanted).orderBy(F.desc("job_queue_id"))


def run_detail(
    tables: JobTables,
    day: str | date | None = None,
    hour: int | None = None,
    job_id: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """Queue rows of known jobs behind a cell of the dashboard, newest first."""
    wanted = all_of(
        F.col("job_id") == job_id if job_id is not None else None,
        F.col("job_status") == status if status else None,
    )
    known = tables.source_job.select("job_id")
    rows = created_within(tables.job_queue, day, day, hour).where(wanted)
    return rows.join(known, "job_id", "left_semi").orderBy(F.desc("job_queue_id"))
