"""Flat exports with text cells, and their writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from runledger.functions.texts import flag_text, iso_text, stamp_text, text_of
from runledger.operators.details import primary_schedules
from runledger.sources.tables import JobTables


def job_report(tables: JobTables) -> DataFrame:
    """Every job as 15 text cells: blank where there is no value."""
    tasks = tables.source_task.select("task_detail_id", "task_name")
    schedules = primary_schedules(
        tables.scheduler, ("start_date", "end_date", "start_time", "recurrence_time")
    )
    jobs = tables.source_job.join(tasks, "task_detail_id", "left").join(schedules, "job_id", "left")
    return jobs.select(
        text_of(F.col("job_name")).alias("job_name"),
        F.format_string("%d [%s]", "task_detail_id", "task_name").alias("task"),
        F.col("execution"),
        F.col("priority").cast("string").alias("priority"),
        F.col("job_status").alias("status"),
        stamp_text(F.col("date_created")).alias("created_date"),
        text_of(F.col("start_date")).alias("start_date"),
        text_of(F.col("end_date")).alias("end_date"),
        text_of(F.col("start_time")).alias("time"),
        text_of(iso_text(F.col("last_job_run"))).alias("last_run"),
        text_of(iso_text(F.col("recurrence_time"))).alias("next_flight"),
        text_of(F.col("job_running_status")).alias("r_status"),
        flag_text(F.col("complete_job")).alias("email_job_complete"),
        flag_text(F.col("fail_job")).alias("email_job_fail"),
        flag_text(F.col("skip_job")).alias("email_job_skip"),
    )


def task_report(tables: JobTables) -> DataFrame:
    """Every task that has a type as 8 text cells."""
    types = tables.source_task_type.select("source_task_type_id", "service_name", "queue_topic_partition")
    tasks = tables.source_task.join(types, "source_task_type_id")
    columns = (
        "task_detail_id", "task_name", "task_payload", "task_status", "pipeline_id", "home_page_id",
        "service_name", "queue_topic_partition",
    )
    return tasks.select(*(text_of(F.col(name)).alias(name) for name in columns))


def write_report(report: DataFrame, headings: Sequence[str], path: str) -> None:
    """Write a report as CSV parts, each starting with the headings."""
    report.toDF(*headings).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
