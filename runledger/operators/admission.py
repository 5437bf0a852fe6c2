"""Putting due schedules into the run queue.

One frame of decisions, one row per due schedule, from which the rows to write are
projected. Ids come from the schedule's own id above a base, so they are unique
without any numbering pass over the rows and a retried run gives the same ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.joins import spread_join
from runledger.functions.predicates import moment
from runledger.functions.texts import job_message
from runledger.operators.dashboards import in_flight_per_job
from runledger.operators.schedule import When, due_by_time, schedule_advance
from runledger.sources.tables import JobTables


@dataclass(frozen=True)
class AdmissionChanges:
    """The rows one admission run writes."""

    queue_rows: DataFrame
    job_updates: DataFrame
    schedules: DataFrame
    audit_rows: DataFrame
    skip_mails: DataFrame
    last_run: DataFrame


def highest_id(table: DataFrame, key: str, known: int | None = None) -> Column:
    """The table's highest key as a scalar subquery, 0 for an empty table.

    A caller that keeps the highest id, as one with a very large table will, gives it as
    ``known`` and the table is not read.
    """
    if known is not None:
        return F.lit(known).cast("bigint")
    return table.agg(F.coalesce(F.max(key), F.lit(0)).alias(key)).scalar()


def queue_admission(tables: JobTables, last_run: When, now: When, strict: bool = True) -> DataFrame:
    """What becomes of each due schedule: Queue, or Skip while its job is in flight.

    Of several due schedules of one job the earliest is queued and the others skipped.
    The earliest is a minimum per job, reduced before the shuffle and joined back with a
    job's schedules spread over tasks: no job is ranked, or even gathered, in one place.
    """
    due = due_by_time(tables.scheduler, last_run, now, strict)
    per_schedule_job = due.groupBy("job_id").agg(
        F.min(F.struct("recurrence_time", "scheduler_id"))["scheduler_id"].alias("first_schedule"),
        F.count("*").alias("rows"),
    )
    advanced = schedule_advance(due.withColumn("due_time", F.col("recurrence_time")))
    active = tables.source_job.where("job_status = 'Active'").select("job_id", "skip_job")
    per_job = (
        per_schedule_job.join(active, "job_id")
        .join(in_flight_per_job(tables), "job_id", "left")
        .withColumn("busy", F.coalesce("in_flight", F.lit(0)) > 0)
        .select("job_id", "first_schedule", "busy", "skip_job")
    )
    queued = ~F.col("busy") & (F.col("scheduler_id") == F.col("first_schedule"))
    job_id = F.col("job_id")
    message = F.when(F.col("queued"), job_message(job_id, "Job ", " now in the queue.")).otherwise(
        job_message(job_id, "Job ", " skip, already in queue.")
    )
    return (
        spread_join(advanced, per_job, "job_id", "scheduler_id", per_schedule_job.select("job_id", "rows"))
        .withColumn("queued", queued)
        .select(
            "scheduler_id",
            "job_id",
            "due_time",
            F.when(F.col("queued"), "Queue").otherwise("Skip").alias("job_status"),
            message.alias("message"),
            moment(now).alias("decided_at"),
            F.col("recurrence_time").alias("next_recurrence_time"),
            "exhausted",
            (~F.col("queued") & F.col("skip_job")).alias("mail_skip"),
        )
    )


def admission_changes(
    tables: JobTables,
    last_run: When,
    now: When,
    strict: bool = True,
    queue_id: int | None = None,
    log_id: int | None = None,
) -> AdmissionChanges:
    """The decisions as rows to write: queue, jobs, schedules, audit and the new last run.

    ``queue_id`` and ``log_id`` are the highest ids so far, looked up when not given.
    """
    new_queue_id = highest_id(tables.job_queue, "job_queue_id", queue_id) + F.col("scheduler_id")
    new_log_id = highest_id(tables.job_audit_logs, "job_audit_log_id", log_id) + F.col("scheduler_id")
    decided = queue_admission(tables, last_run, now, strict)
    queued = F.col("job_status") == "Queue"
    at, nothing = F.col("decided_at"), F.lit(None)
    queue_rows = decided.select(
        new_queue_id.alias("job_queue_id"),
        at.alias("date_created"),
        nothing.cast("timestamp_ntz").alias("end_time"),
        "job_id",
        F.lit(False).alias("job_send"),
        "job_status",
        F.col("message").alias("job_status_message"),
        nothing.cast("boolean").alias("run_manual"),
        nothing.cast("boolean").alias("skip_manual"),
        F.when(~queued, at).alias("skip_time"),
        F.when(queued, at).alias("start_time"),
    )
    audit_rows = decided.select(
        new_log_id.alias("job_audit_log_id"),
        new_queue_id.alias("job_queue_id"),
        F.col("message").alias("log_detail"),
        at.alias("date_created"),
    )
    job_updates = decided.where(queued).select(
        "job_id", F.col("job_status").alias("job_running_status"), at.alias("last_job_run")
    )
    schedules = decided.where(~F.col("exhausted")).select(
        "scheduler_id", F.col("next_recurrence_time").alias("recurrence_time")
    )
    skip_mails = decided.where("mail_skip").select("job_id", "scheduler_id", at.alias("time_slot"))
    last = tables.lookup_data.where("lookup_type = 'SCHEDULER_LAST_RUN_TIME'").withColumn(
        "lookup_value", F.lit(str(now).replace(" ", "T"))
    )
    return AdmissionChanges(queue_rows, job_updates, schedules, audit_rows, skip_mails, last)
