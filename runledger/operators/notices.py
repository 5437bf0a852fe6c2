"""Rows for mail and job status notices; sending them is the caller's sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runledger.functions.timing import effective_time
from runledger.model import EMAIL_RECEIVER
from runledger.operators.details import active_jobs, primary_schedules, status_payload
from runledger.sources.tables import JobTables


def notification_feed(tables: JobTables, events: DataFrame) -> DataFrame:
    """A mail row for each event (job_queue_id, job_id, job_status) its job wants one for.

    Skip, Completed and Failed each have a flag on the job. The recipient is a setting;
    without it there is nobody to write to and no rows.
    """
    recipient = tables.lookup_data.where(
        (F.col("lookup_type") == EMAIL_RECEIVER) & F.col("parent_lookup_id").isNull()
    ).select("lookup_value")
    status = F.col("job_status")
    wanted = (
        (F.col("skip_job") & (status == "Skip"))
        | (F.col("complete_job") & (status == "Completed"))
        | (F.col("fail_job") & (status == "Failed"))
    )
    flags = tables.source_job.select("job_id", "skip_job", "complete_job", "fail_job")
    rows = tables.job_queue.select("job_queue_id", "skip_time", "start_time")
    mails = events.where(status.isin("Skip", "Completed", "Failed")).join(flags, "job_id").where(wanted)
    return (
        mails.join(rows, "job_queue_id")
        .withColumn("recipient", recipient.scalar())
        .where("recipient is not null")
        .select(
            "job_id",
            F.col("job_queue_id").alias("event_id"),
            effective_time(status, F.col("skip_time"), F.col("start_time")).alias("time_slot"),
            status.alias("status"),
            "recipient",
            F.concat(F.lit("Source Job "), status).alias("subject"),
        )
    )


def status_notifications(tables: JobTables, job_ids: DataFrame) -> DataFrame:
    """The JSON notice of each Active job among the ids, with its primary schedule's next run."""
    first = primary_schedules(tables.scheduler, ("recurrence_time",))
    return status_payload(active_jobs(tables, job_ids).join(first, "job_id", "left"))
