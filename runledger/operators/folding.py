"""Folding worker status messages into queue rows, jobs and the audit log.

The fold is an aggregate per key with a fixed-size state - the newest status code
and the newest end time - so it is reduced inside every task before it is shuffled,
can be merged again across micro-batches, and does not mind a key with very many
messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.texts import job_message
from runledger.model import AUDIT_LOG, QUEUE_DETAIL, RUN_STATUSES
from runledger.sources.tables import JobTables

_CODES = {status: code for code, status in enumerate(RUN_STATUSES, start=1)}


def status_code(status: Column) -> Column:
    """A status as a small number, which keeps the aggregate state fixed in size."""
    code = F.lit(None).cast("int")
    for name, number in _CODES.items():
        code = F.when(status == name, F.lit(number)).otherwise(code)
    return code


def status_name(code: Column) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name in RUN_STATUSES)), code)


def state_messages(messages: DataFrame) -> DataFrame:
    """Messages that set a status; one with a status that does not exist is refused."""
    return messages.where((F.col("message_type") == QUEUE_DETAIL) & F.col("job_status").isin(*RUN_STATUSES))


def newest_per_queue_row(messages: DataFrame) -> DataFrame:
    """Partial folds per queue row: newest status and newest end time, each with its seq."""
    ended = F.when(F.col("end_time").isNotNull(), F.col("seq"))
    return state_messages(messages).groupBy("job_queue_id").agg(
        F.max("seq").alias("status_seq"),
        F.max_by(status_code(F.col("job_status")), "seq").alias("status_code"),
        F.max(ended).alias("end_seq"),
        F.max_by("end_time", ended).alias("end_time"),
    )


def newest_per_job(messages: DataFrame) -> DataFrame:
    return state_messages(messages).groupBy("job_id").agg(
        F.max("seq").alias("status_seq"),
        F.max_by(status_code(F.col("job_status")), "seq").alias("status_code"),
    )


def merge_partials(partials: DataFrame, key: str) -> DataFrame:
    """Folds of several batches as one; in which order they came does not matter."""
    merged = [
        F.max("status_seq").alias("status_seq"),
        F.max_by("status_code", "status_seq").alias("status_code"),
    ]
    if "end_seq" in partials.columns:
        merged += [F.max("end_seq").alias("end_seq"), F.max_by("end_time", "end_seq").alias("end_time")]
    return partials.groupBy(key).agg(*merged)


def folded_queue_rows(queue: DataFrame, newest: DataFrame) -> DataFrame:
    """The queue rows a fold changes, in their new state."""
    newest = newest.select("job_queue_id", "status_code", F.col("end_time").alias("new_end_time"))
    ended = F.col("new_end_time").isNotNull()
    return (
        queue.join(newest, "job_queue_id")
        .withColumn("job_status", status_name(F.col("status_code")))
        .withColumn(
            "job_status_message",
            F.when(ended, job_message(F.col("job_id"), "Job ", " now complete.")).otherwise(F.col("job_status_message")),
        )
        .withColumn("end_time", F.coalesce("new_end_time", "end_time"))
        .select(*queue.columns)
    )


def folded_jobs(jobs: DataFrame, newest: DataFrame) -> DataFrame:
    newest = newest.select("job_id", "status_code")
    return (
        jobs.join(newest, "job_id")
        .withColumn("job_running_status", status_name(F.col("status_code")))
        .select(*jobs.columns)
    )


def audit_messages(messages: DataFrame) -> DataFrame:
    """Messages that leave an audit text."""
    status_ok = F.col("job_status").isin(*RUN_STATUSES)
    kept = (F.col("message_type") == AUDIT_LOG) | ((F.col("message_type") == QUEUE_DETAIL) & status_ok)
    return messages.where(kept)


def audit_rows(messages: DataFrame) -> DataFrame:
    return audit_messages(messages).select(
        "seq", "job_queue_id", F.col("logs_detail").alias("log_detail"), F.col("event_time").alias("date_created")
    )


def status_fold(tables: JobTables, messages: DataFrame) -> DataFrame:
    """Queue rows changed by a set of messages."""
    return folded_queue_rows(tables.job_queue, newest_per_queue_row(messages))


def status_fold_jobs(tables: JobTables, messages: DataFrame) -> DataFrame:
    """Jobs changed by a set of messages."""
    return folded_jobs(tables.source_job, newest_per_job(messages))


def cascade_from_types(tables: JobTables, types: DataFrame) -> DataFrame:
    """Jobs of the given types (source_task_type_id, new_status) with that status.

    A null status cascades nothing.
    """
    types = types.where("new_status is not null").select("source_task_type_id", "new_status")
    tasks = tables.source_task.select("task_detail_id", "source_task_type_id").join(types, "source_task_type_id")
    return cascade_from_tasks(tables, tasks)


def cascade_from_tasks(tables: JobTables, tasks: DataFrame) -> DataFrame:
    """Jobs of the given tasks (task_detail_id, new_status) with that status."""
    tasks = tasks.where("new_status is not null").select("task_detail_id", "new_status")
    jobs = tables.source_job
    return (
        jobs.join(tasks, "task_detail_id")
        .withColumn("job_status", F.col("new_status"))
        .select(*jobs.columns)
    )
