"""Sending waiting queue rows: the batch, the plan, the records and their outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.predicates import moment
from runledger.functions.texts import iso_text, job_message
from runledger.operators.admission import highest_id
from runledger.operators.details import setting
from runledger.operators.notices import notification_feed, status_notifications
from runledger.operators.schedule import When, parse_routes
from runledger.sources.tables import JobTables


@dataclass(frozen=True)
class DispatchChanges:
    """The rows one dispatch writes and the mails and notices it causes."""

    queue_rows: DataFrame
    job_updates: DataFrame
    audit_rows: DataFrame
    mails: DataFrame
    notices: DataFrame


def waiting_rows(queue: DataFrame) -> DataFrame:
    return queue.where("job_status = 'Queue' and not job_send")


def dispatch_batch(tables: JobTables, limit: int | None = None, by_priority: bool = False) -> DataFrame:
    """The first waiting rows, as many as the setting allows, by id or by priority first."""
    if limit is None:
        value = setting(tables.lookup_data, "QUEUE_FETCH_LIMIT")
        if value is None:
            raise ValueError("no QUEUE_FETCH_LIMIT setting and no limit given")
        limit = int(value)
    waiting = waiting_rows(tables.unfinished_rows())
    if not by_priority:
        return waiting.orderBy("job_queue_id").limit(limit)
    priorities = tables.source_job.select("job_id", "priority")
    ordered = waiting.join(priorities, "job_id", "left").orderBy(F.asc_nulls_last("priority"), "job_queue_id")
    return ordered.limit(limit).drop("priority")


def dispatch_plan(batch: DataFrame, tables: JobTables) -> DataFrame:
    """Outcome of each batch row before anything is sent.

    ``sent``, or failed as ``job_inactive``, ``type_inactive`` or ``bad_route``, or
    ``no_type`` when the task has no type and the row stays as it is.
    """
    wanted = batch.select("job_id").distinct()
    active = (
        tables.source_job.where("job_status = 'Active'")
        .select("job_id", "task_detail_id", "priority")
        .join(wanted, "job_id", "left_semi")
    )
    task_columns = [
        "task_detail_id", "task_name", "task_status", "home_page_id", "pipeline_id", "task_payload",
        "source_task_type_id",
    ]
    types = parse_routes(
        tables.source_task_type.select("source_task_type_id", "task_type_status", "queue_topic_partition")
    )
    # The batch's jobs meet their task and type first, at one row per job; a job that
    # holds a third of the batch then takes part in a single join with its rows.
    routed = (
        active.join(tables.source_task.select(*task_columns), "task_detail_id", "left")
        .join(types, "source_task_type_id", "left")
        .withColumn("job_found", F.lit(True))
    )
    type_active = F.coalesce(F.col("task_type_status") == "Active", F.lit(False)) & F.col(
        "queue_topic_partition"
    ).isNotNull()
    outcome = (
        F.when(F.col("job_found").isNull(), "job_inactive")
        .when(F.col("source_task_type_id").isNull(), "no_type")
        .when(~type_active, "type_inactive")
        .when(~F.col("route_valid"), "bad_route")
        .otherwise("sent")
    )
    job_id = F.col("job_id")
    failure = (
        F.when(
            F.col("outcome") == "job_inactive",
            job_message(job_id, "Job ", " fail in the queue due to main job either (delete|inactive)."),
        )
        .when(F.col("outcome") == "type_inactive", job_message(job_id, "Broker not active job ", " fail."))
        .when(
            F.col("outcome") == "bad_route",
            F.concat(
                job_message(job_id, "Broker configuration wrong job ", " fail "), F.col("queue_topic_partition")
            ),
        )
    )
    return (
        batch.join(routed, "job_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("failure_text", failure)
        .drop("job_found", "task_type_status", "route_valid")
    )


def _payload() -> Column:
    """The message value; absent fields are left out."""
    queue_row = F.struct(
        F.col("job_queue_id").alias("jobQueueId"),
        iso_text(F.col("start_time")).alias("startTime"),
        iso_text(F.col("end_time")).alias("endTime"),
        iso_text(F.col("skip_time")).alias("skipTime"),
        F.col("job_status").alias("jobStatus"),
        F.col("job_id").alias("jobId"),
        F.col("job_status_message").alias("jobStatusMessage"),
        F.col("run_manual").alias("runManual"),
        F.col("skip_manual").alias("skipManual"),
        F.col("job_send").alias("jobSend"),
        iso_text(F.col("date_created")).alias("dateCreated"),
    )
    task = F.struct(
        F.col("task_detail_id").alias("taskDetailId"),
        F.col("task_name").alias("taskName"),
        F.col("task_status").alias("taskStatus"),
        F.col("home_page_id").alias("homePageId"),
        F.col("pipeline_id").alias("pipelineId"),
        F.col("task_payload").alias("taskPayload"),
    )
    return F.to_json(
        F.struct(
            queue_row.alias("jobQueue"), task.alias("taskDetail"), F.col("priority").cast("string").alias("priority")
        )
    )


def planned_records(plan: DataFrame) -> DataFrame:
    """Every planned row with its outcome and, where it is to be sent, its record."""
    sent = F.col("outcome") == "sent"
    return plan.select(
        "job_queue_id",
        "job_id",
        "outcome",
        "failure_text",
        F.when(sent, F.col("topic")).alias("topic"),
        F.when(sent, F.col("partition")).alias("partition"),
        F.when(sent, F.sha2(F.col("job_queue_id").cast("string"), 256)).alias("key"),
        F.when(sent, _payload()).alias("value"),
    )


def dispatch_records(plan: DataFrame) -> DataFrame:
    """Records to send, in the column shape Spark's Kafka sink takes.

    The key is a hash of the queue id: spread like a random one, yet equal when a
    record is sent again. Partition is null where any will do.
    """
    records = planned_records(plan.where("outcome = 'sent'"))
    return records.select("job_queue_id", "topic", "partition", "key", "value")


def write_records(records: DataFrame, fmt: str = "kafka", **options: str) -> None:
    """Send records: to Kafka where its connector is installed, or to any batch sink."""
    sendable = records.select("topic", "partition", "key", "value")
    if fmt != "kafka":
        path = options.pop("path")
        sendable.write.format(fmt).options(**options).mode("append").save(path)
    else:
        sendable.write.format(fmt).options(**options).save()


def _settled(plan: DataFrame, results: DataFrame, now: When) -> DataFrame:
    """The batch rows that change, in their new state, with outcome and audit text."""
    results = results.select("job_queue_id", "ok", "offset", "error")
    done = (
        plan.withColumn("value", _payload())
        .join(results, "job_queue_id", "left")
        .where("outcome in ('job_inactive', 'type_inactive', 'bad_route') or (outcome = 'sent' and ok is not null)")
        .withColumn("success", (F.col("outcome") == "sent") & F.col("ok"))
    )
    # The stored message and audit texts.
    job = F.concat(F.lit("Job "), F.col("job_id").cast("string"))
    offset = F.col("offset").cast("string")
    sent_message = F.concat(F.lit("Sent message=["), F.col("value"), F.lit("] with offset=["), offset, F.lit("]"))
    sent_audit = F.concat(job, F.lit(" sent message=["), F.col("value"), F.lit("] with offset=["), offset, F.lit("]"))
    unsent_audit = F.concat(
        job, F.lit(" unable to send message=["), F.col("value"), F.lit("] due to: "), F.coalesce("error", F.lit("null"))
    )
    success = F.col("success")
    audit_text = F.when(success, sent_audit).when(F.col("outcome") == "sent", unsent_audit).otherwise(F.col("failure_text"))
    return done.withColumns(
        {
            "job_send": success,
            "job_status": F.when(success, "Start").otherwise("Failed"),
            "job_status_message": F.when(success, sent_message).otherwise(F.concat(job, F.lit(" now complete."))),
            "end_time": F.when(~success, moment(now)).otherwise(F.col("end_time")),
            "audit_text": audit_text,
        }
    )


def dispatch_outcome(plan: DataFrame, results: DataFrame, now: When) -> DataFrame:
    """State of the batch rows after sending, with the audit text of each.

    ``results`` has (job_queue_id, ok, offset, error) per record sent. Rows without a
    task type, and sent rows without a result yet, do not change and are not returned.
    """
    return _settled(plan, results, now).select(
        "job_queue_id", "job_id", "outcome", "job_send", "job_status", "job_status_message", "end_time", "audit_text"
    )


def dispatch_changes(
    plan: DataFrame, results: DataFrame, tables: JobTables, now: When, log_id: int | None = None
) -> DispatchChanges:
    """What a dispatch writes: its queue rows and jobs in their new state, the audit rows, mails and notices.

    A job with several rows in the batch takes the status of the one with the highest id, and
    gets one notice, of its new state. Mails go out for failed rows of jobs that want them, also
    of jobs that are not active. A queue row whose job does not exist changes alone. Audit ids
    are the highest so far (``log_id``, looked up when not given) plus the queue id.
    """
    settled = _settled(plan, results, now)
    newest = settled.groupBy("job_id").agg(F.max_by("job_status", "job_queue_id").alias("new_status"))
    jobs = tables.source_job
    job_updates = jobs.join(newest, "job_id").withColumn("job_running_status", F.col("new_status")).select(*jobs.columns)
    queue_rows = settled.select(*tables.job_queue.columns)
    audit_rows = settled.select(
        (highest_id(tables.job_audit_logs, "job_audit_log_id", log_id) + F.col("job_queue_id")).alias("job_audit_log_id"),
        "job_queue_id",
        F.col("audit_text").alias("log_detail"),
        moment(now).alias("date_created"),
    )
    # The feed takes times from the queue; the batch has all the rows it asks for.
    failed = queue_rows.where("job_status = 'Failed'")
    mails = notification_feed(tables.replacing(job_queue=failed), failed.select("job_queue_id", "job_id", "job_status"))
    notices = status_notifications(tables.replacing(source_job=job_updates), newest.select("job_id"))
    return DispatchChanges(queue_rows, job_updates, audit_rows, mails, notices)
