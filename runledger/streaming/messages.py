"""Status messages as a stream: current state, audit log and hourly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.model import DAY_COLUMN
from runledger.operators.folding import audit_messages, folded_queue_rows, merge_partials, newest_per_queue_row
from runledger.sources.tables import JobTables
from runledger.streaming.runs import batch_path, read_batches, read_partials, start_batches, write_new_rows, write_partials

FOLD_SCHEMA = "job_queue_id bigint, status_seq bigint, status_code int, end_seq bigint, end_time timestamp_ntz"
AUDIT_SCHEMA = "seq bigint, job_queue_id bigint, log_detail string, date_created timestamp_ntz"
HOURLY_SCHEMA = "hour_start timestamp_ntz, job_status string, total_count bigint"


def start_status_fold(messages: DataFrame, output: str, available_now: bool = False) -> StreamingQuery:
    """Write each batch's newest status per queue row.

    Partial folds merge in any order, so no state is held between batches and neither
    late messages nor ever more queue rows cost the stream anything. They are merged by
    levels, so what a reader opens grows with the logarithm of the batches.
    """

    def step(batch: DataFrame, batch_no: int) -> None:
        write_partials(newest_per_queue_row(batch), output, batch_no, _merged_folds)

    return start_batches(messages, step, output, available_now)


def _merged_folds(folds: DataFrame) -> DataFrame:
    return merge_partials(folds, "job_queue_id")


def folded_so_far(spark: SparkSession, output: str) -> DataFrame:
    """Newest status and end time per queue row over all batches."""
    return _merged_folds(read_partials(spark, output, FOLD_SCHEMA))


def queue_rows_so_far(spark: SparkSession, output: str, tables: JobTables) -> DataFrame:
    """The queue rows the stream has changed, in their new state."""
    return folded_queue_rows(tables.job_queue, folded_so_far(spark, output))


def compact_folds(spark: SparkSession, output: str, target: str) -> None:
    """Write all folds so far as one batch of a new folder, to keep reading cheap."""
    folded_so_far(spark, output).write.mode("overwrite").parquet(batch_path(target, 0))


def start_audit_log(messages: DataFrame, output: str, available_now: bool = False) -> StreamingQuery:
    """Append audit rows, each message once even when it is delivered again, however late.

    A repeat is known by its seq among the rows already written for its day, so no
    watermark is needed and none drops a late row.
    """
    rows = audit_messages(messages).select(
        "seq", "job_queue_id", F.col("logs_detail").alias("log_detail"), F.col("event_time").alias("date_created")
    )

    def step(batch: DataFrame, batch_no: int) -> None:
        write_new_rows(batch, output, batch_no, "seq", AUDIT_SCHEMA, "date_created")

    return start_batches(rows, step, output, available_now)


def audit_log_so_far(spark: SparkSession, output: str) -> DataFrame:
    columns = ("seq", "job_queue_id", "log_detail", "date_created")
    return read_batches(spark, output, f"{AUDIT_SCHEMA}, {DAY_COLUMN} date").select(*columns)


def start_hourly_counts(messages: DataFrame, output: str, available_now: bool = False) -> StreamingQuery:
    """Keep counts of status messages per hour and status.

    Each batch writes the counts of its own messages and these add up, so a message counts
    however late it is, no state is held, and a repeated batch overwrites what it wrote.
    """

    def step(batch: DataFrame, batch_no: int) -> None:
        states = batch.where("message_type = 'QUEUE_DETAIL'")
        hour = F.date_trunc("hour", "event_time").cast("timestamp_ntz").alias("hour_start")
        counts = states.groupBy(hour, "job_status").agg(F.count("*").alias("total_count"))
        write_partials(counts, output, batch_no, _added_counts)

    return start_batches(messages, step, output, available_now)


def _added_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("hour_start", "job_status").agg(F.sum("total_count").alias("total_count"))


def hourly_counts_so_far(spark: SparkSession, output: str) -> DataFrame:
    """The count of each hour and status over all batches."""
    return _added_counts(read_partials(spark, output, HOURLY_SCHEMA))
