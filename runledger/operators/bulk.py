"""Checking and loading uploaded job and task sheets of any size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.predicates import is_blank, moment
from runledger.functions.timing import first_run
from runledger.model import (
    DATE_PATTERN,
    FLAG_TEXTS,
    FREQUENCIES,
    PRIORITIES,
    RECURRENCES,
    TIME_PATTERN,
)
from runledger.operators.admission import highest_id
from runledger.operators.payload import payload_flatten, well_formed
from runledger.operators.schedule import When
from runledger.sources.tables import JobTables

_WHOLE_NUMBER = r"^[+-]?[0-9]+\z"
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _allowed(values) -> str:
    return "[" + ", ".join(str(value) for value in values) + "]"


# The text each rule leaves, where {row} is the sheet's row number and
# {values} the values allowed.
JOB_MESSAGES = {
    "job_name_empty": "JobName should not be empty at row {row}.<br>",
    "task_id_empty": "TaskId should not be empty at row {row}.<br>",
    "start_date_empty": "StartDate should not be empty at row {row}.<br>",
    "start_time_empty": "StartTime should not be empty at row {row}.<br>",
    "frequency_empty": "Frequency should not be empty at row {row}.<br>",
    "priority_empty": "Priority should not be empty at row {row}.<br>",
    "start_date_invalid": "Invalid startDate at row {row}.<br>",
    "start_time_invalid": "Invalid startTime at row {row}.<br>",
    "frequency_invalid": f"Frequency not valid its should be {_allowed(FREQUENCIES)} at row {{row}}.",
    "end_date_invalid": "Invalid endDate at row {row}.<br>",
    "priority_invalid": f"Priority not valid its should be {_allowed(PRIORITIES)} at row {{row}}.<br>",
    "complete_flag_invalid": f"EmailJob complete not valid its should be {_allowed(FLAG_TEXTS)} at row {{row}}.<br>",
    "fail_flag_invalid": f"EmailJob fail not valid its should be {_allowed(FLAG_TEXTS)} at row {{row}}.<br>",
    "skip_flag_invalid": f"EmailJob skip not valid its should be {_allowed(FLAG_TEXTS)} at row {{row}}.<br>",
    "recurrence_invalid": "Recurrence not valid its should be {values} at row {row}.",
    "end_before_start": "EndDate should not be previous date at row {row}.<br>",
    "weekly_span_short": "EndDate must be 7 day difference from startDate at row {row}.<br>",
    "monthly_span_short": "EndDate must be 31 day difference from startDate at row {row}.<br>",
    "start_time_past": "StartTime should not be previous time at row {row}.<br>",
    "start_date_past": "StartDate should not be previous date at row {row}.",
    "unparsable": "Issue with (Start Date, End Date, Start Time, Recurrence) at row {row}.<br>",
    "task_not_active": "Delete sourceTask not link with source job at row {row}.\n",
}
TASK_MESSAGES = {
    "type_not_found": "SourceTaskType not exist at row {row}.\n",
    "type_deleted": "Delete sourceTaskType not link with source task at row {row}.\n",
    "type_inactive": "Inactive sourceTaskType not link with source task at row {row}.\n",
    "type_id_empty": "Task type id should not be empty at row {row}.<br>",
    "task_name_empty": "Task name should not be empty at row {row}.<br>",
    "task_payload_empty": "Task payload should not be empty at row {row}.<br>",
    "task_payload_invalid": "Task payload not valid at row {row}.<br>",
}


@dataclass(frozen=True)
class JobLoad:
    """What a job upload writes, or the errors that stop all of it."""

    jobs: DataFrame
    schedules: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class TaskLoad:
    tasks: DataFrame
    payload_tags: DataFrame
    errors: DataFrame


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _whole_number(text: Column, kind: str = "int") -> Column:
    return F.when(text.rlike(_WHOLE_NUMBER), text.try_cast(kind))


def _iso_date(text: Column) -> Column:
    return F.when(text.rlike(_ISO_DATE), text.try_cast("date"))


def _breaks(text: Column, pattern: str) -> Column:
    return ~_yes(text.rlike(pattern))


def _bad_flag(text: Column) -> Column:
    shown = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000)))
    return ~is_blank(text) & ~_yes(shown.isin(*FLAG_TEXTS))


def _recurrence_allowed(frequency: Column, number: Column) -> Column:
    allowed = F.lit(False)
    for name, values in RECURRENCES.items():
        allowed = F.when(frequency == name, number.isin(*values)).otherwise(allowed)
    return allowed


def _read_cells(rows: DataFrame, now: When) -> DataFrame:
    """Adds what the cells stand for, in steps, so that no rule repeats another's work."""
    start, end, clock = F.col("start_date"), F.col("end_date"), F.col("start_time")
    frequency, recurrence = F.col("frequency"), F.col("recurrence")
    parts = F.split(clock, ":")
    read = rows.withColumns(
        {
            "_known": _yes(frequency.isin(*FREQUENCIES)),
            "_repeats": ~is_blank(recurrence),
            "_number": _whole_number(recurrence),
            "_first_day": _iso_date(start),
            "_last_day": _iso_date(end),
            "_has_end": ~is_blank(end),
            "_hours": _whole_number(F.try_element_at(parts, F.lit(1))),
            "_minutes": _whole_number(F.try_element_at(parts, F.lit(2))),
        }
    )
    # What cannot be read ends the closer checks and leaves "unparsable", which comes
    # last but does not take back errors found before it.
    unreadable = F.col("_repeats") & (~F.col("_known") | F.col("_number").isNull())
    read = read.withColumns({"_unreadable_recurrence": unreadable, "_closer": F.col("_known") & ~unreadable})
    today = F.to_date(moment(now))
    read = read.withColumn("_ahead", F.col("_closer") & _yes(F.col("_first_day") >= today))
    read = read.withColumn("_unreadable_end", F.col("_ahead") & F.col("_has_end") & F.col("_last_day").isNull())
    return read.withColumn("_timed", F.col("_ahead") & ~F.col("_unreadable_end"))


def _job_rules(now: When) -> list[tuple[str, Column]]:
    """Every rule's condition, in the order its code is listed."""
    frequency, priority, end = F.col("frequency"), F.col("priority"), F.col("end_date")
    first_day, last_day = F.col("_first_day"), F.col("_last_day")
    ends = F.col("_ahead") & F.col("_has_end")
    in_order, span = _yes(last_day >= first_day), F.datediff(last_day, first_day)
    minutes = F.col("_hours").cast("bigint") * 60 + F.col("_minutes")
    begins = F.timestamp_add("MINUTE", minutes, first_day.cast("timestamp_ntz"))
    unreadable_time = F.col("_timed") & (F.col("_hours").isNull() | F.col("_minutes").isNull())
    unparsable = (
        F.col("_unreadable_recurrence")
        | (frequency.isNull() & ~F.col("_repeats"))
        | (F.col("_closer") & first_day.isNull())
        | F.col("_unreadable_end")
        | unreadable_time
    )
    wrong_number = F.col("_repeats") & ~F.col("_unreadable_recurrence")
    return [
        ("job_name_empty", is_blank(F.col("job_name"))),
        ("task_id_empty", is_blank(F.col("task_id"))),
        ("start_date_empty", is_blank(F.col("start_date"))),
        ("start_time_empty", is_blank(F.col("start_time"))),
        ("frequency_empty", is_blank(frequency)),
        ("priority_empty", is_blank(priority)),
        ("start_date_invalid", _breaks(F.col("start_date"), DATE_PATTERN)),
        ("start_time_invalid", _breaks(F.col("start_time"), TIME_PATTERN)),
        ("frequency_invalid", ~F.col("_known")),
        ("end_date_invalid", F.col("_has_end") & _breaks(end, DATE_PATTERN)),
        ("priority_invalid", ~_yes(priority.isin(*PRIORITIES))),
        ("complete_flag_invalid", _bad_flag(F.col("email_job_complete"))),
        ("fail_flag_invalid", _bad_flag(F.col("email_job_fail"))),
        ("skip_flag_invalid", _bad_flag(F.col("email_job_skip"))),
        ("recurrence_invalid", wrong_number & ~_yes(_recurrence_allowed(frequency, F.col("_number")))),
        ("end_before_start", ends & _yes(last_day < first_day)),
        ("weekly_span_short", ends & in_order & (frequency == "Weekly") & (span < 6)),
        ("monthly_span_short", ends & in_order & (frequency == "Monthly") & (span < 30)),
        ("start_time_past", F.col("_timed") & _yes(begins < moment(now))),
        ("start_date_past", F.col("_closer") & _yes(first_day < F.to_date(moment(now)))),
        ("unparsable", unparsable),
    ]


def _code_list(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that hold, in order."""
    codes = F.concat_ws(",", *(F.when(condition, code) for code, condition in rules))
    return F.filter(F.split(codes, ","), lambda code: code != "")


def bulk_job_validation(rows: DataFrame, now: When) -> DataFrame:
    """Adds ``errors``, the codes of the rules a row fails, in order; empty for a valid row."""
    return _read_cells(rows, now).select(*rows.columns, _code_list(_job_rules(now)).alias("errors"))


def _with_task_check(checked: DataFrame, tables: JobTables) -> DataFrame:
    active = tables.source_task.where("task_status = 'Active'").select(
        F.col("task_detail_id").alias("task_number"), F.lit(True).alias("task_found")
    )
    missing = ~is_blank(F.col("task_id")) & F.col("task_found").isNull()
    return (
        checked.withColumn("task_number", _whole_number(F.col("task_id"), "bigint"))
        .join(active, "task_number", "left")
        .withColumn(
            "errors",
            F.when(missing, F.array_append("errors", F.lit("task_not_active"))).otherwise(F.col("errors")),
        )
        .drop("task_found")
    )


def missing_task_rows(rows: DataFrame, tables: JobTables) -> DataFrame:
    """Upload rows that name a task which is not an Active one."""
    active = tables.source_task.where("task_status = 'Active'").select(F.col("task_detail_id").alias("task_number"))
    named = rows.where(~is_blank(F.col("task_id"))).withColumn("task_number", _whole_number(F.col("task_id"), "bigint"))
    return named.join(active, "task_number", "left_anti").drop("task_number")


def error_texts(checked: DataFrame, messages: dict[str, str] = JOB_MESSAGES) -> DataFrame:
    """The failed rows with their codes spelled out as one text."""
    texts = F.create_map(*(part for code, text in messages.items() for part in (F.lit(code), F.lit(text))))
    values = F.lit("null")
    for name, allowed in RECURRENCES.items():
        if "frequency" in checked.columns:
            values = F.when(F.col("frequency") == name, _allowed(allowed)).otherwise(values)

    def spelled(code: Column) -> Column:
        text = F.replace(F.element_at(texts, code), F.lit("{row}"), F.col("row_no").cast("string"))
        return F.replace(text, F.lit("{values}"), values)

    message = F.concat_ws("", F.transform("errors", spelled))
    sheet = ["sheet"] if "sheet" in checked.columns else []
    return checked.where(F.size("errors") > 0).select(*sheet, "row_no", "errors", message.alias("message"))


def _place(rows: DataFrame) -> Column:
    """A row's number in the whole upload: over all sheets where they are several, else in its sheet."""
    return F.col("load_no") if "load_no" in rows.columns else F.col("row_no") - 1


def bulk_load(rows: DataFrame, tables: JobTables, now: When) -> JobLoad:
    """All of a job upload, or none of it when any row fails.

    The gate is an uncorrelated NOT EXISTS over the failed rows, evaluated once; past it
    every row is good, so the rules are not applied a second time. Ids are the highest id
    plus the row's place in the upload, which is unique over all its sheets.
    """
    checked = _with_task_check(bulk_job_validation(rows, now), tables)
    failed = checked.where(F.size("errors") > 0)
    accepted = rows.where(~failed.select("row_no").exists())
    accepted = accepted.withColumn("task_number", _whole_number(F.col("task_id"), "bigint"))
    place = _place(rows)
    job_id = highest_id(tables.source_job, "job_id") + place
    truth = {
        f"{target}_job": F.coalesce(F.lower(F.col(f"email_job_{source}")) == "true", F.lit(False))
        for target, source in (("complete", "complete"), ("fail", "fail"), ("skip", "skip"))
    }
    jobs = accepted.select(
        job_id.alias("job_id"),
        "job_name",
        F.col("task_number").alias("task_detail_id"),
        F.lit("Active").alias("job_status"),
        F.lit(None).cast("string").alias("job_running_status"),
        F.lit(None).cast("timestamp_ntz").alias("last_job_run"),
        F.lit("Auto").alias("execution"),
        F.col("priority").try_cast("int").alias("priority"),
        moment(now).alias("date_created"),
        *(flag.alias(column) for column, flag in truth.items()),
    )
    start = _iso_date(F.col("start_date"))
    schedules = accepted.select(
        (highest_id(tables.scheduler, "scheduler_id") + place).alias("scheduler_id"),
        job_id.alias("job_id"),
        start.alias("start_date"),
        _iso_date(F.col("end_date")).alias("end_date"),
        "start_time",
        "frequency",
        F.when(~is_blank(F.col("recurrence")), F.col("recurrence")).alias("recurrence"),
        moment(now).alias("date_created"),
        first_run(start, F.col("start_time")).alias("recurrence_time"),
    )
    return JobLoad(jobs, schedules, error_texts(checked))


def bulk_task_validation(rows: DataFrame, tables: JobTables) -> DataFrame:
    """Adds ``errors`` to task upload rows: type, required cells and readable payload."""
    types = tables.source_task_type.select(
        F.col("source_task_type_id").alias("type_number"), F.col("task_type_status").alias("type_status")
    )
    type_text, payload = F.col("source_task_type_id"), F.col("task_payload")
    named = ~is_blank(type_text)
    rules = [
        ("type_not_found", named & F.col("type_status").isNull()),
        ("type_deleted", named & (F.col("type_status") == "Delete")),
        ("type_inactive", named & (F.col("type_status") == "Inactive")),
        ("type_id_empty", ~named),
        ("task_name_empty", is_blank(F.col("task_name"))),
        ("task_payload_empty", is_blank(payload)),
        ("task_payload_invalid", ~is_blank(payload) & ~F.col("readable")),
    ]
    return (
        rows.withColumn("readable", well_formed(F.coalesce(payload, F.lit(""))))
        .withColumn("type_number", _whole_number(type_text, "bigint"))
        .join(types, "type_number", "left")
        .withColumn("errors", _code_list(rules))
        .drop("readable", "type_status")
    )


def bulk_task_load(rows: DataFrame, tables: JobTables, now: When) -> TaskLoad:
    """All of a task upload with the tags of its payloads, or none of it."""
    checked = bulk_task_validation(rows, tables)
    failed = checked.where(F.size("errors") > 0)
    accepted = rows.where(~failed.select("row_no").exists())
    accepted = accepted.withColumn("type_number", _whole_number(F.col("source_task_type_id"), "bigint"))
    tasks = accepted.select(
        (highest_id(tables.source_task, "task_detail_id") + _place(rows)).alias("task_detail_id"),
        "task_name",
        F.lit("Active").alias("task_status"),
        "home_page_id",
        "pipeline_id",
        "task_payload",
        F.col("type_number").alias("source_task_type_id"),
        moment(now).alias("date_created"),
    )
    tags = payload_flatten(tasks.select("task_detail_id", "task_payload")).withColumnRenamed(
        "task_detail_id", "payload_id"
    )
    return TaskLoad(tasks, tags, error_texts(checked, TASK_MESSAGES))
