"""Which schedules are due, when they run next and every run inside a horizon."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.predicates import moment
from runledger.functions.timing import (
    FIXED_STEP_SECONDS,
    SETTLED_STEPS,
    at_day_of,
    first_run,
    last_allowed_run,
    micros_since_1970,
    months_between_starts,
    next_run,
    step_count,
)
from runledger.model import ROUTE_PATTERN
from runledger.sources.tables import JobTables

When = str | datetime


def with_first_run(schedules: DataFrame) -> DataFrame:
    return schedules.withColumn("first_run", first_run(F.col("start_date"), F.col("start_time")))


def parse_routes(df: DataFrame, column: str = "queue_topic_partition") -> DataFrame:
    """Adds topic, partition (null for any) and whether the route text is valid."""
    route = F.col(column)
    valid = F.coalesce(route.rlike(ROUTE_PATTERN), F.lit(False))
    return df.withColumns(
        {
            "topic": F.when(valid, F.regexp_extract(route, ROUTE_PATTERN, 1)),
            "partition": F.when(valid, F.regexp_extract(route, ROUTE_PATTERN, 2)).try_cast("int"),
            "route_valid": valid,
        }
    )


def with_next_run(schedules: DataFrame) -> DataFrame:
    following = next_run(F.col("recurrence_time"), F.col("frequency"), F.col("recurrence"))
    return schedules.withColumn("next_run", following)


def _may_run(run: Column, limit: Column) -> Column:
    return run.isNotNull() & (limit.isNull() | (run <= limit))


def schedule_advance(schedules: DataFrame) -> DataFrame:
    """Moves each schedule to its next run if it has one not after its end.

    Schedules that have none keep their time and are marked exhausted.
    """
    advances = _may_run(F.col("next_run"), last_allowed_run(F.col("end_date"), F.col("start_time")))
    return (
        with_next_run(schedules)
        .withColumn("exhausted", ~advances)
        .withColumn("recurrence_time", F.when(F.col("exhausted"), F.col("recurrence_time")).otherwise(F.col("next_run")))
        .drop("next_run")
    )


def due_by_time(schedules: DataFrame, last_run: When, now: When, strict: bool = True) -> DataFrame:
    """Schedules with a run from the last check to now, both included.

    The strict test, which the service applies too, takes the run's time of day today
    and wants it strictly between the two checks. It never finds a run just before
    midnight that is looked for just after; ``strict=False`` keeps the window only.
    """
    run = F.col("recurrence_time")
    due = schedules.where((run >= moment(last_run)) & (run <= moment(now)))
    if not strict:
        return due
    today = at_day_of(run, moment(now))
    return due.where((today > moment(last_run)) & (today < moment(now)))


def _of_active_jobs(schedules: DataFrame, tables: JobTables) -> DataFrame:
    active = tables.source_job.where("job_status = 'Active'").select("job_id")
    return schedules.join(active, "job_id", "left_semi")


def due_candidates(tables: JobTables, last_run: When, now: When) -> DataFrame:
    """Schedules of Active jobs with a run in the window, both ends included."""
    return _of_active_jobs(due_by_time(tables.scheduler, last_run, now, strict=False), tables)


def schedule_due(tables: JobTables, last_run: When, now: When, strict: bool = True) -> DataFrame:
    """Schedules of Active jobs that are due; see :func:`due_by_time` for ``strict``."""
    return _of_active_jobs(due_by_time(tables.scheduler, last_run, now, strict), tables)


def run_calendar(schedules: DataFrame, start: When, end: When) -> DataFrame:
    """Every run from ``start`` up to, not including, ``end``, numbered from 0.

    Run 0 is the time the schedule now waits for; later ones follow step by step to
    the schedule's end. Fixed steps are computed by division, so a schedule that began
    long ago costs no more than the runs it has inside the horizon. Month steps chain:
    31 January is followed by 29 February and then by the 29th.
    """
    first, limit = F.col("recurrence_time"), F.col("last_allowed")
    lower, upper = moment(start), moment(end)
    prepared = (
        schedules.where(first < upper)
        .withColumn("last_allowed", last_allowed_run(F.col("end_date"), F.col("start_time")))
        .withColumn("steps", step_count(F.col("recurrence")))
        .select("scheduler_id", "job_id", "frequency", "recurrence_time", "last_allowed", "steps")
    )
    monthly = F.coalesce((F.col("frequency") == "Monthly") & (F.col("steps") > 0), F.lit(False))
    fixed = _fixed_step_runs(prepared.where(~monthly), lower, upper, limit)
    return fixed.unionByName(_month_runs(prepared.where(monthly), lower, upper, limit))


def _div(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by)


def _fixed_step_runs(prepared: DataFrame, lower: Column, upper: Column, limit: Column) -> DataFrame:
    """Runs of schedules with steps of fixed length; those without any step have run 0 only."""
    seconds = F.lit(None).cast("bigint")
    for name, unit in FIXED_STEP_SECONDS.items():
        seconds = F.when(F.col("frequency") == name, F.col("steps").cast("bigint") * unit).otherwise(seconds)
    step, start = F.col("step_micros"), F.col("first_micros")
    steps = F.when(seconds > 0, seconds * 1_000_000)
    # The last microsecond a later run may have: before the horizon's end, not after the
    # schedule's. Run 0 is not bound by the schedule's end.
    last_micros = F.least(micros_since_1970(upper) - 1, micros_since_1970(limit))
    zero = F.lit(0).cast("bigint")
    without_step = F.when(start >= micros_since_1970(lower), zero)
    first_no = F.greatest(zero, _div(micros_since_1970(lower) - start + step - 1, step))
    last_no = F.when(last_micros >= start, _div(last_micros - start, step)).otherwise(zero)
    stepping = (
        prepared.withColumns({"step_micros": steps, "first_micros": micros_since_1970(F.col("recurrence_time"))})
        .withColumn("first_no", F.when(step.isNull(), without_step).otherwise(first_no))
        .withColumn("last_no", F.when(step.isNull(), zero).otherwise(last_no))
    )
    # The outer form keeps the optimizer from working the array out once more in a filter.
    numbers = F.when(F.col("last_no") >= F.col("first_no"), F.sequence("first_no", "last_no"))
    run_no = F.col("run_no")
    return (
        stepping.select("scheduler_id", "job_id", "recurrence_time", step, F.explode_outer(numbers).alias("run_no"))
        .where(run_no.isNotNull())
        .select(
            "scheduler_id",
            "job_id",
            "run_no",
            F.timestamp_add("MICROSECOND", run_no * F.coalesce(step, zero), F.col("recurrence_time")).alias("run_time"),
        )
    )




def _month_runs(prepared: DataFrame, lower: Column, upper: Column, limit: Column) -> DataFrame:
    """Runs inside the horizon by their number; the day is the least of the months passed, as a chain would give.

    A chain of steps never gets a lost day back, so run k falls on the first run's day or the
    shortest month up to k. Nothing is kept for the runs before the horizon.
    """
    first, step = F.col("recurrence_time"), F.col("steps").cast("bigint")
    zero = F.lit(0).cast("bigint")
    base = F.timestamp_add("DAY", 1 - F.dayofmonth(first), first)
    first_no = F.greatest(zero, _div(months_between_starts(first, lower).cast("bigint"), step) - 1)
    last_no = F.greatest(zero, _div(months_between_starts(first, upper).cast("bigint"), step) + 1)
    runs = prepared.withColumn("base", base).select("*", F.explode(F.sequence(first_no, last_no)).alias("run_no"))
    passed = F.sequence(zero, F.least(F.col("run_no"), F.lit(SETTLED_STEPS)))

    def shortest(day: Column, number: Column) -> Column:
        month = F.add_months(F.to_date("base"), (number * F.col("steps")).cast("int"))
        return F.least(day, F.dayofmonth(F.last_day(month)))

    day = F.aggregate(passed, F.dayofmonth(first), shortest)
    month = F.timestamp_add("MONTH", (F.col("run_no") * step).cast("int"), F.col("base"))
    run = F.col("run_time")
    return (
        runs.withColumn("run_time", F.timestamp_add("DAY", day - 1, month))
        .where((run >= lower) & (run < upper))
        .where((F.col("run_no") == 0) | _may_run(run, limit))
        .select("scheduler_id", "job_id", "run_no", "run_time")
    )
