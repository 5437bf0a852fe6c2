"""Operator requests: run now, skip the next run, fail, interrupt.

Requests act one after the other, in order of their ids. What a request does to a job is a map
over the job's few states: a run leaves it busy, an accepted fail or interrupt of a queue row
leaves it free, a skip leaves it as it was and uses up a run of its schedule. Maps compose, so
the requests of a job are cut into ranges of ids, each range is reduced to one map and the maps
are composed in order; a job with very many requests needs no task that sees them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from runledger.functions.joins import spread_join
from runledger.functions.predicates import moment
from runledger.functions.texts import job_message
from runledger.functions.timing import last_allowed_run, later_run, step_count
from runledger.model import BUSY_STATUSES
from runledger.operators.admission import highest_id
from runledger.operators.details import primary_schedules
from runledger.operators.schedule import When
from runledger.sources.tables import JobTables

RESULT_COLUMNS = (
    "request_id", "action", "job_id", "job_queue_id", "result", "new_status", "run_time", "next_recurrence_time",
    "message", "mail",
)
SKIP_COLUMNS = ("scheduler_id", "end_date", "start_time", "frequency", "recurrence", "recurrence_time")


@dataclass(frozen=True)
class ActionChanges:
    """The rows a batch of requests writes."""

    new_queue_rows: DataFrame
    queue_updates: DataFrame
    job_updates: DataFrame
    schedules: DataFrame
    audit_rows: DataFrame


# Request ids in a range: what a task may see of one job at once.
RANGE_IDS = 100_000


def _met_states(events: DataFrame, first_states: DataFrame, range_ids: int) -> DataFrame:
    """The events (job_id, request_id, kind: run, skip or free) with the job's state they meet, ``met``, and ``skips``.

    ``first_states`` has ``start`` ("run" for busy, else "free") and any other columns of each job;
    they come along. ``skips`` is the number of earlier skips that met a free job.
    """
    ranged = events.withColumn("ids", F.expr(f"request_id div {range_ids}"))
    inside = Window.partitionBy("job_id", "ids").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    is_skip = F.col("kind") == "skip"
    last = F.last(F.when(~is_skip, F.col("kind")), ignorenulls=True).over(inside)
    marked = ranged.withColumn("last", last)
    # Skips before the range's first run or fail depend on the state the range begins with.
    unknown, free = (is_skip & F.col("last").isNull()).cast("long"), F.coalesce(is_skip & (F.col("last") == "free"), F.lit(False)).cast("long")
    marked = marked.withColumns({"unknown": unknown, "free": free})
    # One map a range: its end state (none: the one it began with) and its skips from either state.
    maps = marked.groupBy("job_id", "ids").agg(
        F.max(F.when(~is_skip, F.struct("request_id", "kind")))["kind"].alias("end"),
        F.sum("unknown").alias("unknown_here"), F.sum("free").alias("free_here"),
    )
    before = Window.partitionBy("job_id").orderBy("ids").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.join(first_states, "job_id", "left").withColumn("start", F.coalesce("start", F.lit("free")))
    maps = maps.withColumn("begins", F.coalesce(F.last("end", ignorenulls=True).over(before), F.col("start")))
    taken = F.col("free_here") + F.when(F.col("begins") == "free", F.col("unknown_here")).otherwise(0)
    maps = maps.withColumn("taken", taken).withColumn("skips_before", F.coalesce(F.sum("taken").over(before), F.lit(0)))
    both = marked.withColumns({name: F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in ("unknown", "free")})
    both = both.join(maps.drop("end", "unknown_here", "free_here", "start", "taken"), ["job_id", "ids"])
    skips = F.col("skips_before") + F.col("free") + F.when(F.col("begins") == "free", F.col("unknown")).otherwise(0)
    return both.withColumns({"met": F.coalesce("last", "begins"), "skips": skips}).drop("ids", "last", "unknown", "free", "begins", "skips_before")


def _job_requests(requests: DataFrame, freed: DataFrame, tables: JobTables, now: When, range_ids: int) -> DataFrame:
    asked = requests.where("action in ('run', 'skip')").select("job_id", "request_id", F.col("action").alias("kind"))
    jobs = asked.select("job_id").distinct()
    schedules = primary_schedules(tables.scheduler.join(jobs, "job_id", "left_semi"), SKIP_COLUMNS).select(
        "job_id", "recurrence_time", "frequency", step_count(F.col("recurrence")).alias("steps"),
        last_allowed_run(F.col("end_date"), F.col("start_time")).alias("until"),
    )
    busy = F.coalesce(F.col("job_running_status").isin(*BUSY_STATUSES), F.lit(False))
    states = tables.source_job.where("job_status = 'Active'").select(
        "job_id", F.when(busy, "run").otherwise("free").alias("start"), "execution", "skip_job", F.lit(True).alias("found")
    )
    # Only jobs with a run or a skip have something to ask of their state.
    events = asked.where("job_id is not null").unionByName(freed.join(jobs, "job_id", "left_semi").withColumn("kind", F.lit("free")))
    met = _met_states(events, states.join(schedules, "job_id", "left"), range_ids).where("kind <> 'free'")
    met = met.unionByName(asked.where("job_id is null"), allowMissingColumns=True)

    def run_after(steps: Column) -> Column:
        return later_run(F.col("recurrence_time"), F.col("frequency"), F.col("steps"), steps)

    def may(run: Column) -> Column:
        return run.isNotNull() & (F.col("until").isNull() | (run <= F.col("until")))

    met = met.withColumns({"this_run": run_after(F.col("skips")), "next_run": run_after(F.col("skips") + 1), "first_skip": run_after(F.lit(1))})
    is_run = F.col("kind") == "run"
    result = (
        F.when(F.col("job_id").isNull(), "job_id_missing")
        .when(F.col("found").isNull(), "job_not_active")
        .when(F.col("met") == "run", "job_busy")
        .when(~is_run & F.coalesce(F.col("execution") != "Auto", F.lit(True)), "not_auto")
        # A refused skip moves nothing, so once a job's skips are refused, all later ones are.
        .when(~is_run & ~(may(F.col("next_run")) & may(F.col("first_skip"))), "no_next_run")
        .otherwise("done")
    )
    judged = met.withColumn("result", result)
    runs = (F.col("result") == "done") & is_run
    skips = (F.col("result") == "done") & ~is_run
    return judged.select(
        "request_id",
        F.col("kind").alias("action"),
        "job_id",
        F.lit(None).cast("bigint").alias("job_queue_id"),
        "result",
        F.when(runs, "Queue").when(skips, "Skip").alias("new_status"),
        F.when(runs, moment(now)).when(skips, F.col("this_run")).alias("run_time"),
        F.when(skips, F.col("next_run")).alias("next_recurrence_time"),
        F.when(runs, job_message(F.col("job_id"), "Job ", " now in the queue."))
        .when(skips, job_message(F.col("job_id"), "Job ", " skip, by user action."))
        .alias("message"),
        F.coalesce(skips & F.col("skip_job"), F.lit(False)).alias("mail"),
    )


def _queue_requests(requests: DataFrame, tables: JobTables, now: When) -> DataFrame:
    asked = requests.where("action in ('fail', 'interrupt')").select("request_id", "action", "job_queue_id")
    per_row = asked.groupBy("job_queue_id").agg(F.min("request_id").alias("first_request"), F.count("*").alias("rows"))
    flags = tables.source_job.select("job_id", "fail_job")
    state = (
        tables.job_queue.select("job_queue_id", "job_id", F.col("job_status").alias("queue_status"))
        .join(per_row.drop("rows"), "job_queue_id")
        .join(flags, "job_id", "left")
    )
    later = F.col("request_id") > F.col("first_request")
    waiting = F.col("queue_status") == "Queue"
    result = (
        F.when(F.col("job_queue_id").isNull(), "queue_id_missing")
        .when(F.col("queue_status").isNull(), "queue_row_not_found")
        .when((F.col("action") == "fail") & (~waiting | later), "not_in_queue")
        .otherwise("done")
    )
    fails = (F.col("result") == "done") & (F.col("action") == "fail")
    interrupts = (F.col("result") == "done") & (F.col("action") == "interrupt")
    return (
        spread_join(asked, state, "job_queue_id", "request_id", per_row.select("job_queue_id", "rows"), "left")
        .withColumn("result", result)
        .select(
            "request_id",
            "action",
            "job_id",
            "job_queue_id",
            "result",
            F.when(fails, "Failed").when(interrupts, "Interrupt").alias("new_status"),
            F.when(F.col("result") == "done", moment(now)).alias("run_time"),
            F.lit(None).cast("timestamp_ntz").alias("next_recurrence_time"),
            F.when(fails, job_message(F.col("job_id"), "Job ", " fail by manual."))
            .when(interrupts, job_message(F.col("job_id"), "Job ", " interrupted."))
            .alias("message"),
            F.coalesce(fails & F.col("fail_job"), F.lit(False)).alias("mail"),
        )
    )


def operator_actions(requests: DataFrame, tables: JobTables, now: When, range_ids: int = RANGE_IDS) -> DataFrame:
    """The result of each request (request_id, action, job_id, job_queue_id), the requests acting in order of their ids.

    ``done`` or the reason it was refused, the new status, the time it stands for, the
    audit text and whether a mail is due. Ids of requests are unique and not null. A queue row
    can be failed while it waits, so the first fail or interrupt of a row decides on later ones;
    a job is free again after each accepted one.
    """
    on_rows = _queue_requests(requests, tables, now)
    freed = on_rows.where("result = 'done' and job_id is not null").select("job_id", "request_id")
    both = _job_requests(requests, freed, tables, now, range_ids).unionByName(on_rows)
    return both.select(*RESULT_COLUMNS)


def action_changes(
    requests: DataFrame, tables: JobTables, now: When, queue_id: int | None = None, log_id: int | None = None
) -> ActionChanges:
    """Accepted requests as rows to write.

    ``queue_id`` and ``log_id`` are the highest ids so far, looked up when not given.
    """
    done = operator_actions(requests, tables, now).where("result = 'done'")
    on_job, on_row = done.where("action in ('run', 'skip')"), done.where("action in ('fail', 'interrupt')")
    runs, nothing = F.col("action") == "run", F.lit(None)
    new_queue_id = highest_id(tables.job_queue, "job_queue_id", queue_id) + F.col("request_id")
    new_log_id = highest_id(tables.job_audit_logs, "job_audit_log_id", log_id) + F.col("request_id")
    new_rows = on_job.select(
        new_queue_id.alias("job_queue_id"),
        moment(now).alias("date_created"),
        nothing.cast("timestamp_ntz").alias("end_time"),
        "job_id",
        F.lit(False).alias("job_send"),
        F.col("new_status").alias("job_status"),
        F.col("message").alias("job_status_message"),
        F.when(runs, F.lit(True)).alias("run_manual"),
        F.when(~runs, F.lit(True)).alias("skip_manual"),
        F.when(~runs, F.col("run_time")).alias("skip_time"),
        F.when(runs, F.col("run_time")).alias("start_time"),
    )
    # Ending a row by hand leaves the same closing message as a normal end.
    updates = on_row.groupBy("job_queue_id", "job_id").agg(
        F.max_by("new_status", "request_id").alias("job_status"), F.max("run_time").alias("end_time")
    )
    updates = updates.withColumn("job_status_message", job_message(F.col("job_id"), "Job ", " now complete."))
    jobs = done.where("action <> 'skip'").groupBy("job_id").agg(
        F.max_by("new_status", "request_id").alias("job_running_status"),
        F.max(F.when(runs, F.col("run_time"))).alias("last_job_run"),
    )
    first = primary_schedules(tables.scheduler, ("scheduler_id",))
    last_skips = on_job.where(~runs).groupBy("job_id").agg(F.max_by("next_recurrence_time", "request_id").alias("recurrence_time"))
    schedules = last_skips.join(first, "job_id").select("scheduler_id", "recurrence_time")
    audit = done.select(
        new_log_id.alias("job_audit_log_id"),
        F.coalesce("job_queue_id", new_queue_id).alias("job_queue_id"),
        F.col("message").alias("log_detail"),
        moment(now).alias("date_created"),
    )
    return ActionChanges(new_rows, updates, jobs, schedules, audit)
