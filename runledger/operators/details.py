"""Job, task and lookup records put together from several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runledger.functions.joins import join_many
from runledger.functions.texts import iso_text, stamp_text
from runledger.sources.tables import JobTables

SCHEDULE_COLUMNS = (
    "scheduler_id", "start_date", "end_date", "start_time", "frequency", "recurrence", "recurrence_time",
)
TYPE_COLUMNS = (
    "source_task_type_id", "service_name", "queue_topic_partition", "description", "schema_payload",
    "is_schema_register",
)
TASK_COLUMNS = ("task_detail_id", "task_name", "task_status", "task_payload")
LOOKUP_COLUMNS = ("lookup_id", "lookup_value", "lookup_type", "description", "date_created")
DETAIL_JOB_COLUMNS = (
    "job_id", "job_status", "job_running_status", "last_job_run", "job_name", "date_created", "priority",
    "execution", "complete_job", "fail_job", "skip_job",
)


def primary_schedules(schedules: DataFrame, columns: tuple[str, ...] = SCHEDULE_COLUMNS) -> DataFrame:
    """The schedule with the lowest id of each job, with the columns asked for.

    A minimum is reduced inside each task before the shuffle, which a ranking over
    all schedules of a job would not be.
    """
    kept = F.min_by(F.struct(*columns), "scheduler_id").alias("schedule")
    return schedules.groupBy("job_id").agg(kept).select("job_id", "schedule.*")


def job_list(tables: JobTables) -> DataFrame:
    """All jobs by id, each with its schedule and whether it ever ran."""
    ran = tables.job_queue.groupBy("job_id").agg(F.lit(True).alias("ran"))
    return (
        tables.source_job.join(primary_schedules(tables.scheduler), "job_id", "left")
        .join(ran, "job_id", "left")
        .withColumn("has_run", F.coalesce("ran", F.lit(False)))
        .drop("ran")
        .orderBy("job_id")
    )


def _typed_tasks(tables: JobTables, lookup_field: str, task_ids: DataFrame | None = None) -> DataFrame:
    """Tasks with their type as a struct and the names behind their two lookup ids."""
    tasks = tables.source_task
    if task_ids is not None:
        tasks = tasks.join(task_ids, "task_detail_id", "left_semi")
    types = tables.source_task_type.select(
        "source_task_type_id", F.struct(*TYPE_COLUMNS).alias("source_task_type")
    )
    names = tables.lookup_data.select("lookup_id", F.col(lookup_field).alias("lookup_name"))
    for column in ("home_page_id", "pipeline_id"):
        # A task names few different lookups: pick those first, so that the join with
        # the tasks sees a small side and the lookup table is never matched per task.
        used = tasks.select(F.col(column).alias("id_text")).where("id_text is not null").distinct()
        used = used.withColumn("lookup_id", F.col("id_text").try_cast("bigint"))
        used = used.join(names, "lookup_id").select(
            F.col("id_text").alias(column), F.col("lookup_name").alias(f"{column}_name")
        )
        tasks = tasks.join(used, column, "left")
    tasks = tasks.join(types, "source_task_type_id", "left")
    return tasks.select(
        "task_detail_id",
        F.struct(
            *TASK_COLUMNS,
            F.col("home_page_id_name").alias("home_page"),
            F.col("pipeline_id_name").alias("pipeline"),
            "source_task_type",
        ).alias("task"),
    )


def job_detail(tables: JobTables, job_id: int | None = None, lookup_field: str = "lookup_type") -> DataFrame:
    """One record per job with its task, task type and schedule nested in it.

    The dashboard shows the lookup's value where the job view shows its type:
    ``lookup_field`` picks one.
    """
    if lookup_field not in ("lookup_type", "lookup_value"):
        raise ValueError("lookup_field is lookup_type or lookup_value")
    jobs, schedules, task_ids = tables.source_job, tables.scheduler, None
    if job_id is not None:
        jobs = jobs.where(F.col("job_id") == job_id)
        schedules = schedules.where(F.col("job_id") == job_id)
        task_ids = jobs.select("task_detail_id")
    first = primary_schedules(schedules).select("job_id", F.struct(*SCHEDULE_COLUMNS).alias("schedule"))
    return (
        jobs.select("task_detail_id", *DETAIL_JOB_COLUMNS)
        .join(_typed_tasks(tables, lookup_field, task_ids), "task_detail_id", "left")
        .join(first, "job_id", "left")
        .select(*DETAIL_JOB_COLUMNS, "task", "schedule")
    )


def flat_job_detail(detail: DataFrame) -> DataFrame:
    """The nested job record as one flat row."""
    task = [F.col(f"task.{name}").alias(name) for name in (*TASK_COLUMNS, "home_page", "pipeline")]
    task_type = [
        F.col(f"task.source_task_type.{name}").alias("type_description" if name == "description" else name)
        for name in TYPE_COLUMNS
    ]
    schedule = [F.col(f"schedule.{name}").alias(name) for name in SCHEDULE_COLUMNS]
    return detail.select(*DETAIL_JOB_COLUMNS, *task, *task_type, *schedule)


def task_detail(tables: JobTables, task_detail_id: int | None = None) -> DataFrame:
    """Tasks with their type, one row per payload tag in tag order."""
    tasks, tags = tables.source_task, tables.source_task_payload
    if task_detail_id is not None:
        tasks = tasks.where(F.col("task_detail_id") == task_detail_id)
        tags = tags.where(F.col("payload_id") == task_detail_id)
    types = tables.source_task_type.select(*TYPE_COLUMNS, "task_type_status").withColumnRenamed(
        "description", "type_description"
    )
    tags = tags.withColumnRenamed("payload_id", "task_detail_id")
    typed = tasks.drop("date_created").join(types, "source_task_type_id", "left")
    return join_many(typed, tags, "task_detail_id", "task_payload_id").orderBy("task_detail_id", "task_payload_id")


def job_status_snapshot(tables: JobTables, job_ids: DataFrame) -> DataFrame:
    """State and next run of the Active jobs among the ids given."""
    active = tables.source_job.where("job_status = 'Active'").join(job_ids.select("job_id"), "job_id", "left_semi")
    runs = tables.scheduler.select("job_id", "scheduler_id", "recurrence_time")
    return join_many(active, runs, "job_id", "scheduler_id").select(
        "job_id", "job_status", "job_running_status", "last_job_run", "recurrence_time", "execution"
    )


def audit_trail(tables: JobTables, queue_id: int | None = None) -> DataFrame:
    """Audit rows with their queue row and job, by log id."""
    logs, queue = tables.job_audit_logs, tables.job_queue
    if queue_id is not None:
        logs = logs.where(F.col("job_queue_id") == queue_id)
        queue = queue.where(F.col("job_queue_id") == queue_id)
    queue = queue.select(
        "job_queue_id",
        "job_id",
        F.col("date_created").alias("queued_at"),
        F.col("job_status").alias("queue_status"),
        "job_status_message",
        "start_time",
        "skip_time",
        "end_time",
    )
    jobs = tables.source_job.select("job_id", "job_name", "job_status", "job_running_status", "execution")
    # The queue meets its jobs first: the log, which is the largest, is shuffled once before the order.
    return (
        logs.join(queue.join(jobs, "job_id", "left"), "job_queue_id", "left")
        .select(
            "job_audit_log_id", "job_queue_id", "log_detail", "date_created", "job_id", "job_name", "job_status",
            "job_running_status", "execution", "queued_at", "queue_status", "job_status_message", "start_time",
            "skip_time", "end_time",
        )
        .orderBy("job_audit_log_id")
    )


def root_lookups(tables: JobTables) -> DataFrame:
    return tables.lookup_data.where("parent_lookup_id is null").select(*LOOKUP_COLUMNS)


def lookup_tree(tables: JobTables, parent_id: int | None = None, roots_only: bool = True) -> DataFrame:
    """Lookups beside each of their children, one row per pair; childless ones once.

    Children stay rows, so a parent holding a third of all lookups is no single cell.
    With a ``parent_id`` the pair list of that lookup, root or not.
    """
    lookups = tables.lookup_data
    if parent_id is not None:
        parents = lookups.where(F.col("lookup_id") == parent_id)
    else:
        parents = lookups.where("parent_lookup_id is null") if roots_only else lookups
    children = lookups.where("parent_lookup_id is not null").select(
        F.col("parent_lookup_id").alias("lookup_id"),
        *(F.col(name).alias(f"child_{name}") for name in LOOKUP_COLUMNS),
    )
    if parent_id is not None:
        children = children.where(F.col("lookup_id") == parent_id)
    pairs = join_many(parents.select(*LOOKUP_COLUMNS), children, "lookup_id", "child_lookup_id")
    return pairs.orderBy("lookup_id", "child_lookup_id")


def setting(lookups: DataFrame, name: str) -> str | None:
    """The value of one setting, found by its unique type."""
    row = lookups.where(F.col("lookup_type") == name).select("lookup_value").head()
    return row[0] if row else None


def active_jobs(tables: JobTables, job_ids: DataFrame) -> DataFrame:
    """The Active jobs among the ids given."""
    return tables.source_job.where("job_status = 'Active'").join(job_ids.select("job_id"), "job_id", "left_semi")


def active_tasks_by_id(tables: JobTables, task_ids: DataFrame) -> DataFrame:
    active = tables.source_task.where("task_status = 'Active'")
    return active.join(task_ids.select("task_detail_id"), "task_detail_id", "left_semi")


def active_types_by_id(tables: JobTables, type_ids: DataFrame) -> DataFrame:
    active = tables.source_task_type.where("task_type_status = 'Active'")
    return active.join(type_ids.select("source_task_type_id"), "source_task_type_id", "left_semi")


def active_job_lookup(tables: JobTables, job_ids: DataFrame) -> DataFrame:
    """Active jobs among the ids, with their task and its type where those are Active too."""
    jobs = active_jobs(tables, job_ids).select("job_id", "job_name", "task_detail_id")
    tasks = tables.source_task.where("task_status = 'Active'").select(
        "task_detail_id", "task_name", "source_task_type_id"
    )
    types = tables.source_task_type.where("task_type_status = 'Active'").select("source_task_type_id", "service_name")
    return (
        jobs.join(tasks, "task_detail_id", "left")
        .join(types, "source_task_type_id", "left")
        .select("job_id", "job_name", "task_detail_id", "task_name", "source_task_type_id", "service_name")
    )


def active_tasks(tables: JobTables) -> DataFrame:
    return tables.source_task.where("task_status = 'Active'").select("task_detail_id", "task_name")


def type_tasks(tables: JobTables, type_id: int | None = None) -> DataFrame:
    """Tasks of one type, or of every type with the type's id."""
    tasks = tables.source_task.where(
        F.col("source_task_type_id") == type_id if type_id is not None else F.col("source_task_type_id").isNotNull()
    )
    return tasks.select("source_task_type_id", "task_detail_id", "task_name", "task_status")


def status_payload(snapshot: DataFrame) -> DataFrame:
    """The JSON text a job status notice carries; absent times are left out."""
    fields = F.struct(
        F.col("job_id").alias("jobId"),
        F.col("job_status").alias("jobStatus"),
        F.col("job_running_status").alias("jobRunningStatus"),
        iso_text(F.col("last_job_run")).alias("lastJobRun"),
        stamp_text(F.col("recurrence_time")).alias("recurrenceTime"),
        F.col("execution").alias("execution"),
    )
    return snapshot.select("job_id", F.to_json(fields).alias("payload"))
