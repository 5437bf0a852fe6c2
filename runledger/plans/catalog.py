"""Every operator as a named query over a folder of sample tables.

Each runs over whole tables. Dates, search texts and a page are the parameters a
caller of the operator would give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runledger.functions.texts import parsed_stamp
from runledger.functions.timing import effective_time
from runledger.model import JOB_SHEET_COLUMNS, JOB_SHEET_HEADINGS
from runledger.operators import (
    actions,
    adhoc,
    admission,
    bulk,
    dashboards,
    definitions,
    details,
    dispatch,
    folding,
    lookups,
    notices,
    paging,
    payload,
    quality,
    reports,
    schedule,
    search,
)
from runledger.session import work_path
from runledger.sources.sample_views import raw_table, sample_tables, view_over
from runledger.sources.due_wheel import DueWheel
from runledger.sources.name_grams import NameGrams
from runledger.sources.open_days import index_open_days
from runledger.sources.sheets import read_sheet, write_sheet
from runledger.sources.tables import JobTables, read_table, read_tables, write_changes, write_table
from runledger.streaming import dispatching, messages

DAY, HOUR = "2024-01-09", 10
WEEK = ("2024-01-08", "2024-01-14")
WINDOW = ("1996-01-01 00:00:00", "1997-01-01 00:00:00")
WHEEL_WINDOW = ("1996-06-01 00:00:00", "1997-03-31 23:59:59")
DUE = ("1995-01-01 00:00:00", "1998-12-31 12:00:00")
HORIZON = ("1996-06-01 00:00:00", "1996-06-08 00:00:00")
YEAR = ("1996-06-01 00:00:00", "1997-06-01 00:00:00")
UPLOAD_CLOCK = "1998-01-01 00:00:00"
NOW = "2024-02-01 00:00:00"
# The status messages read as requests of operators, in both dialects.
REQUEST_LOG = (
    "seq as request_id",
    "case when seq % 5 < 1 then 'run' when seq % 5 < 3 then 'skip' when seq % 2 = 0 then 'fail' else 'interrupt' end as action",
    "case when seq % 5 < 3 then case when seq % 3 = 0 then 3 else job_id end end as job_id",
    "case when seq % 5 >= 3 then seq + 1000 end as job_queue_id",
)
# The job changes read as changes of task types, in both dialects; many meet the same type.
TYPE_LOG = (
    "change_id",
    "op",
    "case when op <> 'add' then 1000 + change_id % 7 end as source_task_type_id",
    "job_name as service_name",
    "execution as description",
    "case when priority is not null then concat('topic=made-topic&partitions=[', cast(priority as varchar(2)), ']') end as queue_topic_partition",
    "case when complete_job then 'name string' end as schema_payload",
    "job_status as task_type_status",
)
# Schedules sent with changes: some jobs get several, not all name an end or a recurrence.
SENT_SCHEDULES = (
    "scheduler_id as change_id",
    "job_id",
    "start_date",
    "case when scheduler_id % 3 = 0 then end_date end as end_date",
    "start_time",
    "frequency",
    "case when scheduler_id % 4 = 0 then '' when scheduler_id % 4 <> 1 then recurrence end as recurrence",
)
SCHEDULE_BASE = 5000000
# Upload rows as a deep tree: each hangs below one of a third of its number.
DEEP_TREE = ("seq as lookup_id", "case when seq >= 3 then cast((seq - seq % 3) / 3 as bigint) end as parent_lookup_id")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(run: Callable[[JobTables], DataFrame]) -> Callable[[JobTables], DataFrame]:
    """Register a query that needs the sample tables and nothing else."""
    _QUERIES[run.__name__] = lambda spark, folder: run(sample_tables(spark, folder))
    return run


def _spark_query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


# Scans, reports and sheets


@_query
def job_list(tables: JobTables) -> DataFrame:
    return details.job_list(tables)


@_query
def job_report(tables: JobTables) -> DataFrame:
    return reports.job_report(tables)


@_query
def task_report(tables: JobTables) -> DataFrame:
    return reports.task_report(tables)


def _plan(tables: JobTables) -> DataFrame:
    return dispatch.dispatch_plan(dispatch.waiting_rows(tables.job_queue), tables)


@_query
def dispatch_records(tables: JobTables) -> DataFrame:
    return dispatch.dispatch_records(_plan(tables))


@_query
def lookup_closure(tables: JobTables) -> DataFrame:
    return lookups.lookup_closure(tables.lookup_data)


@_query
def lookup_closure_deep(tables: JobTables) -> DataFrame:
    return lookups.lookup_closure(tables.status_messages.selectExpr(*DEEP_TREE))


@_spark_query
def bulk_read(spark: SparkSession, folder: str) -> DataFrame:
    """Upload sheets written from the upload rows and read back, cells as text."""
    path = work_path(spark, "job-sheets")
    write_sheet(sample_tables(spark, folder).bulk_jobs, path, JOB_SHEET_HEADINGS, JOB_SHEET_COLUMNS)
    return read_sheet(spark, path).where("row_no >= 2").select(*JOB_SHEET_COLUMNS)


@_spark_query
def bulk_read_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per sheet and number over a folder of three sheets: each starts at 2 and leaves none out."""
    path = work_path(spark, "job-sheets")
    rows = sample_tables(spark, folder).bulk_jobs
    for third in range(3):
        part = rows.where(F.pmod("row_no", F.lit(3)) == third).coalesce(1)
        write_sheet(part, f"{path}/sheet-{third}", JOB_SHEET_HEADINGS, JOB_SHEET_COLUMNS)
    read = read_sheet(spark, f"{path}/*")
    third = F.regexp_extract("sheet", "sheet-([0-9])", 1).cast("int").alias("third")
    return read.groupBy(third).agg(F.count("*").alias("rows"), F.min("row_no").alias("first_no"), F.max("row_no").alias("last_no"), F.count_distinct("row_no").alias("numbers"))


@_spark_query
def bulk_load_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """A faultless upload in three sheets: how many jobs it makes, under how many ids, and the highest."""
    path = work_path(spark, "job-sheets")
    tables = sample_tables(spark, folder)
    # Found once by many tasks; the one task that writes a sheet only passes its rows on.
    rows = _sound_jobs(tables)
    found = work_path(spark, "sound-jobs")
    rows.write.parquet(found)
    rows = spark.read.schema(rows.schema).parquet(found)
    for third in range(3):
        part = rows.where(F.pmod("row_no", F.lit(3)) == third).coalesce(1)
        write_sheet(part, f"{path}/sheet-{third}", JOB_SHEET_HEADINGS, JOB_SHEET_COLUMNS)
    jobs = bulk.bulk_load(read_sheet(spark, f"{path}/*"), tables, UPLOAD_CLOCK).jobs
    return jobs.agg(F.count("*").alias("jobs"), F.count_distinct("job_id").alias("ids"), F.max("job_id").alias("highest"))


# Filters and searches


@_query
def date_range_filter(tables: JobTables) -> DataFrame:
    found = search.date_range_filter(tables.source_task, "2023-02-01", "2023-06-30")
    return found.select("task_detail_id", "date_created")


@_query
def task_search(tables: JobTables) -> DataFrame:
    found = search.task_search(tables, "task_name", "wIdGet", end="2024-03-31")
    return found.select("task_detail_id", "task_name", "task_status", "source_task_type_id", "service_name")


@_query
def linked_job_search(tables: JobTables) -> DataFrame:
    return search.linked_jobs(tables, item="date_created", value="2023-1")


@_query
def queue_log(tables: JobTables) -> DataFrame:
    return dashboards.queue_log(tables, *WEEK, statuses=["Queue", "Failed", "Skip"])


@_query
def run_detail(tables: JobTables) -> DataFrame:
    return dashboards.run_detail(tables, hour=HOUR, status="Completed")


@_query
def active_job_lookup(tables: JobTables) -> DataFrame:
    return details.active_job_lookup(tables, tables.job_queue.select("job_id").distinct())


@_query
def active_tasks(tables: JobTables) -> DataFrame:
    return details.active_tasks(tables)


@_query
def root_lookups(tables: JobTables) -> DataFrame:
    return details.root_lookups(tables)


@_query
def effective_run_time(tables: JobTables) -> DataFrame:
    time = effective_time(F.col("job_status"), F.col("skip_time"), F.col("start_time"))
    return tables.job_queue.select("job_queue_id", time.alias("run_time"))


@_query
def parse_timestamp_text(tables: JobTables) -> DataFrame:
    text = F.col("date_created").cast("string")
    return tables.job_queue.select("job_queue_id", parsed_stamp(text).alias("created_at"))


# Joins


@_query
def due_candidates(tables: JobTables) -> DataFrame:
    return schedule.due_candidates(tables, *WINDOW).select("scheduler_id", "job_id", "recurrence_time")


@_query
def job_status_snapshot(tables: JobTables) -> DataFrame:
    return details.job_status_snapshot(tables, tables.job_queue.select("job_id").distinct())


@_query
def task_search_page(tables: JobTables) -> DataFrame:
    return search.task_search_page(
        tables, "service_name", "a", start="2023-01-15", column="task_name", direction="desc", page=3, limit=25
    )


@_query
def task_search_page_by_links(tables: JobTables) -> DataFrame:
    return search.task_search_page(tables, column="total_link_jobs", direction="desc", page=2, limit=20)


@_query
def task_linked_jobs(tables: JobTables) -> DataFrame:
    return search.linked_jobs(tables, start="2023-07-01", end="2024-01-31", item="job_status", value="Active")


@_query
def type_tasks(tables: JobTables) -> DataFrame:
    return details.type_tasks(tables)


@_query
def job_detail(tables: JobTables) -> DataFrame:
    return details.flat_job_detail(details.job_detail(tables))


@_query
def job_detail_by_value(tables: JobTables) -> DataFrame:
    return details.flat_job_detail(details.job_detail(tables, lookup_field="lookup_value"))


@_query
def task_detail(tables: JobTables) -> DataFrame:
    return details.task_detail(tables)


@_query
def audit_trail(tables: JobTables) -> DataFrame:
    return details.audit_trail(tables)


@_query
def lookup_tree(tables: JobTables) -> DataFrame:
    return details.lookup_tree(tables)


@_query
def missing_task_rows(tables: JobTables) -> DataFrame:
    return bulk.missing_task_rows(tables.bulk_jobs, tables).select("row_no", "task_id")


# Counts


@_query
def job_status_counts(tables: JobTables) -> DataFrame:
    return dashboards.job_status_counts(tables)


@_query
def job_running_counts(tables: JobTables) -> DataFrame:
    return dashboards.job_running_counts(tables)


@_query
def runs_by_weekday(tables: JobTables) -> DataFrame:
    return dashboards.runs_by_weekday(tables, "2024-01-01", "2024-01-28")


@_query
def runs_by_weekday_hour(tables: JobTables) -> DataFrame:
    return dashboards.runs_by_weekday_hour(tables, *WEEK)


@_query
def run_status_matrix(tables: JobTables) -> DataFrame:
    return dashboards.run_status_matrix(tables, DAY, HOUR)


@_query
def job_run_statistics(tables: JobTables) -> DataFrame:
    return dashboards.job_run_statistics(tables)


@_query
def queue_status_counts(tables: JobTables) -> DataFrame:
    return dashboards.queue_status_counts(tables)


@_query
def tasks_per_type(tables: JobTables) -> DataFrame:
    return dashboards.tasks_per_type(tables)


@_query
def in_flight_per_job(tables: JobTables) -> DataFrame:
    return dashboards.in_flight_per_job(tables)


@_query
def runs_per_job(tables: JobTables) -> DataFrame:
    return dashboards.runs_per_job(tables)


@_query
def task_search_total(tables: JobTables) -> DataFrame:
    return search.task_search_total(tables, "service_name", "a", start="2023-01-15")


# Order, pages and batches


@_query
def sort_page(tables: JobTables) -> DataFrame:
    jobs = tables.source_job.select("job_id", "job_name", "job_running_status", "priority")
    return paging.sort_page(jobs, "job_id", "job_running_status", "desc", page=2, limit=50)


@_query
def sort_page_deep(tables: JobTables) -> DataFrame:
    """A page in the midst of the audit log by its creation time, found by ranges."""
    logs = tables.job_audit_logs
    return paging.sort_page(logs, "job_audit_log_id", "date_created", "desc", page=20, limit=75, top_rows=1000)


@_query
def page_info(tables: JobTables) -> DataFrame:
    return paging.page_info(search.task_search_total(tables, "service_name", "a"), page=3, limit=25)


@_query
def dispatch_batch(tables: JobTables) -> DataFrame:
    return dispatch.dispatch_batch(tables)


@_query
def dispatch_batch_by_priority(tables: JobTables) -> DataFrame:
    return dispatch.dispatch_batch(tables, limit=5000, by_priority=True)


# Schedules


@_query
def first_run(tables: JobTables) -> DataFrame:
    return schedule.with_first_run(tables.scheduler).select("scheduler_id", "first_run")


@_query
def route_parse(tables: JobTables) -> DataFrame:
    tasks = tables.source_task.select("task_detail_id", "source_task_type_id")
    routes = schedule.parse_routes(tables.source_task_type.select("source_task_type_id", "queue_topic_partition"))
    return tasks.join(routes, "source_task_type_id").select("task_detail_id", "topic", "partition", "route_valid")


@_query
def next_run(tables: JobTables) -> DataFrame:
    return schedule.with_next_run(tables.scheduler).select("scheduler_id", "next_run")


@_query
def schedule_advance(tables: JobTables) -> DataFrame:
    return schedule.schedule_advance(tables.scheduler).select("scheduler_id", "recurrence_time", "exhausted")


@_query
def schedule_due(tables: JobTables) -> DataFrame:
    return schedule.schedule_due(tables, *DUE).select("scheduler_id", "job_id", "recurrence_time")


@_query
def run_calendar(tables: JobTables) -> DataFrame:
    """One week of all schedules, and twelve months of those that run by the week or month."""
    slow = F.coalesce(F.col("frequency").isin("Weekly", "Monthly"), F.lit(False))
    week = schedule.run_calendar(tables.scheduler.where(~slow), *HORIZON)
    return week.unionByName(schedule.run_calendar(tables.scheduler.where(slow), *YEAR))


# Table changes


@_query
def queue_admission(tables: JobTables) -> DataFrame:
    return admission.queue_admission(tables, *DUE)


@_query
def queue_admission_rows(tables: JobTables) -> DataFrame:
    return admission.admission_changes(tables, *DUE).queue_rows


@_query
def queue_admission_jobs(tables: JobTables) -> DataFrame:
    return admission.admission_changes(tables, *DUE).job_updates


@_query
def queue_admission_schedules(tables: JobTables) -> DataFrame:
    return admission.admission_changes(tables, *DUE).schedules


@_query
def queue_admission_audit(tables: JobTables) -> DataFrame:
    return admission.admission_changes(tables, *DUE).audit_rows


@_query
def queue_admission_mails(tables: JobTables) -> DataFrame:
    return admission.admission_changes(tables, *DUE).skip_mails


@_query
def queue_admission_last_run(tables: JobTables) -> DataFrame:
    return admission.admission_changes(tables, *DUE).last_run


@_query
def dispatch_plan(tables: JobTables) -> DataFrame:
    return _plan(tables).select("job_queue_id", "job_id", "outcome", "failure_text", "topic", "partition")


def _results(tables: JobTables) -> DataFrame:
    """A broker's answers: each fifth record fails."""
    ok = F.col("job_queue_id") % 5 != 0
    return dispatch.waiting_rows(tables.job_queue).select(
        "job_queue_id",
        ok.alias("ok"),
        F.when(ok, F.col("job_queue_id") * 2).alias("offset"),
        F.when(~ok, "broker timeout").alias("error"),
    )


@_query
def dispatch_outcome(tables: JobTables) -> DataFrame:
    return dispatch.dispatch_outcome(_plan(tables), _results(tables), NOW)


def _dispatch_changes(tables: JobTables) -> dispatch.DispatchChanges:
    return dispatch.dispatch_changes(_plan(tables), _results(tables), tables, NOW)


@_query
def dispatch_queue_rows(tables: JobTables) -> DataFrame:
    return _dispatch_changes(tables).queue_rows


@_query
def dispatch_jobs(tables: JobTables) -> DataFrame:
    return _dispatch_changes(tables).job_updates


@_query
def dispatch_audit(tables: JobTables) -> DataFrame:
    return _dispatch_changes(tables).audit_rows


@_query
def dispatch_mails(tables: JobTables) -> DataFrame:
    return _dispatch_changes(tables).mails


@_query
def dispatch_notices(tables: JobTables) -> DataFrame:
    return _dispatch_changes(tables).notices


@_query
def operator_actions(tables: JobTables) -> DataFrame:
    return actions.operator_actions(tables.operator_requests, tables, NOW)


@_query
def operator_actions_queue(tables: JobTables) -> DataFrame:
    return actions.action_changes(tables.operator_requests, tables, NOW).queue_updates


@_query
def operator_actions_new_rows(tables: JobTables) -> DataFrame:
    return actions.action_changes(tables.operator_requests, tables, NOW).new_queue_rows


@_query
def operator_actions_sequence(tables: JobTables) -> DataFrame:
    """A log in which jobs get many requests, a third of the runs and skips going to one job."""
    return actions.operator_actions(tables.status_messages.selectExpr(*REQUEST_LOG), tables, NOW)


@_query
def operator_actions_schedules(tables: JobTables) -> DataFrame:
    return actions.action_changes(tables.status_messages.selectExpr(*REQUEST_LOG), tables, NOW).schedules


@_query
def operator_actions_jobs(tables: JobTables) -> DataFrame:
    return actions.action_changes(tables.status_messages.selectExpr(*REQUEST_LOG), tables, NOW).job_updates


@_query
def operator_actions_audit(tables: JobTables) -> DataFrame:
    return actions.action_changes(tables.status_messages.selectExpr(*REQUEST_LOG), tables, NOW).audit_rows


@_query
def status_fold(tables: JobTables) -> DataFrame:
    return folding.status_fold(tables, tables.status_messages)


@_query
def status_fold_jobs(tables: JobTables) -> DataFrame:
    return folding.status_fold_jobs(tables, tables.status_messages)


@_query
def status_fold_audit(tables: JobTables) -> DataFrame:
    return folding.audit_rows(tables.status_messages)


@_query
def status_cascade(tables: JobTables) -> DataFrame:
    types = tables.source_task_type.select("source_task_type_id", F.col("task_type_status").alias("new_status"))
    return folding.cascade_from_types(tables, types).select("job_id", "task_detail_id", "job_status")


@_query
def status_cascade_from_tasks(tables: JobTables) -> DataFrame:
    tasks = tables.source_task.select("task_detail_id", F.col("task_status").alias("new_status"))
    return folding.cascade_from_tasks(tables, tasks).select("job_id", "task_detail_id", "job_status")


@_query
def bulk_job_validation(tables: JobTables) -> DataFrame:
    checked = bulk.bulk_job_validation(tables.bulk_jobs, UPLOAD_CLOCK)
    return checked.select("row_no", F.concat_ws(",", "errors").alias("errors"))


@_query
def bulk_task_validation(tables: JobTables) -> DataFrame:
    checked = bulk.bulk_task_validation(tables.bulk_tasks, tables)
    return checked.select("row_no", F.concat_ws(",", "errors").alias("errors"))


def _sound_jobs(tables: JobTables) -> DataFrame:
    """The upload rows that pass every rule, as a sheet without faults would hold."""
    faults = bulk.bulk_load(tables.bulk_jobs, tables, UPLOAD_CLOCK).errors.select("row_no")
    return tables.bulk_jobs.join(faults, "row_no", "left_anti")


@_query
def bulk_load(tables: JobTables) -> DataFrame:
    return bulk.bulk_load(_sound_jobs(tables), tables, UPLOAD_CLOCK).jobs


@_query
def bulk_load_schedules(tables: JobTables) -> DataFrame:
    return bulk.bulk_load(_sound_jobs(tables), tables, UPLOAD_CLOCK).schedules


@_query
def bulk_load_errors(tables: JobTables) -> DataFrame:
    load = bulk.bulk_load(tables.bulk_jobs, tables, UPLOAD_CLOCK)
    return load.errors.select("row_no", F.concat_ws(",", "errors").alias("errors"))


@_query
def bulk_load_rejected(tables: JobTables) -> DataFrame:
    """Job rows of an upload with faults: none."""
    return bulk.bulk_load(tables.bulk_jobs, tables, UPLOAD_CLOCK).jobs.select("job_id", "job_name")


@_query
def payload_flatten(tables: JobTables) -> DataFrame:
    return payload.payload_flatten(tables.source_task)


@_query
def payload_build(tables: JobTables) -> DataFrame:
    return payload.payload_build(tables.source_task_payload).withColumnRenamed("payload_id", "task_detail_id")


@_query
def upsert_definitions(tables: JobTables) -> DataFrame:
    return definitions.upsert_definitions(tables.job_changes, tables, "source_job", NOW)


@_query
def upsert_job_errors(tables: JobTables) -> DataFrame:
    return definitions.check_changes(tables.job_changes, tables, "source_job").select("change_id", "op", "error")


@_query
def upsert_tasks(tables: JobTables) -> DataFrame:
    return definitions.upsert_definitions(tables.task_changes, tables, "source_task", NOW)


@_query
def upsert_task_errors(tables: JobTables) -> DataFrame:
    return definitions.check_changes(tables.task_changes, tables, "source_task").select("change_id", "op", "error")


@_query
def upsert_task_cascade(tables: JobTables) -> DataFrame:
    rows = definitions.cascaded_jobs(tables.task_changes, tables, "source_task")
    return rows.select("job_id", "task_detail_id", "job_status")


def _sent_tags(tables: JobTables) -> DataFrame:
    """Three tags with every other task change."""
    rows = tables.task_changes.where("change_id % 2 = 0").select("change_id", "task_name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    return rows.selectExpr("change_id", "change_id * 3 + i as row_no", "concat('tag', i) as tag_key", "case when i > 0 then 'tag0' end as tag_parent", "task_name as tag_value")


@_query
def upsert_task_tags(tables: JobTables) -> DataFrame:
    return definitions.task_tags(tables.task_changes, _sent_tags(tables), tables).added


@_query
def upsert_task_tags_removed(tables: JobTables) -> DataFrame:
    return definitions.task_tags(tables.task_changes, _sent_tags(tables), tables).removed


@_query
def upsert_types(tables: JobTables) -> DataFrame:
    return definitions.upsert_definitions(tables.job_changes.selectExpr(*TYPE_LOG), tables, "source_task_type", NOW)


@_query
def upsert_type_errors(tables: JobTables) -> DataFrame:
    checked = definitions.check_changes(tables.job_changes.selectExpr(*TYPE_LOG), tables, "source_task_type")
    return checked.select("change_id", "op", "error")


@_query
def upsert_type_cascade(tables: JobTables) -> DataFrame:
    rows = definitions.cascaded_jobs(tables.job_changes.selectExpr(*TYPE_LOG), tables, "source_task_type")
    return rows.select("job_id", "task_detail_id", "job_status")


@_query
def upsert_schedules_added(tables: JobTables) -> DataFrame:
    return definitions.schedules_to_add(tables.scheduler.selectExpr(*SENT_SCHEDULES), NOW, SCHEDULE_BASE)


@_query
def upsert_schedules_changed(tables: JobTables) -> DataFrame:
    return definitions.schedules_to_update(tables.scheduler.selectExpr(*SENT_SCHEDULES), tables)


@_query
def upsert_lookups(tables: JobTables) -> DataFrame:
    return definitions.upsert_definitions(tables.lookup_changes, tables, "lookup_data", NOW)


@_query
def notification_feed(tables: JobTables) -> DataFrame:
    return notices.notification_feed(tables, folding.state_messages(tables.status_messages))


@_query
def status_notifications(tables: JobTables) -> DataFrame:
    return notices.status_notifications(tables, tables.job_queue.select("job_id").distinct())


@_query
def unlisted_values(tables: JobTables) -> DataFrame:
    """Upload rows taken as schedules hold frequencies that do not exist."""
    rows = tables.bulk_jobs.select(F.col("row_no").alias("scheduler_id"), "frequency")
    return quality.unlisted_values(tables.replacing(scheduler=rows))


# Tables written and changed in place


@_spark_query
def written_status_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The queue written by day, changed there by the status messages, and read back whole."""
    path = work_path(spark, "tables")
    tables = sample_tables(spark, folder)
    write_table(tables.job_queue, "job_queue", f"{path}/job_queue")
    stored = read_tables(spark, path)
    changed = folding.status_fold(tables.replacing(job_queue=stored.job_queue), tables.status_messages)
    write_changes(spark, changed, "job_queue", f"{path}/job_queue", "job_queue_id")
    return read_table(spark, "job_queue", f"{path}/job_queue").select(*tables.job_queue.columns)


def _changed_queue(spark: SparkSession, folder: str) -> JobTables:
    """The sample tables with a queue that was written, indexed by open days and then changed."""
    path = work_path(spark, "tables")
    tables = sample_tables(spark, folder)
    write_table(tables.job_queue, "job_queue", f"{path}/job_queue")
    index_open_days(spark, f"{path}/job_queue")
    stored = read_tables(spark, path)
    changed = folding.status_fold(tables.replacing(job_queue=stored.job_queue), tables.status_messages)
    write_changes(spark, changed, "job_queue", f"{path}/job_queue", "job_queue_id")
    stored = read_tables(spark, path)
    return tables.replacing(job_queue=stored.job_queue, open_queue=stored.open_queue)


@_spark_query
def written_in_flight(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in flight per job after a change set, from open days alone."""
    return dashboards.in_flight_per_job(_changed_queue(spark, folder))


@_spark_query
def gram_search(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks with a text in their name, by postings of the name's grams."""
    tasks = sample_tables(spark, folder).source_task
    grams = NameGrams(spark, work_path(spark, "task-grams"), "task_detail_id", "task_name", ignore_case=True)
    grams.write(tasks)
    return grams.search(tasks, "wIdGet").select("task_detail_id", "task_name", "task_status")


@_spark_query
def wheel_due(spark: SparkSession, folder: str) -> DataFrame:
    """What is due in a window after the schedules of the window before have moved, from a wheel by year and month."""
    wheel = DueWheel(spark, work_path(spark, "due-wheel"), "year", "month")
    wheel.write(sample_tables(spark, folder).scheduler)
    wheel.advance(*WINDOW)
    return wheel.due(*WHEEL_WINDOW).select("scheduler_id", "job_id", "recurrence_time")


@_spark_query
def written_job_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs written whole, changed in place by the status messages, and read back."""
    path = work_path(spark, "tables")
    tables = sample_tables(spark, folder)
    write_table(tables.source_job, "source_job", f"{path}/source_job")
    stored = read_tables(spark, path)
    changed = folding.status_fold_jobs(tables.replacing(source_job=stored.source_job), tables.status_messages)
    write_changes(spark, changed, "source_job", f"{path}/source_job", "job_id")
    return read_table(spark, "source_job", f"{path}/source_job")


# Streams: the raw table is read as a file stream, to its end


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = raw_table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return view_over(spark, name, events=events)


@_spark_query
def stream_status_fold(spark: SparkSession, folder: str) -> DataFrame:
    output = work_path(spark, "status-fold")
    messages.start_status_fold(_stream(spark, folder, "status_messages"), output, available_now=True).awaitTermination()
    return messages.queue_rows_so_far(spark, output, sample_tables(spark, folder))


def _stream_by_quarters(spark: SparkSession, folder: str, name: str, when: str) -> DataFrame:
    """A table as a stream of four writes, the newest rows first, so that all but the first come late."""
    path = work_path(spark, f"{name}-quarters")
    rows = getattr(sample_tables(spark, folder), name)
    seconds = F.unix_seconds(F.col(when).cast("timestamp"))
    low, high = rows.agg(F.min(seconds), F.max(seconds)).head()
    age = F.coalesce(F.floor((F.lit(high) - seconds) * 4 / max(1, high - low + 1)), F.lit(3))
    for quarter in range(4):
        rows.where(age == quarter).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16).parquet(path)


@_spark_query
def stream_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    output = work_path(spark, "audit-log")
    stream = _stream_by_quarters(spark, folder, "status_messages", "event_time")
    messages.start_audit_log(stream, output, available_now=True).awaitTermination()
    return messages.audit_log_so_far(spark, output)


@_spark_query
def stream_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    output = work_path(spark, "hourly-counts")
    stream = _stream_by_quarters(spark, folder, "status_messages", "event_time")
    messages.start_hourly_counts(stream, output, available_now=True).awaitTermination()
    return messages.hourly_counts_so_far(spark, output)


def _dispatched(spark: SparkSession, folder: str, limit: int | None) -> DataFrame:
    output = work_path(spark, "dispatch")
    stream = _stream_by_quarters(spark, folder, "job_queue", "date_created")
    dispatching.start_intake(stream, output, available_now=True).awaitTermination()
    dispatching.send_all(spark, output, lambda: sample_tables(spark, folder), limit)
    return dispatching.records_so_far(spark, output)


@_spark_query
def stream_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    return _dispatched(spark, folder, None)


@_spark_query
def stream_dispatch_limited(spark: SparkSession, folder: str) -> DataFrame:
    """In steps of at most a quarter of the waiting rows; all are sent in the end."""
    waiting = dispatch.waiting_rows(sample_tables(spark, folder).job_queue).count()
    return _dispatched(spark, folder, max(1, waiting // 4))


# A caller's SQL

ADHOC_TEXT = """
select j.execution, q.job_status, count(*) as runs, max(q.date_created) as newest
from job_queue q join source_job j on j.job_id = q.job_id
where j.priority <= :highest
group by j.execution, q.job_status
order by runs desc
"""


MIXED_CASE_TEXT = """
SELECT s.Frequency AS frequency, COUNT(*) AS schedules FROM SCHEDULER s
JOIN Source_Job j ON j.job_id = s.job_id GROUP BY s.Frequency
"""


@_spark_query
def adhoc_sql_mixed_case(spark: SparkSession, folder: str) -> DataFrame:
    return adhoc.adhoc_sql(spark, sample_tables(spark, folder), MIXED_CASE_TEXT)


@_spark_query
def adhoc_sql(spark: SparkSession, folder: str) -> DataFrame:
    return adhoc.adhoc_sql(spark, sample_tables(spark, folder), ADHOC_TEXT, {"highest": 9})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
