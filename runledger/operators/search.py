"""Task and job searches with dates, one search text, order and pages."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.predicates import all_of, contains_text, in_days
from runledger.operators.paging import sort_page
from runledger.sources.tables import JobTables

# Searchable items: the column and whether the search ignores case.
TASK_ITEMS = {
    "task_detail_id": ("task_detail_id", False),
    "task_name": ("task_name", True),
    "task_status": ("task_status", False),
    "source_task_type_id": ("source_task_type_id", False),
    "service_name": ("service_name", True),
}
JOB_ITEMS = {
    "job_id": ("job_id", False),
    "job_name": ("job_name", True),
    "job_status": ("job_status", False),
    "date_created": ("date_created", False),
}
PAGE_COLUMNS = (
    "task_detail_id", "task_name", "task_payload", "home_page_id", "pipeline_id", "task_status",
    "source_task_type_id", "description", "is_schema_register", "queue_topic_partition", "schema_payload",
    "service_name", "task_type_status", "total_link_jobs",
)


def item_condition(items: Mapping[str, tuple[str, bool]], item: str | None, value: str | None) -> Column | None:
    """One search; an unknown item, or none, filters nothing."""
    if item is None or value is None or item.lower() not in items:
        return None
    column, ignore_case = items[item.lower()]
    return contains_text(F.col(column), value, ignore_case)


def _tasks_with_type(
    tables: JobTables, start: str | date | None, end: str | date | None, item: str | None, value: str | None
) -> DataFrame:
    tasks = tables.source_task.where(all_of(in_days(F.col("date_created"), start, end)))
    joined = tasks.drop("date_created").join(tables.source_task_type, "source_task_type_id")
    return joined.where(all_of(item_condition(TASK_ITEMS, item, value)))


def date_range_filter(
    df: DataFrame, start: str | date | None = None, end: str | date | None = None, column: str = "date_created"
) -> DataFrame:
    """Rows of whole days from ``start`` to ``end``, either left out."""
    return df.where(all_of(in_days(F.col(column), start, end)))


def task_search(
    tables: JobTables,
    item: str | None = None,
    value: str | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Tasks that have a type and meet the search, without counts or page."""
    return _tasks_with_type(tables, start, end, item, value)


def _with_links(found: DataFrame, tables: JobTables, is_page: bool) -> DataFrame:
    """Adds the lookup names and the number of jobs to tasks.

    For a page only the jobs and lookups its rows name are counted and read: the ids of
    a page are no more than its limit, so they are sent to the scans. Otherwise jobs are
    counted per task before they meet the tasks.
    """
    jobs = tables.source_job.select("task_detail_id")
    names = tables.lookup_data.select(F.col("lookup_id").cast("string").alias("id_text"), "lookup_type")
    used = found.select(F.explode(F.array("home_page_id", "pipeline_id")).alias("id_text")).where("id_text is not null")
    if is_page:
        jobs = jobs.join(F.broadcast(found.select("task_detail_id")), "task_detail_id", "left_semi")
        names = names.join(F.broadcast(used), "id_text", "left_semi")
    else:
        names = names.join(used.distinct(), "id_text", "left_semi")
    links = jobs.groupBy("task_detail_id").agg(F.count("*").alias("links"))
    named = found
    for column in ("home_page_id", "pipeline_id"):
        name = names.select(F.col("id_text").alias(column), F.col("lookup_type").alias(f"{column}_name"))
        named = named.join(name, column, "left")
    return (
        named.join(links, "task_detail_id", "left")
        .drop("home_page_id", "pipeline_id")
        .withColumnsRenamed({"home_page_id_name": "home_page_id", "pipeline_id_name": "pipeline_id"})
        .withColumn("total_link_jobs", F.coalesce("links", F.lit(0)))
        .select(*PAGE_COLUMNS)
    )


def task_search_page(
    tables: JobTables,
    item: str | None = None,
    value: str | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    column: str | None = None,
    direction: str | None = None,
    page: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One page of the task search with lookup names and linked-job counts.

    Ordering by a column of the task or its type picks the page first and then counts
    jobs and looks names up for those few rows only. Ordering by the job count or a
    lookup name has to work these out for every task found.
    """
    found = _tasks_with_type(tables, start, end, item, value)
    late = column in ("total_link_jobs", "home_page_id", "pipeline_id")
    if late:
        return sort_page(
            _with_links(found, tables, False), "task_detail_id", column, direction, page, limit, PAGE_COLUMNS
        )
    rows = sort_page(found, "task_detail_id", column, direction, page, limit, PAGE_COLUMNS)
    return sort_page(_with_links(rows, tables, True), "task_detail_id", column, direction, 1, limit, PAGE_COLUMNS)


def task_search_total(
    tables: JobTables,
    item: str | None = None,
    value: str | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Number of tasks the search finds; the joins that only add columns are left out."""
    return _tasks_with_type(tables, start, end, item, value).agg(F.count("*").alias("total_record"))


def linked_jobs(
    tables: JobTables,
    task_detail_id: int | None = None,
    start: str | date | None = None,
    end: str | date | None = None,
    item: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """Jobs of one task, or of every task, with times as text."""
    known = tables.source_task.where(F.col("task_status").isin("Delete", "Inactive", "Active"))
    jobs = tables.source_job.where(
        all_of(
            F.col("task_detail_id") == task_detail_id if task_detail_id is not None else None,
            in_days(F.col("date_created"), start, end),
            item_condition(JOB_ITEMS, item, value),
        )
    )
    if task_detail_id is not None:
        known = known.where(F.col("task_detail_id") == task_detail_id)
    return jobs.join(known.select("task_detail_id"), "task_detail_id", "left_semi").select(
        "job_id",
        "job_name",
        "job_status",
        "execution",
        "job_running_status",
        F.col("last_job_run").cast("string").alias("last_job_run"),
        "priority",
        F.col("date_created").cast("string").alias("date_created"),
    )


def linked_jobs_total(tables: JobTables, **search) -> DataFrame:
    return linked_jobs(tables, **search).agg(F.count("*").alias("total_record"))
