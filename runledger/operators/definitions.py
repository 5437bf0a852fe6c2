"""Applying change sets to jobs, tasks, task types, lookups and schedules.

A change set has the target's columns and ``change_id`` (its order) and ``op`` (add,
update, delete). Each change is checked by itself; the valid ones of a key are then
folded to one row by an aggregate, and that row is joined with the current table.
Only changed rows are returned.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from runledger.functions.predicates import is_blank, moment
from runledger.functions.timing import first_run
from runledger.operators.admission import highest_id
from runledger.operators.details import primary_schedules
from runledger.operators.folding import cascade_from_tasks, cascade_from_types
from runledger.operators.schedule import When
from runledger.sources.tables import JobTables


@dataclass(frozen=True)
class Link:
    """A column that has to name a row of another table."""

    column: str
    table: str
    key: str
    status: str
    error: str
    active_for: tuple[str, ...]
    checked_for: tuple[str, ...] = ("add", "update")
    before_lookup: bool = False


@dataclass(frozen=True)
class Rules:
    """How changes of one table are checked and applied."""

    table: str
    key: str
    required: Mapping[str, tuple[str, ...]]
    kept: tuple[str, ...] = ()
    replaced: tuple[str, ...] = ()
    status: str | None = None
    defaults: Mapping[str, object] = field(default_factory=dict)
    link: Link | None = None
    created: str | None = None


RULES = {
    "source_job": Rules(
        "source_job",
        "job_id",
        {"add": ("job_name", "task_detail_id", "execution", "priority"), "update": ("job_id", "job_name", "task_detail_id"), "delete": ("job_id",)},
        kept=("execution", "priority"),
        replaced=("job_name", "task_detail_id", "complete_job", "fail_job", "skip_job"),
        status="job_status",
        defaults={"complete_job": False, "fail_job": False, "skip_job": False},
        link=Link("task_detail_id", "source_task", "task_detail_id", "task_status", "task_not_active", ("update",)),
        created="date_created",
    ),
    "source_task": Rules(
        "source_task",
        "task_detail_id",
        {
            "add": ("task_name", "task_payload", "source_task_type_id"),
            "update": ("task_detail_id", "task_name", "task_payload", "source_task_type_id"),
            "delete": ("task_detail_id",),
        },
        replaced=("task_name", "task_payload", "source_task_type_id", "home_page_id", "pipeline_id"),
        status="task_status",
        link=Link(
            "source_task_type_id", "source_task_type", "source_task_type_id", "task_type_status", "type_not_active",
            ("add", "update"), before_lookup=True,
        ),
        created="date_created",
    ),
    "source_task_type": Rules(
        "source_task_type",
        "source_task_type_id",
        {
            "add": ("service_name", "description", "queue_topic_partition"),
            "update": ("source_task_type_id", "service_name", "queue_topic_partition"),
            "delete": ("source_task_type_id",),
        },
        replaced=("service_name", "description", "queue_topic_partition", "schema_payload"),
        status="task_type_status",
    ),
    "lookup_data": Rules(
        "lookup_data",
        "lookup_id",
        {
            "add": ("lookup_value", "lookup_type"),
            "update": ("lookup_id", "lookup_value", "lookup_type"),
            "delete": ("lookup_id",),
        },
        kept=("description", "parent_lookup_id"),
        replaced=("lookup_value", "lookup_type"),
        created="date_created",
    ),
}


def _missing(column: str) -> Column:
    return is_blank(F.col(column).cast("string"))


def _first_error(checks: list[tuple[Column, Column | str]]) -> Column:
    """The first check that holds, as its code; null when none does."""

    def outer(later: Column, check: tuple[Column, Column | str]) -> Column:
        condition, code = check
        return F.when(condition, code).otherwise(later)

    return reduce(outer, reversed(checks), F.lit(None).cast("string"))


def check_changes(changes: DataFrame, tables: JobTables, name: str) -> DataFrame:
    """The changes with the ``error`` each one meets, null for a valid change."""
    rules = RULES[name]
    current = getattr(tables, name).select(F.col(rules.key), F.lit(True).alias("found"))
    checked = changes.join(current, rules.key, "left")
    op = F.col("op")
    checks: list[tuple[Column, Column | str]] = [
        (~F.coalesce(op.isin(*rules.required), F.lit(False)), "unknown_op")
    ]
    for kind, columns in rules.required.items():
        checks += [((op == kind) & _missing(column), f"{column}_missing") for column in columns]
    not_found = (op != "add") & F.col("found").isNull()
    # Deleting an unknown task type is not an error: there is nothing left to do.
    if name == "source_task_type":
        not_found = not_found & (op != "delete")
    lookups: list[tuple[Column, Column | str]] = [(not_found, "not_found")]
    if rules.link:
        link = rules.link
        linked = getattr(tables, link.table).select(
            F.col(link.key).alias(link.column), F.col(link.status).alias("link_status")
        )
        checked = checked.join(linked, link.column, "left")
        bad = op.isin(*link.checked_for) & F.col("link_status").isNull()
        bad = bad | (op.isin(*link.active_for) & (F.coalesce("link_status", F.lit("")) != "Active"))
        lookups = [(bad, link.error), *lookups] if link.before_lookup else [*lookups, (bad, link.error)]
    if name == "lookup_data":
        # A parent that does not exist is ignored, as if none had been sent.
        parents = tables.lookup_data.select(F.col("lookup_id").alias("parent_lookup_id"), F.lit(True).alias("parent_found"))
        checked = checked.join(parents, "parent_lookup_id", "left").withColumn(
            "parent_lookup_id", F.when(F.col("parent_found"), F.col("parent_lookup_id"))
        )
    return checked.withColumn("error", _first_error([*checks, *lookups])).select(*changes.columns, "error")


def _last(column: str, when: Column | None = None) -> Column:
    """The value of the last change, or of the last for which the condition holds."""
    order = F.col("change_id") if when is None else F.when(when, F.col("change_id"))
    return F.max_by(F.struct(F.col(column).alias("value")), order)["value"].alias(column)


def _effective(valid: DataFrame, rules: Rules) -> DataFrame:
    """Changes with defaults filled in and the status each one sets."""
    for column, value in rules.defaults.items():
        valid = valid.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    if rules.status:
        kinds = F.when(F.col("op") == "delete", "Delete").when(F.col("op") == "add", "Active")
        sent = F.when(~is_blank(F.col(rules.status)), F.col(rules.status)) if rules.status in valid.columns else F.lit(None)
        valid = valid.withColumn(rules.status, F.coalesce(kinds, sent))
    return valid


def upsert_definitions(changes: DataFrame, tables: JobTables, name: str, now: When, id_base: int | None = None) -> DataFrame:
    """The rows of a table that valid changes add or alter, in their new state.

    New rows get ``id_base`` (the highest key if not given) plus the change id. Rows
    of ``lookup_data`` that are to be removed come with ``removed`` set.
    """
    rules = RULES[name]
    current = getattr(tables, name)
    valid = _effective(check_changes(changes, tables, name).where("error is null").drop("error"), rules)
    base = F.lit(id_base) if id_base is not None else current.agg(F.coalesce(F.max(rules.key), F.lit(0))).scalar()

    added = valid.where("op = 'add'").withColumn(rules.key, base + F.col("change_id"))
    if rules.created and rules.created in current.columns:
        added = added.withColumn(rules.created, moment(now))
    if name == "source_task_type":
        added = added.withColumn("is_schema_register", ~_missing("schema_payload"))
    for column in current.columns:
        if column not in added.columns:
            added = added.withColumn(column, F.lit(None).cast(current.schema[column].dataType))
    added = added.select(*current.columns)

    updates = F.col("op") == "update"
    folded = [_last(column, updates & F.col(column).isNotNull()) for column in rules.kept]
    folded += [_last(column, updates) for column in rules.replaced]
    if rules.status:
        folded.append(_last(rules.status, F.col(rules.status).isNotNull()))
    folded += [F.max(updates).alias("updated"), F.max_by("op", "change_id").alias("last_op")]
    altered = valid.where("op <> 'add'").groupBy(rules.key).agg(*folded)
    sent = altered.select(
        rules.key, "updated", "last_op",
        *(F.col(name_).alias(f"new_{name_}") for name_ in altered.columns if name_ not in (rules.key, "updated", "last_op")),
    )
    rows = current.join(sent, rules.key)
    for column in (*rules.kept, *((rules.status,) if rules.status else ())):
        rows = rows.withColumn(column, F.coalesce(f"new_{column}", column))
    for column in rules.replaced:
        rows = rows.withColumn(column, F.when(F.col("updated"), F.col(f"new_{column}")).otherwise(F.col(column)))
    if name == "source_task_type":
        rows = rows.withColumn(
            "is_schema_register",
            F.when(F.col("updated"), ~_missing("schema_payload")).otherwise(F.col("is_schema_register")),
        )
    if rules.status:
        return added.unionByName(rows.select(*current.columns))
    rows = rows.withColumn("removed", F.col("last_op") == "delete")
    return added.withColumn("removed", F.lit(False)).unionByName(rows.select(*current.columns, "removed"))


def cascaded_jobs(changes: DataFrame, tables: JobTables, name: str) -> DataFrame:
    """Jobs whose status follows from task or task type changes.

    Deleting a task deletes its jobs; a type's new status passes to the jobs of its
    tasks, and an update that names no status passes none.
    """
    valid = _effective(check_changes(changes, tables, name).where("error is null"), RULES[name])
    if name == "source_task":
        gone = valid.where("op = 'delete'").select("task_detail_id").distinct()
        return cascade_from_tasks(tables, gone.withColumn("new_status", F.lit("Delete")))
    if name == "source_task_type":
        passed = valid.where("op <> 'add' and task_type_status is not null").groupBy("source_task_type_id")
        return cascade_from_types(tables, passed.agg(F.max_by("task_type_status", "change_id").alias("new_status")))
    raise ValueError(f"changes of {name} do not cascade")


def schedules_to_add(sent: DataFrame, now: When, id_base: int) -> DataFrame:
    """Schedules sent for new jobs: (change_id, job_id, dates, start_time, frequency, recurrence)."""
    return sent.select(
        (F.lit(id_base) + F.col("change_id")).alias("scheduler_id"),
        "job_id",
        "start_date",
        "end_date",
        "start_time",
        "frequency",
        F.when(~is_blank(F.col("recurrence")), F.col("recurrence")).alias("recurrence"),
        moment(now).alias("date_created"),
        first_run(F.col("start_date"), F.col("start_time")).alias("recurrence_time"),
    )


def schedules_to_update(sent: DataFrame, tables: JobTables) -> DataFrame:
    """The primary schedules of updated jobs: an absent end or recurrence keeps the old one.

    Several schedules sent for one job (``change_id`` is their order) act one after the other.
    """
    filled = sent.withColumn("recurrence", F.when(~is_blank(F.col("recurrence")), F.col("recurrence")))
    folded = [_last(column).alias(f"new_{column}") for column in ("start_date", "start_time", "frequency")]
    folded += [_last(column, F.col(column).isNotNull()).alias(f"new_{column}") for column in ("end_date", "recurrence")]
    new = filled.groupBy("job_id").agg(*folded)
    # Only the schedules of jobs that were sent are reduced.
    own = tables.scheduler.join(new.select("job_id"), "job_id", "left_semi")
    first = primary_schedules(own, tuple(c for c in tables.scheduler.columns if c != "job_id"))
    rows = first.join(new, "job_id")
    for column in ("start_date", "start_time", "frequency"):
        rows = rows.withColumn(column, F.col(f"new_{column}"))
    for column in ("end_date", "recurrence"):
        rows = rows.withColumn(column, F.coalesce(f"new_{column}", column))
    rows = rows.withColumn("recurrence_time", first_run(F.col("start_date"), F.col("start_time")))
    return rows.select(*tables.scheduler.columns)


@dataclass(frozen=True)
class TagChanges:
    """Payload tags that a change set of tasks adds, and the ids of those it takes away."""

    added: DataFrame
    removed: DataFrame


def task_tags(
    changes: DataFrame, sent: DataFrame, tables: JobTables, id_base: int | None = None, task_base: int | None = None
) -> TagChanges:
    """The payload tags of added and updated tasks.

    ``sent`` has the tags of the changes (change_id, row_no, tag_key, tag_parent, tag_value),
    ``row_no`` being unique in the set. The tags of a task's last valid update that sent any
    replace all it had; an update without tags keeps them. Refused changes change no tags. New
    tags get ``id_base`` (the highest id if not given) plus ``row_no``.
    """
    valid = check_changes(changes, tables, "source_task").where("error is null and op <> 'delete'")
    with_tags = valid.join(sent.select("change_id").distinct(), "change_id", "left_semi")
    task_id = highest_id(tables.source_task, "task_detail_id", task_base) + F.col("change_id")
    added = with_tags.where("op = 'add'").select("change_id", task_id.alias("payload_id"))
    last = with_tags.where("op = 'update'").groupBy("task_detail_id").agg(F.max("change_id").alias("change_id"))
    owners = added.unionByName(last.select("change_id", F.col("task_detail_id").alias("payload_id")))
    tag_id = highest_id(tables.source_task_payload, "task_payload_id", id_base) + F.col("row_no")
    rows = sent.join(owners, "change_id").select(
        tag_id.alias("task_payload_id"), "tag_key", "tag_parent", "tag_value", "payload_id"
    )
    replaced = tables.source_task_payload.join(last.select(F.col("task_detail_id").alias("payload_id")), "payload_id", "left_semi")
    return TagChanges(rows, replaced.select("task_payload_id"))
