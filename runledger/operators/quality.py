"""Stored texts that are none of the values their column may have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from runledger.model import EXECUTIONS, FREQUENCIES, RECORD_STATUSES, RUN_STATUSES
from runledger.sources.tables import JobTables

# Key and listed columns of each table: the allowed values, and whether null is allowed
# because a value need not be set.
LISTED_COLUMNS = {
    "job_queue": ("job_queue_id", (("job_status", RUN_STATUSES, False),)),
    "source_job": (
        "job_id",
        (
            ("job_status", RECORD_STATUSES, False),
            ("job_running_status", RUN_STATUSES, True),
            ("execution", EXECUTIONS, False),
        ),
    ),
    "scheduler": ("scheduler_id", (("frequency", FREQUENCIES, False),)),
    "source_task": ("task_detail_id", (("task_status", RECORD_STATUSES, False),)),
    "source_task_type": ("source_task_type_id", (("task_type_status", RECORD_STATUSES, False),)),
}


def unlisted_values(tables: JobTables) -> DataFrame:
    """Rows whose status, execution or frequency differs from its list, even in case only."""

    def found(table: str) -> DataFrame:
        key, listed = LISTED_COLUMNS[table]
        cells = F.array(
            *(
                F.struct(
                    F.lit(column).alias("column_name"),
                    F.col(column).alias("value"),
                    (~F.coalesce(F.col(column).isin(*allowed), F.lit(optional))).alias("bad"),
                )
                for column, allowed, optional in listed
            )
        )
        rows = getattr(tables, table).select(F.col(key).cast("bigint").alias("row_key"), F.inline(cells))
        return rows.where("bad").select(F.lit(table).alias("table_name"), "row_key", "column_name", "value")

    return reduce(DataFrame.unionByName, map(found, LISTED_COLUMNS))
