"""Change sets merged into written tables."""

import datetime as dt

import pytest
from helpers import dicts

from runledger.model import TABLE_SCHEMAS
from runledger.sources import tables as sources
from runledger.sources.tables import read_table, read_tables, write_changes, write_table
from pyspark.sql import functions as F

KEYS = {
    "job_queue": "job_queue_id", "source_job": "job_id", "scheduler": "scheduler_id", "source_task": "task_detail_id",
    "source_task_payload": "task_payload_id", "source_task_type": "source_task_type_id", "lookup_data": "lookup_id",
    "job_audit_logs": "job_audit_log_id",
}


def rows(df):
    return sorted(map(str, dicts(df)))


@pytest.mark.parametrize("name", sorted(TABLE_SCHEMAS))
def test_a_table_keeps_all_rows(spark, sample, tmp_path, name):
    """Changes read from the table itself replace their rows, and new keys are added."""
    path, key = str(tmp_path / name), KEYS[name]
    start = getattr(sample, name).limit(300)
    write_table(start, name, path)
    before = read_table(spark, name, path)
    number = before.agg(F.max(key)).head()[0]
    old = before.where(F.col(key) % 3 == 0)
    new = before.orderBy(key).limit(1).withColumn(key, F.lit(number + 1).cast("bigint"))
    expected = rows(before.unionByName(new))
    write_changes(spark, old.unionByName(new), name, path, key)
    assert rows(read_table(spark, name, path)) == expected


def test_a_failed_write_leaves_the_table(spark, sample, tmp_path, monkeypatch):
    path = str(tmp_path / "source_job")
    write_table(sample.source_job, "source_job", path)
    before = rows(read_table(spark, "source_job", path))
    monkeypatch.setattr(sources, "_change_places", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        write_changes(spark, read_table(spark, "source_job", path).limit(5), "source_job", path, "job_id")
    assert rows(read_table(spark, "source_job", path)) == before


def test_a_table_is_not_overwritten_by_its_own_rows(spark, sample, tmp_path):
    path = str(tmp_path / "source_job")
    write_table(sample.source_job, "source_job", path)
    tables = read_tables(spark, str(tmp_path))
    with pytest.raises(ValueError, match="write_changes"):
        write_table(tables.source_job.limit(3), "source_job", path)
    assert tables.source_job.count() == sample.source_job.count()


def queue_row(spark, number, text, day):
    from helpers import table

    return table(spark, "job_queue", {"job_queue_id": number, "job_id": 1, "job_status_message": text, "date_created": dt.datetime.fromisoformat(day)})


def test_a_day_that_loses_its_only_row_goes(spark, tmp_path):
    path = str(tmp_path / "job_queue")
    start = queue_row(spark, 1, "x", "2024-01-01T10:00:00").unionByName(queue_row(spark, 2, "y", "2024-01-02T10:00:00"))
    write_table(start, "job_queue", path)
    change = queue_row(spark, 1, "x2", "2024-01-03T09:00:00")
    write_changes(spark, change, "job_queue", path, "job_queue_id")
    expected = rows(change.unionByName(queue_row(spark, 2, "y", "2024-01-02T10:00:00")))
    assert rows(read_table(spark, "job_queue", path).drop("created_on")) == expected
    assert not (tmp_path / "job_queue" / "created_on=2024-01-01").exists()
    # The same change set once more changes nothing.
    write_changes(spark, change, "job_queue", path, "job_queue_id")
    assert rows(read_table(spark, "job_queue", path).drop("created_on")) == expected


def test_of_several_changes_of_a_key_the_last_one_counts(spark, tmp_path):
    path = str(tmp_path / "job_queue")
    write_table(queue_row(spark, 1, "x", "2024-01-01T10:00:00"), "job_queue", path)
    changes = [queue_row(spark, 1, text, "2024-01-01T10:00:00").withColumn("change_no", F.lit(no)) for no, text in ((2, "b"), (9, "c"), (1, "a"))]
    changes = changes[0].unionByName(changes[1]).unionByName(changes[2])
    before = rows(read_table(spark, "job_queue", path))
    with pytest.raises(ValueError, match="several changes of one job_queue_id"):
        write_changes(spark, changes, "job_queue", path, "job_queue_id")
    assert rows(read_table(spark, "job_queue", path)) == before
    write_changes(spark, changes, "job_queue", path, "job_queue_id", order="change_no")
    assert [row["job_status_message"] for row in dicts(read_table(spark, "job_queue", path))] == ["c"]
