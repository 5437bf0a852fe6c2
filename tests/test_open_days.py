"""The index of days with unfinished rows, beside a written queue."""

import datetime as dt

import pytest
from helpers import at, dicts, table

from runledger.operators import dashboards, dispatch
from runledger.sources import open_days, tables as sources
from runledger.sources.tables import read_tables, write_changes, write_table


def queue(spark, *rows):
    made = [{"job_queue_id": n, "job_id": n % 3, "job_status": status, "job_send": False, "date_created": day and at(f"{day}T10:00:00")}
            for n, day, status in rows]
    return table(spark, "job_queue", *made)


START = [
    (1, "2024-01-01", "Completed"), (2, "2024-01-01", "Failed"), (3, "2024-01-02", "Queue"), (4, "2024-01-02", "Completed"),
    (5, "2024-01-03", "Running"), (6, None, "Start"), (7, "2024-01-04", "Skip"),
]


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "job_queue")
    write_table(queue(spark, *START), "job_queue", path)
    open_days.index_open_days(spark, path)
    return str(tmp_path)


def days(spark, base):
    return {row["created_on"] and str(row["created_on"]): row["open_rows"] for row in dicts(open_days.open_days(spark, f"{base}/job_queue"))}


def ids(frame):
    return sorted(row["job_queue_id"] for row in dicts(frame))


def opened(frame):
    return {file.split("created_on=")[1].split("/")[0] for file in frame.inputFiles()}


def test_only_open_days_are_read(spark, base):
    assert days(spark, base) == {"2024-01-02": 1, "2024-01-03": 1, None: 1}
    stored = read_tables(spark, base)
    assert ids(stored.open_queue) == [3, 5, 6]
    assert opened(stored.open_queue) == {"2024-01-02", "2024-01-03", "__HIVE_DEFAULT_PARTITION__"}
    counts = {row["job_id"]: row["in_flight"] for row in dicts(dashboards.in_flight_per_job(stored))}
    assert counts == {0: 2, 2: 1}
    assert opened(dispatch.dispatch_batch(stored, 10)) <= opened(stored.open_queue)
    # Another queue has other unfinished rows.
    assert dashboards.in_flight_per_job(stored.replacing(job_queue=queue(spark, (9, "2024-01-01", "Queue")))).head()["in_flight"] == 1


def test_changes_open_and_close_days(spark, base):
    path = f"{base}/job_queue"
    changed = queue(spark, (3, "2024-01-02", "Completed"), (7, "2024-01-04", "Running"), (8, "2024-01-09", "Queue"), (6, "2024-01-05", "Queue"))
    write_changes(spark, changed, "job_queue", path, "job_queue_id")
    assert days(spark, base) == {"2024-01-03": 1, "2024-01-04": 1, "2024-01-05": 1, "2024-01-09": 1}
    assert ids(read_tables(spark, base).open_queue) == [5, 6, 7, 8]


def test_a_write_that_breaks_off_lists_days_too_many(spark, base, monkeypatch):
    path = f"{base}/job_queue"
    monkeypatch.setattr(open_days, "settle", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    changed = queue(spark, (3, "2024-01-02", "Completed"), (8, "2024-01-09", "Queue"))
    with pytest.raises(OSError, match="lost"):
        write_changes(spark, changed, "job_queue", path, "job_queue_id")
    assert set(days(spark, base)) == {"2024-01-02", "2024-01-03", "2024-01-09", None}
    assert ids(read_tables(spark, base).open_queue) == [5, 6, 8]
    monkeypatch.undo()
    write_changes(spark, changed, "job_queue", path, "job_queue_id")
    assert set(days(spark, base)) == {"2024-01-03", "2024-01-09", None}


def test_without_an_index_the_whole_queue_is_asked(spark, base):
    path = f"{base}/job_queue"
    write_table(queue(spark, (20, "2024-02-01", "Queue")), "job_queue", path, mode="append")
    assert open_days.open_days(spark, path) is None
    assert ids(read_tables(spark, base).open_queue) == [3, 5, 6, 20]
    open_days.index_open_days(spark, path)
    write_changes(spark, queue(spark, *((n, day, "Completed") for n, day, _ in [*START, (20, "2024-02-01", "")])), "job_queue", path, "job_queue_id")
    assert days(spark, base) == {} and ids(read_tables(spark, base).open_queue) == []
    assert dt.date(2024, 2, 1) in {row["created_on"] for row in dicts(sources.read_table(spark, "job_queue", path))}
