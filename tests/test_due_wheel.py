"""Schedules in buckets of their next run."""

import random

import pytest
from helpers import at, dicts, table
from pyspark.sql import functions as F

from runledger.operators import schedule
from runledger.sources.due_wheel import DueWheel

WINDOW = ("2024-01-01T05:00:00", "2024-01-02T06:30:00")


def rows(count, seed=3):
    some = random.Random(seed)
    made = []
    for n in range(count):
        time = f"2024-01-0{some.randint(1, 5)}T{some.choice(['05', '06', '23'])}:{some.choice(['00', '30', '59'])}:00"
        steps = some.choice([("Hr", "1"), ("Daily", "1"), ("Daily", "2"), ("Mint", "5"), ("Weekly", "1"), ("Monthly", "1"), ("Hr", None)])
        made.append({
            "scheduler_id": n, "job_id": n % 4, "start_date": at("2024-01-01T00:00:00").date(), "start_time": "05:00",
            "end_date": some.choice([None, at("2024-01-02T00:00:00").date()]), "frequency": steps[0], "recurrence": steps[1],
            "recurrence_time": some.choice([at(time), at(time), at(time), None]),
        })
    return made


def files(frame):
    return set(frame.inputFiles())


def same(left, right):
    return sorted(map(repr, dicts(left))) == sorted(map(repr, dicts(right)))


def advanced(schedules, window):
    """The plain way: every schedule is looked at."""
    due = schedule.due_by_time(schedules, *window, strict=False)
    moved = schedule.schedule_advance(due).drop("exhausted")
    return schedules.join(due.select("scheduler_id"), "scheduler_id", "left_anti").unionByName(moved)


@pytest.fixture
def wheel(spark, tmp_path):
    made = DueWheel(spark, str(tmp_path / "wheel"))
    made.write(table(spark, "scheduler", *rows(60)))
    return made


def test_only_buckets_of_the_window_are_opened(spark, wheel):
    due = wheel.due(*WINDOW)
    assert same(due, schedule.due_by_time(table(spark, "scheduler", *rows(60)), *WINDOW, strict=False))
    assert due.count() > 0
    # Days beyond the window are not even listed; of its days, only the hours inside are scanned.
    assert {file.split("due_coarse=")[1].split("/")[0] for file in files(due)} == {"2024-01-01", "2024-01-02"}
    plan = due._jdf.queryExecution().executedPlan().toString()
    assert "due_fine" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_an_advance_equals_the_plain_way_and_leaves_other_buckets_alone(spark, wheel):
    before, whole = files(wheel.schedules()), table(spark, "scheduler", *rows(60))
    wheel.advance(*WINDOW)
    want = advanced(whole, WINDOW)
    assert same(wheel.schedules(), want.select(wheel.schedules().columns))
    moved = schedule.schedule_advance(schedule.due_by_time(whole, *WINDOW, strict=False)).where(~F.col("exhausted"))
    gained = {row["recurrence_time"].strftime("%Y-%m-%dT%H") for row in dicts(moved)}
    old = {row["recurrence_time"].strftime("%Y-%m-%dT%H") for row in rows(60) if row["scheduler_id"] in {r["scheduler_id"] for r in dicts(moved)}}
    touched = gained | old
    untouched = {file for file in before if file.split("due_fine=")[1].split("/")[0] not in touched}
    assert untouched and untouched <= files(wheel.schedules())
    assert wheel.schedules().groupBy("scheduler_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("writes", [0, 1])
def test_an_advance_that_broke_off_is_completed_once(spark, wheel, monkeypatch, writes):
    write, done = DueWheel._write, []

    def breaking(self, placed):
        if len(done) == writes:
            raise OSError("lost")
        done.append(1)
        write(self, placed)

    monkeypatch.setattr(DueWheel, "_write", breaking)
    with pytest.raises(OSError):
        wheel.advance(*WINDOW)
    monkeypatch.setattr(DueWheel, "_write", write)
    for _ in range(2):
        wheel.mend()
        assert same(wheel.schedules(), advanced(table(spark, "scheduler", *rows(60)), WINDOW).select(wheel.schedules().columns))


def test_empty_tables_and_windows(spark, tmp_path, wheel):
    empty = DueWheel(spark, str(tmp_path / "none"))
    empty.write(table(spark, "scheduler"))
    empty.advance(*WINDOW)
    assert empty.due(*WINDOW).isEmpty()
    before = files(wheel.schedules())
    wheel.advance("2030-01-01T00:00:00", "2030-01-02T00:00:00")
    assert files(wheel.schedules()) == before
    with pytest.raises(ValueError):
        DueWheel(spark, "x", "hour", "day")
