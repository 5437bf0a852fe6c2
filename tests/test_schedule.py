import calendar
import datetime as dt
import random

from helpers import at, by, dicts, frame, table, tables
from pyspark.sql import functions as F
from runledger.functions.timing import as_instant, as_local
from runledger.operators import schedule

# Route texts as task types hold them: the first seven are valid, the others not.
ROUTES = [
    "topic=test-topic&partitions=[*]", "topic=scrapping-topic&partitions=[0]", "topic=scrapping-topic&partitions=[1]",
    "topic=scrapping-topic&partitions=[2]", "topic=comparison-topic&partitions=[0]", "topic=comparison-topic&partitions=[1]",
    "topic=comparison-topic&partitions=[2]", "extraction-topic&partitions=[*]", "Web Auto Bots", "Mobile Auto Bots",
    "Data Statistics Report", "topic=a&partitions=[12]", "topic=a1&partitions=[1]",
]


def plan(number, run, frequency="Daily", recurrence="1", end=None, clock="00:00", job_id=1):
    run = at(run)
    return {
        "scheduler_id": number, "job_id": job_id, "start_date": run.date(), "end_date": dt.date.fromisoformat(end) if end else None,
        "start_time": clock, "frequency": frequency, "recurrence": recurrence, "recurrence_time": run,
    }


def test_routes(spark):
    rows = frame(spark, "n int, queue_topic_partition string", *({"n": n, "queue_topic_partition": r} for n, r in enumerate(ROUTES)))
    parsed = by(schedule.parse_routes(rows), "n")
    assert [parsed[n]["route_valid"] for n in range(len(ROUTES))] == [True] * 7 + [False] * 6
    assert (parsed[0]["topic"], parsed[0]["partition"]) == ("test-topic", None)
    assert (parsed[3]["topic"], parsed[3]["partition"]) == ("scrapping-topic", 2)
    assert parsed[7]["topic"] is None


def test_next_run_and_month_end(spark):
    rows = table(
        spark, "scheduler",
        plan(1, "2024-01-31T10:00:00", "Monthly"), plan(2, "2024-01-31T10:00:00", "Weekly", "2"),
        plan(3, "2024-01-31T23:59:00", "Mint", "5"), plan(4, "2024-01-31T23:00:00", "Hr", "3"),
        plan(5, "2024-01-31T10:00:00", "Daily", ""), plan(6, "2024-01-31T10:00:00", "Yearly", "1"),
        plan(7, "2024-01-31T10:00:00", "Daily", None),
    )
    runs = {key: row["next_run"] for key, row in by(schedule.with_next_run(rows), "scheduler_id").items()}
    assert runs == {
        1: at("2024-02-29T10:00:00"), 2: at("2024-02-14T10:00:00"), 3: at("2024-02-01T00:04:00"),
        4: at("2024-02-01T02:00:00"), 5: None, 6: None, 7: None,
    }


def test_advance_up_to_and_including_the_end(spark):
    rows = table(
        spark, "scheduler",
        plan(1, "2024-01-01T08:00:00", end="2024-01-02", clock="08:00"),
        plan(2, "2024-01-01T08:00:00", end="2024-01-02", clock="07:59"),
        plan(3, "2024-01-01T08:00:00"), plan(4, "2024-01-01T08:00:00", recurrence=None),
    )
    moved = by(schedule.schedule_advance(rows), "scheduler_id")
    assert [(moved[n]["recurrence_time"].day, moved[n]["exhausted"]) for n in (1, 2, 3, 4)] == [
        (2, False), (1, True), (2, False), (1, True),
    ]


def test_window_is_inclusive_and_the_strict_test_is_not(spark):
    sets = tables(
        spark,
        source_job=[{"job_id": 1, "job_status": "Active"}, {"job_id": 2, "job_status": "Inactive"}],
        scheduler=[
            plan(1, "2024-01-01T10:00:00"), plan(2, "2024-01-01T10:01:00"), plan(3, "2024-01-01T10:00:30"),
            plan(4, "2024-01-01T10:00:30", job_id=2), plan(5, "2024-01-01T10:01:01"),
        ],
    )
    window = ("2024-01-01 10:00:00", "2024-01-01 10:01:00")
    assert sorted(r["scheduler_id"] for r in dicts(schedule.due_candidates(sets, *window))) == [1, 2, 3]
    assert [r["scheduler_id"] for r in dicts(schedule.schedule_due(sets, *window))] == [3]


def test_a_run_before_midnight_slips_only_when_strict(spark):
    sets = tables(
        spark, source_job=[{"job_id": 1, "job_status": "Active"}], scheduler=[plan(1, "2024-01-01T23:59:40")]
    )
    window = ("2024-01-01 23:59:30", "2024-01-02 00:00:30")
    assert schedule.schedule_due(sets, *window).count() == 0
    assert schedule.schedule_due(sets, *window, strict=False).count() == 1


def stepped(row, start, end):
    """Runs of a schedule found by taking one step after the other."""
    run, number = row["recurrence_time"], 0
    runs = []
    limit = None
    if row["end_date"]:
        hour, minute = map(int, row["start_time"].split(":"))
        limit = dt.datetime.combine(row["end_date"], dt.time(hour, minute))
    while run < end:
        if run >= start:
            runs.append((row["scheduler_id"], number, run))
        if not row["recurrence"]:
            break
        count = int(row["recurrence"])
        if row["frequency"] == "Monthly":
            months = run.year * 12 + run.month - 1 + count
            year, month = divmod(months, 12)
            day = min(run.day, calendar.monthrange(year, month + 1)[1])
            run = run.replace(year=year, month=month + 1, day=day)
        else:
            unit = {"Mint": "minutes", "Hr": "hours", "Daily": "days", "Weekly": "weeks"}.get(row["frequency"])
            if unit is None:
                break
            run += dt.timedelta(**{unit: count})
        number += 1
        if limit is not None and run > limit:
            break
    return runs


def test_calendar_equals_repeated_steps(spark):
    chance = random.Random(7)
    rows = []
    for number in range(120):
        run = at("2023-10-01T00:00:00") + dt.timedelta(minutes=chance.randrange(0, 60 * 24 * 200))
        frequency = chance.choice(["Mint", "Hr", "Daily", "Weekly", "Monthly", "Monthly", "Yearly"])
        end = (run + dt.timedelta(days=chance.randrange(0, 150))).date().isoformat() if chance.random() < 0.5 else None
        row = plan(number, run.isoformat(), frequency, chance.choice(["1", "2", "5", "30", None]), end, f"{run:%H:%M}")
        rows.append(row)
    rows.append(plan(900, "2023-08-31T05:00:00", "Monthly", "1"))
    start, end = at("2024-01-15T06:00:00"), at("2024-04-20T00:00:00")
    found = schedule.run_calendar(table(spark, "scheduler", *rows), start.isoformat(" "), end.isoformat(" "))
    expected = {run for row in rows for run in stepped(row, start, end)}
    assert {(r["scheduler_id"], r["run_no"], r["run_time"]) for r in dicts(found)} == expected
    drifted = sorted(run for number, _, run in expected if number == 900)
    assert [run.day for run in drifted] == [30, 29, 29] or [run.day for run in drifted] == [30, 29, 29, 29]


def test_instants_do_not_depend_on_the_session_zone(spark):
    rows = frame(spark, "t timestamp_ntz", {"t": at("2024-03-31T02:30:00.000001")})
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            there = rows.select(as_instant("t").alias("i")).select(as_local("i").alias("t"), F.unix_micros("i").alias("n"))
            assert there.collect()[0] == (at("2024-03-31T02:30:00.000001"), 1711852200000001)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_schedule_work_does_not_feel_summer_time(spark):
    sets = tables(
        spark,
        source_job=[{"job_id": 1, "job_status": "Active"}],
        scheduler=[plan(1, "2024-03-31T02:30:00", "Hr"), plan(2, "2024-03-30T02:30:00"), plan(3, "2024-01-31T02:30:00", "Monthly", "2")],
    )
    zone = spark.conf.get("spark.sql.session.timeZone")

    def results():
        runs = schedule.run_calendar(sets.scheduler, "2024-03-31 00:00:00", "2024-03-31 06:00:00")
        due = schedule.schedule_due(sets, "2024-03-30 00:00:00", "2024-03-31 04:00:00")
        return sorted(map(str, dicts(runs))), sorted(map(str, dicts(schedule.schedule_advance(due))))

    try:
        expected = results()
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert results() == expected
        assert len(expected[0]) == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
