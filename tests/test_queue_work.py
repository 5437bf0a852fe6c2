"""Admission, dispatch, operator requests and status folding on small tables."""

import calendar
import datetime as dt
import json
import random

import pytest
from helpers import at, by, dicts, frame, table, tables
from pyspark.sql import functions as F
from runledger.model import STATUS_MESSAGE
from runledger.operators import actions, admission, dispatch, folding, notices

DAY = ("2024-01-01 00:00:00", "2024-01-01 12:00:00")


def plan(number, job_id, run, recurrence="1", end=None, frequency="Daily"):
    run = at(run)
    return {
        "scheduler_id": number, "job_id": job_id, "start_date": run.date(), "start_time": f"{run:%H:%M}", "frequency": frequency,
        "end_date": dt.date.fromisoformat(end) if end else None, "recurrence": recurrence, "recurrence_time": run,
    }


def job(number, status="Active", running=None, execution="Auto", task=1, **flags):
    return {
        "job_id": number, "job_name": f"job {number}", "job_status": status, "job_running_status": running,
        "execution": execution, "task_detail_id": task, "priority": 10 - number,
        "skip_job": False, "fail_job": False, "complete_job": False, **flags,
    }


def waiting(number, job_id, status="Queue", sent=False):
    return {
        "job_queue_id": number, "job_id": job_id, "job_status": status, "job_send": sent,
        "date_created": at("2024-01-01T00:00:00"), "start_time": at("2024-01-01T00:00:00"),
        "job_status_message": "waits",
    }


def test_admission_queues_the_first_and_skips_the_rest(spark):
    sets = tables(
        spark,
        source_job=[job(1), job(2, skip_job=True), job(3, "Inactive")],
        scheduler=[
            plan(1, 1, "2024-01-01T09:00:00"), plan(2, 1, "2024-01-01T08:00:00"), plan(3, 1, "2024-01-01T08:00:00"),
            plan(4, 2, "2024-01-01T08:00:00", end="2024-01-01"), plan(5, 3, "2024-01-01T08:00:00"),
        ],
        job_queue=[waiting(7, 2, "Running", True), waiting(8, 1, "Completed", True)],
        job_audit_logs=[{"job_audit_log_id": 50, "job_queue_id": 7}],
        lookup_data=[{"lookup_id": 1, "lookup_type": "SCHEDULER_LAST_RUN_TIME", "lookup_value": "x"}],
    )
    decided = by(admission.queue_admission(sets, *DAY), "scheduler_id")
    assert {key: row["job_status"] for key, row in decided.items()} == {1: "Skip", 2: "Queue", 3: "Skip", 4: "Skip"}
    assert decided[2]["message"] == "Job 1 now in the queue."
    assert decided[4]["message"] == "Job 2 skip, already in queue." and decided[4]["mail_skip"] and decided[4]["exhausted"]
    assert decided[1]["next_recurrence_time"] == at("2024-01-02T09:00:00")

    changes = admission.admission_changes(sets, *DAY)
    rows = by(changes.queue_rows, "job_queue_id")
    assert sorted(rows) == [9, 10, 11, 12]
    assert rows[10]["start_time"] == at("2024-01-01T12:00:00") and rows[10]["skip_time"] is None
    assert rows[12]["skip_time"] == at("2024-01-01T12:00:00") and rows[12]["start_time"] is None
    assert dicts(changes.job_updates) == [
        {"job_id": 1, "job_running_status": "Queue", "last_job_run": at("2024-01-01T12:00:00")}
    ]
    assert sorted(r["scheduler_id"] for r in dicts(changes.schedules)) == [1, 2, 3]
    assert {(r["job_audit_log_id"], r["job_queue_id"]) for r in dicts(changes.audit_rows)} == {(50 + n, 8 + n) for n in range(1, 5)}
    known = admission.admission_changes(sets, *DAY, queue_id=100, log_id=200)
    assert sorted(by(known.queue_rows, "job_queue_id")) == [101, 102, 103, 104]
    assert {(r["job_audit_log_id"], r["job_queue_id"]) for r in dicts(known.audit_rows)} == {(200 + n, 100 + n) for n in range(1, 5)}
    assert dicts(changes.last_run, "lookup_value") == [{"lookup_value": "2024-01-01T12:00:00"}]


def dispatch_tables(spark):
    return tables(
        spark,
        source_job=[job(1), job(2, "Delete"), job(3, task=3), job(4, task=4), job(5, task=5)],
        source_task=[
            {"task_detail_id": 1, "task_name": "one", "source_task_type_id": 1, "task_payload": "<a/>"},
            {"task_detail_id": 3, "source_task_type_id": 2}, {"task_detail_id": 4, "source_task_type_id": 3}, {"task_detail_id": 5},
        ],
        source_task_type=[
            {"source_task_type_id": 1, "task_type_status": "Active", "queue_topic_partition": "topic=t&partitions=[3]"},
            {"source_task_type_id": 2, "task_type_status": "Inactive", "queue_topic_partition": "topic=t&partitions=[3]"},
            {"source_task_type_id": 3, "task_type_status": "Active", "queue_topic_partition": "nowhere"},
        ],
        job_queue=[waiting(n, n) for n in range(1, 6)] + [waiting(6, 1), waiting(7, 1, sent=True), waiting(8, 1, "Skip")],
        lookup_data=[{"lookup_id": 1, "lookup_type": "QUEUE_FETCH_LIMIT", "lookup_value": "2"}],
    )


def test_dispatch_from_batch_to_outcome(spark, tmp_path):
    sets = dispatch_tables(spark)
    assert [r["job_queue_id"] for r in dicts(dispatch.dispatch_batch(sets))] == [1, 2]
    first = dispatch.dispatch_batch(sets, limit=2, by_priority=True)
    assert [r["job_queue_id"] for r in dicts(first)] == [5, 4]

    planned = dispatch.dispatch_plan(dispatch.waiting_rows(sets.job_queue), sets)
    outcomes = {key: row["outcome"] for key, row in by(planned, "job_queue_id").items()}
    assert outcomes == {1: "sent", 2: "job_inactive", 3: "type_inactive", 4: "bad_route", 5: "no_type", 6: "sent"}
    records = by(dispatch.dispatch_records(planned), "job_queue_id")
    assert sorted(records) == [1, 6] and (records[1]["topic"], records[1]["partition"]) == ("t", 3)
    value = json.loads(records[1]["value"])
    assert value["taskDetail"] == {"taskDetailId": 1, "taskName": "one", "taskPayload": "<a/>"} and value["priority"] == "9"
    assert "endTime" not in value["jobQueue"]

    dispatch.write_records(dispatch.dispatch_records(planned), "parquet", path=str(tmp_path / "sent"))
    assert spark.read.parquet(str(tmp_path / "sent")).columns == ["topic", "partition", "key", "value"]

    results = frame(
        spark, "job_queue_id bigint, ok boolean, offset bigint, error string",
        {"job_queue_id": 1, "ok": True, "offset": 77}, {"job_queue_id": 6, "ok": False, "error": "gone"},
    )
    after = by(dispatch.dispatch_outcome(planned, results, "2024-01-02 00:00:00"), "job_queue_id")
    assert sorted(after) == [1, 2, 3, 4, 6]
    assert (after[1]["job_status"], after[1]["job_send"], after[1]["end_time"]) == ("Start", True, None)
    assert after[1]["audit_text"].startswith("Job 1 sent message=[{") and after[1]["audit_text"].endswith("offset=[77]")
    assert after[6]["audit_text"].endswith("due to: gone") and after[6]["job_status_message"] == "Job 1 now complete."
    assert after[4]["audit_text"] == "Broker configuration wrong job 4 fail nowhere"
    assert {after[n]["job_status"] for n in (2, 3, 4, 6)} == {"Failed"}


def test_operator_requests(spark):
    sets = tables(
        spark,
        source_job=[
            job(1), job(2, running="Queue"), job(3, "Inactive"), job(4, execution="Manual"), job(5, skip_job=True),
            job(6, running="Start"), job(7),
        ],
        scheduler=[
            plan(5, 5, "2024-01-03T08:00:00"), plan(1, 1, "2024-01-03T08:00:00", end="2024-01-03"), plan(7, 7, "2024-01-03T08:00:00"),
        ],
        job_queue=[waiting(21, 1), waiting(22, 1, "Running", True)],
    )

    def request(number, action, job_id=None, queue_id=None):
        return {"request_id": number, "action": action, "job_id": job_id, "job_queue_id": queue_id}

    asked = frame(
        spark, "request_id bigint, action string, job_id bigint, job_queue_id bigint",
        request(1, "run", 1), request(2, "run", 1), request(3, "run", 2), request(4, "run", 3), request(5, "run", 6),
        request(6, "skip", 4), request(7, "skip", 5), request(8, "skip", 5), request(9, "skip", 1), request(10, "skip", 7),
        request(11, "run", 7), request(12, "fail", queue_id=21), request(13, "fail", queue_id=21), request(14, "fail", queue_id=22),
        request(15, "interrupt", queue_id=22), request(16, "interrupt", queue_id=99), request(17, "run"), request(18, "fail"),
    )
    done = by(actions.operator_actions(asked, sets, "2024-01-02 00:00:00"), "request_id")
    assert {key: row["result"] for key, row in done.items()} == {
        1: "done", 2: "job_busy", 3: "job_busy", 4: "job_not_active", 5: "done", 6: "not_auto", 7: "done", 8: "done",
        9: "job_busy", 10: "done", 11: "done", 12: "done", 13: "not_in_queue", 14: "not_in_queue", 15: "done",
        16: "queue_row_not_found", 17: "job_id_missing", 18: "queue_id_missing",
    }
    assert done[7]["message"] == "Job 5 skip, by user action." and done[7]["mail"]
    assert (done[7]["run_time"], done[7]["next_recurrence_time"]) == (at("2024-01-03T08:00:00"), at("2024-01-04T08:00:00"))

    changes = actions.action_changes(asked, sets, "2024-01-02 00:00:00")
    new = by(changes.new_queue_rows, "job_queue_id")
    assert new[22 + 7]["skip_manual"] and new[22 + 7]["skip_time"] == at("2024-01-03T08:00:00")
    assert new[22 + 1]["run_manual"] and new[22 + 1]["job_status"] == "Queue"
    updates = by(changes.queue_updates, "job_queue_id")
    assert updates[21]["job_status"] == "Failed" and updates[22]["job_status"] == "Interrupt"
    assert updates[21]["job_status_message"] == "Job 1 now complete."
    jobs = by(changes.job_updates, "job_id")
    assert jobs[1]["job_running_status"] == "Interrupt" and jobs[6]["last_job_run"] == at("2024-01-02T00:00:00")
    assert (done[8]["run_time"], done[8]["next_recurrence_time"]) == (at("2024-01-04T08:00:00"), at("2024-01-05T08:00:00"))
    moved = {r["scheduler_id"]: r["recurrence_time"] for r in dicts(changes.schedules)}
    assert moved == {5: at("2024-01-05T08:00:00"), 7: at("2024-01-04T08:00:00")}
    assert changes.audit_rows.count() == 8


def one_by_one(requests, jobs, schedules, rows):
    """The requests as a plain loop over the state they leave; months by the day of the run before."""
    status = {j["job_id"]: j["job_running_status"] for j in jobs}
    of_job, rows = {j["job_id"]: j for j in jobs}, {r["job_queue_id"]: dict(r) for r in rows}
    plans = {}
    for p in sorted(schedules, key=lambda p: p["scheduler_id"]):
        plans.setdefault(p["job_id"], dict(p))
    units = {"Mint": dt.timedelta(minutes=1), "Hr": dt.timedelta(hours=1), "Daily": dt.timedelta(days=1), "Weekly": dt.timedelta(weeks=1)}

    def following(p):
        if not p["recurrence"]:
            return None
        if p["frequency"] != "Monthly":
            return p["recurrence_time"] + int(p["recurrence"]) * units[p["frequency"]]
        months = p["recurrence_time"].year * 12 + p["recurrence_time"].month - 1 + int(p["recurrence"])
        last = calendar.monthrange(months // 12, months % 12 + 1)[1]
        return p["recurrence_time"].replace(year=months // 12, month=months % 12 + 1, day=min(last, p["recurrence_time"].day))

    out = {}
    for r in sorted(requests, key=lambda r: r["request_id"]):
        time = None
        if r["action"] in ("run", "skip"):
            j, p = of_job.get(r["job_id"]), plans.get(r["job_id"])
            step = following(p) if p else None
            if j is None or j["job_status"] != "Active":
                result = "job_not_active"
            elif status[r["job_id"]] in ("Queue", "Running"):
                result = "job_busy"
            elif r["action"] == "run":
                result, status[r["job_id"]] = "done", "Queue"
            elif j["execution"] != "Auto":
                result = "not_auto"
            elif step is None or p["end_date"] and step > dt.datetime.combine(p["end_date"], dt.time.fromisoformat(p["start_time"])):
                result = "no_next_run"
            else:
                result, time, p["recurrence_time"] = "done", p["recurrence_time"], step
        else:
            row = rows.get(r["job_queue_id"])
            if row is None:
                result = "queue_row_not_found"
            elif r["action"] == "fail" and row["job_status"] != "Queue":
                result = "not_in_queue"
            else:
                result, row["job_status"] = "done", "Failed" if r["action"] == "fail" else "Interrupt"
                status[row["job_id"]] = row["job_status"]
        out[r["request_id"]] = (result, time)
    return out


@pytest.mark.parametrize("seed, range_ids", [(1, 7), (2, 1), (3, 1000)])
def test_requests_act_one_after_the_other_in_any_ranges(spark, seed, range_ids):
    chance = random.Random(seed)
    jobs = [
        job(n, chance.choice(["Active"] * 4 + ["Inactive"]), chance.choice([None, "Queue", "Running", "Failed"]), chance.choice(["Auto"] * 3 + ["Manual"]))
        for n in range(1, 9)
    ]
    schedules = [
        plan(n, n % 8 + 1, f"2024-01-{chance.randint(28, 31)}T08:00:00", chance.choice(["1", "2", "0", ""]), chance.choice([None, "2024-04-20"]),
             chance.choice(["Mint", "Hr", "Daily", "Weekly", "Monthly", "Monthly"]))
        for n in range(1, 12)
    ]
    rows = [waiting(100 + n, chance.randint(1, 8), chance.choice(["Queue", "Running"])) for n in range(60)]
    requests = []
    for number in chance.sample(range(1, 600), 300):
        action = chance.choice(["run", "skip", "skip", "fail", "interrupt"])
        on_job = action in ("run", "skip")
        # Job 1 gets half of all.
        requests.append({
            "request_id": number, "action": action, "job_id": chance.choice([1] * 9 + list(range(1, 10))) if on_job else None,
            "job_queue_id": None if on_job else chance.randint(100, 165),
        })
    sets = tables(spark, source_job=jobs, scheduler=schedules, job_queue=rows)
    asked = frame(spark, "request_id bigint, action string, job_id bigint, job_queue_id bigint", *requests)
    found = by(actions.operator_actions(asked, sets, "2024-01-02 00:00:00", range_ids), "request_id")
    wanted = one_by_one(requests, jobs, schedules, rows)
    assert {key: (row["result"], row["run_time"] if row["action"] == "skip" else None) for key, row in found.items()} == wanted
    assert {result for result, _ in wanted.values()} >= {"done", "job_busy", "no_next_run", "not_in_queue", "queue_row_not_found"}


def message(seq, row, status="Running", kind="QUEUE_DETAIL", end=None):
    return {
        "seq": seq, "job_queue_id": row, "job_id": row * 10, "message_type": kind, "job_status": status,
        "logs_detail": f"log {seq}", "event_time": at("2024-01-01T00:00:00"), "end_time": at(end) if end else None,
    }


def test_fold_takes_the_newest_state_and_the_newest_end(spark):
    sets = tables(
        spark, source_job=[job(10), job(20)],
        job_queue=[waiting(1, 10, "Start"), waiting(2, 20, "Start"), waiting(3, 20, "Start")],
    )
    messages = frame(
        spark, STATUS_MESSAGE,
        message(3, 1, "Running"), message(2, 1, "Failed", end="2024-01-05T00:00:00"), message(1, 1, "Completed", end="2024-01-09T00:00:00"),
        message(4, 2, "Completed", "AUDIT_LOG", "2024-01-07T00:00:00"), message(5, 2, "Nonsense"), message(6, 2, "Skip", "OTHER"),
        message(7, 99, "Failed"), message(8, 3, "Skip"),
    )
    rows = by(folding.status_fold(sets, messages), "job_queue_id")
    assert sorted(rows) == [1, 3]
    assert (rows[1]["job_status"], rows[1]["end_time"]) == ("Running", at("2024-01-05T00:00:00"))
    assert rows[1]["job_status_message"] == "Job 10 now complete." and rows[3]["job_status_message"] == "waits"
    assert sorted(r["seq"] for r in dicts(folding.audit_rows(messages))) == [1, 2, 3, 4, 7, 8]
    assert [(r["job_id"], r["job_running_status"]) for r in dicts(folding.status_fold_jobs(sets, messages))] == [(10, "Running")]


def test_partial_folds_merge_in_any_order(spark):
    chance = random.Random(3)
    statuses = ["Start", "Running", "Completed", "Failed"]
    rows = [
        message(seq, chance.randrange(4), chance.choice(statuses), end=f"2024-01-{1 + seq % 28:02d}T00:00:00" if seq % 3 else None)
        for seq in range(200)
    ]
    messages = frame(spark, STATUS_MESSAGE, *rows).cache()
    whole = by(folding.newest_per_queue_row(messages), "job_queue_id")
    parts = [folding.newest_per_queue_row(messages.where(F.hash("seq") % 3 == n)) for n in (0, 1, -1, 2, -2)]
    merged = parts[0]
    for part in parts[1:]:
        merged = part.unionByName(merged)
    assert by(folding.merge_partials(merged, "job_queue_id"), "job_queue_id") == whole


def test_cascade_passes_only_statuses_that_are_given(spark):
    sets = tables(
        spark, source_job=[job(1), job(2, task=2), job(3, task=3)],
        source_task=[{"task_detail_id": n, "source_task_type_id": n} for n in (1, 2, 3)],
    )
    types = frame(
        spark, "source_task_type_id bigint, new_status string",
        {"source_task_type_id": 1, "new_status": "Inactive"}, {"source_task_type_id": 2},
    )
    assert [(r["job_id"], r["job_status"]) for r in dicts(folding.cascade_from_types(sets, types))] == [(1, "Inactive")]


def test_mails_follow_the_flags_and_need_a_recipient(spark):
    sets = tables(
        spark, source_job=[job(1, fail_job=True), job(2, complete_job=True)],
        job_queue=[waiting(1, 1), {**waiting(2, 1, "Skip"), "skip_time": at("2024-01-03T00:00:00")}, waiting(3, 2)],
        lookup_data=[{"lookup_id": 1, "lookup_type": "EMAIL_RECEIVER", "lookup_value": "a@b.c"}],
    )
    events = frame(
        spark, "job_queue_id bigint, job_id bigint, job_status string",
        {"job_queue_id": 1, "job_id": 1, "job_status": "Failed"}, {"job_queue_id": 2, "job_id": 1, "job_status": "Skip"},
        {"job_queue_id": 3, "job_id": 2, "job_status": "Completed"}, {"job_queue_id": 3, "job_id": 2, "job_status": "Failed"},
    )
    mails = by(notices.notification_feed(sets, events), "event_id")
    assert {key: row["subject"] for key, row in mails.items()} == {1: "Source Job Failed", 3: "Source Job Completed"}
    assert notices.notification_feed(sets.replacing(lookup_data=table(spark, "lookup_data")), events).count() == 0


def test_status_notice_leaves_out_absent_times(spark):
    sets = tables(spark, source_job=[job(1, running="Queue"), job(2, "Inactive")], scheduler=[plan(1, 1, "2024-01-01T09:30:00")])
    notice = dicts(notices.status_notifications(sets, sets.source_job))
    assert len(notice) == 1 and json.loads(notice[0]["payload"]) == {
        "jobId": 1, "jobStatus": "Active", "jobRunningStatus": "Queue", "recurrenceTime": "2024-01-01 09:30:00.0", "execution": "Auto",
    }


def test_a_dispatch_leaves_jobs_at_their_newest_row_and_mails_who_wants_it(spark):
    stamp = at("2024-03-01T00:00:00")
    rows = [{"job_queue_id": n, "job_id": job, "job_send": False, "job_status": "Queue", "start_time": stamp, "date_created": stamp}
            for n, job in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 99))]
    sets = tables(
        spark,
        job_queue=rows,
        source_job=[
            {"job_id": 1, "job_status": "Active", "task_detail_id": 1, "priority": 1, "fail_job": False},
            {"job_id": 2, "job_status": "Active", "task_detail_id": 1, "priority": 1, "fail_job": True},
            {"job_id": 3, "job_status": "Inactive", "task_detail_id": 1, "priority": 1, "fail_job": True, "job_running_status": "Queue"},
        ],
        source_task=[{"task_detail_id": 1, "task_status": "Active", "source_task_type_id": 1}],
        source_task_type=[{"source_task_type_id": 1, "task_type_status": "Active", "queue_topic_partition": "topic=t&partitions=[*]"}],
        lookup_data=[{"lookup_id": 1, "lookup_type": "EMAIL_RECEIVER", "lookup_value": "ops"}],
    )
    plan = dispatch.dispatch_plan(dispatch.waiting_rows(sets.job_queue), sets)
    results = frame(
        spark, "job_queue_id bigint, ok boolean, offset bigint, error string",
        {"job_queue_id": 1, "ok": False, "error": "down"}, {"job_queue_id": 2, "ok": True, "offset": 7},
        {"job_queue_id": 3, "ok": False, "error": "down"},
    )
    changes = dispatch.dispatch_changes(plan, results, sets, "2024-03-02 00:00:00", log_id=100)
    assert {n: row["job_running_status"] for n, row in by(changes.job_updates, "job_id").items()} == {1: "Start", 2: "Failed", 3: "Failed"}
    queue = by(changes.queue_rows, "job_queue_id")
    assert {n: (row["job_status"], row["job_send"]) for n, row in queue.items()} == {
        1: ("Failed", False), 2: ("Start", True), 3: ("Failed", False), 4: ("Failed", False), 5: ("Failed", False)}
    assert queue[2]["end_time"] is None and queue[5]["end_time"] == at("2024-03-02T00:00:00")
    assert sorted(row["job_audit_log_id"] for row in dicts(changes.audit_rows)) == [101, 102, 103, 104, 105]
    assert sorted((row["job_id"], row["event_id"], row["status"]) for row in dicts(changes.mails)) == [(2, 3, "Failed"), (3, 4, "Failed")]
    notices = by(changes.notices, "job_id")
    assert notices.keys() == {1, 2} and '"jobRunningStatus":"Start"' in notices[1]["payload"]
