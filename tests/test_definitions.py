import datetime as dt
import random

import pytest

from helpers import at, by, dicts, frame, tables
from runledger.operators import definitions

JOB_CHANGE = (
    "change_id bigint, op string, job_id bigint, job_name string, task_detail_id bigint, job_status string, execution string,"
    " priority int, complete_job boolean, fail_job boolean, skip_job boolean"
)
TYPE_CHANGE = (
    "change_id bigint, op string, source_task_type_id bigint, service_name string, description string,"
    " queue_topic_partition string, schema_payload string, task_type_status string"
)
NOW = "2024-05-01 00:00:00"


@pytest.fixture(scope="module")
def sets(spark):
    return tables(
        spark,
        source_job=[
            {"job_id": n, "job_name": f"j{n}", "task_detail_id": 1, "job_status": "Active", "execution": "Auto", "priority": n,
             "date_created": at("2024-01-01T00:00:00"), "complete_job": True, "fail_job": False, "skip_job": True}
            for n in range(1, 7)
        ],
        source_task=[
            {"task_detail_id": 1, "task_status": "Active", "source_task_type_id": 8},
            {"task_detail_id": 2, "task_status": "Inactive", "source_task_type_id": 9},
        ],
        source_task_type=[
            {"source_task_type_id": n, "service_name": "s", "description": "d", "queue_topic_partition": "r", "task_type_status": "Active",
             "is_schema_register": False}
            for n in (8, 9)
        ],
        scheduler=[
            {"scheduler_id": n, "job_id": 1, "start_date": dt.date(2024, 1, 1), "end_date": dt.date(2024, 2, 1), "start_time": "08:00",
             "frequency": "Daily", "recurrence": "1", "recurrence_time": at("2024-01-05T08:00:00")}
            for n in (3, 4)
        ],
    )


def test_each_change_gets_its_first_error(spark, sets):
    def change(number, op, **cells):
        return {"change_id": number, "op": op, "job_name": "n", "task_detail_id": 1, "execution": "Auto", "priority": 1, **cells}

    changes = frame(
        spark, JOB_CHANGE,
        change(1, "add", job_name=""), change(2, "add", task_detail_id=None), change(3, "add", task_detail_id=77), change(4, "add", task_detail_id=2),
        change(5, "update"), change(6, "update", job_id=99), change(7, "update", job_id=1, task_detail_id=2), change(8, "update", job_id=1),
        change(9, "delete"), change(10, "delete", job_id=99), change(11, "delete", job_id=2), change(12, "move", job_id=2),
        change(13, "add", execution=None), change(14, "add", priority=None),
    )
    errors = {key: row["error"] for key, row in by(definitions.check_changes(changes, sets, "source_job"), "change_id").items()}
    assert errors == {
        1: "job_name_missing", 2: "task_detail_id_missing", 3: "task_not_active", 4: None, 5: "job_id_missing", 6: "not_found",
        7: "task_not_active", 8: None, 9: "job_id_missing", 10: "not_found", 11: None, 12: "unknown_op",
        13: "execution_missing", 14: "priority_missing",
    }
    rows = by(definitions.upsert_definitions(changes, sets, "source_job", NOW, id_base=1000), "job_id")
    assert sorted(rows) == [1, 2, 1004]
    assert rows[1004]["job_status"] == "Active" and rows[1004]["complete_job"] is False and rows[1004]["date_created"] == at("2024-05-01T00:00:00")
    assert (rows[1]["job_name"], rows[1]["execution"], rows[1]["priority"], rows[1]["skip_job"]) == ("n", "Auto", 1, False)
    assert rows[2]["job_status"] == "Delete" and rows[2]["skip_job"] is True


def test_several_changes_of_a_job_act_one_after_the_other(spark, sets):
    chance = random.Random(11)
    changes = []
    for number in range(60):
        op = chance.choice(["update", "update", "delete"])
        changes.append({
            "change_id": number, "op": op, "job_id": chance.randrange(1, 7), "job_name": chance.choice([f"n{number}", None]),
            "task_detail_id": chance.choice([1, 1, 2]), "job_status": chance.choice([None, None, "Inactive", "Active"]),
            "execution": chance.choice([None, "Manual", "Auto"]), "priority": chance.choice([None, number]),
            "complete_job": chance.choice([None, True, False]), "fail_job": True, "skip_job": None,
        })
    expected = {row["job_id"]: row for row in dicts(sets.source_job)}
    touched = set()
    for change in changes:
        row = expected[change["job_id"]]
        if change["op"] == "delete":
            row["job_status"] = "Delete"
        elif change["job_name"] is None or change["task_detail_id"] != 1:
            continue
        else:
            row["job_name"], row["task_detail_id"] = change["job_name"], 1
            for kept in ("job_status", "execution", "priority"):
                row[kept] = change[kept] if change[kept] is not None else row[kept]
            row["complete_job"], row["fail_job"], row["skip_job"] = bool(change["complete_job"]), True, False
        touched.add(change["job_id"])
    rows = by(definitions.upsert_definitions(frame(spark, JOB_CHANGE, *changes), sets, "source_job", NOW), "job_id")
    assert rows == {key: expected[key] for key in touched}


def test_types_and_their_jobs(spark, sets):
    def change(number, op, type_id=None, **cells):
        cells = {"service_name": "x", "description": "y", "queue_topic_partition": "z", **cells}
        return {"change_id": number, "op": op, "source_task_type_id": type_id, **cells}

    changes = frame(
        spark, TYPE_CHANGE,
        change(1, "add", schema_payload="a int"), change(2, "update", 8, description=None, schema_payload="b int"),
        change(3, "delete", 9), change(4, "delete", 55), change(5, "add", description=""),
    )
    errors = {key: row["error"] for key, row in by(definitions.check_changes(changes, sets, "source_task_type"), "change_id").items()}
    assert errors == {1: None, 2: None, 3: None, 4: None, 5: "description_missing"}
    rows = by(definitions.upsert_definitions(changes, sets, "source_task_type", NOW), "source_task_type_id")
    assert sorted(rows) == [8, 9, 10]
    assert rows[10]["is_schema_register"] and rows[10]["task_type_status"] == "Active"
    assert (rows[8]["description"], rows[8]["is_schema_register"], rows[8]["task_type_status"]) == (None, True, "Active")
    assert rows[9]["task_type_status"] == "Delete" and rows[9]["service_name"] == "s"
    # Type 8 named no status, so only the deleted type would pass one on, and it has no jobs here.
    assert definitions.cascaded_jobs(changes, sets, "source_task_type").count() == 0
    passed = frame(spark, TYPE_CHANGE, change(1, "update", 8, task_type_status="Inactive"))
    assert {r["job_status"] for r in dicts(definitions.cascaded_jobs(passed, sets, "source_task_type"))} == {"Inactive"}


def test_schedules_of_changed_jobs(spark, sets):
    sent = frame(
        spark, "change_id bigint, job_id bigint, start_date date, end_date date, start_time string, frequency string, recurrence string",
        {"change_id": 5, "job_id": 1, "start_date": dt.date(2024, 6, 1), "start_time": "09:30", "frequency": "Hr", "recurrence": ""},
    )
    added = dicts(definitions.schedules_to_add(sent, NOW, 100))[0]
    assert (added["scheduler_id"], added["recurrence"], added["recurrence_time"]) == (105, None, at("2024-06-01T09:30:00"))
    updated = dicts(definitions.schedules_to_update(sent, sets))
    assert len(updated) == 1 and updated[0]["scheduler_id"] == 3
    assert (updated[0]["end_date"], updated[0]["recurrence"], updated[0]["frequency"]) == (dt.date(2024, 2, 1), "1", "Hr")
    assert updated[0]["recurrence_time"] == at("2024-06-01T09:30:00")


def test_several_schedules_of_a_job_act_in_order(spark, sets):
    schema = "change_id bigint, job_id bigint, start_date date, end_date date, start_time string, frequency string, recurrence string"
    day = dt.date(2024, 6, 1)
    sent = frame(
        spark, schema,
        {"change_id": 2, "job_id": 1, "start_date": day, "start_time": "08:00", "frequency": "Daily"},
        {"change_id": 1, "job_id": 1, "start_date": day, "end_date": day, "start_time": "07:00", "frequency": "Hr", "recurrence": "4"},
        {"change_id": 3, "job_id": 77, "start_date": day, "start_time": "08:00", "frequency": "Daily"},
    )
    updated = dicts(definitions.schedules_to_update(sent, sets))
    assert len(updated) == 1
    row = updated[0]
    assert (row["start_time"], row["frequency"], row["end_date"], row["recurrence"]) == ("08:00", "Daily", day, "4")


def test_tags_of_changed_tasks(spark, sets):
    tags = [{"task_payload_id": 50 + n, "tag_key": f"old{n}", "payload_id": 1} for n in range(2)]
    changes = frame(
        spark, "change_id bigint, op string, task_detail_id bigint, task_name string, task_payload string, source_task_type_id bigint, task_status string, home_page_id string, pipeline_id string",
        {"change_id": 1, "op": "update", "task_detail_id": 1, "task_name": "a", "task_payload": "p", "source_task_type_id": 8},
        {"change_id": 2, "op": "update", "task_detail_id": 1, "task_name": "b", "task_payload": "p", "source_task_type_id": 8},
        {"change_id": 3, "op": "update", "task_detail_id": 1, "task_name": "c", "task_payload": "p", "source_task_type_id": 8},
        {"change_id": 4, "op": "add", "task_name": "d", "task_payload": "p", "source_task_type_id": 8},
        {"change_id": 5, "op": "add", "task_payload": "refused", "source_task_type_id": 8},
    )
    sent = frame(
        spark, "change_id bigint, row_no bigint, tag_key string, tag_parent string, tag_value string",
        *({"change_id": change, "row_no": change * 10, "tag_key": f"k{change}"} for change in (1, 2, 4, 5)),
    )
    own = frame(spark, "task_payload_id bigint, tag_key string, tag_parent string, tag_value string, payload_id bigint", *tags)
    found = definitions.task_tags(changes, sent, sets.replacing(source_task_payload=own), id_base=1000, task_base=500)
    assert {(r["task_payload_id"], r["tag_key"], r["payload_id"]) for r in dicts(found.added)} == {(1020, "k2", 1), (1040, "k4", 504)}
    assert {r["task_payload_id"] for r in dicts(found.removed)} == {50, 51}
    # Without tags sent, a task keeps what it has.
    kept = definitions.task_tags(changes, sent.where("change_id > 90"), sets.replacing(source_task_payload=own), id_base=1000)
    assert kept.added.count() == 0 and kept.removed.count() == 0
