"""Upload sheets, their rules and XML payloads."""

import random
from xml.dom import minidom

import pytest
from hypothesis import given, settings, strategies as st

from conftest import SAMPLE
from helpers import by, dicts, frame, tables
from runledger.model import JOB_SHEET_COLUMNS, JOB_SHEET_HEADINGS
from runledger.operators import bulk, payload
from runledger.plans import catalog
from runledger.sources.sheets import HeadingError, check_headings, read_sheet, write_sheet

CLOCK = "2024-03-01 10:00:00"
ROW = "row_no bigint, " + ", ".join(f"{name} string" for name in JOB_SHEET_COLUMNS)
GOOD = {
    "job_name": "a", "task_id": "1", "start_date": "2024-03-02", "start_time": "09:00", "frequency": "Daily", "recurrence": "1",
    "priority": "1", "email_job_complete": "true",
}
# Changed cells of an otherwise good row, and the rules the row then fails.
CASES = [
    ({}, ""),
    ({"job_name": ""}, "job_name_empty"),
    ({"task_id": None}, "task_id_empty"),
    ({"start_date": None}, "start_date_empty,start_date_invalid,unparsable"),
    ({"start_date": "2024-3-2"}, "start_date_invalid,unparsable"),
    ({"start_date": "2024-02-30"}, "unparsable"),
    ({"start_date": "2024-02-29"}, "start_date_past"),
    ({"start_date": "2024-03-01", "start_time": "10:01"}, ""),
    ({"start_date": "2024-03-01", "start_time": "10:00"}, ""),
    ({"start_date": "2024-03-01", "start_time": "09:59"}, "start_time_past"),
    ({"start_time": ""}, "start_time_empty,start_time_invalid,unparsable"),
    ({"start_time": None}, "start_time_empty,start_time_invalid,unparsable"),
    ({"start_time": "25:00"}, "start_time_invalid"),
    ({"start_time": "9:5:x"}, "start_time_invalid"),
    ({"start_time": "09:"}, "start_time_invalid,unparsable"),
    ({"start_time": "ab:cd"}, "start_time_invalid,unparsable"),
    ({"frequency": None}, "frequency_empty,frequency_invalid,unparsable"),
    ({"frequency": ""}, "frequency_empty,frequency_invalid,unparsable"),
    ({"frequency": "", "recurrence": ""}, "frequency_empty,frequency_invalid"),
    ({"frequency": None, "recurrence": None}, "frequency_empty,frequency_invalid,unparsable"),
    ({"frequency": "Yearly"}, "frequency_invalid,unparsable"),
    ({"frequency": "Yearly", "recurrence": None, "start_date": "1999-01-01"}, "frequency_invalid"),
    ({"recurrence": "7"}, "recurrence_invalid"),
    ({"recurrence": "x"}, "unparsable"),
    ({"recurrence": "1.5"}, "unparsable"),
    ({"recurrence": None}, ""),
    ({"frequency": "Mint", "recurrence": "55"}, ""),
    ({"frequency": "Mint", "recurrence": "60"}, "recurrence_invalid"),
    ({"frequency": "Hr", "recurrence": "12"}, ""),
    ({"frequency": "Hr", "recurrence": "13"}, "recurrence_invalid"),
    ({"frequency": "Monthly", "recurrence": "31"}, ""),
    ({"priority": None}, "priority_empty,priority_invalid"),
    ({"priority": "10"}, "priority_invalid"),
    ({"priority": "100"}, ""),
    ({"end_date": "2024-03-01"}, "end_before_start"),
    ({"end_date": "2024-03-02"}, ""),
    ({"end_date": "2024-13-01"}, "end_date_invalid,unparsable"),
    ({"end_date": "2024-02-31"}, "unparsable"),
    ({"end_date": "2024-02-31", "start_time": None}, "start_time_empty,start_time_invalid,unparsable"),
    ({"frequency": "Weekly", "end_date": "2024-03-07"}, "weekly_span_short"),
    ({"frequency": "Weekly", "end_date": "2024-03-08"}, ""),
    ({"frequency": "Weekly", "end_date": "2024-03-01"}, "end_before_start"),
    ({"frequency": "Monthly", "end_date": "2024-03-31"}, "monthly_span_short"),
    ({"frequency": "Monthly", "end_date": "2024-04-01"}, ""),
    ({"email_job_complete": "maybe"}, "complete_flag_invalid"),
    ({"email_job_fail": "TRUE", "email_job_skip": "fALSE"}, ""),
    ({"email_job_fail": "no", "email_job_skip": "t"}, "fail_flag_invalid,skip_flag_invalid"),
    ({"end_date": "2024-03-01", "start_time": "xx"}, "start_time_invalid,end_before_start,unparsable"),
]


@pytest.fixture(scope="module")
def sets(spark):
    return tables(
        spark,
        source_job=[{"job_id": 40}], scheduler=[{"scheduler_id": 60}],
        source_task=[{"task_detail_id": 1, "task_status": "Active"}, {"task_detail_id": 2, "task_status": "Delete"}],
        source_task_type=[
            {"source_task_type_id": 5, "task_type_status": "Active"}, {"source_task_type_id": 6, "task_type_status": "Inactive"},
            {"source_task_type_id": 7, "task_type_status": "Delete"},
        ],
    )


def sheet(spark, *changes):
    return frame(spark, ROW, *({"row_no": 2 + n, **GOOD, **change} for n, change in enumerate(changes)))


def test_every_rule(spark):
    checked = by(bulk.bulk_job_validation(sheet(spark, *(change for change, _ in CASES)), CLOCK), "row_no")
    found = [(change, ",".join(checked[2 + n]["errors"])) for n, (change, _) in enumerate(CASES)]
    assert found == CASES


def test_load_is_all_or_nothing(spark, sets):
    good = bulk.bulk_load(sheet(spark, {}, {"end_date": "2024-03-09", "recurrence": ""}), sets, CLOCK)
    jobs, schedules = by(good.jobs, "job_id"), by(good.schedules, "job_id")
    assert sorted(jobs) == sorted(schedules) == [41, 42] and good.errors.count() == 0
    assert (jobs[41]["complete_job"], jobs[41]["fail_job"], jobs[41]["execution"], jobs[41]["priority"]) == (True, False, "Auto", 1)
    assert (schedules[42]["scheduler_id"], schedules[42]["recurrence"], str(schedules[42]["end_date"])) == (62, None, "2024-03-09")

    bad = bulk.bulk_load(sheet(spark, {}, {"task_id": "2"}, {"task_id": "x", "recurrence": "9"}), sets, CLOCK)
    assert bad.jobs.count() == bad.schedules.count() == 0
    errors = by(bad.errors, "row_no")
    assert errors[3]["message"] == "Delete sourceTask not link with source job at row 3.\n"
    assert errors[4]["message"].startswith("Recurrence not valid its should be [1, 2, 3, 4, 5, 6] at row 4.Delete sourceTask")


def test_task_upload(spark, sets):
    def row(number, type_id="5", name="n", xml="<a><b>1</b></a>"):
        return {"row_no": number, "source_task_type_id": type_id, "task_name": name, "task_payload": xml}

    schema = "row_no bigint, source_task_type_id string, task_name string, task_payload string, pipeline_id string, home_page_id string"
    rows = frame(
        spark, schema, row(2), row(3, "6"), row(4, "7"), row(5, "8"), row(6, "x"), row(7, None), row(8, name=""), row(9, xml=None), row(10, xml="<a>"),
    )
    checked = {key: ",".join(row_["errors"]) for key, row_ in by(bulk.bulk_task_validation(rows, sets), "row_no").items()}
    assert checked == {
        2: "", 3: "type_inactive", 4: "type_deleted", 5: "type_not_found", 6: "type_not_found", 7: "type_id_empty", 8: "task_name_empty",
        9: "task_payload_empty", 10: "task_payload_invalid",
    }
    assert bulk.bulk_task_load(rows, sets, CLOCK).tasks.count() == 0
    load = bulk.bulk_task_load(rows.where("row_no = 2"), sets, CLOCK)
    assert dicts(load.tasks, "task_detail_id", "source_task_type_id") == [{"task_detail_id": 3, "source_task_type_id": 5}]
    assert [(r["payload_id"], r["tag_key"], r["tag_value"]) for r in dicts(load.payload_tags)] == [(3, "a", None), (3, "b", "1")]


def test_sheets_are_numbered_through_all_their_blocks(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    for name, count in (("one.csv", 3000), ("two.csv", 10)):
        lines = [",".join(JOB_SHEET_HEADINGS)] + [f"{name}-{n},1,,,,,,,,," for n in range(count)]
        (folder / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = dicts(read_sheet(spark, str(folder)), "row_no", "job_name", "end_date")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["job_name"], r["row_no"]) for r in rows} == {
        (f"{name}-{n}", n + 2) for name, count in (("one.csv", 3000), ("two.csv", 10)) for n in range(count)
    }
    assert len(rows) == 3010 and rows[0]["end_date"] == ""


def test_headings_have_to_agree(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(",".join(JOB_SHEET_HEADINGS).replace("Priority", "priority") + "\n")
    with pytest.raises(HeadingError, match="Priority heading missing"):
        read_sheet(spark, str(path))
    with pytest.raises(HeadingError):
        check_headings(JOB_SHEET_HEADINGS[:-1], JOB_SHEET_HEADINGS)


def test_sheet_round_trip(spark, sample, tmp_path):
    path = str(tmp_path / "jobs")
    write_sheet(sample.bulk_jobs, path, JOB_SHEET_HEADINGS, JOB_SHEET_COLUMNS)
    back = read_sheet(spark, path).select(*JOB_SHEET_COLUMNS)
    cells = sample.bulk_jobs.select(*JOB_SHEET_COLUMNS).na.fill("")
    assert back.exceptAll(cells).count() == 0 and back.count() == cells.count()


def test_cells_may_hold_line_breaks(spark, tmp_path):
    """Payloads of several lines, with quotes and commas, in two files; rows keep their numbers."""
    payload_text = '<task>\n  <name a="1">x, "y"</name>\n\n</task>'
    sheets = []
    for number in range(2):
        cells = [{"row_no": k, **GOOD, "job_name": f"{number}-{k}\n{payload_text}" if k % 2 else f'{number}-{k} "q"'} for k in range(2, 9)]
        path = str(tmp_path / f"sheet-{number}")
        write_sheet(frame(spark, ROW, *cells).coalesce(1), path, JOB_SHEET_HEADINGS, JOB_SHEET_COLUMNS)
        sheets += [(number, cell["row_no"], cell["job_name"]) for cell in cells]
    back = read_sheet(spark, str(tmp_path / "sheet-*"))
    assert sorted((int(r["job_name"][0]), r["row_no"], r["job_name"]) for r in dicts(back)) == sorted(sheets)
    assert sorted(r["load_no"] for r in dicts(back)) == list(range(1, 15))


def test_reading_tags():
    text = """<?xml version="1.0"?><!-- c --><r xmlns:x="u" a="1"> t <x:k><![CDATA[ 1 < 2 ]]></x:k><e/><m>a<n>&amp;b</n>c</m>\n<r>  </r></r>"""
    assert payload.read_tags(text) == [
        ("r", "r", None), ("x:k", "r", "1 < 2"), ("e", "r", ""), ("m", "r", None), ("n", "m", "&b"), ("r", "r", ""),
    ]
    for bad in ("<a>", "<a/><b/>", "text", "<y:a/>", "<a>&none;</a>"):
        with pytest.raises(Exception):
            payload.read_tags(bad)


def test_flattening_skips_what_cannot_be_read(spark):
    rows = frame(
        spark, "task_detail_id bigint, task_payload string",
        {"task_detail_id": 1, "task_payload": "<a><b> x </b></a>"}, {"task_detail_id": 2, "task_payload": "<a>"}, {"task_detail_id": 3},
        {"task_detail_id": 4, "task_payload": ""},
    )
    assert [tuple(r.values()) for r in dicts(payload.payload_flatten(rows))] == [(1, 1, "a", "a", None), (1, 2, "b", "a", "x")]


def test_the_task_that_writes_a_sheet_neither_joins_nor_sorts(spark, monkeypatch):
    plans = []

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write_sheet(rows, *rest)

    monkeypatch.setattr(catalog, "write_sheet", seen)
    found = dicts(catalog.queries()["bulk_load_sheets"](spark, SAMPLE))
    assert found[0]["jobs"] == found[0]["ids"] > 0
    assert len(plans) == 3 and not any(step in plan for plan in plans for step in ("Join", "Sort", "Exchange"))


def by_dom(tags):
    """The document as the last element of a name, searched for each time, gives it."""
    document = minidom.Document()
    root = None
    for key, parent, value in tags:
        element = document.createElement(key)
        if value:
            element.appendChild(document.createTextNode(value))
        if root is None:
            root = document.appendChild(element)
        elif not parent:
            root.appendChild(element)
        else:
            known = document.getElementsByTagName(parent)
            if known:
                known[-1].appendChild(element)
            else:
                root.appendChild(document.createElement(parent)).appendChild(element)
    return root.toxml()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["a", "b", "c", "d", "", None]), st.sampled_from(["1", "<&", None])), min_size=1, max_size=14))
def test_building_puts_tags_under_the_last_element_of_the_name(tags):
    document = payload._Document()
    for tag in tags:
        document.add(*tag)
    assert minidom.parseString(document.text()).documentElement.toxml() == minidom.parseString(by_dom(tags)).documentElement.toxml()


def test_build_then_flatten_gives_the_tags_back(spark):
    chance = random.Random(5)
    rows, number = [], 0
    for owner in range(40):
        names = [f"n{owner}"]
        rows.append((number, names[0], names[0], None, owner))
        leaves = []
        for place in range(chance.randrange(1, 30)):
            number += 1
            parent = chance.choice(names[-2:])
            name = f"n{owner}-{place}"
            rows.append((number, name, parent, None, owner))
            names.append(name)
        number += 1
    tags = spark.createDataFrame(rows, "task_payload_id bigint, tag_key string, tag_parent string, tag_value string, payload_id bigint")
    built = payload.payload_build(tags.repartition(7))
    back = payload.payload_flatten(built, "payload_id")
    assert {(r.payload_id, r.tag_key, r.tag_parent) for r in back.collect()} == {(r[4], r[1], r[2]) for r in rows}
    assert back.count() == len(rows)
