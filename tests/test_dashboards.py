from helpers import at, by, dicts, table, tables
from runledger.operators import dashboards, details, paging, reports, search


def queue_row(number, job_id, status, created):
    return {"job_queue_id": number, "job_id": job_id, "job_status": status, "date_created": at(created), "job_send": False}


def test_an_hour_without_runs_still_has_its_total(spark):
    rows = dicts(dashboards.run_status_matrix(tables(spark), "2030-01-01", 0))
    assert len(rows) == 1 and rows[0]["job_id"] is None
    assert {value for name, value in rows[0].items() if name not in ("job_id", "job_name")} == {0}


def test_matrix_counts_known_jobs_of_the_hour_and_puts_the_total_last(spark):
    sets = tables(
        spark,
        source_job=[{"job_id": 1, "job_name": "a"}, {"job_id": 2, "job_name": "b"}],
        job_queue=[
            queue_row(1, 2, "Failed", "2024-01-09T10:00:00"),
            queue_row(2, 1, "Skip", "2024-01-09T10:59:59.999999"),
            queue_row(3, 1, "Failed", "2024-01-09T10:30:00"),
            queue_row(4, 1, "Failed", "2024-01-09T11:00:00"),
            queue_row(5, 9, "Failed", "2024-01-09T10:10:00"),
        ],
    )
    rows = dicts(dashboards.run_status_matrix(sets, "2024-01-09", 10), "job_id", "failed", "skip", "stop", "total")
    assert [tuple(row.values()) for row in rows] == [(1, 1, 1, 0, 2), (2, 1, 0, 0, 1), (None, 2, 1, 0, 3)]


def test_statistics_of_a_job_that_never_ran_are_zeros(spark):
    sets = tables(spark, source_job=[{"job_id": 1}])
    assert dicts(dashboards.job_run_statistics(sets, 1), "job_id", "total") == [{"job_id": 1, "total": 0}]


def test_weekday_names_and_whole_end_day(spark):
    sets = tables(
        spark,
        job_queue=[
            queue_row(1, 1, "Queue", "2024-01-08T00:00:00"),
            queue_row(2, 1, "Queue", "2024-01-14T23:59:59.999999"),
            queue_row(3, 1, "Queue", "2024-01-15T00:00:00"),
        ],
    )
    assert {r["daycode"] for r in dicts(dashboards.runs_by_weekday(sets, "2024-01-08", "2024-01-14"))} == {"Mon", "Sun"}
    hourly = dicts(dashboards.runs_by_weekday_hour(sets, "2024-01-08", "2024-01-14"), "daycode", "hr")
    assert sorted(map(tuple, (row.values() for row in hourly))) == [("Monday", 0), ("Sunday", 23)]


def test_queue_log_lists_newest_first_and_needs_both_dates(spark):
    sets = tables(spark, job_queue=[queue_row(n, n % 2, "Queue", f"2024-01-0{n}T01:00:00") for n in range(1, 6)])
    log = dashboards.queue_log(sets, "2024-01-02", "2024-01-05", job_ids=[1])
    assert [row["job_queue_id"] for row in dicts(log)] == [5, 3]
    try:
        dashboards.queue_log(sets, "2024-01-02", "")
    except ValueError:
        return
    raise AssertionError("a missing date was accepted")


def test_search_items(spark):
    sets = tables(
        spark,
        source_task=[
            {"task_detail_id": 12, "task_name": "Alpha", "task_status": "Active", "source_task_type_id": 1},
            {"task_detail_id": 21, "task_name": "beta", "task_status": "Inactive", "source_task_type_id": 1},
            {"task_detail_id": 31, "task_name": "gamma", "task_status": "Active"},
        ],
        source_task_type=[{"source_task_type_id": 1, "service_name": "Web"}],
    )

    def found(item, value):
        return sorted(row["task_detail_id"] for row in dicts(search.task_search(sets, item, value)))

    assert found("task_name", "AL") == [12]
    assert found("TASK_STATUS", "Active") == [12]
    assert found("task_status", "active") == [21]
    assert found("task_detail_id", "1") == [12, 21]
    assert found("service_name", "wEb") == [12, 21]
    assert found("nothing_known", "x") == [12, 21]
    assert found(None, None) == [12, 21]


def test_page_has_names_counts_and_a_stable_order(spark):
    sets = tables(
        spark,
        source_task=[
            {"task_detail_id": n, "task_name": "same", "source_task_type_id": 1, "home_page_id": "5", "pipeline_id": "6"}
            for n in range(1, 31)
        ],
        source_task_type=[{"source_task_type_id": 1, "service_name": "Web"}],
        lookup_data=[{"lookup_id": 5, "lookup_type": "HOME"}],
        source_job=[{"job_id": n, "task_detail_id": 12} for n in range(3)],
    )
    page = dicts(search.task_search_page(sets, column="task_name", page=2, limit=10))
    assert [row["task_detail_id"] for row in page] == list(range(11, 21))
    assert [row["total_link_jobs"] for row in page] == [0, 3] + [0] * 8
    assert {(row["home_page_id"], row["pipeline_id"]) for row in page} == {("HOME", None)}
    first = dicts(search.task_search_page(sets, column="total_link_jobs", direction="desc", limit=2))
    assert [row["task_detail_id"] for row in first] == [12, 1]


def test_paging_defaults_and_refused_columns(spark):
    rows = table(spark, "source_job", *({"job_id": n, "priority": n % 3 or None} for n in range(25)))
    assert paging.sort_page(rows, "job_id").count() == paging.DEFAULT_ROWS
    desc = dicts(paging.sort_page(rows, "job_id", "priority", "desc", limit=1))
    assert desc[0]["priority"] is None
    odd = dicts(paging.sort_page(rows, "job_id", "priority", "sideways", limit=1))
    assert odd[0]["priority"] == 1
    for column in ("1; drop table x", "unknown"):
        try:
            paging.sort_page(rows, "job_id", column)
        except ValueError:
            continue
        raise AssertionError("an unknown column was accepted")


def test_reports_have_blank_cells_and_iso_times(spark, tmp_path):
    sets = tables(
        spark,
        source_job=[
            {
                "job_id": 1, "job_name": "a", "task_detail_id": 7, "job_status": "Active", "execution": "Auto", "priority": 1,
                "date_created": at("2024-01-01T00:00:00"), "last_job_run": at("2024-01-02T03:04:05.5"), "skip_job": True,
            }
        ],
        source_task=[{"task_detail_id": 7, "task_name": "t"}],
    )
    report = reports.job_report(sets)
    row = dicts(report)[0]
    assert row["task"] == "7 [t]" and row["created_date"] == "2024-01-01 00:00:00.0"
    assert row["last_run"] == "2024-01-02T03:04:05.500" and row["start_date"] == row["next_flight"] == ""
    assert (row["email_job_skip"], row["email_job_fail"]) == ("True", "False")
    from runledger.model import JOB_REPORT_HEADINGS

    reports.write_report(report, JOB_REPORT_HEADINGS, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).columns == list(JOB_REPORT_HEADINGS)


def test_job_list_takes_the_lowest_schedule(spark):
    sets = tables(
        spark,
        source_job=[{"job_id": 1}, {"job_id": 2}],
        scheduler=[{"scheduler_id": 9, "job_id": 1}, {"scheduler_id": 4, "job_id": 1, "frequency": "Hr"}],
        job_queue=[queue_row(1, 2, "Skip", "2024-01-01T00:00:00")],
    )
    rows = by(details.job_list(sets), "job_id")
    assert (rows[1]["scheduler_id"], rows[1]["frequency"], rows[1]["has_run"]) == (4, "Hr", False)
    assert (rows[2]["scheduler_id"], rows[2]["has_run"]) == (None, True)


def test_detail_of_one_job_is_nested(spark, sample):
    one = dicts(details.job_detail(sample, 3))
    assert len(one) == 1 and one[0]["task"]["source_task_type"]["source_task_type_id"] is not None
    assert dicts(details.flat_job_detail(details.job_detail(sample)).where("job_id = 3")) == dicts(
        details.flat_job_detail(details.job_detail(sample, 3))
    )


def test_children_of_one_lookup(spark, sample):
    children = dicts(details.lookup_tree(sample, parent_id=1))
    assert len(children) == 5 and {row["lookup_id"] for row in children} == {1}
