"""Readers, writers, ad-hoc SQL, and the shape of the plans."""

import os
import re
from types import SimpleNamespace

import pytest

import __spark_entry__ as entries
from conftest import SAMPLE
from helpers import by, dicts, plan_of, table, tables
from runledger.operators import adhoc, dashboards, quality, search
from runledger.plans import catalog
from runledger.session import shared_folder, work_path
from runledger.sources.tables import JobTables, read_table, read_tables, replace_rows, write_table


@pytest.fixture(scope="module")
def stored(spark, sample, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    for name in ("job_queue", "source_job", "scheduler", "source_task", "source_task_type", "lookup_data", "job_audit_logs"):
        write_table(getattr(sample, name), name, f"{base}/{name}")
    return base


def test_written_tables_read_back(spark, sample, stored):
    back = read_tables(spark, stored)
    for name in ("job_queue", "source_job", "job_audit_logs"):
        expected = getattr(sample, name)
        assert getattr(back, name).select(expected.columns).exceptAll(expected).count() == 0
        assert getattr(back, name).count() == expected.count()


def test_growing_tables_are_laid_out_by_day(stored):
    days = [name for name in os.listdir(f"{stored}/job_queue") if name.startswith("created_on=")]
    assert len(days) > 20 and not any(name.startswith("created_on=") for name in os.listdir(f"{stored}/source_job"))


def test_csv_and_catalog_tables(spark, sample, tmp_path):
    sample.source_job.write.option("header", True).csv(str(tmp_path / "jobs"))
    assert read_table(spark, "source_job", str(tmp_path / "jobs"), "csv").exceptAll(sample.source_job).count() == 0
    sample.source_job.createOrReplaceTempView("known_jobs")
    assert read_table(spark, "source_job", "known_jobs", "table").count() == sample.source_job.count()


def test_replacing_rows(spark):
    current = table(spark, "source_job", {"job_id": 1, "job_name": "a"}, {"job_id": 2, "job_name": "b"})
    changed = table(spark, "source_job", {"job_id": 2, "job_name": "B"}, {"job_id": 3, "job_name": "c"})
    after = by(replace_rows(current, changed, "job_id"), "job_id")
    assert {key: row["job_name"] for key, row in after.items()} == {1: "a", 2: "B", 3: "c"}


def test_tables_open_only_when_used():
    opened = []
    sets = JobTables({"job_queue": lambda: opened.append("job_queue") or "queue", "source_job": lambda: opened.append("source_job")})
    assert sets.job_queue == sets.job_queue == "queue" and opened == ["job_queue"]
    with pytest.raises(AttributeError):
        sets.unknown


def test_adhoc_runs_queries_only(spark, sample):
    found = adhoc.adhoc_sql(spark, sample, "with c as (select 1 as one) select job_id from source_job, c where job_id = :id order by 1;", {"id": 3})
    assert dicts(found) == [{"job_id": 3}]
    for text in ("drop view source_job", "create view v as select 1", "insert into source_job select * from source_job", "set a=b"):
        with pytest.raises(Exception):
            adhoc.adhoc_sql(spark, sample, text)
    assert dicts(adhoc.adhoc_sql(spark, sample, "select job_id from source_job where job_id < 0")) == []
    with pytest.raises(ValueError):
        adhoc.adhoc_sql(spark, sample, " ; ")


def cluster(master, folder=None):
    """A stand-in for a session on a given master."""
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=context)


def test_values_outside_their_lists_are_found(spark):
    sets = tables(
        spark,
        source_task_type=[{"source_task_type_id": 1000, "task_type_status": "active"}, {"source_task_type_id": 1001, "task_type_status": "Active"}],
        source_job=[{"job_id": 1, "job_status": None, "execution": "Auto"}],
    )
    found = {(r["table_name"], r["row_key"], r["column_name"], r["value"]) for r in dicts(quality.unlisted_values(sets))}
    assert found == {("source_task_type", 1000, "task_type_status", "active"), ("source_job", 1, "job_status", None)}


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert work_path(spark, "x") != work_path(spark, "x") and work_path(spark, "x").startswith(shared_folder(spark))
    assert shared_folder(cluster("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_folder(cluster("yarn"))


def test_date_filters_prune_days_or_reach_the_scan(spark, stored):
    plan = plan_of(dashboards.queue_log(read_tables(spark, stored), "2024-01-08", "2024-01-09"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date_created", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(date_created", plan)
    assert re.search(r"PartitionFilters: \[[^\]]*created_on#\d+ >= 2024-01-08[^\]]*created_on#\d+ <= 2024-01-09", plan)


def test_counts_read_only_their_columns(spark, stored):
    plan = plan_of(dashboards.run_status_matrix(read_tables(spark, stored), "2024-01-09", 10))
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any(set(re.findall(r"(\w+):", read)) == {"date_created", "job_id", "job_status"} for read in reads)


def test_a_page_is_a_top_k(spark, stored):
    plan = plan_of(search.task_search_page(read_tables(spark, stored), column="task_name", limit=10))
    assert "TakeOrderedAndProject" in plan


# Windows allowed by name: a row per file block of an upload, and the ranges of request ids of a job.
_BLOCKS = {"bulk_load_sheets", "bulk_read_numbers"}
_RANGES = {name for name in catalog.queries() if name.startswith("operator_actions")}


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n != "bulk_read" and not n.startswith("stream_")))
def test_no_query_pairs_all_rows_or_numbers_them_in_one_task(spark, name):
    plan = plan_of(entries.queries()[name](spark, SAMPLE))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    windows = [line for line in plan.split("\n") if re.match(r"[\s:+-]*\*?(\(\d+\) )?Window ", line)]
    assert not windows or name in _BLOCKS | _RANGES
    if name in _RANGES:
        assert all(re.search(r"\[job_id#\d+L?(, ids#\d+L?)?\], \[(ids|request_id)#", line) for line in windows if "request_id" in line or "ids" in line)
    assert "collect_list" not in plan and "collect_set" not in plan
