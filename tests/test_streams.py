"""Stream queries over several files, in any order and with repeats."""

import os

import pytest
from helpers import dicts
from pyspark.sql import functions as F
from runledger.model import JOB_QUEUE, STATUS_MESSAGE
from runledger.operators import dispatch, folding
from runledger.streaming import dispatching, messages, runs


def in_files(df, folder, parts, *extra):
    """Write rows as several files, the order of time broken up between them."""
    for frame in (df.repartition(parts, F.hash(df.columns[0])), *extra):
        frame.write.mode("append").parquet(folder)
    return folder


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(str, dicts(df)))


@pytest.fixture(scope="module")
def message_files(spark, sample, tmp_path_factory):
    some = sample.status_messages
    return in_files(some, str(tmp_path_factory.mktemp("messages") / "in"), 4, some.where("seq % 7 = 0").coalesce(1))


def test_stream_fold_equals_the_batch_fold(spark, sample, message_files, tmp_path):
    output = str(tmp_path / "out")
    messages.start_status_fold(stream(spark, message_files, STATUS_MESSAGE), output, available_now=True).awaitTermination()
    expected = rows(folding.status_fold(sample, sample.status_messages))
    assert rows(messages.queue_rows_so_far(spark, output, sample)) == expected
    batches = len([name for name in os.listdir(output) if name.startswith("batch_no=")])
    assert batches > 2
    compacted = str(tmp_path / "compacted")
    messages.compact_folds(spark, output, compacted)
    assert rows(messages.queue_rows_so_far(spark, compacted, sample)) == expected


def test_a_repeated_batch_changes_nothing(spark, sample, message_files, tmp_path):
    output = str(tmp_path / "out")
    query = messages.start_status_fold(stream(spark, message_files, STATUS_MESSAGE), output, available_now=True)
    query.awaitTermination()
    before = rows(messages.folded_so_far(spark, output))
    first = spark.read.parquet(os.path.join(output, "batch_no=0"))
    again = spark.createDataFrame(first.collect(), first.schema)
    again.write.mode("overwrite").parquet(os.path.join(output, "batch_no=0"))
    assert rows(messages.folded_so_far(spark, output)) == before


def test_audit_rows_come_once_across_restarts(spark, sample, message_files, tmp_path):
    output = str(tmp_path / "audit")
    for _ in range(2):
        source = stream(spark, message_files, STATUS_MESSAGE)
        messages.start_audit_log(source, output, available_now=True).awaitTermination()
    assert rows(messages.audit_log_so_far(spark, output)) == rows(folding.audit_rows(sample.status_messages))


def test_hourly_counts_equal_the_batch_counts(spark, sample, tmp_path):
    folder = newest_first(sample.status_messages, str(tmp_path / "in"), "event_time", 3)
    output = str(tmp_path / "counts")
    messages.start_hourly_counts(stream(spark, folder, STATUS_MESSAGE), output, available_now=True).awaitTermination()
    expected = (
        sample.status_messages.where("message_type = 'QUEUE_DETAIL'")
        .groupBy(F.date_trunc("hour", "event_time").cast("timestamp_ntz").alias("hour_start"), "job_status")
        .agg(F.count("*").alias("total_count"))
    )
    assert rows(messages.hourly_counts_so_far(spark, output)) == rows(expected)


def newest_first(df, folder, when, parts=4):
    """Files of a table, one a batch, the newest rows in the first."""
    ordered = df.orderBy(F.desc(when)).collect()
    size = -(-len(ordered) // parts)
    for part in range(parts):
        some = ordered[part * size : (part + 1) * size]
        df.sparkSession.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_late_audit_rows_are_written(spark, sample, tmp_path):
    folder = newest_first(sample.status_messages, str(tmp_path / "in"), "event_time")
    output = str(tmp_path / "audit")
    messages.start_audit_log(stream(spark, folder, STATUS_MESSAGE), output, available_now=True).awaitTermination()
    assert rows(messages.audit_log_so_far(spark, output)) == rows(folding.audit_rows(sample.status_messages))


def waiting_ids(sample):
    return sorted(row["job_queue_id"] for row in dicts(dispatch.waiting_rows(sample.job_queue)))


def test_dispatch_sends_each_row_once_and_keeps_to_its_limit(spark, sample, tmp_path):
    folder = newest_first(sample.job_queue, str(tmp_path / "in"), "date_created")
    sample.job_queue.where("job_queue_id % 5 = 0").coalesce(1).write.mode("append").parquet(folder)
    output = str(tmp_path / "dispatch")
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    assert sorted(row["job_queue_id"] for row in dicts(dispatching.unsent_rows(spark, output))) == waiting_ids(sample)
    steps = dispatching.send_all(spark, output, lambda: sample, limit=60)
    taken = dispatching.plans_so_far(spark, output)
    per_step = sorted(row["count"] for row in dicts(taken.groupBy("batch_no").count()))
    assert len(per_step) == steps and set(per_step[1:]) <= {60} and 0 < per_step[0] <= 60
    assert sorted(row["job_queue_id"] for row in dicts(taken)) == waiting_ids(sample)
    assert dispatching.unsent_rows(spark, output).count() == 0


def test_a_repeated_step_plans_the_same_rows(spark, sample, tmp_path):
    folder = newest_first(sample.job_queue, str(tmp_path / "in"), "date_created", 1)
    output = str(tmp_path / "dispatch")
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    for number in (1, 2):
        dispatching.dispatch_step(spark, output, lambda: sample, 10, by_priority=True, number=number)
    before = rows(dispatching.plans_so_far(spark, output))
    dispatching.dispatch_step(spark, output, lambda: sample, 10, by_priority=True, number=1)
    assert rows(dispatching.plans_so_far(spark, output)) == before and len(before) == 20


def test_a_timer_sends_without_new_input_and_opens_the_tables_anew(spark, sample, tmp_path):
    folder = newest_first(sample.job_queue, str(tmp_path / "in"), "date_created", 1)
    output = str(tmp_path / "dispatch")
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    opened = []

    def open_tables():
        opened.append(1)
        jobs = sample.source_job if len(opened) == 1 else sample.source_job.withColumn("job_status", F.lit("Inactive"))
        return sample.replacing(source_job=jobs)

    query = dispatching.start_steps(spark, output, open_tables, limit=20, interval="1 second")
    try:
        for _ in range(120):
            if len(opened) >= 4:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    outcomes = {row["outcome"]: row["count"] for row in dicts(dispatching.plans_so_far(spark, output).groupBy("outcome").count())}
    assert outcomes.get("job_inactive", 0) >= 20


def test_dispatch_without_a_limit_equals_the_batch_records(spark, sample, tmp_path):
    folder = newest_first(sample.job_queue, str(tmp_path / "in"), "date_created", 3)
    output = str(tmp_path / "dispatch")
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    dispatching.send_all(spark, output, lambda: sample)
    planned = dispatch.dispatch_plan(dispatch.waiting_rows(sample.job_queue), sample)
    assert rows(dispatching.records_so_far(spark, output)) == rows(dispatch.dispatch_records(planned))


def test_steps_open_only_what_is_above_the_mark(spark, sample, tmp_path):
    folder = newest_first(sample.job_queue, str(tmp_path / "in"), "date_created", 3)
    output = str(tmp_path / "dispatch")
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    waiting = len(waiting_ids(sample))
    limit = waiting * 2 // 5
    assert dispatching.dispatch_step(spark, output, lambda: sample, limit) == limit
    assert dispatching.current_era(spark, output).number == 0
    assert dispatching.dispatch_step(spark, output, lambda: sample, limit) == limit
    era = dispatching.current_era(spark, output)
    assert (era.number, era.last) == (1, {dispatching.ASKED: 2}) and era.mark >= 2
    left = dispatching.unsent_rows(spark, output)
    assert left.count() == waiting - 2 * limit
    assert all("/eras/era=1/" in file for file in left.inputFiles())
    # New rows make a segment above the mark; those behind it stay closed.
    more = sample.job_queue.where("job_status = 'Queue' and not job_send").withColumn("job_queue_id", F.col("job_queue_id") + 10**9)
    more.coalesce(1).write.mode("append").parquet(folder)
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    opened = dispatching.unsent_rows(spark, output)
    segments = {file.split("batch_no=")[1].split("/")[0] for file in opened.inputFiles() if "/waiting/" in file}
    assert segments and all(int(segment) > era.mark for segment in segments)
    dispatching.send_all(spark, output, lambda: sample, limit)
    ids = sorted(row["job_queue_id"] for row in dicts(dispatching.plans_so_far(spark, output)))
    assert ids == sorted([*waiting_ids(sample), *(number + 10**9 for number in waiting_ids(sample))])


def test_steps_and_eras_that_broke_off_are_taken_up(spark, sample, tmp_path):
    folder = newest_first(sample.job_queue, str(tmp_path / "in"), "date_created", 1)
    output = str(tmp_path / "dispatch")
    dispatching.start_intake(stream(spark, folder, JOB_QUEUE), output, available_now=True).awaitTermination()
    count, half = len(waiting_ids(sample)), -(-len(waiting_ids(sample)) // 2)
    # Rows carried without marks: the era before still counts.
    sample.job_queue.limit(0).write.parquet(os.path.join(output, "eras", "era=1", "rows"))
    assert dispatching.current_era(spark, output).number == 0
    assert dispatching.dispatch_step(spark, output, lambda: sample, half, steps=dispatching.TIMER, number=0) == half
    assert dispatching.current_era(spark, output).last == {dispatching.TIMER: 0}
    before = rows(dispatching.plans_so_far(spark, output))
    assert dispatching.dispatch_step(spark, output, lambda: sample, half, steps=dispatching.TIMER, number=0) == half
    assert rows(dispatching.plans_so_far(spark, output)) == before
    # A segment that is being written waits, and so do those after it.
    os.makedirs(os.path.join(output, "waiting", "batch_no=90"))
    assert dispatching.unsent_rows(spark, output).count() == count - half


def test_partial_results_are_merged_by_levels(spark, sample, tmp_path):
    output, some = str(tmp_path / "folds"), sample.status_messages.where("seq % 3 = 0")
    merge = lambda folds: folding.merge_partials(folds, "job_queue_id")
    for number in range(11):
        part = some.where(F.pmod(F.hash("seq"), F.lit(11)) == number)
        runs.write_partials(folding.newest_per_queue_row(part).coalesce(1), output, number, merge, fanout=3)
    # 11 batches in threes: nine, then two of their own.
    live = runs.live_folders(spark, output, 3)
    assert [path.split("folds")[1] for path in live] == ["-merged/level=2/batch_no=0", "/batch_no=9", "/batch_no=10"]
    expected = rows(folding.status_fold(sample, some))

    def folded():
        folds = merge(runs.read_partials(spark, output, messages.FOLD_SCHEMA, 3))
        return rows(folding.folded_queue_rows(sample.job_queue, folds))

    assert folded() == expected
    # A merge that broke off: its parts stand for it. A batch being written is for the next reader.
    os.remove(os.path.join(f"{output}-merged", "level=2", "batch_no=0", "_SUCCESS"))
    os.makedirs(os.path.join(output, "batch_no=11"))
    assert len(runs.live_folders(spark, output, 3)) == 5
    assert folded() == expected
    assert runs.live_folders(spark, str(tmp_path / "none")) == []
