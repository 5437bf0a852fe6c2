"""SQL for a separate engine that gives the result each named query should have.

Written apart from the operators: rankings stand where they reduce, scans and set
operations where they join, recursion where they divide.
"""

from __future__ import annotations

import re

from runledger.model import JOB_SHEET_COLUMNS
from runledger.plans.catalog import (
    DEEP_TREE,
    REQUEST_LOG,
    SCHEDULE_BASE,
    WHEEL_WINDOW,
    SENT_SCHEDULES,
    TYPE_LOG,
    DAY,
    DUE,
    HORIZON,
    HOUR,
    NOW,
    UPLOAD_CLOCK,
    WEEK,
    WINDOW,
    YEAR,
)
from runledger.sources.sample_views import VIEWS, check_text

_CHECKS: dict[str, str] = {}

ACTIVE_RUNS = "('Queue','Start','Running')"
JOB_COLUMNS = (
    "job_id, job_name, task_detail_id, job_status, job_running_status, last_job_run, execution, priority,"
    " date_created, complete_job, fail_job, skip_job"
)
QUEUE_COLUMNS = (
    "job_queue_id, date_created, end_time, job_id, job_send, job_status, job_status_message, run_manual,"
    " skip_manual, skip_time, start_time"
)
PRIMARY = "(select * from scheduler qualify row_number() over (partition by job_id order by scheduler_id) = 1)"


def _check(name: str, text: str) -> None:
    used = [view for view in VIEWS if re.search(rf"\b{view}\b", text)]
    views = ",\n".join(f"{view} as (\n{check_text(view)}\n)" for view in used)
    text = text.strip()
    if text.startswith("with recursive "):
        text, head = text[len("with recursive "):], "with recursive "
        _CHECKS[name] = f"{head}{views},\n{text}"
    elif text.startswith("with "):
        _CHECKS[name] = f"with {views},\n{text[len('with '):]}"
    else:
        _CHECKS[name] = f"with {views}\n{text}"


def _iso(column: str) -> str:
    micros = f"(extract(microseconds from {column}) % 1000000)"
    return (
        f"case when {column} is null then null"
        f" when {micros} % 1000 <> 0 then strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"
        f" when {micros} <> 0 then strftime({column}, '%Y-%m-%dT%H:%M:%S.%g')"
        f" when second({column}) <> 0 then strftime({column}, '%Y-%m-%dT%H:%M:%S')"
        f" else strftime({column}, '%Y-%m-%dT%H:%M') end"
    )


def _flag(column: str) -> str:
    return f"case when {column} then 'True' else 'False' end"


def _clock(column: str, date: str) -> str:
    return (
        f"(cast({date} as timestamp) + to_hours(cast(substr({column}, 1, 2) as int))"
        f" + to_minutes(cast(substr({column}, 4, 2) as int)))"
    )


NEXT_RUN = """case when recurrence is null or recurrence = '' then null
  when frequency = 'Mint' then recurrence_time + to_minutes(cast(recurrence as int))
  when frequency = 'Hr' then recurrence_time + to_hours(cast(recurrence as int))
  when frequency = 'Daily' then recurrence_time + to_days(cast(recurrence as int))
  when frequency = 'Weekly' then recurrence_time + to_days(7 * cast(recurrence as int))
  when frequency = 'Monthly' then recurrence_time + to_months(cast(recurrence as int)) end"""
ADVANCED = f"""(select s.*, n is not null and (end_date is null or n <= {_clock('start_time', 'end_date')}) as advances
 from (select *, {NEXT_RUN} as n from scheduler) s)"""
DUE_ROWS = f"""(select s.* from {ADVANCED} s join source_job j on j.job_id = s.job_id and j.job_status = 'Active'
 where s.recurrence_time between timestamp '{DUE[0]}' and timestamp '{DUE[1]}'
   and date '{DUE[1][:10]}' + cast(s.recurrence_time as time) > timestamp '{DUE[0]}'
   and date '{DUE[1][:10]}' + cast(s.recurrence_time as time) < timestamp '{DUE[1]}')"""
ADMITTED = f"""(select d.*, j.skip_job,
   not exists (select 1 from job_queue q where q.job_id = d.job_id and q.job_status in {ACTIVE_RUNS})
     and row_number() over (partition by d.job_id order by d.recurrence_time, d.scheduler_id) = 1 as queued
 from {DUE_ROWS} d join source_job j on j.job_id = d.job_id)"""
ADMITTED_TEXT = (
    "case when queued then concat('Job ', job_id, ' now in the queue.')"
    " else concat('Job ', job_id, ' skip, already in queue.') end"
)

# Scans, reports and sheets

_check("job_list", f"""
select j.*, s.scheduler_id, s.start_date, s.end_date, s.start_time, s.frequency, s.recurrence, s.recurrence_time,
  j.job_id in (select job_id from job_queue) as has_run
from source_job j left join {PRIMARY} s on s.job_id = j.job_id order by j.job_id
""")
_check("job_report", f"""
select j.job_name, concat(t.task_detail_id, ' [', t.task_name, ']') as task, j.execution,
  cast(j.priority as varchar) as priority, j.job_status as status,
  strftime(j.date_created, '%Y-%m-%d %H:%M:%S.0') as created_date,
  coalesce(cast(s.start_date as varchar), '') as start_date, coalesce(cast(s.end_date as varchar), '') as end_date,
  coalesce(s.start_time, '') as time, coalesce({_iso('j.last_job_run')}, '') as last_run,
  coalesce({_iso('s.recurrence_time')}, '') as next_flight, coalesce(j.job_running_status, '') as r_status,
  {_flag('j.complete_job')} as email_job_complete, {_flag('j.fail_job')} as email_job_fail,
  {_flag('j.skip_job')} as email_job_skip
from source_job j join source_task t on t.task_detail_id = j.task_detail_id left join {PRIMARY} s on s.job_id = j.job_id
""")
_check("task_report", """
select task_detail_id::varchar as task_detail_id, task_name, task_payload, task_status, ifnull(pipeline_id, '') as pipeline_id,
  ifnull(home_page_id, '') as home_page_id, service_name, queue_topic_partition
from source_task_type join source_task using (source_task_type_id)
""")

_PLANNED = """planned as (
  select q.*, j.job_id as active_job, j.priority, t.task_detail_id, t.task_name, t.task_status, t.home_page_id, t.pipeline_id,
    t.task_payload, y.queue_topic_partition as route,
    case when j.job_id is null then 'job_inactive' when t.source_task_type_id is null then 'no_type'
      when coalesce(y.task_type_status, '') <> 'Active' then 'type_inactive'
      when not regexp_matches(y.queue_topic_partition, '^topic=([a-zA-Z-]*)&partitions=\\[([0-9*])\\]$') then 'bad_route'
      else 'sent' end as outcome
  from job_queue q
  left join (select * from source_job where job_status = 'Active') j on j.job_id = q.job_id
  left join source_task t on t.task_detail_id = j.task_detail_id
  left join source_task_type y on y.source_task_type_id = t.source_task_type_id
  where q.job_status = 'Queue' and not q.job_send
), routed as (
  select *, case when outcome = 'sent' then split_part(split_part(route, '&', 1), '=', 2) end as topic,
    case when outcome = 'sent' then try_cast(route[-2:-2] as int) end as partition
  from planned
)"""


def _field(name: str, text: str, quoted: bool = True) -> str:
    mark = '"' if quoted else ""
    return f"""case when {text} is null then '' else concat('"{name}":{mark}', {text}, '{mark},') end"""


_QUEUE_JSON = " || ".join([
    _field("jobQueueId", "cast(job_queue_id as varchar)", False),
    _field("startTime", f"({_iso('start_time')})"),
    _field("endTime", f"({_iso('end_time')})"),
    _field("skipTime", f"({_iso('skip_time')})"),
    _field("jobStatus", "job_status"),
    _field("jobId", "cast(job_id as varchar)", False),
    _field("jobStatusMessage", "job_status_message"),
    _field("runManual", "cast(run_manual as varchar)", False),
    _field("skipManual", "cast(skip_manual as varchar)", False),
    _field("jobSend", "cast(job_send as varchar)", False),
    _field("dateCreated", f"({_iso('date_created')})"),
])
_TASK_JSON = " || ".join([
    _field("taskDetailId", "cast(task_detail_id as varchar)", False),
    _field("taskName", "task_name"),
    _field("taskStatus", "task_status"),
    _field("homePageId", "home_page_id"),
    _field("pipelineId", "pipeline_id"),
    _field("taskPayload", "task_payload"),
])
_VALUE = (
    f"""concat('{{"jobQueue":{{', rtrim({_QUEUE_JSON}, ','), '}},"taskDetail":{{', rtrim({_TASK_JSON}, ','),"""
    """ '},"priority":"', priority, '"}')"""
)
_RECORDS = f"""with {_PLANNED}
select job_queue_id, topic, partition, sha256(cast(job_queue_id as varchar)) as key, {_VALUE} as value
from routed where outcome = 'sent'"""

_check("dispatch_records", _RECORDS)
_check("bulk_read", "select " + ", ".join(f"coalesce({cell}, '') as {cell}" for cell in JOB_SHEET_COLUMNS) + " from bulk_jobs")
_check("bulk_read_numbers", """
select cast(row_no % 3 as int) as third, count(*) as rows, 2 as first_no, count(*) + 1 as last_no, count(*) as numbers
from bulk_jobs group by 1
""")

# Filters and searches

_check("date_range_filter", """
select task_detail_id, date_created from source_task
where cast(date_created as date) between date '2023-02-01' and date '2023-06-30'
""")
_check("task_search", """
with named as (select * from source_task where contains(lower(task_name), 'widget') and date_created < timestamp '2024-04-01')
select task_detail_id, task_name, task_status, source_task_type_id, service_name
from source_task_type join named using (source_task_type_id)
""")
# A job has one task, so the jobs of tasks of any known status are a set of jobs.
_LINKED = """
select job_id, job_name, job_status, execution, job_running_status, priority,
  left(last_job_run::varchar, 19) as last_job_run, left(date_created::varchar, 19) as date_created
from source_job
where task_detail_id in (select task_detail_id from source_task where task_status in ('Delete', 'Inactive', 'Active'))"""
_check("linked_job_search", f"{_LINKED} and contains(source_job.date_created::varchar, '2023-1')")
_check("queue_log", f"""
select * from job_queue where cast(date_created as date) between date '{WEEK[0]}' and date '{WEEK[1]}'
  and job_status in ('Queue','Failed','Skip') order by job_queue_id desc
""")
_check("run_detail", f"""
select job_queue.* from job_queue inner join source_job on source_job.job_id = job_queue.job_id
where extract(hour from job_queue.date_created) = {HOUR} and job_queue.job_status = 'Completed'
order by job_queue.job_queue_id desc
""")
_check("active_job_lookup", """
select j.job_id, j.job_name, j.task_detail_id, t.task_name, t.source_task_type_id, y.service_name
from source_job j
left join source_task t on t.task_detail_id = j.task_detail_id and t.task_status = 'Active'
left join source_task_type y on y.source_task_type_id = t.source_task_type_id and y.task_type_status = 'Active'
where j.job_status = 'Active' and exists (select 1 from job_queue q where q.job_id = j.job_id)
""")
_check("active_tasks", "select task_detail_id, task_name from source_task where task_status = 'Active'")
_check("root_lookups", """
select lookup_id, lookup_value, lookup_type, description, date_created from lookup_data where parent_lookup_id is null
""")
_check("effective_run_time", """
select job_queue_id, case when job_status = 'Skip' then skip_time else start_time end as run_time from job_queue
""")
_check("parse_timestamp_text", """
select job_queue_id, date_trunc('second', date_created) as created_at from job_queue
""")

# Joins

_check("due_candidates", f"""
select s.scheduler_id, s.job_id, s.recurrence_time from scheduler s inner join source_job j on s.job_id = j.job_id
where s.recurrence_time between timestamp '{WINDOW[0]}' and timestamp '{WINDOW[1]}' and j.job_status = 'Active'
""")
_check("job_status_snapshot", """
with ran as (
  select job_id, job_status, job_running_status, last_job_run, execution from source_job
  semi join job_queue using (job_id) where job_status = 'Active')
select ran.*, recurrence_time from scheduler join ran using (job_id)
union all
select *, null from ran anti join scheduler using (job_id)
""")
_SEARCH_PAGE = """
with links as (select task_detail_id, count(*) as jobs from source_job group by all),
names as (select map_from_entries(list((lookup_id::varchar, lookup_type))) as of_id from lookup_data),
found as (
  select task_detail_id, task_name, task_payload, task_status, date_created, source_task_type_id, description, is_schema_register,
    queue_topic_partition, schema_payload, service_name, task_type_status, ifnull(jobs, 0) as total_link_jobs,
    of_id[home_page_id] as home_page_id, of_id[pipeline_id] as pipeline_id
  from source_task_type join source_task using (source_task_type_id) left join links using (task_detail_id) cross join names)
select * exclude date_created from found
"""
_check("task_search_page", f"""{_SEARCH_PAGE}
where contains(lower(service_name), 'a') and date_created >= timestamp '2023-01-15'
order by task_name desc nulls first, task_detail_id limit 25 offset 50
""")
_check("task_search_page_by_links", f"""{_SEARCH_PAGE}
order by total_link_jobs desc, task_detail_id limit 20 offset 20
""")
_check("task_linked_jobs", f"""{_LINKED} and contains(job_status, 'Active')
  and source_job.date_created >= timestamp '2023-07-01' and source_job.date_created < timestamp '2024-02-01'""")
_check("type_tasks", """
select source_task_type_id, task_detail_id, task_name, task_status from source_task where source_task_type_id is not null
""")
_DETAIL = """
select j.job_id, j.job_status, j.job_running_status, j.last_job_run, j.job_name, j.date_created, j.priority, j.execution,
  j.complete_job, j.fail_job, j.skip_job, t.task_detail_id, t.task_name, t.task_status, t.task_payload,
  h.{0} as home_page, p.{0} as pipeline, y.source_task_type_id, y.service_name, y.queue_topic_partition,
  y.description as type_description, y.schema_payload, y.is_schema_register,
  s.scheduler_id, s.start_date, s.end_date, s.start_time, s.frequency, s.recurrence, s.recurrence_time
from source_job j left join source_task t on t.task_detail_id = j.task_detail_id
left join source_task_type y on y.source_task_type_id = t.source_task_type_id
left join lookup_data h on h.lookup_id = cast(t.home_page_id as bigint)
left join lookup_data p on p.lookup_id = cast(t.pipeline_id as bigint)
left join {1} s on s.job_id = j.job_id
"""
_check("job_detail", _DETAIL.format("lookup_type", PRIMARY))
_check("job_detail_by_value", _DETAIL.format("lookup_value", PRIMARY))
_check("task_detail", """
select t.task_detail_id, t.source_task_type_id, t.task_name, t.task_status, t.home_page_id, t.pipeline_id, t.task_payload,
  y.service_name, y.queue_topic_partition, y.description as type_description, y.schema_payload, y.is_schema_register,
  y.task_type_status, p.task_payload_id, p.tag_key, p.tag_parent, p.tag_value
from source_task t left join source_task_type y on y.source_task_type_id = t.source_task_type_id
left join source_task_payload p on p.payload_id = t.task_detail_id
order by t.task_detail_id, p.task_payload_id
""")
_check("audit_trail", """
select l.job_audit_log_id, l.job_queue_id, l.log_detail, l.date_created, q.job_id, j.job_name, j.job_status,
  j.job_running_status, j.execution, q.date_created as queued_at, q.job_status as queue_status, q.job_status_message,
  q.start_time, q.skip_time, q.end_time
from job_audit_logs l left join job_queue q on q.job_queue_id = l.job_queue_id left join source_job j on j.job_id = q.job_id
order by l.job_audit_log_id
""")
_check("lookup_tree", """
select p.lookup_id, p.lookup_value, p.lookup_type, p.description, p.date_created, c.lookup_id as child_lookup_id,
  c.lookup_value as child_lookup_value, c.lookup_type as child_lookup_type, c.description as child_description,
  c.date_created as child_date_created
from lookup_data p left join lookup_data c on c.parent_lookup_id = p.lookup_id
where p.parent_lookup_id is null order by p.lookup_id, c.lookup_id
""")
def _closure(rows: str) -> str:
    return f"""
with recursive lookups as ({rows}), pointed as (
  select lookup_id, case when parent_lookup_id in (select lookup_id from lookups) then parent_lookup_id end as up from lookups),
walked as (
  select lookup_id, lookup_id as root_id, cast(0 as bigint) as depth, cast(lookup_id as varchar) as path from pointed where up is null
  union all
  select c.lookup_id, w.root_id, w.depth + 1, concat(w.path, '/', c.lookup_id) from walked w join pointed c on c.up = w.lookup_id)
select p.lookup_id, w.root_id, w.depth, w.path, w.lookup_id is null as in_cycle
from pointed p left join walked w on w.lookup_id = p.lookup_id"""


_check("lookup_closure", _closure("select lookup_id, parent_lookup_id from lookup_data"))
_check("lookup_closure_deep", _closure(f"select {', '.join(DEEP_TREE)} from status_messages"))
_check("missing_task_rows", """
select row_no, task_id from bulk_jobs b where task_id is not null and not exists
  (select 1 from source_task t where cast(t.task_detail_id as varchar) = b.task_id and t.task_status = 'Active')
""")

# Counts

_MATRIX = """count(case when job_status = 'Queue' then 1 end) as queue, count(case when job_status = 'Start' then 1 end) as start,
  count(case when job_status = 'Running' then 1 end) as running, count(case when job_status = 'Failed' then 1 end) as failed,
  count(case when job_status = 'Completed' then 1 end) as completed, count(case when job_status = 'Stop' then 1 end) as stop,
  count(case when job_status = 'Skip' then 1 end) as skip, count(case when job_status = 'Interrupt' then 1 end) as interrupt,
  count(*) as total"""
_check("job_status_counts", "select job_status, count(job_id) as total_count from source_job group by job_status")
_check("job_running_counts", """
select job_running_status, count(job_id) as total_count from source_job
where job_running_status in ('Start', 'Running', 'Failed', 'Completed') group by job_running_status
""")
_check("runs_by_weekday", """
select strftime(date_created, '%a') as daycode, count(*) as total_count from job_queue
where cast(date_created as date) between date '2024-01-01' and date '2024-01-28' group by 1
""")
_check("runs_by_weekday_hour", f"""
select dayname(date_created) as daycode, extract(hour from date_created) as hr, cast(date_created as date) as date,
  count(*) as total_count
from job_queue where cast(date_created as date) between date '{WEEK[0]}' and date '{WEEK[1]}' group by 1, 2, 3
""")
_check("run_status_matrix", f"""
with hit as (
  select q.job_id, j.job_name, q.job_status from job_queue q inner join source_job j on j.job_id = q.job_id
  where cast(q.date_created as date) = date '{DAY}' and extract(hour from q.date_created) = {HOUR})
select job_id, job_name, {_MATRIX} from hit group by job_id, job_name
union all select null, null, {_MATRIX} from hit
order by job_id nulls last
""")
_check("job_run_statistics", f"""
select job_id, {_MATRIX} from job_queue where job_id in (select job_id from source_job) group by job_id
""")
_check("queue_status_counts", "select job_status, count(*) as total_count from job_queue group by job_status")
_check("tasks_per_type", """
select y.source_task_type_id, y.description, y.task_type_status, y.queue_topic_partition, y.service_name,
  count(t.source_task_type_id) as total_task_link, y.is_schema_register, y.schema_payload
from source_task_type y left join source_task t on t.source_task_type_id = y.source_task_type_id
group by all order by y.source_task_type_id
""")
_check("in_flight_per_job", f"""
select job_id, count(*) as in_flight from job_queue where job_status in {ACTIVE_RUNS} group by job_id
""")
_check("runs_per_job", "select job_id, count(*) as runs from job_queue group by job_id")
_TOTAL = """
from source_task where source_task_type_id in (
  select source_task_type_id from source_task_type where contains(lower(service_name), 'a'))"""
_check("task_search_total", f"""
select count(*) as total_record {_TOTAL} and date_created >= timestamp '2023-01-15'
""")

# Order, pages and batches

_check("sort_page", """
select job_id, job_name, job_running_status, priority from source_job
order by job_running_status desc nulls first, job_id limit 50 offset 50
""")
_check("sort_page_deep", """
select * from job_audit_logs qualify row_number() over (order by date_created desc nulls first, job_audit_log_id) between 1426 and 1500
""")
_check("page_info", f"""
select cast(25 as bigint) as page_size, cast(3 as bigint) as current_page, count(*) as total_record {_TOTAL}
""")
_check("dispatch_batch", """
select * from job_queue where job_status = 'Queue' and not job_send order by job_queue_id
limit (select cast(lookup_value as bigint) from lookup_data where lookup_type = 'QUEUE_FETCH_LIMIT')
""")
_check("dispatch_batch_by_priority", """
select q.* from job_queue q left join source_job j on j.job_id = q.job_id where q.job_status = 'Queue' and not q.job_send
order by j.priority nulls last, q.job_queue_id limit 5000
""")

# Schedules

_check("first_run", f"select scheduler_id, {_clock('start_time', 'start_date')} as first_run from scheduler")
_check("route_parse", """
select t.task_detail_id, case when ok then regexp_extract(route, 'topic=([^&]*)', 1) end as topic,
  case when ok then try_cast(regexp_extract(route, '\\[(.)\\]', 1) as int) end as partition, ok as route_valid
from source_task t join (select source_task_type_id, queue_topic_partition as route,
  regexp_full_match(queue_topic_partition, 'topic=[a-zA-Z-]*&partitions=\\[[0-9*]\\]') as ok from source_task_type) y
  on y.source_task_type_id = t.source_task_type_id
""")
_check("next_run", f"select scheduler_id, {NEXT_RUN} as next_run from scheduler")
_check("schedule_advance", f"""
select scheduler_id, case when advances then n else recurrence_time end as recurrence_time, not advances as exhausted
from {ADVANCED} a
""")
_check("gram_search", "select task_detail_id, task_name, task_status from source_task where contains(lower(task_name), 'widget')")
_check("wheel_due", f"""
with moved as (
  select scheduler_id, job_id, case when advances and recurrence_time between timestamp '{WINDOW[0]}' and timestamp '{WINDOW[1]}'
    then n else recurrence_time end as recurrence_time from {ADVANCED} a)
select * from moved where recurrence_time between timestamp '{WHEEL_WINDOW[0]}' and timestamp '{WHEEL_WINDOW[1]}'
""")
_check("schedule_due", f"select scheduler_id, job_id, recurrence_time from {DUE_ROWS} d")
_check("run_calendar", f"""
with recursive bounded as (
  select scheduler_id, job_id, frequency, recurrence_time, try_cast(recurrence as int) as steps,
    {_clock('start_time', 'end_date')} as last_allowed,
    case frequency when 'Mint' then 60 when 'Hr' then 3600 when 'Daily' then 86400 when 'Weekly' then 604800 end
      * cast(recurrence as bigint) as step_seconds
    , case when frequency in ('Weekly', 'Monthly') then timestamp '{YEAR[1]}' else timestamp '{HORIZON[1]}' end as upto
  from scheduler),
fixed as (
  select scheduler_id, job_id, recurrence_time, last_allowed, step_seconds,
    unnest(range(greatest(1, cast(floor(epoch(timestamp '{HORIZON[0]}' - recurrence_time) / step_seconds) as bigint) - 1),
      cast(ceil(epoch(upto - recurrence_time) / step_seconds) as bigint) + 2)) as run_no, upto
  from bounded where step_seconds is not null),
monthly as (
  select scheduler_id, job_id, cast(0 as bigint) as run_no, recurrence_time as run_time, steps, last_allowed
  from bounded where frequency = 'Monthly' and steps is not null
  union all
  select scheduler_id, job_id, run_no + 1, run_time + to_months(steps), steps, last_allowed from monthly
  where run_time + to_months(steps) < timestamp '{YEAR[1]}'
    and (last_allowed is null or run_time + to_months(steps) <= last_allowed)),
runs as (
  select scheduler_id, job_id, cast(0 as bigint) as run_no, recurrence_time as run_time, upto from bounded
  union all
  select scheduler_id, job_id, run_no, recurrence_time + to_seconds(run_no * step_seconds), upto from fixed
  where last_allowed is null or recurrence_time + to_seconds(run_no * step_seconds) <= last_allowed
  union all
  select scheduler_id, job_id, run_no, run_time, timestamp '{YEAR[1]}' from monthly where run_no > 0)
select scheduler_id, job_id, run_no, run_time from runs
where run_time >= timestamp '{HORIZON[0]}' and run_time < upto
""")

# Table changes

_check("queue_admission", f"""
select scheduler_id, job_id, recurrence_time as due_time, case when queued then 'Queue' else 'Skip' end as job_status,
  {ADMITTED_TEXT} as message, timestamp '{DUE[1]}' as decided_at,
  case when advances then n else recurrence_time end as next_recurrence_time, not advances as exhausted,
  not queued and skip_job as mail_skip
from {ADMITTED} a
""")
_check("queue_admission_rows", f"""
select (select max(job_queue_id) from job_queue) + scheduler_id as job_queue_id, timestamp '{DUE[1]}' as date_created,
  cast(null as timestamp) as end_time, job_id, false as job_send,
  case when queued then 'Queue' else 'Skip' end as job_status, {ADMITTED_TEXT} as job_status_message,
  cast(null as boolean) as run_manual, cast(null as boolean) as skip_manual,
  case when not queued then timestamp '{DUE[1]}' end as skip_time, case when queued then timestamp '{DUE[1]}' end as start_time
from {ADMITTED} a
""")
_check("queue_admission_jobs", f"""
select job_id, 'Queue' as job_running_status, timestamp '{DUE[1]}' as last_job_run from {ADMITTED} a where queued
""")
_check("queue_admission_schedules", f"""
select scheduler_id, n as recurrence_time from {DUE_ROWS} d where advances
""")
_check("queue_admission_audit", f"""
select (select max(job_audit_log_id) from job_audit_logs) + scheduler_id as job_audit_log_id,
  (select max(job_queue_id) from job_queue) + scheduler_id as job_queue_id, {ADMITTED_TEXT} as log_detail,
  timestamp '{DUE[1]}' as date_created
from {ADMITTED} a
""")
_check("queue_admission_mails", f"""
select job_id, scheduler_id, timestamp '{DUE[1]}' as time_slot from {ADMITTED} a where skip_job and not queued
""")
_check("queue_admission_last_run", f"""
select * replace ('{DUE[1].replace(" ", "T")}' as lookup_value) from lookup_data where lookup_type = 'SCHEDULER_LAST_RUN_TIME'
""")
_FAILURE = """case outcome when 'job_inactive' then concat('Job ', job_id, ' fail in the queue due to main job either (delete|inactive).')
    when 'type_inactive' then concat('Broker not active job ', job_id, ' fail.')
    when 'bad_route' then concat('Broker configuration wrong job ', job_id, ' fail ', route) end"""
_check("dispatch_plan", f"""with {_PLANNED}
select job_queue_id, job_id, outcome, {_FAILURE} as failure_text,
  case when regexp_matches(route, '^topic=[a-zA-Z-]*&partitions=') then split_part(split_part(route, '&', 1), '=', 2) end as topic,
  case when regexp_matches(route, '^topic=[a-zA-Z-]*&partitions=') then try_cast(route[-2:-2] as int) end as partition
from routed""")
_check("dispatch_outcome", f"""with {_PLANNED}, done as (
  select *, outcome = 'sent' and job_queue_id % 5 <> 0 as ok, {_VALUE} as value from routed where outcome <> 'no_type')
select job_queue_id, job_id, outcome, ok as job_send, case when ok then 'Start' else 'Failed' end as job_status,
  case when ok then concat('Sent message=[', value, '] with offset=[', job_queue_id * 2, ']')
    else concat('Job ', job_id, ' now complete.') end as job_status_message,
  case when not ok then timestamp '{NOW}' end as end_time,
  case when ok then concat('Job ', job_id, ' sent message=[', value, '] with offset=[', job_queue_id * 2, ']')
    when outcome = 'sent' then concat('Job ', job_id, ' unable to send message=[', value, '] due to: broker timeout')
    else {_FAILURE} end as audit_text
from done""")
_SETTLED = f"""{_PLANNED}, answered as (
  select *, outcome = 'sent' and job_queue_id % 5 <> 0 as ok, {_VALUE} as value from routed where outcome <> 'no_type'),
settled as (
  select *, case when ok then 'Start' else 'Failed' end as new_status,
    case when ok then concat('Job ', job_id, ' sent message=[', value, '] with offset=[', job_queue_id * 2, ']')
      when outcome = 'sent' then concat('Job ', job_id, ' unable to send message=[', value, '] due to: broker timeout')
      else {_FAILURE} end as audit_text
  from answered),
moved as (
  select j.* replace (s.new_status as job_running_status) from source_job j
  join (select * from settled qualify row_number() over (partition by job_id order by job_queue_id desc) = 1) s on s.job_id = j.job_id)"""
_check("dispatch_queue_rows", f"""with {_SETTLED}
select job_queue_id, date_created, case when ok then end_time else timestamp '{NOW}' end as end_time, job_id, ok as job_send,
  new_status as job_status, case when ok then concat('Sent message=[', value, '] with offset=[', job_queue_id * 2, ']')
    else concat('Job ', job_id, ' now complete.') end as job_status_message, run_manual, skip_manual, skip_time, start_time
from settled""")
_check("dispatch_jobs", f"with {_SETTLED} select {JOB_COLUMNS} from moved")
_check("dispatch_audit", f"""with {_SETTLED}
select (select max(job_audit_log_id) from job_audit_logs) + job_queue_id as job_audit_log_id, job_queue_id,
  audit_text as log_detail, timestamp '{NOW}' as date_created
from settled""")
_check("dispatch_mails", f"""with {_SETTLED}
select s.job_id, s.job_queue_id as event_id, s.start_time as time_slot, 'Failed' as status,
  (select lookup_value from lookup_data where lookup_type = 'EMAIL_RECEIVER') as recipient, 'Source Job Failed' as subject
from settled s where not s.ok and s.job_id in (select job_id from source_job where fail_job)""")

_ACTIONS = f"""job_side as (
  select r.request_id, r.action, r.job_id, j.skip_job, s.recurrence_time, s.n,
    case when j.job_id is null then 'job_not_active' when coalesce(j.job_running_status, '') in ('Queue', 'Running') then 'job_busy'
      when r.action = 'skip' and j.execution <> 'Auto' then 'not_auto'
      when r.action = 'skip' and not coalesce(s.advances, false) then 'no_next_run' else 'done' end as result
  from operator_requests r
  left join (select * from source_job where job_status = 'Active') j on j.job_id = r.job_id
  left join (select * from {ADVANCED} a qualify row_number() over (partition by job_id order by scheduler_id) = 1) s
    on s.job_id = r.job_id
  where r.action in ('run', 'skip')),
row_side as (
  select r.request_id, r.action, q.job_id, r.job_queue_id, j.fail_job,
    case when q.job_queue_id is null then 'queue_row_not_found' when r.action = 'fail' and q.job_status <> 'Queue' then 'not_in_queue'
      else 'done' end as result
  from operator_requests r left join job_queue q on q.job_queue_id = r.job_queue_id
  left join source_job j on j.job_id = q.job_id where r.action in ('fail', 'interrupt')),
judged as (
  select request_id, action, job_id, cast(null as bigint) as job_queue_id, result,
    case when result = 'done' then case action when 'run' then 'Queue' else 'Skip' end end as new_status,
    case when result = 'done' then case action when 'run' then timestamp '{NOW}' else recurrence_time end end as run_time,
    case when result = 'done' and action = 'skip' then n end as next_recurrence_time,
    case when result = 'done' then concat('Job ', job_id, case action when 'run' then ' now in the queue.' else ' skip, by user action.' end) end as message,
    result = 'done' and action = 'skip' and skip_job as mail
  from job_side
  union all
  select request_id, action, job_id, job_queue_id, result,
    case when result = 'done' then case action when 'fail' then 'Failed' else 'Interrupt' end end,
    case when result = 'done' then timestamp '{NOW}' end, cast(null as timestamp),
    case when result = 'done' then concat('Job ', job_id, case action when 'fail' then ' fail by manual.' else ' interrupted.' end) end,
    result = 'done' and action = 'fail' and fail_job
  from row_side)"""
_check("operator_actions", f"with {_ACTIONS} select * replace (coalesce(mail, false) as mail) from judged")
_check("operator_actions_queue", f"""with {_ACTIONS}
select job_queue_id, job_id, new_status as job_status, run_time as end_time, concat('Job ', job_id, ' now complete.') as job_status_message
from judged where result = 'done' and action in ('fail', 'interrupt')""")
_check("operator_actions_new_rows", f"""with {_ACTIONS}
select (select max(job_queue_id) from job_queue) + request_id as job_queue_id, timestamp '{NOW}' as date_created,
  cast(null as timestamp) as end_time, job_id, false as job_send, new_status as job_status, message as job_status_message,
  case when action = 'run' then true end as run_manual, case when action = 'skip' then true end as skip_manual,
  case when action = 'skip' then run_time end as skip_time, case when action = 'run' then run_time end as start_time
from judged where result = 'done' and action in ('run', 'skip')""")

# The same log as in the catalog. What a request meets is told by the last run or accepted fail before
# it; each skip that meets a free job goes one step further along the schedule's chain of runs.
_LOG = f"""recursive log as (select {', '.join(REQUEST_LOG)} from status_messages),
rows_asked as (
  select l.request_id, l.action, q.job_id, l.job_queue_id, q.job_status, row_number() over (partition by l.job_queue_id order by l.request_id) as nth
  from log l left join job_queue q on q.job_queue_id = l.job_queue_id where l.action in ('fail', 'interrupt')),
rows_judged as (
  select *, case when job_status is null then 'queue_row_not_found' when action = 'fail' and (job_status <> 'Queue' or nth > 1) then 'not_in_queue' else 'done' end as result
  from rows_asked),
moves as (
  select job_id, request_id, action as kind from log where action in ('run', 'skip')
  union all select job_id, request_id, 'free' from rows_judged where result = 'done'),
met as (
  select m.*, j.execution, j.skip_job, j.job_id is not null as active,
    coalesce(last_value(case when kind <> 'skip' then kind end ignore nulls) over (partition by m.job_id order by request_id rows between unbounded preceding and 1 preceding),
      case when j.job_running_status in ('Queue', 'Running') then 'run' else 'free' end) as state
  from moves m left join (select * from source_job where job_status = 'Active') j on j.job_id = m.job_id),
counted as (
  select *, count(*) filter (kind = 'skip' and state = 'free') over (partition by job_id order by request_id rows unbounded preceding) as nth
  from met),
steps as (select job_id, max(nth) as most from counted where kind = 'skip' and active and execution = 'Auto' group by job_id),
chain as (
  select s.job_id, 0::bigint as k, s.recurrence_time, s.frequency, s.recurrence, t.most, case when s.end_date is not null then {_clock('s.start_time', 's.end_date')} end as until
  from (select * from scheduler qualify row_number() over (partition by job_id order by scheduler_id) = 1) s join steps t on t.job_id = s.job_id
  union all
  select job_id, k + 1, {NEXT_RUN}, frequency, recurrence, most, until from chain where k < most and recurrence_time is not null),
judged as (
  select c.request_id, c.kind as action, c.job_id, cast(null as bigint) as job_queue_id, c.skip_job, a.recurrence_time as this_run, b.recurrence_time as next_run,
    case when not c.active then 'job_not_active' when c.state = 'run' then 'job_busy' when c.kind = 'run' then 'done' when c.execution <> 'Auto' then 'not_auto'
      when b.recurrence_time is null or b.recurrence_time > b.until then 'no_next_run' else 'done' end as result
  from counted c left join chain a on a.job_id = c.job_id and a.k = c.nth - 1 and c.kind = 'skip' left join chain b on b.job_id = c.job_id and b.k = c.nth and c.kind = 'skip'
  where c.kind <> 'free'),
told as (
  select request_id, action, job_id, job_queue_id, result,
    case when result = 'done' then case action when 'run' then 'Queue' else 'Skip' end end as new_status,
    case when result = 'done' then case action when 'run' then timestamp '{NOW}' else this_run end end as run_time,
    case when result = 'done' and action = 'skip' then next_run end as next_recurrence_time,
    case when result = 'done' then concat('Job ', job_id, case action when 'run' then ' now in the queue.' else ' skip, by user action.' end) end as message,
    coalesce(result = 'done' and action = 'skip' and skip_job, false) as mail
  from judged
  union all
  select r.request_id, action, r.job_id, job_queue_id, result,
    case when result = 'done' then case action when 'fail' then 'Failed' else 'Interrupt' end end,
    case when result = 'done' then timestamp '{NOW}' end, cast(null as timestamp),
    case when result = 'done' then concat('Job ', r.job_id, case action when 'fail' then ' fail by manual.' else ' interrupted.' end) end,
    coalesce(result = 'done' and action = 'fail' and j.fail_job, false)
  from rows_judged r left join source_job j on j.job_id = r.job_id)"""
_check("operator_actions_sequence", f"with {_LOG} select * from told")
_check("operator_actions_schedules", f"""with {_LOG}
select (select min(s.scheduler_id) from scheduler s where s.job_id = t.job_id) as scheduler_id, arg_max(next_recurrence_time, request_id) as recurrence_time
from told t where result = 'done' and action = 'skip' group by job_id""")
_check("operator_actions_jobs", f"""with {_LOG}
select job_id, arg_max(new_status, request_id) as job_running_status, max(case when action = 'run' then run_time end) as last_job_run
from told where result = 'done' and action <> 'skip' group by job_id""")
_check("operator_actions_audit", f"""with {_LOG}
select (select max(job_audit_log_id) from job_audit_logs) + request_id as job_audit_log_id,
  coalesce(job_queue_id, (select max(job_queue_id) from job_queue) + request_id) as job_queue_id, message as log_detail, timestamp '{NOW}' as date_created
from told where result = 'done'""")

_FOLDED = """last_state as (
  select job_queue_id, job_status from status_messages where message_type = 'QUEUE_DETAIL'
  qualify row_number() over (partition by job_queue_id order by seq desc) = 1),
last_end as (
  select job_queue_id, end_time from status_messages where message_type = 'QUEUE_DETAIL' and end_time is not null
  qualify row_number() over (partition by job_queue_id order by seq desc) = 1)"""
_FOLD = f"""with {_FOLDED}
select q.job_queue_id, q.date_created, coalesce(e.end_time, q.end_time) as end_time, q.job_id, q.job_send, s.job_status,
  case when e.end_time is not null then concat('Job ', q.job_id, ' now complete.') else q.job_status_message end as job_status_message,
  q.run_manual, q.skip_manual, q.skip_time, q.start_time
from job_queue q join last_state s on s.job_queue_id = q.job_queue_id left join last_end e on e.job_queue_id = q.job_queue_id"""
_AUDIT = """
select seq, job_queue_id, logs_detail as log_detail, event_time as date_created from status_messages
where message_type in ('AUDIT_LOG', 'QUEUE_DETAIL')"""
_check("status_fold", _FOLD)
_check("status_fold_jobs", """
select j.* replace (m.job_status as job_running_status) from source_job j join (
  select job_id, job_status from status_messages where message_type = 'QUEUE_DETAIL'
  qualify row_number() over (partition by job_id order by seq desc) = 1) m on m.job_id = j.job_id
""")
_check("status_fold_audit", _AUDIT)
_check("status_cascade", """
select j.job_id, j.task_detail_id, y.task_type_status as job_status from source_job j
join source_task t on t.task_detail_id = j.task_detail_id join source_task_type y on y.source_task_type_id = t.source_task_type_id
""")
_check("status_cascade_from_tasks", """
select j.job_id, j.task_detail_id, t.task_status as job_status from source_job j join source_task t on t.task_detail_id = j.task_detail_id
""")

# In the sample sheet the optional cells are null or filled, dates are well shaped and
# only month 13 and hour 25 are impossible.
_RULES = f"""ruled as (
  select b.*, clock, first_day, last_day, known, number,
    known and number is not null as closer, first_day >= date '{UPLOAD_CLOCK[:10]}' as ahead,
    date_diff('day', first_day, last_day) as span
  from (select *, timestamp '{UPLOAD_CLOCK}' as clock, try_cast(start_date as date) as first_day, try_cast(end_date as date) as last_day,
      frequency in ('Mint','Hr','Daily','Weekly','Monthly') as known, try_cast(recurrence as int) as number from bulk_jobs) b),
coded as (
  select row_no, job_name, task_id, list_filter([
    case when job_name is null then 'job_name_empty' end,
    case when task_id is null then 'task_id_empty' end,
    case when not regexp_full_match(start_date, '[0-9]{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])') then 'start_date_invalid' end,
    case when not regexp_full_match(start_time, '(0[0-9]|1[0-9]|2[0-3]):[0-5][0-9]') then 'start_time_invalid' end,
    case when not known then 'frequency_invalid' end,
    case when priority not in ('1','2','3','4','5','6','7','8','9','99','100') then 'priority_invalid' end,
    case when lower(email_job_complete) not in ('true', 'false') then 'complete_flag_invalid' end,
    case when lower(email_job_fail) not in ('true', 'false') then 'fail_flag_invalid' end,
    case when lower(email_job_skip) not in ('true', 'false') then 'skip_flag_invalid' end,
    case when closer and not list_contains(case frequency when 'Mint' then range(5, 60, 5) when 'Hr' then range(1, 13)
      when 'Daily' then range(1, 7) else range(1, 32) end, number) then 'recurrence_invalid' end,
    case when closer and ahead and span < 0 then 'end_before_start' end,
    case when closer and ahead and frequency = 'Weekly' and span between 0 and 5 then 'weekly_span_short' end,
    case when closer and ahead and frequency = 'Monthly' and span between 0 and 29 then 'monthly_span_short' end,
    case when closer and ahead and clock > first_day + to_hours(cast(substr(start_time, 1, 2) as int)) then 'start_time_past' end,
    case when closer and not ahead then 'start_date_past' end,
    case when not known or (closer and first_day is null) then 'unparsable' end], lambda code: code is not null) as codes
  from ruled),
loaded as (
  select c.row_no, case when c.task_id is not null and t.task_detail_id is null then list_append(codes, 'task_not_active') else codes end as codes
  from coded c left join source_task t on cast(t.task_detail_id as varchar) = c.task_id and t.task_status = 'Active')"""
_check("bulk_job_validation", f"with {_RULES} select row_no, array_to_string(codes, ',') as errors from coded")
_check("bulk_load_errors", f"with {_RULES} select row_no, array_to_string(codes, ',') as errors from loaded where len(codes) > 0")
_check("bulk_load", f"""with {_RULES}
select (select max(job_id) from source_job) + b.row_no - 1 as job_id, b.job_name, cast(b.task_id as bigint) as task_detail_id,
  'Active' as job_status, cast(null as varchar) as job_running_status, cast(null as timestamp) as last_job_run, 'Auto' as execution,
  cast(b.priority as int) as priority, timestamp '{UPLOAD_CLOCK}' as date_created,
  coalesce(lower(b.email_job_complete) = 'true', false) as complete_job, coalesce(lower(b.email_job_fail) = 'true', false) as fail_job,
  coalesce(lower(b.email_job_skip) = 'true', false) as skip_job
from bulk_jobs b join loaded l on l.row_no = b.row_no where len(l.codes) = 0""")
_check("bulk_load_sheets", f"""with {_RULES},
sound as (select b.row_no from bulk_jobs b join loaded l on l.row_no = b.row_no where len(l.codes) = 0)
select count(*) as jobs, count(*) as ids, (select max(job_id) from source_job) + count(*) as highest from sound""")
_check("bulk_load_schedules", f"""with {_RULES}
select (select max(scheduler_id) from scheduler) + b.row_no - 1 as scheduler_id, (select max(job_id) from source_job) + b.row_no - 1 as job_id,
  cast(b.start_date as date) as start_date, cast(b.end_date as date) as end_date, b.start_time, b.frequency, b.recurrence,
  timestamp '{UPLOAD_CLOCK}' as date_created, {_clock('b.start_time', 'cast(b.start_date as date)')} as recurrence_time
from bulk_jobs b join loaded l on l.row_no = b.row_no where len(l.codes) = 0""")
_check("bulk_load_rejected", f"""with {_RULES}
select row_no as job_id, job_name from bulk_jobs where not exists (select 1 from loaded where len(codes) > 0)""")
_check("bulk_task_validation", """
select b.row_no, array_to_string(list_filter([
    case when b.source_task_type_id is not null and y.source_task_type_id is null then 'type_not_found' end,
    case when y.task_type_status = 'Delete' then 'type_deleted' end,
    case when y.task_type_status = 'Inactive' then 'type_inactive' end,
    case when b.source_task_type_id is null then 'type_id_empty' end,
    case when b.task_name = '' then 'task_name_empty' end,
    case when not contains(b.task_payload, '</name>') then 'task_payload_invalid' end], lambda code: code is not null), ',') as errors
from bulk_tasks b left join source_task_type y on cast(y.source_task_type_id as varchar) = b.source_task_type_id
""")
_check("payload_flatten", """
select payload_id as task_detail_id, cast(row_number() over (partition by payload_id order by task_payload_id) as int) as ordinal,
  tag_key, tag_parent, tag_value
from source_task_payload
""")
_check("payload_build", "select task_detail_id, task_payload from source_task")

_check("upsert_job_errors", """
select c.change_id, c.op, case
  when c.op = 'add' and c.job_name is null then 'job_name_missing' when c.op = 'add' and c.task_detail_id is null then 'task_detail_id_missing'
  when c.op = 'add' and c.execution is null then 'execution_missing' when c.op = 'add' and c.priority is null then 'priority_missing'
  when c.op = 'update' and c.job_name is null then 'job_name_missing' when c.op = 'update' and c.task_detail_id is null then 'task_detail_id_missing'
  when c.op <> 'add' and j.job_id is null then 'not_found'
  when c.op = 'add' and t.task_detail_id is null then 'task_not_active'
  when c.op = 'update' and coalesce(t.task_status, '') <> 'Active' then 'task_not_active' end as error
from job_changes c left join source_job j on j.job_id = c.job_id left join source_task t on t.task_detail_id = c.task_detail_id
""")
_check("upsert_definitions", f"""
select (select max(job_id) from source_job) + c.change_id as job_id, c.job_name, c.task_detail_id, 'Active' as job_status,
  cast(null as varchar) as job_running_status, cast(null as timestamp) as last_job_run, c.execution, c.priority,
  timestamp '{NOW}' as date_created, c.complete_job, c.fail_job, coalesce(c.skip_job, false) as skip_job
from job_changes c join source_task t on t.task_detail_id = c.task_detail_id where c.op = 'add' and c.job_name is not null
  and c.execution is not null and c.priority is not null
union all
select j.job_id, c.job_name, c.task_detail_id, coalesce(c.job_status, j.job_status), j.job_running_status, j.last_job_run,
  coalesce(c.execution, j.execution), coalesce(c.priority, j.priority), j.date_created, c.complete_job, c.fail_job, coalesce(c.skip_job, false)
from job_changes c join source_job j on j.job_id = c.job_id join source_task t on t.task_detail_id = c.task_detail_id
where c.op = 'update' and c.job_name is not null and t.task_status = 'Active'
union all
select j.* replace ('Delete' as job_status) from job_changes c join source_job j on j.job_id = c.job_id where c.op = 'delete'
""")
_TASK_ERROR = """case
  when c.op in ('add', 'update') and c.task_name is null then 'task_name_missing'
  when c.op in ('add', 'update') and c.task_payload is null then 'task_payload_missing'
  when c.op in ('add', 'update') and c.source_task_type_id is null then 'source_task_type_id_missing'
  when c.op in ('add', 'update') and coalesce(y.task_type_status, '') <> 'Active' then 'type_not_active'
  when c.op <> 'add' and t.task_detail_id is null then 'not_found' end"""
_TASK_CHECKED = f"""checked as (select c.*, {_TASK_ERROR} as error from task_changes c
  left join source_task_type y on y.source_task_type_id = c.source_task_type_id
  left join source_task t on t.task_detail_id = c.task_detail_id)"""
_check("upsert_task_errors", f"with {_TASK_CHECKED} select change_id, op, error from checked")
_check("upsert_tasks", f"""with {_TASK_CHECKED}
select (select max(task_detail_id) from source_task) + change_id as task_detail_id, task_name, 'Active' as task_status, home_page_id,
  pipeline_id, task_payload, source_task_type_id, timestamp '{NOW}' as date_created
from checked where op = 'add' and error is null
union all
select t.task_detail_id, c.task_name, coalesce(c.task_status, t.task_status), c.home_page_id, c.pipeline_id, c.task_payload,
  c.source_task_type_id, t.date_created
from checked c join source_task t on t.task_detail_id = c.task_detail_id where c.op = 'update' and c.error is null
union all
select t.* replace ('Delete' as task_status) from checked c join source_task t on t.task_detail_id = c.task_detail_id
where c.op = 'delete' and c.error is null""")
_check("upsert_task_cascade", f"""with {_TASK_CHECKED}
select job_id, task_detail_id, 'Delete' as job_status from source_job
where task_detail_id in (select task_detail_id from checked where op = 'delete' and error is null)""")
_TAGS = f"""{_TASK_CHECKED}, sent as (
  select change_id, change_id * 3 + i as row_no, concat('tag', i) as tag_key, case when i > 0 then 'tag0' end as tag_parent,
    task_name as tag_value
  from task_changes, unnest([0, 1, 2]) as u(i) where change_id % 2 = 0),
tagged as (
  select change_id, case when op = 'add' then (select max(task_detail_id) from source_task) + change_id else task_detail_id end as owner, op
  from checked where error is null and op <> 'delete' and change_id % 2 = 0
  qualify op = 'add' or row_number() over (partition by op, task_detail_id order by change_id desc) = 1)"""
_check("upsert_task_tags", f"""with {_TAGS}
select (select max(task_payload_id) from source_task_payload) + row_no as task_payload_id, tag_key, tag_parent, tag_value, owner as payload_id
from sent join tagged on tagged.change_id = sent.change_id""")
_check("upsert_task_tags_removed", f"""with {_TAGS}
select task_payload_id from source_task_payload where payload_id in (select owner from tagged where op = 'update')""")
_TYPES = f"""sent as (select {', '.join(TYPE_LOG)} from job_changes), ruled as (
  select *, case when op <> 'delete' and service_name is null then 'service_name_missing'
    when op = 'add' and description is null then 'description_missing'
    when op <> 'delete' and queue_topic_partition is null then 'queue_topic_partition_missing'
    when op = 'update' and source_task_type_id not in (select source_task_type_id from source_task_type) then 'not_found' end as error
  from sent),
sound as (
  select *, case op when 'delete' then 'Delete' else task_type_status end as named_status from ruled where error is null),
statuses as (
  select * from sound where op <> 'add' and named_status is not null
  qualify row_number() over (partition by source_task_type_id order by change_id desc) = 1),
updates as (
  select * from sound where op = 'update' qualify row_number() over (partition by source_task_type_id order by change_id desc) = 1)"""
_check("upsert_type_errors", f"with {_TYPES} select change_id, op, error from ruled")
_check("upsert_types", f"""with {_TYPES}
select (select max(source_task_type_id) from source_task_type) + change_id as source_task_type_id, description,
  schema_payload is not null as is_schema_register, queue_topic_partition, schema_payload, service_name, 'Active' as task_type_status
from sound where op = 'add'
union all
select y.source_task_type_id, case when u.op is null then y.description else u.description end,
  case when u.op is null then y.is_schema_register else u.schema_payload is not null end,
  coalesce(u.queue_topic_partition, y.queue_topic_partition), case when u.op is null then y.schema_payload else u.schema_payload end,
  coalesce(u.service_name, y.service_name), coalesce(z.named_status, y.task_type_status)
from source_task_type y left join updates u on u.source_task_type_id = y.source_task_type_id
left join statuses z on z.source_task_type_id = y.source_task_type_id where u.op is not null or z.op is not null""")
_check("upsert_type_cascade", f"""with {_TYPES}
select job_id, source_job.task_detail_id, named_status as job_status from statuses
join source_task on source_task.source_task_type_id = statuses.source_task_type_id
join source_job on source_job.task_detail_id = source_task.task_detail_id""")
_check("upsert_schedules_added", f"""with sent as (select {', '.join(SENT_SCHEDULES)} from scheduler)
select {SCHEDULE_BASE} + change_id as scheduler_id, job_id, start_date, end_date, start_time, frequency, nullif(recurrence, '') as recurrence,
  timestamp '{NOW}' as date_created, {_clock('start_time', 'start_date')} as recurrence_time
from sent""")
_check("upsert_schedules_changed", f"""with sent as (select {', '.join(SENT_SCHEDULES)} from scheduler), newest as (
  select * from sent qualify row_number() over (partition by job_id order by change_id desc) = 1)
select p.scheduler_id, p.job_id, n.start_date,
  coalesce((select arg_max(s.end_date, s.change_id) from sent s where s.job_id = p.job_id and s.end_date is not null), p.end_date) as end_date,
  n.start_time, n.frequency,
  coalesce((select arg_max(s.recurrence, s.change_id) from sent s where s.job_id = p.job_id and s.recurrence <> ''), p.recurrence) as recurrence,
  p.date_created, {_clock('n.start_time', 'n.start_date')} as recurrence_time
from {PRIMARY} p join newest n on n.job_id = p.job_id""")
_check("upsert_lookups", f"""
with parents as (select lookup_id as parent from lookup_data), sound as (
  select * from lookup_changes where op = 'delete' or (lookup_value is not null and lookup_type is not null))
select (select max(lookup_id) from lookup_data) + change_id as lookup_id, lookup_value, lookup_type, description,
  timestamp '{NOW}' as date_created, parent as parent_lookup_id, false as removed
from sound left join parents on parent = parent_lookup_id where op = 'add'
union all
select l.lookup_id, s.lookup_value, s.lookup_type, coalesce(s.description, l.description), l.date_created,
  coalesce(p.parent, l.parent_lookup_id), false
from sound s join lookup_data l on l.lookup_id = s.lookup_id left join parents p on p.parent = s.parent_lookup_id where s.op = 'update'
union all
select l.lookup_id, l.lookup_value, l.lookup_type, l.description, l.date_created, l.parent_lookup_id, true
from sound s join lookup_data l on l.lookup_id = s.lookup_id where s.op = 'delete'
""")
_check("notification_feed", """
select m.job_id, m.job_queue_id as event_id, case when m.job_status = 'Skip' then q.skip_time else q.start_time end as time_slot,
  m.job_status as status, (select lookup_value from lookup_data where lookup_type = 'EMAIL_RECEIVER') as recipient,
  concat('Source Job ', m.job_status) as subject
from status_messages m join source_job j on j.job_id = m.job_id join job_queue q on q.job_queue_id = m.job_queue_id
where m.message_type = 'QUEUE_DETAIL' and case m.job_status when 'Skip' then j.skip_job when 'Completed' then j.complete_job
  when 'Failed' then j.fail_job else false end
""")
_NOTICE = " || ".join([
    _field("jobId", "cast(j.job_id as varchar)", False),
    _field("jobStatus", "j.job_status"),
    _field("jobRunningStatus", "j.job_running_status"),
    _field("lastJobRun", f"({_iso('j.last_job_run')})"),
    _field("recurrenceTime", "strftime(s.recurrence_time, '%Y-%m-%d %H:%M:%S.0')"),
    _field("execution", "j.execution"),
])
_check("dispatch_notices", f"""with {_SETTLED}
select j.job_id, concat('{{', rtrim({_NOTICE}, ','), '}}') as payload
from moved j left join {PRIMARY} s on s.job_id = j.job_id where j.job_status = 'Active'
""")
_check("status_notifications", f"""
select j.job_id, concat('{{', rtrim({_NOTICE}, ','), '}}') as payload
from source_job j left join {PRIMARY} s on s.job_id = j.job_id
where j.job_status = 'Active' and j.job_id in (select job_id from job_queue)
""")

_check("unlisted_values", """
select 'scheduler' as table_name, row_no as row_key, 'frequency' as column_name, frequency as value from bulk_jobs
where frequency not in ('Mint', 'Hr', 'Daily', 'Weekly', 'Monthly')
""")

# Streams, read to their end

_check("stream_status_fold", _FOLD)
_check("written_status_fold", f"with changed as ({_FOLD}) select {QUEUE_COLUMNS} from changed union all"
    f" select {QUEUE_COLUMNS} from job_queue where job_queue_id not in (select job_queue_id from changed)")
_check("written_in_flight", f"""with changed as ({_FOLD}), whole as (
  select job_id, job_status from changed
  union all select job_id, job_status from job_queue anti join changed using (job_queue_id))
select job_id, count(*) as in_flight from whole where job_status in {ACTIVE_RUNS} group by all""")
_check("written_job_fold", f"""with newest as (
  select job_id as id, arg_max(job_status, seq) as state from status_messages where message_type = 'QUEUE_DETAIL' group by job_id)
select {JOB_COLUMNS.replace('job_running_status', 'coalesce(state, job_running_status) as job_running_status')}
from source_job left join newest on id = job_id""")
_check("stream_audit_log", _AUDIT)
_check("stream_hourly_counts", """
select date_trunc('hour', event_time) as hour_start, job_status, count(*) as total_count from status_messages
where message_type = 'QUEUE_DETAIL' group by 1, 2
""")
_check("stream_dispatch", _RECORDS)
_check("stream_dispatch_limited", _RECORDS)
_check("adhoc_sql_mixed_case", """
select plan.frequency, count(*) as schedules from scheduler plan
where exists (select 1 from source_job owner where owner.job_id = plan.job_id) group by plan.frequency
""")
_check("adhoc_sql", """
select j.execution, q.job_status, count(*) as runs, max(q.date_created) as newest
from job_queue q join source_job j on j.job_id = q.job_id where j.priority <= 9 group by j.execution, q.job_status
""")


def checks() -> dict[str, str]:
    return dict(_CHECKS)
