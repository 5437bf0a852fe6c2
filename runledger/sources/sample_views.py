"""The job tables as views over the sample order, event and part tables.

The same text runs on Spark and, with two small changes of dialect, on the SQL
engine results are checked against. ``{events}`` and the like stand for raw tables.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from runledger.sources.tables import JobTables

RAW_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}

VIEWS = {
    "job_queue": """
select event_id + 1000 as job_queue_id, ts as date_created,
  case when st in ('Failed','Completed','Interrupt') then ts + interval '1' minute * cast(1 + event_id % 50 as int) end as end_time,
  user_id as job_id,
  st in ('Start','Running','Completed') as job_send,
  st as job_status,
  concat('Job ', cast(user_id as varchar(20)), ' ', lower(st), '.') as job_status_message,
  case when st <> 'Skip' and event_id % 11 = 0 then true end as run_manual,
  case when st = 'Skip' and event_id % 2 = 0 then true end as skip_manual,
  case when st = 'Skip' then ts end as skip_time,
  case when st <> 'Skip' then ts end as start_time
from (select *, case event_type when 'signup' then 'Queue' when 'purchase' then 'Start' when 'view' then 'Running'
        when 'click' then 'Completed' else case event_id % 3 when 0 then 'Failed' when 1 then 'Skip' else 'Interrupt' end end as st
      from {events}) e
""",
    "source_job": """
select c_custkey as job_id, c_name as job_name, 2000 + (c_custkey * 7) % 200 as task_detail_id,
  case when c_custkey % 10 = 0 then 'Delete' when c_custkey % 10 in (1,2) then 'Inactive' else 'Active' end as job_status,
  case c_custkey % 8 when 0 then 'Queue' when 1 then 'Start' when 2 then 'Running' when 3 then 'Failed' when 4 then 'Completed'
    when 5 then 'Skip' when 6 then 'Interrupt' end as job_running_status,
  case when c_custkey % 8 <> 7 then timestamp_ntz '2024-01-01 00:00:00' + interval '1' hour * cast(c_custkey % 700 as int) end as last_job_run,
  case when c_custkey % 5 = 0 then 'Manual' else 'Auto' end as execution,
  cast(case c_custkey % 11 when 9 then 99 when 10 then 100 else 1 + c_custkey % 11 end as int) as priority,
  timestamp_ntz '2023-06-01 00:00:00' + interval '1' day * cast(c_custkey % 365 as int) as date_created,
  c_custkey % 2 = 0 as complete_job, c_custkey % 3 = 0 as fail_job, c_custkey % 5 = 0 as skip_job
from {customer}
""",
    "scheduler": """
select o_orderkey + 1001 as scheduler_id, o_custkey as job_id, cast(o_orderdate as date) as start_date,
  case when o_orderstatus <> 'O' then cast(o_orderdate + interval '90' day as date) end as end_date,
  concat(lpad(cast(o_orderkey % 24 as varchar(2)), 2, '0'), ':', lpad(cast((o_orderkey * 7) % 60 as varchar(2)), 2, '0')) as start_time,
  case o_orderpriority when '1-URGENT' then 'Mint' when '2-HIGH' then 'Hr' when '3-MEDIUM' then 'Daily' when '4-NOT SPECIFIED' then 'Weekly' else 'Monthly' end as frequency,
  case when o_orderkey % 17 <> 0 then cast(case o_orderpriority when '1-URGENT' then 5 * (o_orderkey % 11 + 1) when '2-HIGH' then o_orderkey % 12 + 1
    when '3-MEDIUM' then o_orderkey % 6 + 1 else o_orderkey % 31 + 1 end as varchar(20)) end as recurrence,
  o_orderdate as date_created,
  o_orderdate + interval '1' hour * cast(o_orderkey % 24 as int) + interval '1' minute * cast((o_orderkey * 7) % 60 as int) as recurrence_time
from {orders}
""",
    "source_task_type": """
select cast(1000 + r_regionkey as bigint) as source_task_type_id, concat('[', lower(r_name), ']') as description,
  r_regionkey % 2 = 0 as is_schema_register,
  case r_regionkey when 0 then 'topic=test-topic&partitions=[*]' when 1 then 'topic=scrapping-topic&partitions=[0]'
    when 2 then 'topic=scrapping-topic&partitions=[1]' when 3 then 'extraction-topic&partitions=[*]' else 'topic=comparison-topic&partitions=[2]' end as queue_topic_partition,
  case when r_regionkey % 2 = 0 then 'name string, brand string' end as schema_payload,
  r_name as service_name, case when r_regionkey = 4 then 'Inactive' else 'Active' end as task_type_status
from {region}
""",
    "source_task": """
select p_partkey + 2000 as task_detail_id, p_name as task_name,
  case when p_partkey % 12 = 0 then 'Inactive' when p_partkey % 12 = 1 then 'Delete' else 'Active' end as task_status,
  case when p_partkey % 3 <> 0 then cast(100 + p_partkey % 25 as varchar(10)) end as home_page_id,
  case when p_partkey % 4 <> 0 then cast(1 + p_partkey % 5 as varchar(10)) end as pipeline_id,
  concat('<task><name>', p_name, '</name><brand>', p_brand, '</brand><spec><type>', p_type, '</type><size>', cast(p_size as varchar(10)), '</size></spec></task>') as task_payload,
  case when p_partkey % 40 <> 39 then 1000 + p_partkey % 5 end as source_task_type_id,
  timestamp_ntz '2023-01-01 00:00:00' + interval '1' day * cast(p_partkey % 500 as int) as date_created
from {part}
""",
    # Regions, nations and settings, plus one root per customer and one child per
    # order, so that reading the tree is work that grows with the data.
    "lookup_data": """
select lookup_id, lookup_value, lookup_type, description, timestamp_ntz '2023-01-01 00:00:00' as date_created, parent_lookup_id
from (
select cast(1 + r_regionkey as bigint) as lookup_id, r_name as lookup_value, r_name as lookup_type, 'parent' as description, cast(null as bigint) as parent_lookup_id from {region}
union all select cast(100 + n_nationkey as bigint), n_name, n_name, 'child', cast(1 + n_regionkey as bigint) from {nation}
union all select * from (values (cast(9001 as bigint), '2024-01-10T00:00:00', 'SCHEDULER_LAST_RUN_TIME', 'cfg', cast(null as bigint)),
 (cast(9002 as bigint), '25', 'QUEUE_FETCH_LIMIT', 'cfg', cast(null as bigint)), (cast(9003 as bigint), 'ops@example.com', 'EMAIL_RECEIVER', 'cfg', cast(null as bigint))) v
union all select 1000000 + c_custkey, c_mktsegment, c_name, 'customer', cast(null as bigint) from {customer}
union all select 1000000000000 + o_orderkey, o_orderstatus, concat('order-', cast(o_orderkey as varchar(20))), o_orderpriority, 1000000 + o_custkey from {orders}
) l
""",
    "job_audit_logs": """
select event_id * 3 + i + 1000 as job_audit_log_id, event_id + 1000 as job_queue_id,
  concat('Job ', cast(user_id as varchar(20)), case i when 0 then ' now in the queue.' when 1 then ' sent message.' else ' now complete.' end) as log_detail,
  ts + interval '1' minute * i as date_created
from (select *, explode(array(0, 1, 2)) as i from {events}) e
""",
    "status_messages": """
select event_id as seq, ts as event_time, 1000 + cast((event_id - event_id % 5) / 5 as bigint) as job_queue_id,
  cast((event_id - event_id % 5) / 5 as bigint) % 150 as job_id,
  case when event_id % 4 = 0 then 'AUDIT_LOG' else 'QUEUE_DETAIL' end as message_type,
  case event_type when 'signup' then 'Start' when 'purchase' then 'Running' when 'view' then 'Running' when 'click' then 'Completed' else 'Failed' end as job_status,
  props as logs_detail,
  case when event_type in ('click','error') then ts end as end_time
from {events}
""",
    "bulk_jobs": """
select o_orderkey + 2 as row_no,
  case when o_orderkey % 13 <> 0 then concat('job-', cast(o_orderkey as varchar(20))) end as job_name,
  case when o_orderkey % 29 <> 0 then cast(2000 + o_orderkey % 230 as varchar(20)) end as task_id,
  case when o_orderkey % 19 = 0 then '2024-13-01' else cast(cast(o_orderdate as date) as varchar(10)) end as start_date,
  case when o_orderstatus = 'O' then null else cast(cast(o_orderdate + interval '1' day * cast(o_orderkey % 40 - 2 as int) as date) as varchar(10)) end as end_date,
  case when o_orderkey % 23 = 0 then '25:00' else concat(lpad(cast(o_orderkey % 24 as varchar(2)), 2, '0'), ':00') end as start_time,
  case when o_orderkey % 31 = 0 then 'Yearly' else case o_orderpriority when '1-URGENT' then 'Mint' when '2-HIGH' then 'Hr' when '3-MEDIUM' then 'Daily' when '4-NOT SPECIFIED' then 'Weekly' else 'Monthly' end end as frequency,
  cast(o_orderkey % 14 as varchar(10)) as recurrence,
  cast(o_orderkey % 11 as varchar(10)) as priority,
  case o_orderkey % 4 when 0 then 'true' when 1 then 'False' when 2 then 'maybe' end as email_job_complete,
  case o_orderkey % 3 when 0 then 'TRUE' when 1 then 'False' end as email_job_fail,
  'false' as email_job_skip
from {orders}
""",
    # Task upload rows: blank names, broken payloads and unknown types at intervals.
    "bulk_tasks": """
select p_partkey + 2 as row_no,
  case when p_partkey % 19 = 0 then '7777' when p_partkey % 40 <> 39 then cast(1000 + p_partkey % 5 as varchar(10)) end as source_task_type_id,
  case when p_partkey % 13 <> 0 then p_name else '' end as task_name,
  case when p_partkey % 17 = 0 then concat('<task><name>', p_name, '</task>')
    else concat('<task><name>', p_name, '</name><brand>', p_brand, '</brand></task>') end as task_payload,
  cast(1 + p_partkey % 5 as varchar(10)) as pipeline_id,
  cast(100 + p_partkey % 25 as varchar(10)) as home_page_id
from {part}
""",
    # Tag rows of the task payloads, as the flattening operator should give them.
    "source_task_payload": """
select p_partkey * 6 + i as task_payload_id,
  case i when 0 then 'task' when 1 then 'name' when 2 then 'brand' when 3 then 'spec' when 4 then 'type' else 'size' end as tag_key,
  case when i < 4 then 'task' else 'spec' end as tag_parent,
  case i when 1 then p_name when 2 then p_brand when 4 then p_type when 5 then cast(p_size as varchar(10)) end as tag_value,
  p_partkey + 2000 as payload_id
from (select *, explode(array(0, 1, 2, 3, 4, 5)) as i from {part}) p
""",
    # One request per job (run, skip) or queue row (fail, interrupt).
    "operator_requests": """
select c_custkey as request_id, case when c_custkey % 4 < 2 then 'run' else 'skip' end as action,
  c_custkey as job_id, cast(null as bigint) as job_queue_id
from {customer}
union all
select 1000000000000 + event_id, case when event_id % 4 < 2 then 'fail' else 'interrupt' end,
  cast(null as bigint), event_id + 1000
from {events}
""",
    "job_changes": """
select c_custkey as change_id, case c_custkey % 3 when 0 then 'add' when 1 then 'update' else 'delete' end as op,
  case when c_custkey % 3 <> 0 then c_custkey + case when c_custkey % 50 = 1 then 1000000000 else 0 end end as job_id,
  case when c_custkey % 17 <> 0 then concat(c_name, ' changed') end as job_name,
  case when c_custkey % 19 <> 0 then 2000 + (c_custkey * 11) % 230 end as task_detail_id,
  case when c_custkey % 7 < 3 then 'Inactive' end as job_status,
  case when c_custkey % 2 = 0 then 'Manual' end as execution,
  case when c_custkey % 5 <> 0 then cast(c_custkey % 9 + 1 as int) end as priority,
  c_custkey % 3 = 1 as complete_job, c_custkey % 4 = 1 as fail_job, case when c_custkey % 5 <> 1 then c_custkey % 5 = 2 end as skip_job
from {customer}
""",
    "task_changes": """
select p_partkey as change_id, case p_partkey % 3 when 0 then 'add' when 1 then 'update' else 'delete' end as op,
  case when p_partkey % 3 <> 0 then p_partkey + 2000 + case when p_partkey % 50 = 1 then 1000000000 else 0 end end as task_detail_id,
  case when p_partkey % 17 <> 0 then concat(p_name, ' changed') end as task_name,
  case when p_partkey % 19 <> 0 then concat('<task><name>', p_name, '</name></task>') end as task_payload,
  case when p_partkey % 23 <> 0 then 1000 + p_partkey % 6 end as source_task_type_id,
  case when p_partkey % 7 < 3 then 'Inactive' end as task_status,
  case when p_partkey % 2 = 0 then cast(100 + p_partkey % 25 as varchar(10)) end as home_page_id,
  case when p_partkey % 5 = 0 then cast(1 + p_partkey % 5 as varchar(10)) end as pipeline_id
from {part}
""",
    "lookup_changes": """
select o_orderkey as change_id, case o_orderkey % 3 when 0 then 'add' when 1 then 'update' else 'delete' end as op,
  case when o_orderkey % 3 <> 0 then 1000000000000 + o_orderkey + case when o_orderkey % 50 = 1 then 1000000000000 else 0 end end as lookup_id,
  case when o_orderkey % 17 <> 0 then concat('value-', cast(o_orderkey % 100 as varchar(10))) end as lookup_value,
  case when o_orderkey % 19 <> 0 then concat('type-', cast(o_orderkey as varchar(20))) end as lookup_type,
  case when o_orderkey % 7 < 3 then 'changed' end as description,
  case when o_orderkey % 5 < 2 then 1000000 + o_custkey when o_orderkey % 5 = 2 then 5 end as parent_lookup_id
from {orders}
""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def raw_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = os.path.join(folder, f"{name}.parquet")
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(path)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One job table over the raw tables of a folder."""
    raw = {table: raw_table(spark, folder, table) for table in set(_PLACEHOLDER.findall(VIEWS[name]))}
    return spark.sql(VIEWS[name], **raw)


def view_over(spark: SparkSession, name: str, **raw: DataFrame) -> DataFrame:
    """One job table over raw tables given as frames, batch or streaming."""
    return spark.sql(VIEWS[name], **raw)


def sample_tables(spark: SparkSession, folder: str) -> JobTables:
    """Every job table over the raw tables of a folder."""
    return JobTables({name: (lambda name=name: view(spark, folder, name)) for name in VIEWS})


def check_text(name: str) -> str:
    """The view's text for the checking engine, over raw tables known by name there."""
    text = _PLACEHOLDER.sub(lambda found: found.group(1), VIEWS[name])
    text = text.replace("timestamp_ntz '", "timestamp '")
    return re.sub(r"explode\(array\(([^)]*)\)\)", r"unnest([\1])", text).strip()
