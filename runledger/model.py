"""Table schemas and the fixed value lists the tables are checked against."""

from __future__ import annotations

# Table schemas as DDL text, the form Spark's readers take.
JOB_QUEUE = (
    "job_queue_id bigint not null, date_created timestamp_ntz, end_time timestamp_ntz, job_id bigint,"
    " job_send boolean, job_status string, job_status_message string, run_manual boolean,"
    " skip_manual boolean, skip_time timestamp_ntz, start_time timestamp_ntz"
)
SOURCE_JOB = (
    "job_id bigint not null, job_name string, task_detail_id bigint, job_status string,"
    " job_running_status string, last_job_run timestamp_ntz, execution string, priority int,"
    " date_created timestamp_ntz, complete_job boolean, fail_job boolean, skip_job boolean"
)
SCHEDULER = (
    "scheduler_id bigint not null, job_id bigint, start_date date, end_date date, start_time string,"
    " frequency string, recurrence string, date_created timestamp_ntz, recurrence_time timestamp_ntz"
)
SOURCE_TASK = (
    "task_detail_id bigint not null, task_name string, task_status string, home_page_id string,"
    " pipeline_id string, task_payload string, source_task_type_id bigint, date_created timestamp_ntz"
)
SOURCE_TASK_PAYLOAD = (
    "task_payload_id bigint not null, tag_key string, tag_parent string, tag_value string,"
    " payload_id bigint"
)
SOURCE_TASK_TYPE = (
    "source_task_type_id bigint not null, description string, is_schema_register boolean,"
    " queue_topic_partition string, schema_payload string, service_name string,"
    " task_type_status string"
)
LOOKUP_DATA = (
    "lookup_id bigint not null, lookup_value string, lookup_type string, description string,"
    " date_created timestamp_ntz, parent_lookup_id bigint"
)
JOB_AUDIT_LOGS = (
    "job_audit_log_id bigint not null, job_queue_id bigint, log_detail string,"
    " date_created timestamp_ntz"
)
STATUS_MESSAGE = (
    "seq bigint, event_time timestamp_ntz, job_queue_id bigint, job_id bigint, message_type string,"
    " job_status string, logs_detail string, end_time timestamp_ntz"
)

TABLE_SCHEMAS = {
    "job_queue": JOB_QUEUE,
    "source_job": SOURCE_JOB,
    "scheduler": SCHEDULER,
    "source_task": SOURCE_TASK,
    "source_task_payload": SOURCE_TASK_PAYLOAD,
    "source_task_type": SOURCE_TASK_TYPE,
    "lookup_data": LOOKUP_DATA,
    "job_audit_logs": JOB_AUDIT_LOGS,
}

# Tables that only grow are laid out by day under this column, so a date range prunes
# whole folders.
DAILY_TABLES = ("job_queue", "job_audit_logs")
DAY_COLUMN = "created_on"

# Stored enum texts, sheet headings, lookup names and the values an
# upload may use. They have to be these texts for results to agree.
RECORD_STATUSES = ("Inactive", "Active", "Delete")
RUN_STATUSES = ("Queue", "Start", "Running", "Failed", "Completed", "Skip", "Interrupt")
IN_FLIGHT_STATUSES = ("Queue", "Start", "Running")
LIVE_STATUSES = ("Start", "Running", "Failed", "Completed")
MATRIX_STATUSES = ("Queue", "Start", "Running", "Failed", "Completed", "Stop", "Skip", "Interrupt")
BUSY_STATUSES = ("Queue", "Running")
EXECUTIONS = ("Auto", "Manual")
FREQUENCIES = ("Mint", "Hr", "Daily", "Weekly", "Monthly")
PRIORITIES = ("1", "2", "3", "4", "5", "6", "7", "8", "9", "99", "100")
FLAG_TEXTS = ("True", "False")
RECURRENCES = {
    "Mint": tuple(range(5, 60, 5)),
    "Hr": tuple(range(1, 13)),
    "Daily": tuple(range(1, 7)),
    "Weekly": tuple(range(1, 32)),
    "Monthly": tuple(range(1, 32)),
}
QUEUE_FETCH_LIMIT = "QUEUE_FETCH_LIMIT"
SCHEDULER_LAST_RUN_TIME = "SCHEDULER_LAST_RUN_TIME"
EMAIL_RECEIVER = "EMAIL_RECEIVER"
AUDIT_LOG = "AUDIT_LOG"
QUEUE_DETAIL = "QUEUE_DETAIL"
ROUTE_PATTERN = r"^topic=([a-zA-Z-]*)&partitions=\[([0-9*])\]$"
DATE_PATTERN = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[1-2][0-9]|3[0-1])$"
TIME_PATTERN = r"^(0[0-9]|1[0-9]|2[0-3]):([0-5][0-9])$"
JOB_SHEET_HEADINGS = (
    "Job Name", "Task Detail Id", "Start Date", "End Date", "Start Time", "Frequency",
    "Recurrence", "Priority", "Email Job Complete", "Email Job Fail", "Email Job Skip",
)
JOB_REPORT_HEADINGS = (
    "Job Name", "Task", "Execution", "Priority", "Status", "Created Date", "Start Date",
    "End Date", "Time", "Last Run", "Next Flight", "R-Status", "Email job complete",
    "Email job fail", "Email job skip",
)
TASK_SHEET_HEADINGS = ("TaskTypeId", "Task Name", "Task Payload", "PipelineId", "HomePage")
TASK_REPORT_HEADINGS = (
    "Task Id", "Task Name", "Task Payload", "Task Status", "PipelineId", "HomePage",
    "ServiceName", "QueueTopicPartition",
)

# Column names given to the cells of an upload sheet, in heading order.
JOB_SHEET_COLUMNS = (
    "job_name", "task_id", "start_date", "end_date", "start_time", "frequency", "recurrence",
    "priority", "email_job_complete", "email_job_fail", "email_job_skip",
)
TASK_SHEET_COLUMNS = (
    "source_task_type_id", "task_name", "task_payload", "pipeline_id", "home_page_id",
)
