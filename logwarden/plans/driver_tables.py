"""The driver's tables as inputs of the library: events, log lines, texts, scores.

Used by the registered queries, the benchmark and the tests; library code takes any DataFrame
with the right columns. Each mapping is written once in the common SQL subset, so Spark and
the checking engine start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.cluster import dealt, spread

_DIALECT = {
    "spark": {"K": "k", "Q": "`", "CLOCK": "date_format(ts, 'HH:mm')",
              "STAMP": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "SYSLOG": "date_format(ts, 'MMM dd HH:mm:ss')",
              "ISO": "concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HH:mm:ss'))"},
    "duckdb": {"K": "k", "Q": '"', "CLOCK": "strftime(ts, '%H:%M')",
               "STAMP": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "SYSLOG": "strftime(ts, '%b %d %H:%M:%S')",
               "ISO": "concat(strftime(ts, '%Y-%m-%d'), 'T', strftime(ts, '%H:%M:%S'))"},
}

_SOURCE_IP = "concat('10.', user_id % 4, '.', cast(floor(user_id / 4) as bigint) % 250, '.', @K % 3)"

_ACTION = """case
  when event_type = 'error' then 'failed_login'
  when event_type = 'purchase' then case when @K % 4 = 0 then 'successful_login' else 'api_request' end
  when event_type = 'signup' then case when @K % 6 = 0 then 'priv_escalation' else 'signup' end
  when event_type = 'view' then case when @K % 2 = 0 then 'dns_query' when @K in (1, 3) then 'file_download'
       when @K = 5 then 'malware_detected' else 'view' end
  else case when @K % 3 = 0 then 'outbound_conn' when @K % 10 = 1 then 'exfiltration'
       when @K % 10 = 2 then 'port_scan' else 'oauth_grant' end
end"""

_STATUS = """case
  when event_type = 'error' then case when @K % 13 = 0 then 'blocked' else 'failed' end
  when event_type = 'purchase' then case when @K % 16 = 0 then 'failed' else 'success' end
  when event_type = 'signup' then case when @K % 6 = 0 then 'flagged' else 'info' end
  when event_type = 'view' then case when @K % 2 = 0 or @K in (1, 3, 5) then 'flagged' else 'info' end
  else case when @K % 3 = 0 or @K % 10 in (1, 2) then 'flagged' else 'success' end
end"""

_EVENT_COLUMNS = (
    ("ingest_seq", "event_id"),
    ("ts", "cast(ts as timestamp)"),
    ("time_label", "case when @K % 19 <> 0 then @CLOCK end"),
    ("hour", "case when @K % 19 <> 0 then cast(hour(ts) as int) end"),
    ("source_ip", f"case when @K <> 50 then {_SOURCE_IP} end"),
    ("dest_ip", "case when @K % 5 < 3 then concat('172.16.0.', event_id % 9) end"),
    ("@Quser@Q", "case when @K % 11 <> 0 then concat('u', user_id) end"),
    ("host", "case when @K % 7 <> 0 then concat(case (user_id + @K % 2) % 7 when 0 then 'db' when 1 then 'web' "
             "when 2 then 'auth-gw' when 3 then 'edge-fw' when 4 then 'emp-pc' when 5 then 'app-srv' else 'node' end, "
             "'-', user_id % 5) end"),
    ("action", _ACTION),
    ("status", _STATUS),
    ("port", "case when @K % 2 = 0 then cast((event_id * 37) % 40 + 1 as int) end"),
    ("raw", "concat(@STAMP, ' ', event_type, ' user=u', user_id, ' value=', cast(floor(value) as bigint))"),
    ("file", "concat('source-', event_id % 3)"),
)

# One log line per event; the shape depends on k.
_LINE = f"""case
  when event_type = 'error' then concat(@SYSLOG, ' srv-', user_id % 9, ' sshd[', event_id % 5000,
       ']: Failed password for ', case when @K % 2 = 0 then 'invalid user ' else '' end, 'u', user_id,
       ' from ', {_SOURCE_IP}, ' port ', 30000 + event_id % 20000, ' ssh2')
  when event_type = 'purchase' then concat(@SYSLOG, ' srv-', user_id % 9, ' sshd[', event_id % 5000,
       ']: Accepted password for u', user_id, ' from ', {_SOURCE_IP}, ' port ', 30000 + event_id % 20000)
  when event_type = 'signup' then concat(@ISO, ' host=db-', user_id % 5, ' sudo: user=u', user_id,
       ' COMMAND=/bin/sh src=', {_SOURCE_IP})
  when event_type = 'view' then concat('[', @CLOCK, '] named[7]: client ', {_SOURCE_IP}, '#53 query: q', @K,
       '.example.net IN TXT dst 172.16.0.', event_id % 9)
  else concat(@ISO, ' edge BLOCK SRC=', {_SOURCE_IP}, ' DST=172.16.0.', event_id % 9, ' DPT=',
       cast((event_id * 37) % 70000 as bigint), case when @K % 3 = 0 then ' outbound' else ' dropped' end)
end"""


def _render(template: str, dialect: str) -> str:
    for token, text in _DIALECT[dialect].items():
        template = template.replace(f"@{token}", text)
    return template


def event_projection(dialect: str) -> list[str]:
    return [_render(f"{expr} as {name}", dialect) for name, expr in _EVENT_COLUMNS]


def line_projection(dialect: str) -> list[str]:
    columns = ("event_id as ingest_seq", "concat('source-', event_id % 3) as file", f"{_LINE} as value",
               f"{_SOURCE_IP} as true_ip", "concat('u', user_id) as true_user", "event_type")
    return [_render(c, dialect) for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table for costly pattern matching."""
    return spread(table(spark, sf_dir, name).select(*columns))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with the number inside ``props`` read once per row."""
    return table(spark, sf_dir, "events").selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(raw_events(spark, sf_dir)).selectExpr(*event_projection("spark"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(raw_events(spark, sf_dir), "event_id").selectExpr(*line_projection("spark"))


_RAW_EVENTS_SQL = "(select *, cast(json_extract_string(props, '$.k') as int) as k from events)"


def events_sql() -> str:
    return f"select {', '.join(event_projection('duckdb'))} from {_RAW_EVENTS_SQL}"


def lines_sql() -> str:
    return f"select {', '.join(line_projection('duckdb'))} from {_RAW_EVENTS_SQL}"


# ---- structured records: eight given fields per event, as CSV, JSON Lines and JSON text -------

_FIELDS = (
    ("timestamp", "@ISO"),
    ("source_ip", f"case when @K % 8 <> 0 then {_SOURCE_IP} else '' end"),
    ("dest_ip", "case when @K % 5 < 3 then concat('172.16.0.', event_id % 9) else '' end"),
    ("user", "case when @K % 11 <> 0 then concat('u', user_id) else ' ' end"),
    ("host", "case when @K % 7 <> 0 then concat('node-', user_id % 5) else '' end"),
    ("action", "case when @K % 9 = 0 then '' else concat(upper(event_type), ' - Login ', user_id % 3) end"),
    ("status", "case @K % 6 when 0 then 'OK' when 1 then 'denied' when 2 then '403' when 3 then 'Blocked' when 4 then '' else 'n/a' end"),
    ("port", "case when @K % 4 = 0 then '' else concat('', @K * 997 % 70000) end"),
)
CSV_HEADER = "Timestamp,Src_IP, Dest_IP ,User,Host,Event_Type,Status,Port"
_RECORD = ("concat('{\"ts\":\"', f_timestamp, '\",\"src\":\"', f_source_ip, '\",\"dst_ip\":\"', f_dest_ip, '\",\"principal\":\"', f_user, "
           "'\",\"asset\":\"', f_host, '\",\"operation\":\"', f_action, '\",\"outcome\":\"', f_status, '\",\"dport\":\"', f_port, '\"}')")

# Texts over the field columns, valid in both engines.
FIELD_LINES = {
    "csv": "concat(f_timestamp, ',', f_source_ip, ', ', f_dest_ip, ',\"', f_user, '\",', f_host, ',', f_action, ',\"', f_status, '\",', f_port)",
    "record": _RECORD,
    "jsonl": f"case when k % 10 = 0 then concat('Failed password for u', k, ' from 10.9.8.7 port ', k) when k % 10 = 1 then '// note' "
             f"when k % 10 = 2 then '[1,2]' else {_RECORD} end",
}


# Lines of log files: notes and blank lines, which are no events, and lines without a time between dated ones.
UNDATED = {"log": "case when event_id % 7 = 1 then '# rotated' when event_id % 11 = 3 then '  ' "
                  "when k % 4 = 0 then concat('login failed user=u', k, ' src=10.1.2.', k) else value end"}


def field_sql(dialect: str) -> str:
    inner = "(select *, cast(json_extract_string(props, '$.k') as int) as k from events)" if dialect == "duckdb" else "raw_events"
    return f"select event_id as ingest_seq, k, {', '.join(field_projection(dialect))} from {inner}"


def field_projection(dialect: str) -> list[str]:
    return [_render(f"{expr} as f_{name}", dialect) for name, expr in _FIELDS]


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(raw_events(spark, sf_dir), "event_id").selectExpr("event_id as ingest_seq", "k", *field_projection("spark"))
