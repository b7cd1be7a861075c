"""Checking SQL of the queries over files."""

from __future__ import annotations

from logwarden import fixed_values as fv
from logwarden.plans.driver_tables import FIELD_LINES, UNDATED, field_projection, line_projection
from logwarden.plans.oracle_logs import q
from logwarden.plans.oracle_text import _NONE, _PICKS, normalize

_RAW = "(select *, cast(json_extract_string(props, '$.k') as int) as k from events)"
_LINES = f"select event_id, k, {', '.join(line_projection('duckdb'))} from {_RAW} where event_id % 3 = 0"
_GIVEN = f"""select * replace (case when k % 4 = 0 then '' else f_timestamp end as f_timestamp)
  from (select event_id, k, {', '.join(field_projection('duckdb'))} from {_RAW} where event_id % 3 > 0)"""
_CSV = "concat_ws(',', f_timestamp, f_source_ip, f_dest_ip, f_user, f_host, f_action, f_status, f_port)"


def _stamp(text: str) -> str:
    """Date and time of an ISO stamp."""
    iso = q(fv.ISO_TIME_PATTERN)
    return f"case when regexp_matches({text}, {iso}) then replace(regexp_extract({text}, '\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d'), 'T', ' ') end"


_LOG_RAW = f"select event_id as ingest_seq, 'a' as file, false is_record, trim(v) raw, {_NONE} from (select event_id, {UNDATED['log']} as v from ({_LINES})) where trim(v) <> '' and not starts_with(trim(v), '#')"
_CSV_RAW = f"select event_id as ingest_seq, 'b' as file, true is_record, {_CSV} raw, {_PICKS} from ({_GIVEN}) where event_id % 3 = 1"
_JSON_RAW = f"select event_id as ingest_seq, 'c' as file, true is_record, {FIELD_LINES['record']} raw, {_PICKS} from ({_GIVEN}) where event_id % 3 = 2"
_ALL = f"{_LOG_RAW} union all by name {_CSV_RAW} union all by name {_JSON_RAW}"
_EVENTS = (f"ev as (select n.*, {_stamp('coalesce(r.given_timestamp, r.raw)')} as stamp, row_number() over (order by file, ingest_seq) - 1 as event_index "
           f"from ({normalize(_ALL)}) n join ({_ALL}) r using (file, ingest_seq))")
_LABEL = "case when file = 'a' then 'a-log' when file = 'b' then 'b-csv' else 'c-lines' end"

ORACLE = {
    "file_digests": f"""select lot, cast(strlen(body) as bigint) n_bytes, sha256(body) as sha256 from (
      select ingest_seq % 4 as lot, string_agg(value, chr(10) order by ingest_seq) || chr(10) as body from (select {', '.join(line_projection('duckdb'))} from {_RAW}) group by 1)""",
    "flow_files": """select l_orderkey flow, cast(l_linenumber as bigint) segment, case when l_quantity <= 45 then l_quantity end rate,
      case when l_orderkey % 2 = 0 then round(l_tax, 6) end idle, case when l_returnflag = 'R' then 'DoS Hulk' else 'BENIGN' end label,
      case when l_returnflag = 'R' then 1 else 0 end attack from lineitem""",
    "file_events": f"with {_EVENTS} select event_index, stamp, time_label, hour, source_ip, dest_ip, account, host, action, status, port from ev",
    "file_activity": f"""with {_EVENTS}, b as (select coalesce(hour, event_index % 24) as h, status from ev)
      select lpad(cast(r.h as varchar), 2, '0') as hour, count(status) as events, count(*) filter (status in ('failed', 'flagged', 'blocked')) alerts
      from range(24) r(h) left join b on b.h = r.h group by r.h""",
    "file_summary": f"""with {_EVENTS} select {_LABEL} folder, case file when 'a' then 'log' when 'b' then 'csv' else 'jsonl' end format,
      cast(4 as bigint) n_files, count(*) n_events from ev group by file""",
    "file_size_limit": f"with {_EVENTS} select count(*) filter (file = 'b') n_events, cast(0 as bigint) n_over from ev",
}
