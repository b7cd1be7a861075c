"""Checking SQL for extraction, classification, parsing and display functions."""

from __future__ import annotations

from logwarden import fixed_values as fv
from logwarden.plans.driver_tables import FIELD_LINES, field_sql, lines_sql
from logwarden.plans.oracle_logs import q


def has(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, {q(pattern)}, '{flags}')"


def group(text: str, pattern: str, n: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {n}, '{flags}'), '')"


def ips(text: str) -> str:
    return f"regexp_extract_all({text}, {q(fv.IPV4_PATTERN)})"


def first_ip(text: str) -> str:
    return f"coalesce({group(text, fv.LABELED_SOURCE_PATTERN)}, {ips(text)}[1])"


def second_ip(text: str) -> str:
    return f"coalesce({group(text, fv.LABELED_DEST_PATTERN)}, {ips(text)}[2])"


def clamp_port(text: str) -> str:
    return f"case when try_cast({text} as double) > 0 and try_cast({text} as double) <= 65535 then cast(floor(try_cast({text} as double)) as int) end"


def port(text: str) -> str:
    return clamp_port(f"coalesce({', '.join(group(text, p) for p in fv.PORT_PATTERNS)})")


def user(text: str) -> str:
    return f"coalesce({', '.join(group(text, p) for p in fv.USER_PATTERNS)})"


def host(text: str) -> str:
    return f"coalesce({group(text, fv.HOST_LABEL_PATTERN)}, {group(text, fv.HOST_SYSLOG_PATTERN, 1, 'c')})"


def time_part(text: str, n: int) -> str:
    """n = 1 hour, 2 minute."""
    iso, sys_, bare = fv.ISO_TIME_PATTERN, fv.SYSLOG_TIME_PATTERN, fv.BARE_TIME_PATTERN
    return (f"case when {has(text, iso, 'c')} then regexp_extract({text}, {q(iso)}, {n + 1})"
            f" when {has(text, sys_, 'c')} then regexp_extract({text}, {q(sys_)}, {n})"
            f" when {has(text, bare, 'c')} then regexp_extract({text}, {q(bare)}, {n}) end")


def time_label(text: str) -> str:
    return f"{time_part(text, 1)} || ':' || {time_part(text, 2)}"


def hour(text: str) -> str:
    return f"cast({time_part(text, 1)} as int)"


def action(text: str) -> str:
    rules = " ".join(f"when {has(text, p)} then {q(a)}" for p, a, _ in fv.CLASSIFICATION_RULES)
    return f"case {rules} when {has(text, fv.BLOCK_VERB_PATTERN)} then 'blocked_traffic' when {has(text, fv.SYSTEM_ALERT_PATTERN)} then 'system_alert' else 'event' end"


def status(text: str) -> str:
    rules = " ".join(f"when {has(text, p)} then {q(s)}" for p, _, s in fv.CLASSIFICATION_RULES)
    return f"case when {has(text, fv.BLOCK_VERB_PATTERN)} then 'blocked' {rules} when {has(text, fv.SYSTEM_ALERT_PATTERN)} then 'flagged' else 'info' end"


def norm_action(text: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({text})), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"


def norm_status(text: str, fallback: str) -> str:
    rules = " ".join(f"when regexp_matches(lower({text}), {q(p)}) then {q(s)}" for p, s in fv.STATUS_WORD_PATTERNS)
    return f"case {rules} else {fallback} end"


def normalize(records: str) -> str:
    """Event fields of records (is_record, raw, given_*), as the library derives them."""
    judged = "(case when is_record then concat(coalesce(given_action, ''), ' ', coalesce(given_status, ''), ' ', raw) else raw end)"
    clock = "coalesce(given_timestamp, raw)"
    return f"""select ingest_seq, file, {time_label('clock')} time_label, {hour('clock')} as hour,
      coalesce(given_source_ip, {first_ip('raw')}) source_ip,
      case when is_record then given_dest_ip else {second_ip('raw')} end dest_ip,
      coalesce(given_user, {user('raw')}) account,
      case when is_record then given_host else {host('raw')} end host,
      case when given_action is not null then {norm_action('given_action')} else {action('judged')} end as action,
      case when given_status is not null then {norm_status('given_status', status('judged'))} else {status('judged')} end status,
      case when given_port is not null then {clamp_port('given_port')} else {port('raw')} end as port
      from (select *, {judged} judged, {clock} clock from ({records}))"""


_NONE = ", ".join(f"cast(null as varchar) given_{f}" for f in fv.FIELD_ALIASES)


def _plain(table: str, key: str, text: str) -> str:
    return f"select {key}, {action(text)} as action, {status(text)} status from {table}"


_PICKS = ", ".join(f"nullif(trim(f_{f}), '') given_{f}" for f in fv.FIELD_ALIASES)
_FIELD_SOURCE = f"({field_sql('duckdb')})"

ORACLE = {
    "parse_log_lines": normalize(f"select ingest_seq, file, false is_record, trim(value) raw, {_NONE} from ({lines_sql()})"),
    "round_trip_fields": f"""select count(*) n_lines, count(*) filter (ip = true_ip) n_ip, count(*) filter (usr = true_user) n_user
      from (select *, {first_ip('value')} ip, {user('value')} usr from ({lines_sql()}))""",
    "parse_csv_lines": normalize(f"select ingest_seq, 'export.csv' as file, true is_record, {FIELD_LINES['csv']} raw, {_PICKS} from {_FIELD_SOURCE}"),
    "parse_jsonl_lines": normalize(
        f"""select ingest_seq, 'export.jsonl' as file, k % 10 <> 0 is_record, line raw,
        {', '.join(f"case when k % 10 <> 0 then nullif(trim(f_{f}), '') end given_{f}" for f in fv.FIELD_ALIASES)}
        from (select *, {FIELD_LINES['jsonl']} line from {_FIELD_SOURCE}) where k % 10 not in (1, 2)"""),
    "parse_json_documents": normalize(
        f"""select ingest_seq * 8 + i as ingest_seq, concat('doc-', ingest_seq, '.json') as file, true is_record, raw, {_PICKS}
        from (select *, {FIELD_LINES['record']} raw, unnest(case k % 6 when 0 then [0, 1] when 1 then [0] when 2 then [0] else []::int[] end) i
              from {_FIELD_SOURCE})"""),
    "file_formats": """select * from (values ('a.csv', 'csv'), ('b.txt', 'csv'), ('c.jsonl', 'jsonl'), ('d.log', 'log'), ('e.data', 'jsonl'))
        t(file, format) cross join (select count(*) n_events from events)""",
    "text_addresses": f"""select doc_id, len({ips('text')}) n_ips, {first_ip('text')} first_ip, {second_ip('text')} second_ip from documents""",
    "text_fields": f"""select doc_id, {user('text')} account, {host('text')} host, {port('text')} as port, {time_label('text')} time_label,
        {hour('text')} as hour from documents""",
    "classify_documents": _plain("documents", "doc_id", "text"),
    "classify_pages": _plain("pages", "page_id", "html"),
    "classify_conversations": f"select conv_id, turn, {action('text')} as action, {status('text')} status from conversations",
    "class_counts": f"""select lang, action, status, count(*) n from (select lang, {action('text')} as action, {status('text')} status from documents) group by all""",
    "status_words": f"""select event_id, {norm_action('a')} as action, {norm_status('w', "'info'")} status,
        {norm_status('w', "'info'")} in ('failed', 'flagged', 'blocked') alert,
        case when {norm_status('w', "'info'")} = 'info' then 'success' else {norm_status('w', "'info'")} end feed
        from (select event_id, concat(' ', event_type, ' - Type ', user_id % 5, '!') a,
          case event_id % 12 when 0 then 'OK' when 1 then 'Unsuccessful' when 2 then 'denied' when 3 then '403 forbidden' when 4 then 'HTTP 204'
            when 5 then 'Blocked' when 6 then 'Suspicious' when 7 then 'invalid token' when 8 then 'reject' when 9 then 'anomaly'
            when 10 then 'denied auth' else 'n/a' end w from events)""",
    "display_text": """select doc_id, case when length(text) > 96 then text[1:95] || '…' else text end short,
        sha256(text) digest, left(sha256(text), 4) || '…' || right(sha256(text), 4) digest_short,
        md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))) normalized from documents""",
    "shifted_times": """select event_id, lpad(cast(m // 60 as varchar), 2, '0') || ':' || lpad(cast(m % 60 as varchar), 2, '0') shifted from (
        select event_id, ((hour(ts) * 60 + minute(ts) + event_id % 4000 - 2000) % 1440 + 1440) % 1440 m from events)""",
    "url_names": r"""select page_id, case when h = '' then url[1:60] when tail is null then h else h || '/' || tail end as name from (
        select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) h,
          list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: length(s) > 0)[-1] tail from pages)""",
    "score_bands": """select event_id, case when r >= 76 then 'Critical' when r >= 51 then 'High' when r >= 26 then 'Medium' else 'Low' end severity,
        case when r >= 51 then 'Investigating' when r >= 26 then 'Open' else 'Monitoring' end status,
        case when r <= 25 then 'Low' when r <= 50 then 'Medium' when r <= 75 then 'High' else 'Critical' end bucket,
        case when r >= 70 then 'signal' when r >= 40 then 'caution' else 'clearance' end tone, round(r, 4) risk
        from (select event_id, greatest(0, least(100, (1 - (greatest(5, least(150, value)) - 5) / (150 - 5 + 1e-12)) * 100)) r from events)""",
    "humanized_actions": """select event_id, case event_type when 'error' then 'Failed Login' when 'view' then 'DNS Query V2' else upper(event_type[1]) || event_type[2:] end title,
        case when event_type in ('view', 'error') then 'Database' else 'Web / API' end asset_type from events""",
    "source_latest_by_name": """select concat('feed-', event_id % 97) as name, max(event_id) load_order, min(event_id) ordinal from events group by 1""",
    "source_labels": """select user_id, case when count(*) = 1 then concat('u', any_value(event_id), '.log') else concat(count(*), ' uploaded files') end label
        from events group by user_id""",
}
