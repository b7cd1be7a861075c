"""Checking SQL for reason codes and streams; fitted models have none."""

from __future__ import annotations

from logwarden.plans import oracle_text
from logwarden.plans.oracle_logs import _BASE, _DET, _FEAT, with_

_DAY = "date_trunc('day', ts)"

ORACLE = {
    "stream_rules": with_(_BASE, _FEAT, _DET, body="select * from det where section = 0"),
    "stream_late_rows": f"""with {_BASE}, m as (select source_ip, f, ingest_seq, cast(floor(epoch(cast(ts as timestamp)) / 60) as bigint) as mi,
        ingest_seq >= 0.5 * ((select max(ingest_seq) from fl) + 1) as first_lot from fl where length(source_ip) > 0),
      seen as (select source_ip, max(mi) newest from m where first_lot group by source_ip)
      select source_ip, count(*) n_late, count(*) filter (f) n_failed, min(ingest_seq) first_seq, min(mi) first_minute
      from m join seen using (source_ip) where not first_lot and mi < newest - 10 group by source_ip""",
    "reason_codes": """with r as (select event_id, value src_bytes, cast(json_extract_string(props, '$.k') as double) k, event_type flag, event_type in ('error', 'click') attack from events),
      b as (select avg(src_bytes) m1, stddev_samp(src_bytes) s1, avg(k) m2, stddev_samp(k) s2 from r where not attack),
      sh as (select flag, count(*) / (select count(*) from r where not attack) share from r where not attack group by flag),
      c as (select event_id, 0 pos, 'src_bytes' feature, (src_bytes - m1) / s1 z, 'bytes sent to destination' phrase, src_bytes v, m1 m from r, b
        union all select event_id, 1, 'count', (k - m2) / s2, 'connections to same host (last 2s)', k, m2 from r, b),
      f as (select event_id, pos, feature, abs(z) magnitude, concat(phrase, ' is ', case when z > 0 then 'much higher than' else 'much lower than' end,
          ' typical baseline (value=', printf('%g', v), ', normal avg≈', printf('%.2f', m), ')') description from c where abs(z) >= 2
        union all select event_id, 2, 'flag', (1 - coalesce(share, 0)) * 3, concat('connection status flag=''', r.flag, ''' is rare/absent in normal baseline traffic (seen in ',
          printf('%.2f', coalesce(share, 0) * 100), '% of normal cases)') from r left join sh using (flag) where coalesce(share, 0) < 0.01)
      select event_id, row_number() over (partition by event_id order by magnitude desc, pos) - 1 as position, feature, description, round(magnitude, 4) magnitude from f""",
    "stream_parse": oracle_text.ORACLE["parse_log_lines"],
    "stream_brute_force": f"""with {_BASE}, w as (select source_ip, unnest(generate_series(time_bucket(interval 6 hour, ts, timestamp '2024-01-01') - interval 18 hour,
        time_bucket(interval 6 hour, ts, timestamp '2024-01-01'), interval 6 hour)) start from (select source_ip, cast(ts as timestamp) ts from fl where f and length(source_ip) > 0))
      select source_ip, strftime(start, '%Y-%m-%d %H:%M:%S') window_start, strftime(start + interval 1 day, '%Y-%m-%d %H:%M:%S') window_end, count(*) n_failed
      from w group by all having count(*) > 2""",
    "stream_sessions": f"""with {_BASE}, o as (select source_ip, cast(ts as timestamp) t, alert, case when t - lag(t) over (partition by source_ip order by t) <= interval 12 hour then 0 else 1 end fresh
        from (select source_ip, ts, alert, cast(ts as timestamp) t from fl where length(source_ip) > 0)),
      n as (select *, sum(fresh) over (partition by source_ip order by t) s from o),
      a as (select source_ip, min(t) a, max(t) + interval 12 hour b, count(*) n_events, count(*) filter (alert) n_alerts from n group by source_ip, s)
      select source_ip, strftime(a, '%Y-%m-%d %H:%M:%S') session_start, strftime(b, '%Y-%m-%d %H:%M:%S') session_end, n_events, n_alerts from a
      where b <= (select max(cast(ts as timestamp)) - interval 10 minute from fl where length(source_ip) > 0)""",
    "stream_hostile": f"with {_BASE} select source_ip, count(*) n_events, count(*) filter (alert) n_alerts from fl where length(source_ip) > 0 group by source_ip",
}
