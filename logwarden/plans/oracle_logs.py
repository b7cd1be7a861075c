"""Checking SQL for the log-side queries, over the same mapped events."""

from __future__ import annotations

from logwarden import fixed_values as fv
from logwarden.plans.driver_tables import events_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BASE = f"""ev as ({events_sql()}),
fl as (select *,
  coalesce(action = 'failed_login' or (status = 'failed' and regexp_matches(action, 'login|auth')), false) as f,
  action = 'successful_login' as s, action = 'priv_escalation' as p, action = 'dns_query' as d,
  action in ('outbound_conn', 'exfiltration') as o, action in ('malware_detected', 'file_download') as m,
  status in ('failed', 'flagged', 'blocked') as alert, coalesce(host, source_ip) as endpoint from ev)"""

_FEAT = """feat as (select source_ip, count(*) n_events, count(*) filter (f) n_failed, count(*) filter (s) n_success,
  count(*) filter (p) n_priv, count(distinct port) n_ports, count(*) filter (d) n_dns, count(*) filter (o) n_outbound,
  count(*) filter (alert) n_alerts, min(ingest_seq) first_seq, min(ingest_seq) filter (alert) first_alert_seq
  from fl where length(source_ip) > 0 group by source_ip),
mal as (select endpoint, count(*) n_events, count(*) filter (action = 'malware_detected') n_confirmed,
  min(ingest_seq) first_seq from fl where m and length(endpoint) > 0 group by endpoint)"""

_DET = """det as (
select 0 section, source_ip as key, first_seq, 0 rule_order,
  case when n_success > 0 or n_priv > 0 then 'compromise' else 'bruteforce' end kind,
  case when n_priv > 0 then 'Possible Server Compromise' when n_success > 0 then 'Possible Account Compromise'
       else 'Brute-Force Attack' end title,
  cast(floor((case when n_priv > 0 then greatest(78, least(97, r1 + 14)) else r1 end) + 0.5) as bigint) risk,
  n_events, n_failed, n_success, n_priv, n_ports, n_dns, n_outbound, 0 n_confirmed
from (select *, case when n_success > 0 then greatest(70, least(92, r0 + 22)) else r0 end r1
      from (select *, greatest(45.0, least(72.0, 40.0 + 1.5 * n_failed)) r0 from feat where n_failed >= 5))
union all
select 0, source_ip, first_seq, 1, 'privesc', 'Unusual Privilege Escalation',
  cast(greatest(30, least(58, 30 + 6 * n_priv)) as bigint), n_events, n_failed, n_success, n_priv, n_ports, n_dns, n_outbound, 0
from feat where n_failed < 5 and n_priv > 0 and n_success = 0
union all
select 0, source_ip, first_seq, 2, 'portscan', 'Port Scan / Recon',
  cast(greatest(45, least(90, 42 + n_ports)) as bigint), n_events, n_failed, n_success, n_priv, n_ports, n_dns, n_outbound, 0
from feat where n_ports >= 15
union all
select 0, source_ip, first_seq, 3, 'dns_exfil', 'Possible DNS Exfiltration',
  cast(greatest(55, least(88, 50 + n_dns)) as bigint), n_events, n_failed, n_success, n_priv, n_ports, n_dns, n_outbound, 0
from feat where n_dns >= 8
union all
select 0, source_ip, first_seq, 4, 'outbound', 'Suspicious Outbound Activity',
  cast(greatest(45, least(78, 40 + 2 * n_outbound)) as bigint), n_events, n_failed, n_success, n_priv, n_ports, n_dns, n_outbound, 0
from feat where n_outbound >= 5
union all
select 1, endpoint, first_seq, 5, 'malware',
  case when n_confirmed > 0 then 'Malware Detected' else 'Suspicious File Download' end,
  cast(case when n_confirmed > 0 then greatest(45, least(75, 44 + 6 * n_confirmed))
            else greatest(30, least(55, 30 + 3 * n_events)) end as bigint), n_events, 0, 0, 0, 0, 0, 0, n_confirmed
from mal where n_confirmed > 0 or n_events >= 3)"""

_DESC = """keyed as (select 0 section, source_ip as key, * from fl where length(source_ip) > 0
  union all select 1, endpoint, * from fl where m and length(endpoint) > 0),
lab as (select section, key, slot, label, count(*) n, min(ingest_seq) seq from (
    select section, key, ingest_seq, 'host' slot, host label from keyed
    union all select section, key, ingest_seq, 'dest', dest_ip from keyed
    union all select section, key, ingest_seq, 'user', "user" from keyed
    union all select section, key, ingest_seq, 'failed_user', "user" from keyed where f
    union all select section, key, ingest_seq, 'source', source_ip from keyed)
  where length(label) > 0 group by all),
best as (select section, key, slot, label from lab
  qualify row_number() over (partition by section, key, slot order by n desc, seq) = 1),
tops as (select section, key, max(label) filter (slot = 'host') top_host, max(label) filter (slot = 'dest') top_dest,
  max(label) filter (slot = 'user') top_user, max(label) filter (slot = 'failed_user') top_failed_user,
  max(label) filter (slot = 'source') top_source from best group by all),
ports as (select source_ip as key, string_agg(cast(port as varchar), ', ' order by seq) port_text from (
    select source_ip, port, min(ingest_seq) seq from ev where length(source_ip) > 0 and port is not null group by source_ip, port
    qualify row_number() over (partition by source_ip order by min(ingest_seq)) <= 6) group by all),
dd as (select det.*, port_text,
    case when kind = 'malware' then det.key else coalesce(top_host, top_dest) end host,
    case when kind in ('compromise', 'bruteforce', 'privesc')
         then case when n_failed > 0 then top_failed_user else top_user end end usr,
    case when kind = 'malware' then top_source else det.key end ip
  from det left join tops using (section, key) left join ports on det.section = 0 and ports.key = det.key),
ds as (select *,
  case when kind in ('compromise', 'bruteforce') then coalesce(host, usr, ip)
       when kind = 'portscan' then coalesce(host, 'DMZ range') else coalesce(host, ip) end asset,
  case when kind in ('compromise', 'bruteforce') then concat('T1110', case when n_success > 0 then ' T1078' else '' end,
            case when n_priv > 0 then ' T1068' else '' end)
       when kind = 'privesc' then 'T1548' when kind = 'portscan' then 'T1046' when kind = 'dns_exfil' then 'T1048 T1071'
       when kind = 'outbound' then 'T1048' else 'T1204' end mitre,
  case kind
    when 'compromise' then concat('Brute-force attempts from ', ip, ' were followed by a successful login',
       coalesce(' on ' || host, ''), case when n_priv > 0 then ', then privileged activity' else '' end, '.')
    when 'bruteforce' then concat(n_failed, ' failed login attempts from ', ip, ' targeting ',
       coalesce(host, usr, 'multiple accounts'), '.')
    when 'privesc' then concat('Privilege escalation observed from ', ip, coalesce(' on ' || host, ''),
       ' without a matching login baseline.')
    when 'portscan' then concat(n_ports, ' distinct ports probed from ', ip, ' — reconnaissance against ',
       coalesce(host, 'the environment'), '.')
    when 'dns_exfil' then concat('Unusually high DNS query volume from ', coalesce(host, ip),
       ' — consistent with covert-channel exfiltration.')
    when 'outbound' then concat('Repeated outbound connections from ', coalesce(host, ip), ' to external hosts.')
    else case when n_confirmed > 0 then concat('Malicious file activity detected on ', key, '.')
         else concat('Repeated suspicious file downloads on ', key, '.') end end summary
  from dd)"""

_TOP = """top12 as (select *, cast(row_number() over (order by risk desc, section, first_seq, rule_order) as bigint) rnk
  from ds qualify rnk <= 12),
smp as (select t.rnk, e.*, row_number() over (partition by t.rnk order by class_rank, ingest_seq) sample_rank
  from top12 t join (
    select *, unnest([0, 1, 2]) class_rank from keyed) e on t.section = e.section and t.key = e.key
  where case when kind in ('compromise', 'bruteforce')
               then (class_rank = 0 and e.f) or (class_rank = 1 and e.s) or (class_rank = 2 and e.p)
             when class_rank > 0 then false
             when kind = 'privesc' then e.p when kind = 'dns_exfil' then e.d when kind = 'outbound' then e.o else true end
  qualify sample_rank <= 8),
opn as (select rnk, arg_min(time_label, coalesce(hour, 99) * 100 + sample_rank) opened from smp
  where length(time_label) > 0 group by rnk),
inc as (select *, cast(2000 + rnk as varchar) incident_id,
  case when risk >= 76 then 'Critical' when risk >= 51 then 'High' when risk >= 26 then 'Medium' else 'Low' end severity,
  cast(greatest(52, least(95, 58 + floor(risk / 5 + 0.5))) as bigint) confidence
  from (select t.*, coalesce(o.opened, '—') opened from top12 t left join opn o using (rnk))),
inc2 as (select *, case when severity in ('Critical', 'High') then 'Investigating' when severity = 'Medium' then 'Open'
  else 'Monitoring' end status from inc)"""

_SIG = """sig as (
  select rnk, incident_id, 1 pos, case kind when 'privesc' then concat('Privilege escalation from ', ip)
      when 'portscan' then concat(n_ports, ' distinct ports probed')
      when 'dns_exfil' then concat(n_dns, ' DNS queries in the window')
      when 'outbound' then concat(n_outbound, ' outbound connections from ', ip)
      when 'malware' then case when n_confirmed > 0 then concat(n_confirmed, ' malware signature match(es)')
           else concat(n_events, ' suspicious downloads') end
      else concat(n_failed, ' failed logins from ', ip) end factor,
    cast(case kind when 'privesc' then 0.4 when 'portscan' then 0.32 when 'dns_exfil' then 0.3 when 'outbound' then 0.3
      when 'malware' then 0.3 else 0.28 end as double) weight from inc2
  union all
  select rnk, incident_id, 2, case kind when 'privesc' then 'No prior authentication baseline'
      when 'portscan' then 'Single source touching many services'
      when 'dns_exfil' then 'Consistent with covert-channel exfiltration'
      when 'outbound' then 'Destinations outside the known baseline'
      when 'malware' then concat('Activity on endpoint ', key) else 'Repeated attempts in a short window' end,
    cast(case kind when 'privesc' then 0.2 when 'portscan' then 0.16 when 'dns_exfil' then 0.2 when 'outbound' then 0.16
      when 'malware' then 0.14 else 0.12 end as double) from inc2
  union all select rnk, incident_id, 3, 'Successful login after failed attempts', cast(0.24 as double) from inc2
    where kind in ('compromise', 'bruteforce') and n_success > 0
  union all select rnk, incident_id, 4, 'Privileged command shortly after login', cast(0.2 as double) from inc2
    where kind in ('compromise', 'bruteforce') and n_priv > 0
  union all select rnk, incident_id, 5, concat('Target is a monitored asset — ', host), cast(0.1 as double) from inc2
    where kind in ('compromise', 'bruteforce') and host is not null),
fac as (select rnk, incident_id, factor, pos, floor(weight / sum(weight) over (partition by rnk) * 100 + 0.5) / 100 weight from sig),
fac2 as (select *, cast(row_number() over (partition by rnk order by weight desc, pos) as bigint) position from fac)"""

_CUBE = """cub as (select case when hour between 0 and 23 then hour else cast(ingest_seq % 24 as int) end bucket,
  action, status, count(*) n, min(ingest_seq) first_seq from ev group by all),
act as (select lpad(cast(h as varchar), 2, '0') as hour, cast(coalesce(sum(n), 0) as bigint) events,
  cast(coalesce(sum(n) filter (status in ('failed', 'flagged', 'blocked')), 0) as bigint) alerts
  from range(24) r(h) left join cub on bucket = h group by h),
tot as (select cast(sum(n) as bigint) n_events,
  cast(sum(n) filter (status in ('failed', 'flagged', 'blocked')) as bigint) n_alerts,
  cast(coalesce(sum(n) filter (status = 'flagged'), 0) as bigint) n_flagged from cub)"""

_THREAT_VALUES = ", ".join(f"({q(a)}, {q(l)})" for a, l in fv.THREAT_LABELS.items())
_THREATS = f"""thr as (select name, cast(sum(n) as bigint) as cnt, min(first_seq) first_seq
  from cub join (values {_THREAT_VALUES}) t(action, name) using (action) group by name
  order by cnt desc, first_seq limit 5)"""

_HOST = """hos as (select source_ip ip, n_events cnt, n_alerts alerts, first_alert_seq from feat where n_alerts > 0
  order by n_alerts desc, first_alert_seq limit 6)"""

_USERS = """usr0 as (select "user" u, count(*) n_events, count(*) filter (status = 'failed') failed,
  count(*) filter (s) success, count(*) filter (p) privileged, min(ingest_seq) first_seq
  from fl where length("user") > 0 group by all),
usr1 as (select *, cast(greatest(8, least(96, failed * 5 + privileged * 16
  + case when success > 0 and failed >= 5 then 22 else 0 end)) as bigint) risk from usr0),
prof as (select * from usr1 order by risk desc, first_seq limit 4)"""

_CATALOG = ", ".join(f"({q(c)}, {q(t)}, {q(n)})" for c, (t, n) in fv.TECHNIQUE_CATALOG.items())
_TECH = f"""cat(code, tactic, technique) as (values {_CATALOG}),
mit as (select rnk, incident_id, cast(unnest(generate_series(1, len(codes))) as bigint) position, unnest(codes) code
  from (select rnk, incident_id, string_split(mitre, ' ') codes from inc2))"""

_HEALTH = """hc as (select count(*) filter (severity = 'Critical') crit, count(*) filter (severity = 'High') high,
  count(*) filter (status <> 'Resolved') opn, count(*) filter (list_contains(string_split(mitre, ' '), 'T1204')) ep from inc2),
hr as (select count(*) filter (risk >= 60) risky from prof),
dim as (select unnest([
  {'position': 1, 'name': 'Threat Detection', 'value': greatest(55, least(95, 92 - crit * 3))},
  {'position': 2, 'name': 'Incident Response', 'value': greatest(45, least(95, 90 - opn * 3))},
  {'position': 3, 'name': 'User Risk', 'value': greatest(40, least(95, 92 - risky * 10))},
  {'position': 4, 'name': 'Network Security', 'value': greatest(45, least(95, 88 - high * 4))},
  {'position': 5, 'name': 'Endpoint Security', 'value': greatest(45, least(95, 88 - ep * 6))},
  {'position': 6, 'name': 'Vulnerabilities', 'value': greatest(50, least(92, 85 - crit * 4))}], recursive := true) from hc, hr),
sco as (select cast(floor(sum(value) / count(*) + 0.5) as bigint) score from dim)"""


def with_(*parts: str, body: str) -> str:
    return f"with {', '.join(parts)} {body}"


_TO_TOP = (_BASE, _FEAT, _DET, _DESC, _TOP)

_PLAYBOOK = "\n  union all ".join(
    "select incident_id, {i} pos, {text} as action, {impact} impact, {appr} requires_approval from inc2 where kind in ({kinds}){cond}".format(
        i=i,
        text="replace(replace(replace(replace({t}, '{{ip}}', coalesce(ip, '')), '{{user}}', coalesce(usr, '')), '{{asset}}', coalesce(asset, '')), '{{id}}', incident_id)".format(t=q(text)),
        impact=q(impact), appr="true" if approval else "false", kinds=", ".join(q(k) for k in kinds),
        cond={"ip": " and ip is not null", "user": " and usr is not null", None: ""}[needs])
    for i, (kinds, text, impact, approval, needs) in enumerate(fv.PLAYBOOK)
)

_EVENT_STEP = """case when action = 'malware_detected' then 'INTEL' when action = 'priv_escalation' or status in ('failed', 'flagged')
  then 'RULE' else 'DETECT' end"""
_HUMAN = """array_to_string(list_transform(string_split(action, '_'), lambda w: upper(w[1:1]) || w[2:]), ' ')"""

_ENT = """ent0 as (select incident_id, 1 pos, 'Source IP' kind_, ip label, 'Origin of the activity' detail, 'signal' tone from inc2 where ip is not null
  union all select incident_id, 2, 'Target asset', host, 'Affected host', 'caution' from inc2 where host is not null
  union all select incident_id, 3, 'Account', usr, 'Targeted / used account', 'ink' from inc2 where usr is not null
  union all select incident_id, 4, 'Ports', case when n_ports > 6 then concat(port_text, ' +', n_ports - 6) else port_text end,
    concat(n_ports, ' distinct port(s)'), 'ink' from inc2
    where kind in ('compromise', 'bruteforce', 'privesc', 'portscan') and n_ports > 0),
ent as (select *, cast(row_number() over (partition by incident_id order by pos) as bigint) position from ent0)"""

_ORDER_VALUES = ", ".join(f"({q(c)}, {i})" for i, c in enumerate(fv.KILL_CHAIN_ORDER, 1))

_SCRIPT = """lead as (select arg_min(string_split(mitre, ' ')[1], rnk) code from inc2),
worst as (select * from hos order by alerts desc, first_alert_seq limit 1),
scr as (
select 1 as position, concat('Why is incident #', incident_id, ' ', lower(severity), '?') question,
  concat('Incident #', incident_id, ' (', title, coalesce(' on ' || asset, ''), ') scores ', risk,
    '/100 because multiple signals reinforce each other.') answer,
  (select string_agg(concat(factor, ' (', cast(floor(weight * 100 + 0.5) as bigint), '%)'), ' | ' order by position)
     from fac2 where fac2.rnk = 1) bullets, confidence,
  concat('Incident #', incident_id, ' timeline', coalesce(' | Source ' || ip, ''), ' | MITRE ', replace(mitre, ' ', ' / ')) sources
from inc2 where rnk = 1
union all
select 2, 'What should I investigate first?', concat('Prioritise by risk. ', count(*),
  ' incident(s) were detected in this data; start with the highest-risk items.'),
  string_agg(concat('#', incident_id, ' · ', asset, ' · Risk ', risk, ' — ', title), ' | ' order by rnk) filter (rnk <= 3),
  82, 'Incident queue | Risk ranking' from inc2 having count(*) > 0
union all
select 3, concat('Show all attacks related to ', any_value(code)),
  concat(any_value(code), ' (', any_value(technique), ') appears in ', count(*), ' incident(s) in this dataset.'),
  string_agg(concat('#', incident_id, ' · ', asset, ' — ', title), ' | ' order by rnk) filter (k <= 4), 85, 'MITRE mapping'
from (select inc2.*, l.code, cat.technique, row_number() over (order by rnk) k from inc2 cross join lead l
  join cat on cat.code = l.code where list_contains(string_split(mitre, ' '), l.code)) having count(*) > 0
union all
select 4, concat('Show all activity from ', ip), concat(ip, ' is the most active hostile source in this data, tied to ',
  alerts, ' alert(s) across ', cnt, ' event(s).'),
  concat(cnt, ' total events, ', alerts, ' flagged or failed', coalesce((select ' | ' || string_agg(
    concat('Linked to incident #', incident_id, ' — ', title), ' | ' order by rnk) from (
      select * from inc2 where contains(summary, worst.ip) order by rnk limit 2)), '')), 88, concat('Events from ', ip)
from worst)"""



def _norm(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


_INVENTORY = """select name, case when regexp_matches(lower(name), 'db|database|sql') then 'Database'
        when regexp_matches(lower(name), 'web|www|http|api') then 'Web / API'
        when regexp_matches(lower(name), 'auth|idp|sso|gw|gateway') then 'Auth / Identity'
        when regexp_matches(lower(name), 'fw|firewall|edge') then 'Firewall'
        when regexp_matches(lower(name), 'pc|laptop|emp|desktop|endpoint') then 'Endpoint'
        when regexp_matches(lower(name), 'srv|server|app|host') then 'Server' else 'Host' end as type,
        case when risk >= 76 then 'Critical' when risk >= 51 then 'High' when risk >= 26 then 'Medium' else 'Low' end criticality,
        risk, '—' owner, open_incidents
      from (select name, seq, rnk, coalesce(open_incidents, 0) open_incidents,
          cast(coalesce(inc_risk, greatest(8, least(60, 15 + 4 * coalesce(alerts, 0)))) as bigint) risk
        from (select host as name, count(*) filter (alert) alerts, min(ingest_seq) seq from fl where length(host) > 0 group by 1)
        full join (select asset as name, max(risk) inc_risk, count(*) open_incidents, min(rnk) rnk from inc2 group by 1) using (name))
      order by risk desc, seq nulls last, rnk limit 8"""

_NEXT_VALUES = ", ".join(f"({q(c)}, cast({1000 + i} as int))" for i, c in enumerate(fv.LIKELY_NEXT_TECHNIQUES))

ORACLE = {
    "ip_features": with_(_BASE, _FEAT, body="select * from feat"),
    "malware_endpoints": with_(_BASE, _FEAT, body="select * from mal"),
    "detections": with_(_BASE, _FEAT, _DET, body="select * from det"),
    "detections_described": with_(
        _BASE, _FEAT, _DET, _DESC,
        body="select section, key, rule_order, kind, title, risk, asset, host target_host, usr target_user, ip source_ip, "
             "mitre, summary from ds"),
    "incidents": with_(
        *_TO_TOP, body="select incident_id, rnk as rank, kind, title, asset, risk, severity, status, mitre, opened, confidence, "
                       "'Unassigned' assignee, summary, ip source_ip, usr as account from inc2"),
    "incident_samples": with_(
        *_TO_TOP, body="select cast(2000 + rnk as varchar) incident_id, cast(sample_rank as bigint) sample_rank, ingest_seq, "
                       "action, status, time_label, raw from smp"),
    "incident_timeline": with_(*_TO_TOP, body=f"""select * from (
      select cast(2000 + s.rnk as varchar) incident_id, cast(row_number() over (partition by s.rnk order by coalesce(hour, 99), sample_rank) as bigint) step,
        coalesce(time_label, opened) as time, {_HUMAN} title,
        case when length(raw) > 96 then concat(raw[1:95], '…') else raw end detail, {_EVENT_STEP} tag
      from smp s join (select rnk, opened from inc2) i using (rnk) qualify step <= 5)
      union all select incident_id, 6, opened, concat('Incident #', incident_id, ' opened'),
        concat(title, ' — risk ', risk, '/100.'), 'INCIDENT' from inc2"""),
    "incident_risk_factors": with_(*_TO_TOP, _SIG, body="select incident_id, position, factor, round(weight, 6) weight from fac2"),
    "incident_fallback_factors": with_(*_TO_TOP, body="""select incident_id, 1 as position, concat(severity, ' severity classification') factor,
        round(cast(case severity when 'Critical' then 0.34 when 'High' then 0.26 when 'Medium' then 0.18 else 0.1 end as double), 6) weight from inc2
      union all select incident_id, 2, concat('Model confidence ', confidence, '%'), round(confidence / 100.0 * 0.3, 6) from inc2
      union all select incident_id, 3, concat('Target asset — ', asset), 0.2 from inc2
      union all select incident_id, 4, concat(len(string_split(mitre, ' ')), ' technique(s) mapped'),
        round(0.1 + len(string_split(mitre, ' ')) * 0.03, 6) from inc2"""),
    "incident_evidence": with_(*_TO_TOP, body="""select distinct cast(2000 + rnk as varchar) incident_id, file as name, 'Uploaded log' kind,
        concat(left(sha256(file), 4), '…', right(sha256(file), 4)) hash, '10:00' captured, true verified from smp"""),
    "incident_responses": with_(*_TO_TOP, body=f"""select incident_id, cast(row_number() over (partition by incident_id order by pos) as bigint)
        as position, action, impact, requires_approval from ({_PLAYBOOK})"""),
    "incident_techniques": with_(*_TO_TOP, _TECH, body="""select incident_id, position, code, coalesce(tactic, 'Technique') tactic,
        coalesce(technique, code) technique, true observed from mit left join cat using (code)"""),
    "incident_entities": with_(*_TO_TOP, _ENT, body="select incident_id, position, kind_ as kind, label, detail, tone from ent"),
    "incident_edges": with_(*_TO_TOP, _ENT, body="""select incident_id, label from_label, kind_ from_kind, to_label, to_kind from (
        select *, lead(label) over w to_label, lead(kind_) over w to_kind from ent window w as (partition by incident_id order by position))
        where to_label is not null"""),
    "incident_neighbours": with_(*_TO_TOP, _ENT, body="""select distinct incident_id, case when a.position < b.position then b.label else a.label end neighbour
        from (select ent.* from ent) a join ent b using (incident_id), (select host from inc2 where rnk = 1) h
        where b.position = a.position + 1 and (a.label = h.host or b.label = h.host)
        and case when a.label = h.host then true else true end""".replace(
        "case when a.position < b.position then b.label else a.label end", "case when a.label = h.host then b.label else a.label end").replace(
        "\n        and case when a.label = h.host then true else true end", "")),
    "incident_explanations": with_(*_TO_TOP, _SIG, body="""select incident_id, concat('Why is incident #', incident_id, ' ', lower(severity), '?') question,
        concat('Incident #', incident_id, ' (', title, coalesce(' on ' || asset, ''), ') scores ', risk,
          '/100 because multiple signals reinforce each other.') answer,
        (select string_agg(concat(factor, ' (', cast(floor(weight * 100 + 0.5) as bigint), '%)'), ' | ' order by position) from fac2 where fac2.rnk = inc2.rnk) bullets,
        confidence, concat('Incident #', incident_id, ' timeline', coalesce(' | Source ' || ip, ''), ' | MITRE ', replace(mitre, ' ', ' / ')) sources from inc2"""),
    "incident_queue_search": with_(*_TO_TOP, body="""select incident_id, title, asset, risk, severity, status from inc2
        where severity = 'Critical' and status = 'Investigating'
        and contains(lower(concat_ws(' ', incident_id, title, asset, 'Unassigned', mitre)), 't1068')"""),
    "incident_counts": with_(*_TO_TOP, body="""select count(*) n_incidents, count(*) filter (severity = 'Critical') open_critical,
        count(*) filter (status = 'Investigating') investigating, count(*) open_incidents from inc2"""),
    "top_serious": with_(*_TO_TOP, body="""select incident_id, title, asset, risk, severity from inc2
        where severity in ('Critical', 'High') order by risk desc, rnk limit 5"""),
    "activity_series": with_(_BASE, _CUBE, body="select * from act"),
    "activity_peak": with_(_BASE, _CUBE, body="""select arg_max(hour, events * 100 - cast(hour as int)) peak_hour, max(events) peak_events,
        min(events) low_events, max(alerts) peak_alerts from act"""),
    "activity_shares": with_(_BASE, _CUBE, body="select hour, events, round(events / max(events) over (), 6) share from act"),
    "event_totals": with_(_BASE, _CUBE, body="select * from tot"),
    "top_threats": with_(_BASE, _CUBE, _THREATS, body="select name, cnt as count from thr"),
    "attack_type_shares": with_(_BASE, _CUBE, _THREATS, body="""select name, cast(floor(cnt / greatest(sum(cnt) over (), 1) * 100 + 0.5) as bigint) as value from thr"""),
    "hostile_ips": with_(_BASE, _FEAT, _HOST, body="select ip, cnt as count, alerts from hos"),
    "threat_intel": with_(_BASE, _FEAT, _HOST, body="""select ip as value, 'IP' kind, case when alerts >= 10 then 'Malicious' else 'Suspicious' end reputation,
        cast(greatest(60, least(96, 55 + 2 * alerts)) as bigint) confidence, cnt related, '2026-08-26' first_seen, '2026-08-26' last_seen
        from hos order by alerts desc, first_alert_seq limit 4"""),
    "asset_inventory": with_(*_TO_TOP, body=_INVENTORY),
    "asset_counts": with_(*_TO_TOP, body=f"select count(*) n_assets, count(*) filter (open_incidents > 0) n_with_open_incidents from ({_INVENTORY})"),
    "user_profiles": with_(_BASE, _USERS, body="""select u as account, '—' as role, risk, concat(n_events, ' events · ', failed, ' failed · ', privileged, ' privileged') as current,
        concat_ws(' | ', case when failed >= 5 then 'Repeated login failures' end, case when privileged > 0 then 'Privilege use' end,
          case when success > 0 and failed >= 5 then 'Login after brute force' end) flags from prof"""),
    "user_profiles_all": with_(_BASE, _USERS, body="""select u as account, risk, concat(n_events, ' events · ', failed, ' failed · ', privileged, ' privileged') as current,
        concat_ws(' | ', case when failed >= 5 then 'Repeated login failures' end, case when privileged > 0 then 'Privilege use' end,
          case when success > 0 and failed >= 5 then 'Login after brute force' end) flags from usr1"""),
    "health_dimensions": with_(*_TO_TOP, _USERS, _HEALTH, body="select position, name, cast(value as bigint) as value from dim"),
    "health_score": with_(*_TO_TOP, _USERS, _HEALTH, body="select score from sco"),
    "technique_progression": with_(*_TO_TOP, _TECH, body=f"""select code, coalesce(tactic, 'Technique') tactic, coalesce(technique, code) technique, observed, coalesce(next, o.pos) as position
      from (select distinct code, true observed, null as next from mit union all
            select code, false, place from (values {_NEXT_VALUES}) n(code, place) where code not in (select code from mit)) t
      left join cat using (code) left join (values {_ORDER_VALUES}) o(code, pos) using (code)"""),
    "report_summary": with_(*_TO_TOP, _CUBE, _USERS, _HEALTH, body="""select 'Uploaded logs' as "window", n_events total_events, n_alerts total_alerts, crit critical_incidents,
        cast(greatest(0, least(30, floor(n_flagged / n_alerts * 22 + 0.5))) as bigint) false_positive_rate,
        cast(greatest(4, least(30, 6 + crit * 2)) as bigint) avg_response_mins, score security_score from tot, hc, sco"""),
    "top_techniques": with_(*_TO_TOP, _TECH, body="""select code, coalesce(any_value(technique), code) as name, count(*) as count from mit left join cat using (code)
        group by code order by count(*) desc, min(rnk * 10 + position) limit 3"""),
    "notifications": with_(*_TO_TOP, _HOST, body="""select * from (select concat(severity, ' incident #', incident_id) title,
        concat(title, ' · ', asset, ' · Risk ', risk) detail, severity, opened as time from inc2
        where severity in ('Critical', 'High') order by rnk limit 3)
      union all select 'Threat-intel match', concat(ip, ' flagged across ', alerts, ' alerts'), 'High', (select arg_min(opened, rnk) from inc2)
        from (select * from hos order by alerts desc, first_alert_seq limit 1)"""),
    "kpis": with_(*_TO_TOP, _CUBE, body="""select 'Events parsed' as label, n_events as value, (select string_agg(cast(events as varchar), ',' order by hour) from act) spark, 'ink' tone from tot
      union all select 'Alerts', n_alerts, (select string_agg(cast(alerts as varchar), ',' order by hour) from act), 'caution' from tot
      union all select 'Incidents', n, case when n = 0 then '0,0,0,0,0' else (select string_agg(cast(cast(floor(n * i / 6 + 0.5) as bigint) as varchar), ',' order by i) from range(1, 7) r(i)) end, 'signal' from (select count(*) n from inc2)
      union all select 'Critical', n, case when n = 0 then '0,0,0,0,0' else (select string_agg(cast(cast(floor(n * i / 6 + 0.5) as bigint) as varchar), ',' order by i) from range(1, 7) r(i)) end, 'signal' from (select count(*) filter (severity = 'Critical') n from inc2)"""),
    "event_pool": with_(_BASE, body="""select ingest_seq, coalesce(source_ip, '—') source_ip, coalesce(host, dest_ip, '—') asset, action as type,
        case when status = 'info' then 'success' else status end status from fl order by alert desc, ingest_seq limit 16"""),
    "analyst_script": with_(*_TO_TOP, _SIG, _HOST, _TECH, _SCRIPT, body="select cast(position as bigint) as position, question, answer, bullets, cast(confidence as bigint) confidence, sources from scr"),
    "action_counts": with_(_BASE, body="select action, count(*) n, min(ingest_seq) first_seq from ev group by action"),
    "suggestions": with_(*_TO_TOP, _SIG, _HOST, _TECH, _SCRIPT, body="""select cast(case position when 3 then 4 when 4 then 3 else position end as bigint) as position, question from scr"""),
    "run_meta": with_(*_TO_TOP, body="""select '2026-08-26 10:00 UTC' generated_at, (select count(*) from ev) event_count,
        concat(count(*), ' incident(s) detected across ', (select count(*) from ev), ' events') note from inc2"""),
    "analyst_fallback": with_(*_TO_TOP, body="""select concat('I can explain any of the ', count(*), ' detected incident(s), rank them by risk, or trace a MITRE technique through this dataset. Try a suggested question, or ask about a specific incident, IP, or asset.') answer from inc2"""),
    "top_incident": with_(*_TO_TOP, body="select incident_id, title, risk from inc2 where rnk = 1"),
    "question_answers": with_(*_TO_TOP, _SIG, _HOST, _TECH, _SCRIPT, f"""tn as (select position, {_norm("coalesce(question, '')")} nq,
        {_norm("concat_ws(' ', question, answer, bullets, case when position <= 2 then (select incident_id from inc2 where rnk = 1) end, sources)")} hay from scr),
      qs as (select concat(conv_id, '-', turn) question_id, {_norm("case when turn = 0 then 'What should I investigate first?' when turn = 1 and conv_id % 2 = 0 then 'investigate FIRST' else text end")} nq from conversations),
      m as (select question_id, qs.nq, min(position) filter (tn.nq = qs.nq) e, min(position) filter (tn.nq <> '' and (contains(tn.nq, qs.nq) or contains(qs.nq, tn.nq))) p,
          arg_max(position, o * 100 - position) filter (o > 0) b
        from (select qs.*, tn.position, tn.nq tnq, len(list_filter(string_split(qs.nq, ' '), lambda w: length(w) >= 3 and contains(hay, w))) o from qs cross join tn) x
        join tn using (position) join qs using (question_id) group by all)""".replace("join tn using (position) join qs using (question_id) group by all", "join qs using (question_id) join tn using (position) group by all"),
      body="""select question_id, cast(case when nq <> '' then coalesce(e, p, b) end as bigint) as position,
        case when nq = '' then 'fallback' when e is not null then 'exact' when p is not null then 'partial' when b is not null then 'overlap' else 'fallback' end how from m"""),
    "empty_run": """select 'card' part, unnest(['Events parsed', 'Alerts', 'Incidents', 'Critical']) as name, cast(0 as bigint) as value
      union all select 'health', unnest(['Threat Detection', 'Incident Response', 'User Risk', 'Network Security', 'Endpoint Security', 'Vulnerabilities']), 0
      union all select 'activity', lpad(cast(h as varchar), 2, '0'), 0 from range(24) r(h) union all select 'report', 'mins', 0""",
}
