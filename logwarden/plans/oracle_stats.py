"""Checking SQL for profiling, features, calibration, evaluation and drift."""

from __future__ import annotations

from logwarden.operators.evaluate import TARGET_FPRS
from logwarden.plans.driver_tables import events_sql

CUTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _fit(key: str) -> str:
    return f"cast(concat('0x', left(md5(concat({key}, '42')), 8)) as bigint) % 10000 < 7500"


def _hash(key: str) -> str:
    return f"cast(concat('0x', left(md5(concat({key}, '42')), 15)) as bigint)"


_SCORED = f"""sc as (select event_id, value score, event_type family, case when event_type in ('error', 'click') then 1 else 0 end y,
  concat(event_type, '-', cast(json_extract_string(props, '$.k') as int) % 7) label, {_fit('event_id')} fit from events)"""
_PROB = "pr as (select * replace (score / (score + 40) as score) from sc)"


def _rates(source: str, extra: str = "") -> str:
    div = lambda a, b: f"round(case when {b} = 0 then 0 else cast({a} as double) / ({b}) end, 6)"
    return (f"select {extra} tn, fp, fn, tp, {div('tp + tn', 'tn + fp + fn + tp')} accuracy, {div('tp', 'tp + fp')} as precision, "
            f"{div('tp', 'tp + fn')} recall, {div('2 * tp', '2 * tp + fp + fn')} f1, {div('fp', 'fp + tn')} fpr, "
            f"{div('tp + fp', 'tn + fp + fn + tp')} flag_rate from {source}")


def _confusion(hit: str) -> str:
    return (f"count(*) filter (y = 0 and not ({hit})) tn, count(*) filter (y = 0 and ({hit})) fp, "
            f"count(*) filter (y = 1 and not ({hit})) fn, count(*) filter (y = 1 and ({hit})) tp")


def _auc(source: str) -> str:
    return f"""with {source}, g as (select score, count(*) filter (y = 1) pos, count(*) filter (y = 0) neg from s where score is not null group by score),
      c as (select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over () p, sum(neg) over () n from g window w as (order by score))
      select round(sum(pos * ((n - fp) + neg / 2.0)) / (max(p) * max(n)), 6) roc_auc,
        round(sum(pos * tp / cast(tp + fp as double)) / max(p), 6) average_precision from c"""


_FIXED = f"""cut as (select unnest({list(CUTS)}::double[]) threshold),
fx0 as (select threshold, {_confusion('score >= threshold')} from pr cross join cut group by threshold),
fx as ({_rates('fx0', 'threshold,')})"""
_OP = "case when threshold = 0.1 then '0.1' else cast(threshold as varchar) end operating_point"

_LONG_LINES = " union all ".join(f"select l_returnflag, '{c}' feature, {c} as value from lineitem" for c in _NUMBERS)
_SPLIT_LINES = f"""sl as (select *, case when {_fit("concat(l_orderkey, '-', l_linenumber)")} then 'train' else 'test' end split from lineitem)"""

_UNSW = """un as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice sbytes, l_quantity * (l_linenumber - 1) dbytes,
  l_linenumber spkts, l_quantity % 5 dpkts, l_linenumber % 3 sloss, l_quantity % 2 dloss, l_tax * 1000 sload, l_discount * 100 dload,
  l_suppkey % 10 ct_srv_src, l_suppkey % 7 ct_srv_dst, l_partkey % 6 ct_dst_ltm, l_partkey % 9 ct_src_ltm, l_partkey % 4 ct_dst_src_ltm,
  l_discount synack, l_tax ackdat, l_discount + l_tax tcprtt from lineitem)"""
_TRAFFIC = """tr as (select *, (sbytes + dbytes) / (spkts + dpkts + 1) bytes_per_packet, sbytes / (dbytes + 1 + 1e-9) src_dst_byte_ratio,
  spkts / (dpkts + 1 + 1e-9) packet_ratio, (sloss + dloss) / (spkts + dpkts + 1) loss_rate, ct_srv_src + ct_dst_ltm + ct_src_ltm connection_rate from un)"""
_KEYS = "l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) l_linenumber"
_ENGINEERED = ("bytes_per_packet", "src_dst_byte_ratio", "packet_ratio", "loss_rate", "connection_rate")
_ABLATION = {"all": _ENGINEERED, "none": ()} | {f"without_{x}": tuple(c for c in _ENGINEERED if c != x) for x in _ENGINEERED}

_CAND = {"cut_5": 5, "cut_15": 15, "cut_40": 40, "cut_90": 90}
_CANDS = "cd0 as (" + " union all ".join(
    f"select '{n}' detector, {_confusion(f'score < {c}')}, avg(case when label in ('error-3', 'click-5') then cast(score < {c} as int) end) minority from sc"
    for n, c in _CAND.items()) + f"), cd as ({_rates('cd0', 'detector, minority,')})"

_PROFILE = " union all ".join(f"""select '{c}' feature, count(distinct {c}) as "distinct", round(min({c}), 4) as min, round(max({c}), 4) as max, round(avg({c}), 4) mean,
  round(median({c}), 4) median, round(stddev_samp({c}), 4) std, count(*) filter ({c} = 0) zeros, round(count(*) filter ({c} = 0) * 100.0 / count(*), 4) zero_percent,
  count(*) filter ({c} is null) nulls, count(distinct {c}) <= 1 as constant from lineitem""" for c in _NUMBERS)

_HALF = "select *, l_returnflag rf from sl where split = 'train' and l_returnflag <> 'R'"

_AUDITED = """li as (select * replace (case when l_tax > 0.02 then l_tax end as l_tax) from lineitem),
  au as (select * from li union all select * from li where l_orderkey % 7 = 0
    union all select * replace (case when l_linestatus = 'O' then 'F' else 'O' end as l_linestatus) from li where l_orderkey % 14 = 0)"""
_EVENT_NAMES = ("ingest_seq", "ts", "time_label", "hour", "source_ip", "dest_ip", '"user"', "host", "action", "status", "port", "raw", "file")
_EVENT_KINDS = {c: "whole" if c in ("ingest_seq", "hour", "port") else "text" for c in _EVENT_NAMES}
_LINE_KINDS = {"l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_quantity": "real", "l_extendedprice": "real",
               "l_discount": "real", "l_tax": "real", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time", "ratio": "real"}


def _inspection(source: str, kinds: dict[str, str]) -> str:
    def one(c: str, kind: str) -> str:
        number = kind in ("whole", "real")
        text = f"replace(cast({c} as varchar), 'inf', 'Infinity')" if kind == "real" else f"cast({c} as varchar)"
        top = (f"(select string_agg(concat(v, '=', n), '|' order by n desc, v) from (select {text} v, count(*) n from src where {c} is not null "
               "group by all order by n desc, v limit 10))")
        numbers = (f"round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max, null::varchar as first, null::varchar as last, "
                   f"count(*) filter ({c} = 0) zeros, count(*) filter (isinf(cast({c} as double))) infinities" if number else
                   f"null::double as min, null::double as max, min(cast({c} as varchar)) as first, max(cast({c} as varchar)) as last, cast(0 as bigint) zeros, cast(0 as bigint) infinities")
        return (f"select '{c.strip(chr(34))}' feature, '{kind}' kind, count({c}) n, count(*) - count({c}) nulls, count(distinct {c}) as \"distinct\", {numbers}, {top} as top from src")
    return f"with src as (select * from {source}) " + " union all ".join(one(c, k) for c, k in kinds.items())


ORACLE = {
    "dataset_audit": f"""with {_AUDITED} select count(*) n_rows, (select count(*) from duckdb_columns() where table_name = 'lineitem') n_columns,
      count(*) filter (l_tax is null) null_cells, count(*) - (select count(*) from (select distinct * from au)) duplicate_rows from au""",
    "dataset_nulls": f"""with ev as ({events_sql()}) """ + " union all ".join(
        f"""select '{c.strip('"')}' feature, case (select any_value(typeof({c})) from ev) when 'BIGINT' then 'whole' when 'INTEGER' then 'whole' when 'VARCHAR' then 'text'
          else 'time' end as kind, count(*) - count({c}) nulls from ev""" for c in _EVENT_NAMES),
    "audit_by_file": f"""with {_AUDITED} select l_linestatus, count(*) n_rows, count(*) filter (l_tax is null) null_cells,
        count(*) - (select count(*) from (select distinct * from au) u where u.l_linestatus = au.l_linestatus) duplicate_rows from au group by l_linestatus
      union all select null, count(*), count(*) filter (l_tax is null), count(*) - (select count(*) from (select distinct * exclude (l_linestatus) from au)) from au""",
    "audit_labels": f"""with {_AUDITED} """ + " union all ".join(
        f"select l_linestatus, '{c}' feature, cast({c} as varchar) as value, count(*) n from au group by all" for c in ("l_returnflag", "l_linenumber", "l_tax")),
    "class_distribution": """with t as (select l_linestatus dataset, case when l_returnflag <> 'N' then 1 else 0 end label, l_returnflag category from lineitem)
      select dataset, 'class' as level, cast(label as varchar) as value, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (partition by dataset), 6) percent from t group by dataset, label
      union all select dataset, 'category', category, count(*), round(count(*) * 100.0 / sum(count(*)) over (partition by dataset), 6) from t group by dataset, category""",
    "numeric_profile": _PROFILE,
    "categorical_profile": "with l as (" + " union all ".join(f"select '{c}' feature, {c} as value from part" for c in ("p_brand", "p_type", "p_name")) + """),
      c as (select feature, value, count(*) n from l group by all)
      select feature, value, n, cast(row_number() over (partition by feature order by n desc, value) as bigint) as rank,
        count(*) over (partition by feature) as "distinct" from c qualify rank <= 15""",
    "constant_features": "select 'fixed' feature union all select 'absent'",
    "skewness_screen": "select 'value' feature, round(skewness(value), 5) skew from events union all select 'heavy', round(skewness(pow(value, 4)), 5) from events",
    "skewed_features": """select * from (select 'value' feature, round(skewness(value), 5) skew from events
      union all select 'heavy', round(skewness(pow(value, 4)), 5) from events) where abs(skew) > 3""",
    "feature_inspection": _inspection("(select *, case when l_tax = 0 then 'infinity'::double else round(1 / l_tax, 3) end ratio from lineitem)", _LINE_KINDS),
    "event_inspection": _inspection(f"(select * replace (strftime(ts, '%Y-%m-%d %H:%M:%S') as ts) from ({events_sql()}))", _EVENT_KINDS),
    "leakage_candidates": "select 'time_label' feature",
    "column_roles": """select column_name feature, case when column_name = 'l_returnflag' then 'label' when column_name = 'l_orderkey' then 'identifier'
      when data_type in ('VARCHAR', 'TIMESTAMP') then 'categorical' else 'numeric' end as role
      from (select column_name, data_type from duckdb_columns() where table_name = 'lineitem')""",
    "table_head": "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 5",
    "numeric_cleaning": """select event_id, v as number, round(case when v is not null then ln(1 + greatest(v, 0)) else 0 end, 6) logged from (
      select event_id, case when event_id % 9 > 2 then cast(event_id - 500 as double) end v from events)""",
    "attack_families": """select event_id, ['BENIGN', 'BENIGN', 'DoS/DDoS', 'DoS/DDoS', 'PortScan', 'BruteForce', 'WebAttack', 'Infiltration', 'Bot', 'Heartbleed', 'OtherAttack'][event_id % 11 + 1] flow_family,
      cast(event_id % 11 > 1 as bigint) flow_attack, ['normal', 'dos', 'probe', 'r2l', 'u2r', 'unknown'][event_id % 6 + 1] family, cast(event_id % 6 > 0 as bigint) attack,
      ['', 'T1498 T1499', 'T1595 T1046', 'T1110 T1078', 'T1068 T1548', ''][event_id % 6 + 1] techniques from events""",
    "default_fill": """select event_id, 'tcp' protocol_type, case when k % 5 = 0 then 'http' else 'other' end service, 'SF' flag,
      case when k % 3 = 0 then value else 0.0 end src_bytes, 1.0::double as count, 1.0::double same_srv_rate, 0.0::double hot from (select *, cast(json_extract_string(props, '$.k') as int) k from events)""",
    "flow_features": """select l_orderkey, l_partkey, cast(l_linenumber as bigint) l_linenumber, cast(p as bigint) engineered_packet_count, round(b, 8) engineered_byte_count,
      round(p / nullif(s, 0), 8) engineered_packets_per_second, round(b / nullif(s, 0), 8) engineered_bytes_per_second, round(l_linenumber / nullif(q, 0), 8) engineered_fwd_bwd_packet_ratio
      from (select *, cast(l_quantity % 4 as int) q, l_linenumber + cast(l_quantity % 4 as int) p, l_extendedprice + l_quantity b, (l_partkey % 5) * 1000 / 1000000.0::double s from lineitem)""",
    "traffic_features": f"with {_UNSW}, {_TRAFFIC} select {_KEYS}, " + ", ".join(
        f"round({c}, 8) {c}" if c != "connection_rate" else c for c in _ENGINEERED) + " from tr",
    "targeted_features": f"""with {_UNSW} select {_KEYS}, round(sbytes + dbytes, 8) total_bytes, round(spkts + dpkts, 8) total_packets, round(sbytes / (dbytes + 1), 8) byte_ratio,
      round(spkts / (dpkts + 1), 8) packet_ratio, round(sload / (dload + 1), 8) load_ratio, round((sloss + dloss) / (spkts + dpkts + 1), 8) loss_rate,
      ct_srv_src + ct_srv_dst + ct_dst_ltm + ct_src_ltm + ct_dst_src_ltm connection_activity, round(synack + ackdat + tcprtt, 8) tcp_handshake_time from un""",
    "feature_subsets": """select *, (select count(*) from region) n_regions from (values ('baseline_41', 41::bigint), ('behavioral', 25), ('minority_focused', 27),
      ('without_host_stats', 31), ('compact_hybrid', 29)) t(subset, n_features)""",
    "ablation_sets": f"with {_UNSW}, {_TRAFFIC} " + " union all ".join(
        f"select '{n}' feature_set, round(stddev_samp({' + '.join(('sbytes',) + cols)}), 2) spread from tr" for n, cols in _ABLATION.items()),
    "hash_split": f"select event_id, {_fit('event_id')} fit from events",
    "stratified_split": f"""select event_id, event_type family, row_number() over (partition by event_type order by {_hash('event_id')})
      <= ceil(0.8 * count(*) over (partition by event_type)) in_train from events""",
    "down_sample": f"""with {_SCORED} select event_id, true special from sc where label in ('error-3', 'click-5')
      union all select * from (select event_id, false from sc where label not in ('error-3', 'click-5') order by {_hash('event_id')}
        limit (select 3 * count(*) from sc where label in ('error-3', 'click-5')))""",
    "exact_sample": f"select event_id from events order by {_hash('event_id')} limit 3000",
    "day_roles": """select event_id, case dayname(ts) when 'Monday' then 'train' when 'Tuesday' then 'calibration' when 'Saturday' then null when 'Sunday' then null else 'test' end as role from events""",
    "one_hot_and_scale": f"""with {_SPLIT_LINES}, f as ({_HALF}), m as (select avg(l_quantity) a1, stddev_pop(l_quantity) s1, avg(l_extendedprice) a2, stddev_pop(l_extendedprice) s2,
        avg(l_discount) a3, stddev_pop(l_discount) s3, avg(l_tax) a4, stddev_pop(l_tax) s4, count(distinct rf) nf, count(distinct l_linestatus) ns, min(rf) rf1 from f)
      select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) l_linenumber, nf + ns + 4 width, cast(l_returnflag = rf1 as double) first_slot,
        round(case when l_returnflag in (select rf from f) then 1 else 0 end + case when l_linestatus in (select l_linestatus from f) then 1 else 0 end
          + (l_quantity - a1) / s1 + (l_extendedprice - a2) / s2 + (l_discount - a3) / s3 + (l_tax - a4) / s4, 4) total from lineitem cross join m""",
    "sparse_one_hot": f"""with {_SPLIT_LINES},
      s as (select * replace (case when l_linenumber <> 3 then l_returnflag end as l_returnflag, case when l_quantity <> 7 then l_tax end as l_tax) from sl),
      f as (select * from s where split = 'train'), md as (select median(l_tax) med from f),
      fm as (select l_returnflag top from f where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1),
      mo as (select avg(coalesce(l_tax, med)) a1, stddev_pop(coalesce(l_tax, med)) s1, avg(l_quantity) a2, stddev_pop(l_quantity) s2 from f cross join md),
      c as (select distinct 0 k, l_returnflag v from f where l_returnflag is not null union all select distinct 1, cast(l_partkey as varchar) from f
        union all select distinct 2, cast(l_suppkey as varchar) from f),
      q as (select k, v, row_number() over (order by k, v) - 1 slot from c), w as (select count(*) n from q)
      select l_orderkey, cast(l_linenumber as bigint) l_linenumber, n + 2 width, 2 + hits entries, coalesce(a.slot, b.slot, d.slot, n) flag_slot,
        cast(coalesce(a.slot, 0) + coalesce(b.slot, 0) + coalesce(d.slot, 0) + n + n + 1 as bigint) slot_sum,
        round(hits + (coalesce(l_tax, med) - a1) / s1 + (l_quantity - a2) / s2, 4) total
      from s cross join md cross join fm cross join mo cross join w left join q a on a.k = 0 and a.v = coalesce(l_returnflag, top)
        left join q b on b.k = 1 and b.v = cast(l_partkey as varchar) left join q d on d.k = 2 and d.v = cast(l_suppkey as varchar),
        lateral (select cast(a.slot is not null as bigint) + cast(b.slot is not null as bigint) + cast(d.slot is not null as bigint) hits) h""",
    "group_medians": f"with l as ({_LONG_LINES}) select l_returnflag, feature, round(median(value), 6) median from l group by all",
    "log_comparison": """select 'value' feature, round(skewness(value), 4) skew_before, round(skewness(ln(1 + value)), 4) skew_after from events
      union all select 'heavy', round(skewness(pow(value, 4)), 4), round(skewness(ln(1 + pow(value, 4))), 4) from events""",
    "dense_index": "select event_id * 7 + 3 ingest_seq, event_id event_index from events",
    "fpr_thresholds": f"with {_SCORED} " + " union all ".join(
        f"select 'fpr_{f * 100:g}pct' operating_point, round({f}::double, 6) target_fpr, round(quantile_cont(score, {f}), 6) threshold from sc where y = 0 and not fit"
        for f in TARGET_FPRS),
    "upper_tail_threshold": f"with {_SCORED}, {_PROB} select 'fpr_5pct' operating_point, 0.05::double target_fpr, round(quantile_cont(score, 0.95), 6) threshold from pr where y = 0 and not fit",
    "risk_bounds": f"""with {_SCORED} select round(quantile_cont(score, 0.01), 6) score_low, round(quantile_cont(score, 0.99), 6) score_high from (
      select score from sc where y = 0 and not fit union all select score from sc where y = 1)""",
    "detector_metrics": f"with {_SCORED}, m as (select {_confusion('score < 12.5')} from sc) {_rates('m')}",
    "auc": _auc(f"{_SCORED}, s as (select * from sc)"),
    "toxicity_auc": _auc("s as (select n_chars score, toxic y from documents join labels using (doc_id))"),
    "threshold_sweep": f"""with {_SCORED}, th as ({' union all '.join(
        f"select 'fpr_{f * 100:g}pct' operating_point, quantile_cont(score, {f}) threshold from sc where y = 0 and not fit" for f in TARGET_FPRS)}),
      w as (select operating_point, threshold, {_confusion('score < threshold')} from sc cross join th where not fit group by all)
      {_rates('w', 'operating_point, round(threshold, 6) threshold,')}""",
    "fixed_sweep": f"with {_SCORED}, {_PROB}, {_FIXED} select {_OP}, * from fx",
    "even_sweep": f"""with {_SCORED}, b as (select min(score) lo, max(score) hi from sc),
      th as (select concat('step_', i) operating_point, lo + (hi - lo) * i / 39 threshold from b, range(40) r(i)),
      w as (select operating_point, threshold, {_confusion('score < threshold')} from sc cross join th group by all)
      {_rates('w', 'operating_point, round(threshold, 6) threshold,')}""",
    "best_points": f"""with {_SCORED}, {_PROB}, {_FIXED} select 'best_f1' choice, * from (select {_OP}, threshold, precision, recall, f1, fpr from fx order by f1 desc, threshold limit 1)
      union all select 'closest_fpr', * from (select {_OP}, threshold, precision, recall, f1, fpr from fx order by abs(fpr - 0.05), threshold limit 1)""",
    "best_under_fpr_limits": f"""with {_SCORED}, {_PROB}, {_FIXED}, b as (select fpr_limit, {_OP}, threshold, precision, recall, f1, fpr
        from fx join (select unnest([0.05, 0.2, 0.3, 0.5]::double[]) fpr_limit) on fpr <= fpr_limit qualify row_number() over (partition by fpr_limit order by f1 desc, threshold) = 1)
      select * from b qualify row_number() over (partition by threshold order by fpr_limit) = 1""",
    "recall_by_family": f"""with {_SCORED} select family, count(*) total, count(*) filter (score < 12.5) detected, count(*) filter (score >= 12.5) missed,
      round(count(*) filter (score < 12.5) / count(*), 6) recall from sc where y = 1 group by family""",
    "recall_by_label": f"""with {_SCORED} select label, count(*) total, count(*) filter (score < 12.5) detected, round(count(*) filter (score < 12.5) / count(*), 6) recall,
      round(avg(score), 6) mean_score, round(median(score), 6) median_score from sc where y = 1 group by label order by count(*) filter (score < 12.5) / count(*), label limit 10""",
    "score_distribution": f"""with {_SCORED} select family, count(*) total, round(avg(score), 6) mean, min(score) as min, max(score) as max, round(median(score), 6) median from sc group by family""",
    "unseen_recall": f"""with {_SCORED} select count(*) n_rows, count(distinct label) n_labels, round(avg(cast(score < 12.5 as int)), 6) recall from sc
      where not fit and y = 1 and label not in (select label from sc where fit and label not in ('error-2', 'click-6'))""",
    "detector_comparison": f"with {_SCORED}, {_CANDS} select detector, precision, recall, f1, fpr from cd",
    "candidate_selection": f"""with {_SCORED}, {_CANDS} select detector, f1, round(minority, 6) minority from cd where detector in
      ((select detector from cd order by f1 desc, detector desc limit 1), (select detector from cd order by minority desc, detector desc limit 1), 'cut_15')""",
    "metric_deltas": f"""with {_SCORED}, {_CANDS.replace('round(', '(').replace(', 6)', ')')} select a.detector, round(a.precision - b.precision, 6) precision_delta, round(a.recall - b.recall, 6) recall_delta,
      round(a.f1 - b.f1, 6) f1_delta, round(a.fpr - b.fpr, 6) fpr_delta from cd a, cd b where a.detector <> 'cut_15' and b.detector = 'cut_15'""",
    "hybrid_and_or": f"""with {_SCORED}, h as (select *, label like '%3' or label like '%5' p2, score < 20 p1 from sc),
      m as (select 'and' detector, {_confusion('p1 and p2')} from h union all select 'or', {_confusion('p1 or p2')} from h) {_rates('m', 'detector,')}""",
    "score_histogram": f"""with {_SCORED}, b as (select min(score) lo, (max(score) - min(score)) / 60 w from sc)
      select cast(least(floor((score - lo) / w), 59) as bigint) bin, cast(y as bigint) y, count(*) n from sc, b group by all""",
    "roc_points": f"""with {_SCORED}, g as (select score, count(*) filter (y = 1) pos, count(*) filter (y = 0) neg from sc group by score)
      select round(score, 6) threshold, round(sum(neg) over w / sum(neg) over (), 6) fpr, round(sum(pos) over w / sum(pos) over (), 6) tpr from g window w as (order by score)""",
    "effect_sizes": f"""with l as ({_LONG_LINES}), a as (select l_returnflag, feature, avg(value) m, stddev_samp(value) s, median(value) d from l group by all),
      e as (select x.l_returnflag, x.feature, n.m normal_mean, x.m attack_mean, n.d normal_median, x.d attack_median, abs(x.m - n.m) / n.s effect_size, abs(x.d - n.d) median_difference
        from a x join a n on n.feature = x.feature and n.l_returnflag = 'N' where x.l_returnflag <> 'N')
      select l_returnflag, feature, round(normal_mean, 5) normal_mean, round(attack_mean, 5) attack_mean, round(normal_median, 5) normal_median, round(attack_median, 5) attack_median,
        round(effect_size, 5) effect_size, round(median_difference, 5) median_difference, cast(row_number() over (partition by l_returnflag order by effect_size desc, feature) as bigint) as rank
      from e qualify rank <= 3""",
    "numeric_shift": f"with {_SPLIT_LINES} " + " union all ".join(f"""select '{c}' feature, round(a, 5) first_mean, round(b, 5) second_mean, round(s, 5) first_std, round(t, 5) second_std,
      round(abs(a - b) / sqrt((s * s + t * t) / 2), 5) as shift from (select avg({c}) filter (split = 'train') a, avg({c}) filter (split = 'test') b,
      stddev_samp({c}) filter (split = 'train') s, stddev_samp({c}) filter (split = 'test') t from sl)""" for c in _NUMBERS),
    "categorical_shift": f"""with {_SPLIT_LINES}, l as (select split, 'l_returnflag' feature, l_returnflag as value from sl union all select split, 'l_suppkey', cast(l_suppkey as varchar) from sl),
      t as (select count(*) filter (split = 'train') a, count(*) filter (split = 'test') b from sl),
      c as (select feature, value, count(*) filter (split = 'train') first_n, count(*) filter (split = 'test') second_n from l group by all)
      select feature, value, first_n, second_n, round(first_n / a, 6) first_share, round(second_n / b, 6) second_share, round((second_n / b - first_n / a) * 100, 6) change_points from c, t""",
    "category_shares": """with l as (select l_returnflag f, 'l_linestatus' feature, l_linestatus as value from lineitem union all select l_returnflag, 'l_linenumber', cast(l_linenumber as varchar) from lineitem),
      t as (select l_returnflag f, count(*) n from lineitem group by 1), v as (select distinct feature, value from l), fam as (select unnest(['A', 'R']) family),
      c as (select f, feature, value, count(*) n from l group by all)
      select v.feature, v.value, family, round(coalesce(cn.n / (select n from t where f = 'N'), 0), 6) normal_share,
        round(coalesce(cf.n / (select n from t where t.f = family), 0), 6) family_share,
        round(abs(coalesce(cf.n / (select n from t where t.f = family), 0) - coalesce(cn.n / (select n from t where f = 'N'), 0)), 6) difference
      from v cross join fam left join c cn on cn.f = 'N' and cn.feature = v.feature and cn.value = v.value left join c cf on cf.f = family and cf.feature = v.feature and cf.value = v.value""",
    "score_shift": f"""with {_SCORED}, {_PROB} select case when fit then 'fit' else 'rest' end split, count(*) n, round(avg(score), 5) mean, round(stddev_samp(score), 5) std,
      round(min(score), 5) as min, round(max(score), 5) as max, """ + ", ".join(
        f"round(quantile_cont(score, {p}), 5) {n}" for n, p in (("p01", .01), ("p05", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95), ("p99", .99))) + " from pr where y = 0 group by fit",
    "split_fprs": f"""with {_SCORED}, {_PROB} select case when fit then 'fit' else 'rest' end split, threshold, round(avg(cast(score >= threshold as int)), 6) fpr
      from pr cross join (select unnest({list(CUTS)}::double[]) threshold) where y = 0 group by fit, threshold""",
}
