"""Detection rules over normalized events.

One aggregate per source address feeds all address rules, one per endpoint feeds the malware
rule. Both combine map-side, so an address holding a third of the rows shuffles a few partial
rows per task. Labels, sample events and ports are looked up only for the detections kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.functions.text import clamp, is_alert, non_empty, round_half_up

MALWARE_ACTIONS = ("malware_detected", "file_download")
BY_ADDRESS, BY_ENDPOINT = 0, 1


def is_failed_login() -> Column:
    by_status = (F.col("status") == "failed") & F.col("action").rlike("login|auth")
    return F.coalesce((F.col("action") == "failed_login") | by_status, F.lit(False))


def _acts(*actions: str) -> Column:
    return F.col("action").isin(*actions)


def endpoint_key() -> Column:
    return non_empty(F.coalesce("host", "source_ip"))


def ip_features(events: DataFrame) -> DataFrame:
    """Per source address: counts per activity, distinct ports, first position, alerts.

    Grouping by (address, port) first makes the distinct-port count exact without a distinct
    expansion and spreads one hot address over up to 65,536 keys.
    """
    seq = F.col("ingest_seq")
    alert = is_alert(F.col("status"))
    per_port = (
        events.where(F.length("source_ip") > 0)
        .groupBy("source_ip", "port")
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(is_failed_login()).alias("n_failed"),
            F.count_if(_acts("successful_login")).alias("n_success"),
            F.count_if(_acts("priv_escalation")).alias("n_priv"),
            F.count_if(_acts("dns_query")).alias("n_dns"),
            F.count_if(_acts("outbound_conn", "exfiltration")).alias("n_outbound"),
            F.count_if(alert).alias("n_alerts"),
            F.min(seq).alias("first_seq"),
            F.min(F.when(alert, seq)).alias("first_alert_seq"),
        )
    )
    counts = ("n_events", "n_failed", "n_success", "n_priv", "n_dns", "n_outbound", "n_alerts")
    return per_port.groupBy("source_ip").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.count("port").alias("n_ports"),
        F.min("first_seq").alias("first_seq"),
        F.min("first_alert_seq").alias("first_alert_seq"),
    )


def endpoint_features(events: DataFrame) -> DataFrame:
    """Per endpoint (host, else source address): malware and download counts."""
    return (
        events.where(_acts(*MALWARE_ACTIONS))
        .select(endpoint_key().alias("endpoint"), "action", "ingest_seq")
        .where(F.col("endpoint").isNotNull())
        .groupBy("endpoint")
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(F.col("action") == "malware_detected").alias("n_confirmed"),
            F.min("ingest_seq").alias("first_seq"),
        )
    )


def _address_rules() -> Column:
    failed, success, priv = F.col("n_failed"), F.col("n_success") > 0, F.col("n_priv") > 0
    brute = clamp(45.0, 72.0, F.lit(40.0) + failed * 1.5)
    account = F.when(success, clamp(70.0, 92.0, brute + 22)).otherwise(brute)
    server = F.when(priv, clamp(78.0, 97.0, account + 14)).otherwise(account)

    def rule(order: int, trigger: Column, kind: Column | str, title: Column | str, risk: Column) -> Column:
        as_col = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.when(
            trigger,
            F.struct(
                F.lit(order).alias("rule_order"), as_col(kind).alias("kind"), as_col(title).alias("title"),
                risk.cast("bigint").alias("risk"),
            ),
        )

    credential = failed >= fv.BRUTE_FORCE_MIN_FAILED
    return F.array_compact(F.array(
        rule(
            0, credential,
            F.when(success | priv, "compromise").otherwise("bruteforce"),
            F.when(priv, "Possible Server Compromise").when(success, "Possible Account Compromise")
            .otherwise("Brute-Force Attack"),
            round_half_up(server),
        ),
        rule(1, ~credential & priv & ~success, "privesc", "Unusual Privilege Escalation",
             clamp(30, 58, F.lit(30) + F.col("n_priv") * 6)),
        rule(2, F.col("n_ports") >= fv.PORT_SCAN_MIN_PORTS, "portscan", "Port Scan / Recon",
             clamp(45, 90, F.lit(42) + F.col("n_ports"))),
        rule(3, F.col("n_dns") >= fv.DNS_EXFIL_MIN_QUERIES, "dns_exfil", "Possible DNS Exfiltration",
             clamp(55, 88, F.lit(50) + F.col("n_dns"))),
        rule(4, F.col("n_outbound") >= fv.OUTBOUND_MIN_CONNECTIONS, "outbound", "Suspicious Outbound Activity",
             clamp(45, 78, F.lit(40) + F.col("n_outbound") * 2)),
    ))


_COUNTS = ("n_events", "n_failed", "n_success", "n_priv", "n_ports", "n_dns", "n_outbound", "n_confirmed")
DETECTION_COLUMNS = ("section", "key", "first_seq", "rule_order", "kind", "title", "risk") + _COUNTS


def detections(by_address: DataFrame, by_endpoint: DataFrame) -> DataFrame:
    """All detections of the address rules and the malware rule, one row each.

    Emission order (which breaks risk ties) is (section, first_seq, rule_order): addresses in
    order of first appearance, then endpoints likewise.
    """
    address = by_address.select("*", F.explode(_address_rules()).alias("r")).select(
        F.lit(BY_ADDRESS).alias("section"), F.col("source_ip").alias("key"), "first_seq",
        "r.rule_order", "r.kind", "r.title", "r.risk",
        *["n_events" if c == "n_events" else c for c in _COUNTS if c != "n_confirmed"],
        F.lit(0).cast("bigint").alias("n_confirmed"),
    )
    confirmed = F.col("n_confirmed")
    zero = F.lit(0).cast("bigint")
    endpoint = by_endpoint.where((confirmed > 0) | (F.col("n_events") >= fv.DOWNLOAD_MIN_EVENTS)).select(
        F.lit(BY_ENDPOINT).alias("section"), F.col("endpoint").alias("key"), "first_seq",
        F.lit(5).alias("rule_order"), F.lit("malware").alias("kind"),
        F.when(confirmed > 0, "Malware Detected").otherwise("Suspicious File Download").alias("title"),
        F.when(confirmed > 0, clamp(45, 75, F.lit(44) + confirmed * 6))
        .otherwise(clamp(30, 55, F.lit(30) + F.col("n_events") * 3)).cast("bigint").alias("risk"),
        "n_events", *[zero.alias(c) for c in _COUNTS if c not in ("n_events", "n_confirmed")], "n_confirmed",
    )
    return address.select(*DETECTION_COLUMNS).unionByName(endpoint.select(*DETECTION_COLUMNS))


def detect(events: DataFrame) -> DataFrame:
    return detections(ip_features(events), endpoint_features(events))


def rank_and_cap(found: DataFrame, cap: int = fv.MAX_INCIDENTS, first_id: int = fv.FIRST_INCIDENT_ID) -> DataFrame:
    """The ``cap`` riskiest detections with their incident id; ties keep emission order.

    The window runs after the top-k, over at most ``cap`` rows.
    """
    order = [F.desc("risk"), F.asc("section"), F.asc("first_seq"), F.asc("rule_order")]
    top = found.orderBy(*order).limit(cap)
    rank = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("rank", rank).withColumn("incident_id", (F.lit(first_id - 1) + F.col("rank")).cast("string"))


# ---- look-ups for kept detections -------------------------------------------


def _keyed(events: DataFrame, *columns: str) -> DataFrame:
    """Events once per group they belong to: their source address and, for malware, their endpoint."""
    keys = F.array_compact(F.array(
        F.when(F.length("source_ip") > 0,
               F.struct(F.lit(BY_ADDRESS).alias("section"), F.col("source_ip").alias("key"))),
        F.when(_acts(*MALWARE_ACTIONS) & endpoint_key().isNotNull(),
               F.struct(F.lit(BY_ENDPOINT).alias("section"), endpoint_key().alias("key"))),
    ))
    return events.select(*columns, F.explode(keys).alias("k")).select("k.section", "k.key", *columns)


def _side(kept: DataFrame, bounded: bool) -> DataFrame:
    """``kept`` is broadcast only when a configured cap bounds its rows."""
    return F.broadcast(kept) if bounded else kept


def target_labels(kept: DataFrame, events: DataFrame, bounded: bool) -> DataFrame:
    """Most frequent host, destination, user and source per kept group; ties go to the first seen."""
    groups = kept.select("section", "key").distinct()
    columns = ("ingest_seq", "action", "status", "host", "dest_ip", "user", "source_ip")
    slot = lambda name, label: F.struct(F.lit(name).alias("slot"), label.alias("label"))
    slots = F.array(
        slot("host", F.col("host")), slot("dest", F.col("dest_ip")), slot("user", F.col("user")),
        slot("failed_user", F.when(is_failed_login(), F.col("user"))), slot("source", F.col("source_ip")),
    )
    counted = (
        _keyed(events, *columns)
        .join(_side(groups, bounded), ["section", "key"])
        .select("section", "key", "ingest_seq", F.inline(slots))
        .where(F.length("label") > 0)
        .groupBy("section", "key", "slot", "label")
        .agg(F.count("*").alias("n"), F.min("ingest_seq").alias("seq"))
    )

    def top(slot: str) -> Column:
        mine = F.col("slot") == slot
        return F.max_by(F.when(mine, F.col("label")), F.when(mine, F.struct("n", -F.col("seq"))))

    return counted.groupBy("section", "key").agg(
        *[top(s).alias(f"top_{s}") for s in ("host", "dest", "user", "failed_user", "source")]
    )


def first_ports(kept: DataFrame, events: DataFrame, bounded: bool, shown: int = 6) -> DataFrame:
    """First distinct ports per address in input order. A port list holds at most 65,535 entries."""
    groups = kept.where(F.col("section") == BY_ADDRESS).select(F.col("key").alias("source_ip")).distinct()
    return (
        events.where(F.col("port").isNotNull()).select("source_ip", "port", "ingest_seq")
        .join(_side(groups, bounded), "source_ip")
        .groupBy("source_ip", "port").agg(F.min("ingest_seq").alias("seq"))
        .groupBy("source_ip")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("seq", "port"))), 1, shown).alias("p"))
        .select(F.lit(BY_ADDRESS).alias("section"), F.col("source_ip").alias("key"),
                F.col("p.port").alias("first_ports"))
    )


def sample_events(kept: DataFrame, events: DataFrame, bounded: bool, n: int = fv.SAMPLE_EVENTS) -> DataFrame:
    """First ``n`` events behind each kept detection.

    Credential attacks list failures, then successes, then privileged actions; an event that
    is two of these appears twice. ``row_number <= n`` is pruned inside each map task, so at
    most ``n`` rows per detection and task are shuffled.
    """
    groups = kept.select("section", "key", "rule_order", "kind", "incident_id")
    kind = F.col("kind")
    ranks = (
        F.when(kind.isin("compromise", "bruteforce"), F.array_compact(F.array(
            F.when(is_failed_login(), F.lit(0)), F.when(_acts("successful_login"), F.lit(1)),
            F.when(_acts("priv_escalation"), F.lit(2)),
        )))
        .when(kind == "privesc", F.when(_acts("priv_escalation"), F.array(F.lit(0))))
        .when(kind == "dns_exfil", F.when(_acts("dns_query"), F.array(F.lit(0))))
        .when(kind == "outbound", F.when(_acts("outbound_conn", "exfiltration"), F.array(F.lit(0))))
        .otherwise(F.array(F.lit(0)))
    )
    columns = ("ingest_seq", "action", "status", "time_label", "hour", "raw", "file", "host", "source_ip")
    members = (
        _keyed(events, *columns).join(_side(groups, bounded), ["section", "key"])
        .withColumn("class_rank", F.explode(ranks))
    )
    w = Window.partitionBy("incident_id").orderBy("class_rank", "ingest_seq")
    return members.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _factor(text: Column | str, weight: float, when: Column | None = None) -> Column:
    made = F.struct((F.lit(text) if isinstance(text, str) else text).alias("factor"), F.lit(weight).alias("weight"))
    return made if when is None else F.when(when, made)


def describe(kept: DataFrame, events: DataFrame, bounded: bool) -> DataFrame:
    """Kept detections with asset, account, techniques, weighted signals, entities and summary."""
    joined = (
        kept.join(target_labels(kept, events, bounded), ["section", "key"], "left")
        .join(first_ports(kept, events, bounded), ["section", "key"], "left")
    )
    kind, key = F.col("kind"), F.col("key")
    malware = kind == "malware"
    credential = kind.isin("compromise", "bruteforce")
    names_user = credential | (kind == "privesc")
    target_host = F.when(malware, key).otherwise(F.coalesce("top_host", "top_dest"))
    target_user = F.when(names_user, F.when(F.col("n_failed") > 0, F.col("top_failed_user")).otherwise(F.col("top_user")))
    base = joined.select(
        *kept.columns, "first_ports",
        target_host.alias("target_host"), target_user.alias("target_user"),
        F.when(malware, F.col("top_source")).otherwise(key).alias("source_ip"),
    )

    host, user, ip = F.col("target_host"), F.col("target_user"), F.col("source_ip")
    host_part = F.coalesce(_text(" on ", host), F.lit(""))
    success, priv = F.col("n_success") > 0, F.col("n_priv") > 0
    confirmed = F.col("n_confirmed")

    asset = (
        F.when(credential, F.coalesce(host, user, ip))
        .when(kind == "portscan", F.coalesce(host, F.lit("DMZ range")))
        .otherwise(F.coalesce(host, ip))
    )
    techniques = (
        F.when(credential, F.array_compact(F.array(
            F.lit("T1110"), F.when(success, F.lit("T1078")), F.when(priv, F.lit("T1068")))))
        .when(kind == "privesc", F.array(F.lit("T1548")))
        .when(kind == "portscan", F.array(F.lit("T1046")))
        .when(kind == "dns_exfil", F.array(F.lit("T1048"), F.lit("T1071")))
        .when(kind == "outbound", F.array(F.lit("T1048")))
        .otherwise(F.array(F.lit("T1204")))
    )
    signals = (
        F.when(credential, F.array_compact(F.array(
            _factor(_text(F.col("n_failed"), " failed logins from ", ip), 0.28),
            _factor("Repeated attempts in a short window", 0.12),
            _factor("Successful login after failed attempts", 0.24, success),
            _factor("Privileged command shortly after login", 0.2, priv),
            _factor(_text("Target is a monitored asset — ", host), 0.1, host.isNotNull()),
        )))
        .when(kind == "privesc", F.array(
            _factor(_text("Privilege escalation from ", ip), 0.4),
            _factor("No prior authentication baseline", 0.2)))
        .when(kind == "portscan", F.array(
            _factor(_text(F.col("n_ports"), " distinct ports probed"), 0.32),
            _factor("Single source touching many services", 0.16)))
        .when(kind == "dns_exfil", F.array(
            _factor(_text(F.col("n_dns"), " DNS queries in the window"), 0.3),
            _factor("Consistent with covert-channel exfiltration", 0.2)))
        .when(kind == "outbound", F.array(
            _factor(_text(F.col("n_outbound"), " outbound connections from ", ip), 0.3),
            _factor("Destinations outside the known baseline", 0.16)))
        .otherwise(F.array(
            _factor(F.when(confirmed > 0, _text(confirmed, " malware signature match(es)"))
                    .otherwise(_text(F.col("n_events"), " suspicious downloads")), 0.3),
            _factor(_text("Activity on endpoint ", key), 0.14)))
    )
    summary = (
        F.when(kind == "compromise", _text(
            "Brute-force attempts from ", ip, " were followed by a successful login", host_part,
            F.when(priv, ", then privileged activity").otherwise(""), "."))
        .when(kind == "bruteforce", _text(
            F.col("n_failed"), " failed login attempts from ", ip, " targeting ",
            F.coalesce(host, user, F.lit("multiple accounts")), "."))
        .when(kind == "privesc", _text(
            "Privilege escalation observed from ", ip, host_part, " without a matching login baseline."))
        .when(kind == "portscan", _text(
            F.col("n_ports"), " distinct ports probed from ", ip, " — reconnaissance against ",
            F.coalesce(host, F.lit("the environment")), "."))
        .when(kind == "dns_exfil", _text(
            "Unusually high DNS query volume from ", F.coalesce(host, ip),
            " — consistent with covert-channel exfiltration."))
        .when(kind == "outbound", _text(
            "Repeated outbound connections from ", F.coalesce(host, ip), " to external hosts."))
        .when(confirmed > 0, _text("Malicious file activity detected on ", key, "."))
        .otherwise(_text("Repeated suspicious file downloads on ", key, "."))
    )
    n_ports = F.col("n_ports")
    port_text = F.array_join(F.col("first_ports").cast("array<string>"), ", ")
    lists_ports = (credential | kind.isin("privesc", "portscan")) & (n_ports > 0)

    def entity(present: Column, kind_: str, label: Column, detail: Column | str, tone: str) -> Column:
        return F.when(present, F.struct(
            F.lit(kind_).alias("kind"), label.alias("label"),
            (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), F.lit(tone).alias("tone")))

    entities = F.array_compact(F.array(
        entity(ip.isNotNull(), "Source IP", ip, "Origin of the activity", "signal"),
        entity(host.isNotNull(), "Target asset", host, "Affected host", "caution"),
        entity(user.isNotNull(), "Account", user, "Targeted / used account", "ink"),
        entity(lists_ports, "Ports",
               F.when(n_ports > 6, _text(port_text, " +", n_ports - 6)).otherwise(port_text),
               _text(n_ports, " distinct port(s)"), "ink"),
    ))
    return base.select(
        "*", asset.alias("asset"), techniques.alias("mitre"), signals.alias("signals"),
        summary.alias("summary"), entities.alias("entities"),
    )
