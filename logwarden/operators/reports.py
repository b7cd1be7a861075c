"""Aggregates and reports over events and incidents.

Event-sized inputs are reduced by one map-side-combined aggregate each; every later step works
on tables bounded by a configured top-k.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.functions.text import (
    DASH, asset_type, clamp, feed_status, is_alert, normalize_question, round_half_up, severity_from_risk,
)
from logwarden.operators.incidents import explanations, technique_catalog, technique_name



def _threat_label(action: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fv.THREAT_LABELS.items()))
    return F.try_element_at(known, action)


# ---- generic helpers --------------------------------------------------------


def count_by(df: DataFrame, key: str, seq: str = "ingest_seq") -> DataFrame:
    """Rows per key and first position; null and empty keys are skipped."""
    return df.where(F.length(key) > 0).groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))


def top_entries(counted: DataFrame, n: int, count: str = "n", first: str = "first_seq") -> DataFrame:
    """Largest ``n`` counts; ties go to the first seen. Runs as a distributed top-k."""
    return counted.orderBy(F.desc(count), F.asc(first)).limit(n)


# ---- activity, threats, totals ----------------------------------------------


def event_cube(events: DataFrame, index: str = "ingest_seq", strict: bool = True) -> DataFrame:
    """Counts by hour bucket, action and status: one shuffle feeds activity, threats and totals.

    Strict: rows without a valid hour spread over the buckets by ``index`` modulo 24 (``index``
    counts input rows from 0). Otherwise they share the bucket -1.
    """
    valid = F.col("hour").between(0, 23)
    spread = (F.col(index) % 24).cast("int") if strict else F.lit(-1)
    return events.groupBy(
        F.when(valid, F.col("hour")).otherwise(spread).alias("bucket"), "action", "status"
    ).agg(F.count("*").alias("n"), F.min("ingest_seq").alias("first_seq"))


def activity_series(cube: DataFrame) -> DataFrame:
    """24 hourly buckets with events and alerts, empty ones included."""
    spark = cube.sparkSession
    per_hour = cube.groupBy("bucket").agg(
        F.sum("n").alias("events"), F.sum(F.when(is_alert(F.col("status")), F.col("n"))).alias("alerts"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("bucket"))
    return hours.join(F.broadcast(per_hour), "bucket", "left").select(
        F.lpad(F.col("bucket").cast("string"), 2, "0").alias("hour"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("events"),
        F.coalesce("alerts", F.lit(0)).cast("bigint").alias("alerts"),
    )


def top_threats(cube: DataFrame, n: int = 5) -> DataFrame:
    counted = (
        cube.withColumn("name", _threat_label(F.col("action"))).where(F.col("name").isNotNull())
        .groupBy("name").agg(F.sum("n").alias("count"), F.min("first_seq").alias("first_seq"))
    )
    return top_entries(counted, n, "count")


def totals(cube: DataFrame) -> DataFrame:
    n, status = F.col("n"), F.col("status")
    zero = F.lit(0).cast("bigint")
    return cube.agg(
        F.coalesce(F.sum(n), zero).alias("n_events"),
        F.coalesce(F.sum(F.when(is_alert(status), n)), zero).alias("n_alerts"),
        F.coalesce(F.sum(F.when(status == "flagged", n)), zero).alias("n_flagged"),
    )


# ---- addresses, assets, users -----------------------------------------------


def hostile_ips(by_address: DataFrame, n: int = 6) -> DataFrame:
    """Addresses with most alerts; ties go to the address whose first alert came first."""
    return (
        by_address.where(F.col("n_alerts") > 0)
        .select(F.col("source_ip").alias("ip"), F.col("n_events").alias("count"), F.col("n_alerts").alias("alerts"),
                "first_alert_seq")
        .orderBy(F.desc("alerts"), F.asc("first_alert_seq")).limit(n)
    )


def threat_intel(hostile: DataFrame, run_label: str, n: int = 4) -> DataFrame:
    day = run_label.split(" ")[0] or DASH
    return hostile.orderBy(F.desc("alerts"), F.asc("first_alert_seq")).limit(n).select(
        F.col("ip").alias("value"), F.lit("IP").alias("kind"),
        F.when(F.col("alerts") >= 10, "Malicious").otherwise("Suspicious").alias("reputation"),
        clamp(60, 96, F.lit(55) + F.col("alerts") * 2).cast("bigint").alias("confidence"),
        F.col("count").alias("related"), F.lit(day).alias("first_seen"), F.lit(day).alias("last_seen"),
    )


def asset_inventory(events: DataFrame, found: DataFrame, n: int = 8) -> DataFrame:
    """Hosts of events and assets of incidents with risk and open incidents, riskiest ``n``.

    Incident rows join the host aggregate as extra input rows, so hosts shuffle once.
    """
    alert = F.when(is_alert(F.col("status")), 1).otherwise(0)
    none = F.lit(None).cast("bigint")
    from_events = events.where((F.length("host") > 0) & (F.col("host") != DASH)).select(
        F.col("host").alias("name"), alert.cast("bigint").alias("alerts"), F.col("ingest_seq").alias("seq"),
        none.alias("incident_risk"), none.alias("open"), none.alias("incident_rank"))
    from_incidents = found.where((F.length("asset") > 0) & (F.col("asset") != DASH)).select(
        F.col("asset").alias("name"), F.lit(0).cast("bigint").alias("alerts"), none.alias("seq"),
        F.col("risk").cast("bigint").alias("incident_risk"),
        F.when(F.col("status") != "Resolved", 1).otherwise(0).cast("bigint").alias("open"),
        F.col("rank").cast("bigint").alias("incident_rank"))
    risk = F.coalesce("incident_risk", clamp(8, 60, F.lit(15) + F.col("alerts") * 4)).cast("bigint")
    return (
        from_events.unionByName(from_incidents).groupBy("name").agg(
            F.sum("alerts").alias("alerts"), F.min("seq").alias("seq"), F.max("incident_risk").alias("incident_risk"),
            F.coalesce(F.sum("open"), F.lit(0)).cast("bigint").alias("open_incidents"),
            F.min("incident_rank").alias("incident_rank"))
        .withColumn("risk", risk)
        .orderBy(F.desc("risk"), F.asc_nulls_last("seq"), F.asc("incident_rank")).limit(n)
        .select("name", asset_type(F.col("name")).alias("type"), severity_from_risk(F.col("risk")).alias("criticality"),
                "risk", F.lit(DASH).alias("owner"), "open_incidents", "seq", "incident_rank")
    )


def asset_counts(assets: DataFrame) -> DataFrame:
    """Listed assets, and those with open incidents."""
    return assets.agg(F.count("*").alias("n_assets"), F.count_if(F.col("open_incidents") > 0).alias("n_with_open_incidents"))


def user_profiles(events: DataFrame, n: int | None = 4) -> DataFrame:
    """Failed, successful and privileged activity per account, riskiest ``n`` (all when None)."""
    failed, success, priv = F.col("failed"), F.col("success") > 0, F.col("privileged")
    after_brute = success & (failed >= 5)
    profiled = (
        events.where(F.length("user") > 0).groupBy("user").agg(
            F.count("*").alias("n_events"), F.count_if(F.col("status") == "failed").alias("failed"),
            F.count_if(F.col("action") == "successful_login").alias("success"),
            F.count_if(F.col("action") == "priv_escalation").alias("privileged"),
            F.min("ingest_seq").alias("first_seq"))
        .select(
            "user", F.lit(DASH).alias("role"),
            clamp(8, 96, failed * 5 + priv * 16 + F.when(after_brute, 22).otherwise(0)).cast("bigint").alias("risk"),
            F.lit("Derived from normal activity in the uploaded window").alias("baseline"),
            F.concat(F.col("n_events").cast("string"), F.lit(" events · "), failed.cast("string"),
                     F.lit(" failed · "), priv.cast("string"), F.lit(" privileged")).alias("current"),
            F.array_compact(F.array(
                F.when(failed >= 5, "Repeated login failures"), F.when(priv > 0, "Privilege use"),
                F.when(after_brute, "Login after brute force"))).alias("flags"),
            "first_seq",
        )
    )
    return profiled if n is None else profiled.orderBy(F.desc("risk"), F.asc("first_seq")).limit(n)


# ---- posture ----------------------------------------------------------------


def health_dimensions(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """Six clamped posture values; risky users are counted among the retained profiles."""
    counts = found.agg(
        F.count_if(F.col("severity") == "Critical").alias("crit"), F.count_if(F.col("severity") == "High").alias("high"),
        F.count_if(F.col("status") != "Resolved").alias("open"),
        F.count_if(F.array_contains("mitre", "T1204")).alias("endpoint"))
    risky = profiles.agg(F.count_if(F.col("risk") >= 60).alias("risky"))
    value = lambda lo, hi, start, c, step: clamp(lo, hi, F.lit(start) - F.col(c) * step).cast("bigint")
    dims = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), v.alias("value"))
        for i, (name, v) in enumerate((
            ("Threat Detection", value(55, 95, 92, "crit", 3)), ("Incident Response", value(45, 95, 90, "open", 3)),
            ("User Risk", value(40, 95, 92, "risky", 10)), ("Network Security", value(45, 95, 88, "high", 4)),
            ("Endpoint Security", value(45, 95, 88, "endpoint", 6)), ("Vulnerabilities", value(50, 92, 85, "crit", 4)),
        ), 1)
    ])
    return counts.crossJoin(F.broadcast(risky)).select(F.inline(dims))


def health_score(dimensions: DataFrame) -> DataFrame:
    return dimensions.agg(round_half_up(F.sum("value") / F.count("*")).cast("bigint").alias("score"))


def technique_progression(found: DataFrame) -> DataFrame:
    """Observed techniques in kill-chain order, then likely next ones not yet observed."""
    spark = found.sparkSession
    observed = found.select(F.explode("mitre").alias("code"), "rank").groupBy("code").agg(F.min("rank").alias("first"))
    order = F.array_position(F.array(*[F.lit(c) for c in fv.KILL_CHAIN_ORDER]), F.col("code")).cast("int")
    following = spark.createDataFrame(
        [(c, i) for i, c in enumerate(fv.LIKELY_NEXT_TECHNIQUES)], "code string, position int"
    ).join(F.broadcast(observed), "code", "left_anti")
    steps = observed.select("code", F.lit(True).alias("observed"), order.alias("position")).unionByName(
        following.select("code", F.lit(False).alias("observed"), (F.col("position") + 1000).alias("position")))
    return steps.join(F.broadcast(technique_catalog(spark)), "code", "left").select(
        "code", F.coalesce("tactic", F.lit("Technique")).alias("tactic"),
        F.coalesce("technique", "code").alias("technique"), "observed", "position")


def report_summary(found: DataFrame, totals_: DataFrame, score: DataFrame, label: str = "") -> DataFrame:
    crit = found.agg(F.count_if(F.col("severity") == "Critical").alias("critical"))
    alerts = F.col("n_alerts")
    false_positive = F.when(alerts > 0, round_half_up(F.col("n_flagged") / alerts * 22)).otherwise(0)
    return totals_.crossJoin(F.broadcast(crit)).crossJoin(F.broadcast(score)).select(
        F.lit(label or "Uploaded logs").alias("window"), F.col("n_events").alias("total_events"),
        F.col("n_alerts").alias("total_alerts"), F.col("critical").alias("critical_incidents"),
        clamp(0, 30, false_positive).cast("bigint").alias("false_positive_rate"),
        clamp(4, 30, F.lit(6) + F.col("critical") * 2).cast("bigint").alias("avg_response_mins"),
        F.col("score").alias("security_score"),
    )


def attack_type_shares(threats: DataFrame) -> DataFrame:
    """Top threats as whole percentages of their sum (at most a top-k of rows)."""
    total = F.sum("count").over(Window.partitionBy())
    return threats.select(
        "name", round_half_up(F.col("count") / F.greatest(total, F.lit(1)) * 100).cast("bigint").alias("value"),
        "count", "first_seq")


def top_techniques(found: DataFrame, n: int = 3) -> DataFrame:
    counted = (
        found.select("rank", F.posexplode("mitre").alias("i", "code"))
        .groupBy("code").agg(F.count("*").alias("count"), F.min(F.struct("rank", "i")).alias("first_seq"))
    )
    return top_entries(counted, n, "count").select("code", technique_name(F.col("code")).alias("name"), "count", "first_seq")


def notifications(found: DataFrame, hostile: DataFrame, n: int = 4, n_incidents: int = 3) -> DataFrame:
    serious = (
        found.where(F.col("severity").isin("Critical", "High")).orderBy("rank").limit(n_incidents)
        .select(
            F.col("rank").cast("int").alias("position"),
            F.concat("severity", F.lit(" incident #"), "incident_id").alias("title"),
            F.concat("title", F.lit(" · "), "asset", F.lit(" · Risk "), F.col("risk").cast("string")).alias("detail"),
            "severity", F.col("opened").alias("time"))
    )
    first_opened = found.agg(F.min_by("opened", "rank").alias("first_opened"))
    match = (
        hostile.orderBy(F.desc("alerts"), F.asc("first_alert_seq")).limit(1).crossJoin(F.broadcast(first_opened))
        .select(
            F.lit(1 << 30).alias("position"), F.lit("Threat-intel match").alias("title"),
            F.concat("ip", F.lit(" flagged across "), F.col("alerts").cast("string"), F.lit(" alerts")).alias("detail"),
            F.lit("High").alias("severity"), F.coalesce("first_opened", F.lit(DASH)).alias("time"))
    )
    return serious.unionByName(match).orderBy("position").limit(n)


def ramp(total: Column) -> Column:
    """Six rounded steps up to ``total``; five zeros when it is zero."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: round_half_up(total * i / 6))
    return F.when(total <= 0, F.array_repeat(F.lit(0).cast("bigint"), 5)).otherwise(steps)


def kpis(activity: DataFrame, found: DataFrame, totals_: DataFrame) -> DataFrame:
    series = activity.agg(F.array_sort(F.collect_list(F.struct("hour", "events", "alerts"))).alias("s"))
    counts = found.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Critical").alias("crit"))
    card = lambda i, label, value, spark_, tone: F.struct(
        F.lit(i).alias("position"), F.lit(label).alias("label"), value.cast("bigint").alias("value"),
        spark_.cast("array<bigint>").alias("spark"), F.lit(tone).alias("tone"))
    cards = F.array(
        card(1, "Events parsed", F.col("n_events"), F.col("s.events"), "ink"),
        card(2, "Alerts", F.col("n_alerts"), F.col("s.alerts"), "caution"),
        card(3, "Incidents", F.col("n"), ramp(F.col("n")), "signal"),
        card(4, "Critical", F.col("crit"), ramp(F.col("crit")), "signal"),
    )
    return totals_.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(series)).select(F.inline(cards))


def event_pool(events: DataFrame, n: int = 16) -> DataFrame:
    """Alerts first, then input order."""
    alert = is_alert(F.col("status"))
    return (
        events.select(
            "ingest_seq", F.coalesce("source_ip", F.lit(DASH)).alias("source_ip"),
            F.coalesce("host", "dest_ip", F.lit(DASH)).alias("asset"), F.col("action").alias("type"),
            feed_status(F.col("status")).alias("status"), alert.alias("alert"))
        .orderBy(F.desc("alert"), F.asc("ingest_seq")).limit(n)
    )


def peak_hour(activity: DataFrame) -> DataFrame:
    """Busiest hour (first on ties) and each hour's share of the maximum is events / peak_events."""
    return activity.agg(
        F.max_by("hour", F.struct(F.col("events"), -F.col("hour").cast("int"))).alias("peak_hour"),
        F.max("events").alias("peak_events"), F.min("events").alias("low_events"), F.max("alerts").alias("peak_alerts"))


def display_shares(activity: DataFrame) -> DataFrame:
    top = activity.agg(F.max("events").alias("m"))
    return activity.crossJoin(F.broadcast(top)).select(
        "hour", "events", F.coalesce(F.try_divide(F.col("events"), F.col("m")), F.lit(0.0)).alias("share"))


# ---- views ------------------------------------------------------------------


def top_incident(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("risk"), "rank").limit(1)


def top_serious(found: DataFrame, n: int = 5) -> DataFrame:
    return found.where(F.col("severity").isin("Critical", "High")).orderBy(F.desc("risk"), "rank").limit(n)


# ---- analyst questions ------------------------------------------------------


def analyst_script(found: DataFrame, hostile: DataFrame) -> DataFrame:
    """Scripted questions and answers built from the incidents and the top hostile address."""
    top = F.col("rank") == 1
    # On ties of risk the ranks keep their order, so rank 1 is the first incident.
    why = explanations(found).where(top).select(
        F.lit(1).alias("position"), "question", "answer", "bullets", F.col("confidence").cast("bigint").alias("confidence"),
        "sources", "incident_ref")

    def ordered(text: Column, keep: Column, n: int) -> Column:
        rows = F.collect_list(F.when(keep, F.struct(F.col("rank").alias("rank"), text.alias("text"))))
        return F.slice(F.array_sort(rows), 1, n)["text"]

    n_inc = F.col("n_incidents").cast("string")
    line = F.concat(F.lit("#"), "incident_id", F.lit(" · "), "asset", F.lit(" · Risk "), F.col("risk").cast("string"),
                    F.lit(" — "), "title")
    first = (
        found.agg(F.count("*").alias("n_incidents"), ordered(line, F.lit(True), 3).alias("bullets"),
                  F.min_by("incident_id", "rank").alias("incident_ref"))
        .where(F.col("n_incidents") > 0)
        .select(
            F.lit(2).alias("position"), F.lit("What should I investigate first?").alias("question"),
            F.concat(F.lit("Prioritise by risk. "), n_inc,
                     F.lit(" incident(s) were detected in this data; start with the highest-risk items.")).alias("answer"),
            "bullets", F.lit(82).cast("bigint").alias("confidence"),
            F.array(F.lit("Incident queue"), F.lit("Risk ranking")).alias("sources"), "incident_ref")
    )
    lead = found.agg(F.min_by(F.element_at("mitre", 1), "rank").alias("lead_code"))
    has = F.array_contains("mitre", F.col("lead_code"))
    tech_line = F.concat(F.lit("#"), "incident_id", F.lit(" · "), "asset", F.lit(" — "), "title")
    related = (
        found.crossJoin(F.broadcast(lead)).groupBy("lead_code")
        .agg(F.count_if(has).alias("n"), ordered(tech_line, has, 4).alias("bullets"))
        .select(
            F.lit(3).alias("position"),
            F.concat(F.lit("Show all attacks related to "), "lead_code").alias("question"),
            F.concat("lead_code", F.lit(" ("), technique_name(F.col("lead_code")), F.lit(") appears in "),
                     F.col("n").cast("string"), F.lit(" incident(s) in this dataset.")).alias("answer"),
            "bullets", F.lit(85).cast("bigint").alias("confidence"), F.array(F.lit("MITRE mapping")).alias("sources"),
            F.lit(None).cast("string").alias("incident_ref"))
    )
    worst = hostile.orderBy(F.desc("alerts"), F.asc("first_alert_seq")).limit(1)
    mentions = F.contains(F.col("summary"), F.col("ip"))
    linked = F.concat(F.lit("Linked to incident #"), "incident_id", F.lit(" — "), "title")
    alerts, count = F.col("alerts").cast("string"), F.col("count").cast("string")
    activity = (
        worst.join(F.broadcast(found.select("rank", "incident_id", "title", "summary")), mentions, "left")
        .groupBy("ip", "alerts", "count")
        .agg(ordered(linked, F.col("rank").isNotNull(), 2).alias("links"))
        .select(
            F.lit(4).alias("position"), F.concat(F.lit("Show all activity from "), "ip").alias("question"),
            F.concat("ip", F.lit(" is the most active hostile source in this data, tied to "), alerts,
                     F.lit(" alert(s) across "), count, F.lit(" event(s).")).alias("answer"),
            F.concat(F.array(F.concat(count, F.lit(" total events, "), alerts, F.lit(" flagged or failed"))),
                     F.col("links")).alias("bullets"),
            F.lit(88).cast("bigint").alias("confidence"), F.array(F.concat(F.lit("Events from "), "ip")).alias("sources"),
            F.lit(None).cast("string").alias("incident_ref"))
    )
    return why.unionByName(first).unionByName(related).unionByName(activity)


def suggestions(found: DataFrame, hostile: DataFrame) -> DataFrame:
    asked = analyst_script(found, hostile).select("position", "question")
    always = found.sparkSession.range(1).select(
        F.lit(2).alias("position"), F.lit("What should I investigate first?").alias("question"))
    moved = F.when(F.col("position") == 3, 4).when(F.col("position") == 4, 3).otherwise(F.col("position"))
    return asked.unionByName(always).distinct().select(moved.alias("position"), "question")


def answer_questions(questions: DataFrame, script: DataFrame) -> DataFrame:
    """Best scripted turn per question: exact text, else containment, else token overlap.

    ``questions`` has question_id and question. The script is a handful of turns, so it travels
    as one array inside every question row: no pair rows and no shuffle. ``position`` is null
    for the fallback.
    """
    hay = normalize_question(F.concat_ws(
        " ", F.coalesce("question", F.lit("")), "answer", F.array_join("bullets", " "),
        F.coalesce("incident_ref", F.lit("")), F.array_join("sources", " ")))
    turns = script.agg(F.array_sort(F.collect_list(F.struct(
        "position", normalize_question(F.coalesce("question", F.lit(""))).alias("nq"), hay.alias("hay")))).alias("turns"))
    q = F.col("nq")
    first = lambda keep: F.get(F.filter("turns", keep), F.lit(0))["position"]
    tokens = F.filter(F.split(q, " "), lambda t: F.length(t) >= 3)
    overlap = lambda t: F.size(F.filter(F.col("tokens"), lambda w: F.contains(t["hay"], w)))
    scored = F.array_sort(F.transform("turns", lambda t: F.struct(
        (-overlap(t)).alias("miss"), t["position"].alias("position"))))
    best = F.get(F.filter(scored, lambda s: s["miss"] < 0), F.lit(0))["position"]
    asked = questions.withColumn("nq", normalize_question(F.col("question"))).withColumn("tokens", tokens)
    exact = first(lambda t: t["nq"] == q)
    partial = first(lambda t: (t["nq"] != "") & (F.contains(t["nq"], q) | F.contains(q, t["nq"])))
    return asked.crossJoin(F.broadcast(turns)).select(
        "question_id", F.when(q == "", F.lit(None)).otherwise(F.coalesce(exact, partial, best)).alias("position"),
        F.when(q == "", "fallback").when(exact.isNotNull(), "exact").when(partial.isNotNull(), "partial")
        .when(best.isNotNull(), "overlap").otherwise("fallback").alias("how"))


def analyst_fallback(found: DataFrame) -> DataFrame:
    """The answer given when no scripted turn fits."""
    n = F.col("n")
    some = F.concat(
        F.lit("I can explain any of the "), n.cast("string"),
        F.lit(" detected incident(s), rank them by risk, or trace a MITRE technique through this dataset. Try a suggested "
              "question, or ask about a specific incident, IP, or asset."))
    none = F.lit("No incidents were detected in this data. I can still summarise the events — ask about a specific IP, user, or asset.")
    return found.agg(F.count("*").alias("n")).select(F.when(n > 0, some).otherwise(none).alias("answer"))


# ---- empty input ------------------------------------------------------------

EMPTY_NOTE = "No events could be parsed from this source."
EMPTY_ANSWER = ("No events were parsed from this source, so there's nothing to investigate yet. Upload log files or connect a URL "
                "from Data Sources to get started.")


def zeroed(values: DataFrame, *columns: str) -> DataFrame:
    """The same rows with the named numbers at 0, for a run without events."""
    return values.withColumns({c: F.lit(0).cast("bigint") for c in columns})



def empty_activity(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(
        F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"), F.lit(0).cast("bigint").alias("events"),
        F.lit(0).cast("bigint").alias("alerts"))
