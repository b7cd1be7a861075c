"""Registered log-side queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import sha256_short
from logwarden.operators import detect, incidents, reports
from logwarden.plans.analysis import Analysis
from logwarden.plans.driver_tables import events, table

RUN_LABEL = "2026-08-26 10:00 UTC"


def analysis(spark, sf_dir: str) -> Analysis:
    return Analysis(events(spark, sf_dir), run_label=RUN_LABEL)


def joined(name: str, separator: str = " | ") -> str:
    return f"array_join({name}, '{separator}') as {name}"


def whole(name: str) -> str:
    return f"cast({name} as bigint) as {name}"


def _described(spark, sf_dir) -> DataFrame:
    ev = events(spark, sf_dir)
    found = detect.detect(ev)
    return detect.describe(found, ev, bounded=False).selectExpr(
        "section", "key", "rule_order", "kind", "title", "risk", "asset", "target_host", "target_user", "source_ip",
        joined("mitre", " "), "summary")


def _incidents(spark, sf_dir) -> DataFrame:
    return analysis(spark, sf_dir).incidents.selectExpr(
        "incident_id", whole("rank"), "kind", "title", "asset", "risk", "severity", "status",
        joined("mitre", " "), "opened", "confidence", "assignee", "summary", "source_ip", "user as account")


def _files(spark, sf_dir) -> DataFrame:
    """Source files of the mapped events with their short digest, first seen first."""
    named = events(spark, sf_dir).groupBy("file").agg(F.min("ingest_seq").alias("ordinal"))
    return named.select(F.col("file").alias("name"), sha256_short(F.col("file")).alias("hash"), "ordinal")


def _evidence(spark, sf_dir) -> DataFrame:
    run = Analysis(events(spark, sf_dir), files=_files(spark, sf_dir), run_label=RUN_LABEL)
    return run.evidence.drop("ordinal")


def _neighbours(spark, sf_dir) -> DataFrame:
    run = analysis(spark, sf_dir)
    host = run.incidents.where("rank = 1").select(F.get(F.filter("entities", lambda e: e["kind"] == "Target asset"), F.lit(0))["label"])
    top = host.first()  # one row: the asset of the first incident
    return incidents.neighbours(run.edges, top[0] if top else "")


def _queue(spark, sf_dir) -> DataFrame:
    found = incidents.queue(analysis(spark, sf_dir).incidents, "Critical", "Investigating", " T1068 ")
    return found.select("incident_id", "title", "asset", "risk", "severity", "status")


def _profiles(n):
    def build(spark, sf_dir) -> DataFrame:
        rows = reports.user_profiles(events(spark, sf_dir), n)
        role = ["role"] if n else []
        return rows.selectExpr("user as account", *role, "risk", "current", joined("flags"))
    return build


def _script(spark, sf_dir) -> DataFrame:
    return analysis(spark, sf_dir).script.selectExpr(
        whole("position"), "question", "answer", joined("bullets"), "confidence", joined("sources"))


def _of(name: str, *columns):
    def build(spark, sf_dir) -> DataFrame:
        df = getattr(analysis(spark, sf_dir), name)
        return df.selectExpr(*columns) if columns else df
    return build


def _answers(spark, sf_dir) -> DataFrame:
    """Every conversation turn asked as a question of the scripted answers."""
    asked = table(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("question_id"),
        F.when(F.col("turn") == 0, F.lit("What should I investigate first?"))
        .when((F.col("turn") == 1) & (F.col("conv_id") % 2 == 0), "investigate FIRST").otherwise(F.col("text")).alias("question"))
    return reports.answer_questions(asked, analysis(spark, sf_dir).script).selectExpr("question_id", whole("position"), "how")


def _empty(spark, sf_dir) -> DataFrame:
    """A run over no events: the zeroed cards, dimensions and report."""
    run = Analysis(events(spark, sf_dir).where("ingest_seq < 0"), run_label=RUN_LABEL)
    cards = run.kpis.select(F.lit("card").alias("part"), F.col("label").alias("name"), "value")
    dims = run.health.select(F.lit("health").alias("part"), "name", "value")
    hours = run.activity.select(F.lit("activity").alias("part"), F.col("hour").alias("name"), (F.col("events") + F.col("alerts")).alias("value"))
    report = run.summary.select(F.lit("report").alias("part"), F.lit("mins").alias("name"), F.col("avg_response_mins").alias("value"))
    return cards.unionByName(dims).unionByName(hours).unionByName(report)


_POSITION = whole("position")

QUERIES = {
    "ip_features": lambda s, d: detect.ip_features(events(s, d)),
    "malware_endpoints": lambda s, d: detect.endpoint_features(events(s, d)),
    "detections": lambda s, d: detect.detect(events(s, d)),
    "detections_described": _described,
    "incidents": _incidents,
    "incident_samples": _of("samples", "incident_id", whole("sample_rank"), "ingest_seq",
                            "action", "status", "time_label", "raw"),
    "incident_timeline": _of("timeline", "incident_id", whole("step"), "time", "title", "detail", "tag"),
    "incident_risk_factors": _of("risk_factors", "incident_id", _POSITION, "factor", "round(weight, 6) as weight"),
    "incident_fallback_factors": lambda s, d: incidents.fallback_factors(analysis(s, d).incidents).select(
        "incident_id", "position", "factor", F.round("weight", 6).alias("weight")),
    "incident_evidence": _evidence,
    "incident_responses": _of("responses", "incident_id", _POSITION, "action", "impact", "requires_approval"),
    "incident_techniques": _of("techniques", "incident_id", _POSITION, "code", "tactic", "technique", "observed"),
    "incident_entities": _of("entities", "incident_id", _POSITION, "kind", "label", "detail", "tone"),
    "incident_edges": _of("edges"),
    "incident_neighbours": _neighbours,
    "incident_explanations": _of("explanations", "incident_id", "question", "answer", joined("bullets"), "confidence", joined("sources")),
    "incident_queue_search": _queue,
    "incident_counts": lambda s, d: incidents.queue_counts(analysis(s, d).incidents),
    "top_serious": lambda s, d: reports.top_serious(analysis(s, d).incidents).select("incident_id", "title", "asset", "risk", "severity"),
    "activity_series": lambda s, d: reports.activity_series(reports.event_cube(events(s, d))),
    "activity_peak": lambda s, d: reports.peak_hour(reports.activity_series(reports.event_cube(events(s, d)))),
    "activity_shares": lambda s, d: reports.display_shares(reports.activity_series(reports.event_cube(events(s, d)))).select(
        "hour", "events", F.round("share", 6).alias("share")),
    "event_totals": lambda s, d: reports.totals(reports.event_cube(events(s, d))),
    "top_threats": lambda s, d: reports.top_threats(reports.event_cube(events(s, d))).select("name", "count"),
    "attack_type_shares": _of("attack_types", "name", "value"),
    "hostile_ips": lambda s, d: reports.hostile_ips(detect.ip_features(events(s, d))).select("ip", "count", "alerts"),
    "threat_intel": _of("intel"),
    "asset_inventory": _of("assets", "name", "type", "criticality", "risk", "owner", "open_incidents"),
    "asset_counts": lambda s, d: reports.asset_counts(analysis(s, d).assets),
    "user_profiles": _profiles(4),
    "user_profiles_all": _profiles(None),
    "health_dimensions": _of("health"),
    "health_score": _of("score"),
    "technique_progression": _of("progression", "code", "tactic", "technique", "observed", "position"),
    "report_summary": _of("summary"),
    "top_techniques": _of("top_techniques", "code", "name", "count"),
    "notifications": _of("notifications", "title", "detail", "severity", "time"),
    "kpis": _of("kpis", "label", "value", joined("spark", ","), "tone"),
    "event_pool": lambda s, d: reports.event_pool(events(s, d)).drop("alert"),
    "analyst_script": _script,
    "suggestions": _of("suggestions", _POSITION, "question"),
    "run_meta": _of("meta", "generated_at", "event_count", "note"),
    "analyst_fallback": _of("fallback"),
    "top_incident": lambda s, d: reports.top_incident(analysis(s, d).incidents).select("incident_id", "title", "risk"),
    "question_answers": _answers,
    "empty_run": _empty,
    "action_counts": lambda s, d: reports.count_by(events(s, d), "action"),
}
