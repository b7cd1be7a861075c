"""Ranked incidents and their detail tables, all keyed by ``incident_id``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.functions.text import (
    DASH, clamp, humanize_action, non_empty, round_half_up, severity_from_risk, status_from_severity, truncate,
)

NO_HOUR = 99


def technique_tactic(code: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(c), F.lit(t[0])) for c, t in fv.TECHNIQUE_CATALOG.items()))
    return F.coalesce(F.try_element_at(known, code), F.lit("Technique"))


def technique_name(code: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(c), F.lit(t[1])) for c, t in fv.TECHNIQUE_CATALOG.items()))
    return F.coalesce(F.try_element_at(known, code), code)


def technique_catalog(spark: SparkSession) -> DataFrame:
    rows = [(c, t, n) for c, (t, n) in fv.TECHNIQUE_CATALOG.items()]
    return spark.createDataFrame(rows, "code string, tactic string, technique string")


def opened_labels(samples: DataFrame) -> DataFrame:
    """Earliest time label among the sampled events, by hour; missing hours sort last."""
    return (
        samples.where(F.length("time_label") > 0)
        .groupBy("incident_id")
        .agg(F.min_by("time_label", F.struct(F.coalesce("hour", F.lit(NO_HOUR)), F.col("sample_rank"))).alias("opened"))
    )


def incidents(described: DataFrame, samples: DataFrame, lead_assignee: str = "Unassigned") -> DataFrame:
    severity = severity_from_risk(F.col("risk"))
    return (
        described.join(opened_labels(samples), "incident_id", "left")
        .withColumn("severity", severity)
        .select(
            "incident_id", "rank", "kind", "title", "asset", "risk", "severity",
            status_from_severity(F.col("severity")).alias("status"), "mitre",
            F.coalesce("opened", F.lit(DASH)).alias("opened"),
            clamp(52, 95, F.lit(58) + round_half_up(F.col("risk") / 5)).cast("bigint").alias("confidence"),
            F.when(F.col("rank") == 1, lead_assignee).otherwise("Unassigned").alias("assignee"),
            "summary", "source_ip", F.col("target_user").alias("user"), "signals", "entities",
        )
    )


def step_tag(action: Column, status: Column) -> Column:
    return (
        F.when(action == "malware_detected", "INTEL")
        .when((action == "priv_escalation") | status.isin("failed", "flagged"), "RULE")
        .otherwise("DETECT")
    )


def timelines(found: DataFrame, samples: DataFrame) -> DataFrame:
    """First five sampled events by hour, then the step that opened the incident."""
    w = Window.partitionBy("incident_id").orderBy(F.coalesce("hour", F.lit(NO_HOUR)), "sample_rank")
    steps = (
        samples.withColumn("step", F.row_number().over(w)).where(F.col("step") <= fv.TIMELINE_EVENTS)
        .join(F.broadcast(found.select("incident_id", "opened")), "incident_id")
        .select(
            "incident_id", "step", F.coalesce("time_label", "opened").alias("time"),
            humanize_action(F.col("action")).alias("title"), truncate(F.col("raw"), 96).alias("detail"),
            step_tag(F.col("action"), F.col("status")).alias("tag"),
        )
    )
    opening = found.select(
        "incident_id", F.lit(fv.TIMELINE_EVENTS + 1).alias("step"), F.col("opened").alias("time"),
        F.concat(F.lit("Incident #"), "incident_id", F.lit(" opened")).alias("title"),
        F.concat("title", F.lit(" — risk "), F.col("risk").cast("string"), F.lit("/100.")).alias("detail"),
        F.lit("INCIDENT").alias("tag"),
    )
    return steps.unionByName(opening)


def normalized_factors(signals: Column) -> Column:
    """Weights as shares of their sum to two decimals, largest first, ties in given order."""
    total = F.aggregate(signals, F.lit(0.0), lambda acc, s: acc + s["weight"])
    share = lambda s: F.when(total > 0, round_half_up(s["weight"] / total * 100) / 100).otherwise(s["weight"])
    shares = F.transform(signals, lambda s, i: F.struct(
        (-share(s)).alias("order"), i.alias("position"), s["factor"].alias("factor"), share(s).alias("weight")))
    return F.transform(F.array_sort(shares), lambda s: F.struct(s["factor"].alias("factor"), s["weight"].alias("weight")))


def risk_factors(found: DataFrame) -> DataFrame:
    return found.select("incident_id", F.posexplode(normalized_factors(F.col("signals"))).alias("position", "f")).select(
        "incident_id", (F.col("position") + 1).alias("position"), "f.factor", "f.weight")


def fallback_factors(found: DataFrame) -> DataFrame:
    """Factors derived from severity, confidence, asset and technique count, where none were authored."""
    weight = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fv.SEVERITY_FACTOR_WEIGHTS.items()))
    n = F.size("mitre")
    factor = lambda text, w: F.struct(text.alias("factor"), w.cast("double").alias("weight"))
    factors = F.array(
        factor(F.concat("severity", F.lit(" severity classification")), F.try_element_at(weight, F.col("severity"))),
        factor(F.concat(F.lit("Model confidence "), F.col("confidence").cast("string"), F.lit("%")),
               F.col("confidence") / 100 * 0.3),
        factor(F.concat(F.lit("Target asset — "), "asset"), F.lit(0.2)),
        factor(F.concat(n.cast("string"), F.lit(" technique(s) mapped")), F.lit(0.1) + n * 0.03),
    )
    return found.select("incident_id", F.posexplode(factors).alias("position", "f")).select(
        "incident_id", (F.col("position") + 1).alias("position"), "f.factor", "f.weight")


def evidence(found: DataFrame, samples: DataFrame, files: DataFrame, run_label: str) -> DataFrame:
    """Files behind the sampled events, else the first file; ``files`` has name, hash, ordinal."""
    captured = run_label.split(" ")[1] if " " in run_label else run_label
    contributing = samples.select("incident_id", F.col("file").alias("name")).distinct()
    matched = files.join(F.broadcast(contributing), "name").select("incident_id", "name", "hash", "ordinal")
    first = files.orderBy("ordinal").limit(1)
    unmatched = (
        found.select("incident_id").join(matched, "incident_id", "left_anti").crossJoin(F.broadcast(first))
        .select("incident_id", "name", "hash", "ordinal")
    )
    return matched.unionByName(unmatched).select(
        "incident_id", "name", F.lit("Uploaded log").alias("kind"), "hash", F.lit(captured).alias("captured"),
        F.lit(True).alias("verified"), "ordinal",
    )


def response_actions(found: DataFrame) -> DataFrame:
    """Recommended actions per incident from the playbook; entries needing a missing field are left out."""
    def entry(kinds, text, impact, approval, needs):
        filled = F.lit(text)
        for field, value in (("{ip}", F.coalesce("source_ip", F.lit(""))), ("{user}", F.coalesce("user", F.lit(""))),
                             ("{asset}", F.coalesce("asset", F.lit(""))), ("{id}", F.col("incident_id"))):
            if field in text:
                filled = F.replace(filled, F.lit(field), value)
        applies = F.col("kind").isin(*kinds)
        if needs:
            applies &= F.col({"ip": "source_ip", "user": "user"}[needs]).isNotNull()
        return F.when(applies, F.struct(
            filled.alias("action"), F.lit(impact).alias("impact"), F.lit(approval).alias("requires_approval")))

    actions = F.array_compact(F.array(*[entry(*p) for p in fv.PLAYBOOK]))
    return found.select("incident_id", F.posexplode(actions).alias("position", "a")).select(
        "incident_id", (F.col("position") + 1).alias("position"), "a.action", "a.impact", "a.requires_approval")


def technique_chain(found: DataFrame) -> DataFrame:
    """Techniques per incident with tactic and name; unknown codes keep their code."""
    catalog = F.broadcast(technique_catalog(found.sparkSession))
    return (
        found.select("incident_id", F.posexplode("mitre").alias("position", "code"))
        .join(catalog, "code", "left")
        .select(
            "incident_id", (F.col("position") + 1).alias("position"), "code",
            F.coalesce("tactic", F.lit("Technique")).alias("tactic"),
            F.coalesce("technique", "code").alias("technique"), F.lit(True).alias("observed"),
        )
    )


def entities(found: DataFrame) -> DataFrame:
    return found.select("incident_id", F.posexplode("entities").alias("position", "e")).select(
        "incident_id", (F.col("position") + 1).alias("position"), "e.kind", "e.label", "e.detail", "e.tone")


def explanations(found: DataFrame) -> DataFrame:
    bullets = F.transform(normalized_factors(F.col("signals")), lambda f: F.concat(
        f["factor"], F.lit(" ("), round_half_up(f["weight"] * 100).cast("string"), F.lit("%)")))
    sources = F.array_compact(F.array(
        F.concat(F.lit("Incident #"), "incident_id", F.lit(" timeline")),
        F.concat(F.lit("Source "), non_empty(F.col("source_ip"))),
        F.concat(F.lit("MITRE "), F.array_join("mitre", " / ")),
    ))
    return found.select(
        "incident_id", "rank",
        F.concat(F.lit("Why is incident #"), "incident_id", F.lit(" "), F.lower("severity"), F.lit("?")).alias("question"),
        F.concat(
            F.lit("Incident #"), "incident_id", F.lit(" ("), "title",
            F.coalesce(F.concat(F.lit(" on "), "asset"), F.lit("")), F.lit(") scores "),
            F.col("risk").cast("string"), F.lit("/100 because multiple signals reinforce each other."),
        ).alias("answer"),
        bullets.alias("bullets"), F.col("confidence"), sources.alias("sources"),
        F.col("incident_id").alias("incident_ref"),
    )


def of_incident(table: DataFrame, incident_id: str) -> DataFrame:
    """Rows of one incident; an unknown id gives no rows."""
    return table.where(F.col("incident_id") == incident_id)


def queue(found: DataFrame, severity: str = "All", status: str = "All", search: str = "") -> DataFrame:
    """Incidents filtered by severity, status and free text, riskiest first."""
    rows = found
    if severity != "All":
        rows = rows.where(F.col("severity") == severity)
    if status != "All":
        rows = rows.where(F.col("status") == status)
    wanted = search.strip().lower()
    if wanted:
        hay = F.lower(F.concat_ws(" ", "incident_id", "title", "asset", "assignee", F.concat_ws(" ", "mitre")))
        rows = rows.where(hay.contains(wanted))
    return rows.orderBy(F.desc("risk"), "rank")


def queue_counts(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("n_incidents"),
        F.count_if((F.col("severity") == "Critical") & (F.col("status") != "Resolved")).alias("open_critical"),
        F.count_if(F.col("status") == "Investigating").alias("investigating"),
        F.count_if(F.col("status") != "Resolved").alias("open_incidents"),
    )


def entity_edges(found: DataFrame) -> DataFrame:
    """Edges between successive entities of one incident: address -> asset -> account -> ports."""
    return found.select("incident_id", F.posexplode("entities").alias("i", "e"), "entities").where(
        F.col("i") + 1 < F.size("entities")
    ).select(
        "incident_id", F.col("e.label").alias("from_label"), F.col("e.kind").alias("from_kind"),
        F.get("entities", F.col("i") + 1)["label"].alias("to_label"),
        F.get("entities", F.col("i") + 1)["kind"].alias("to_kind"),
    )


def neighbours(edges: DataFrame, label: str) -> DataFrame:
    """Entities one hop from ``label``, in either direction."""
    is_from, is_to = F.col("from_label") == label, F.col("to_label") == label
    return edges.where(is_from | is_to).select(
        "incident_id", F.when(is_from, F.col("to_label")).otherwise(F.col("from_label")).alias("neighbour")).distinct()
