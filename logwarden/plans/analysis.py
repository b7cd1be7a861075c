"""Events to incidents to reports: one object holding every output table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.cluster import pin, written
from logwarden.functions.text import run_label
from logwarden.operators import detect, incidents, reports


class Analysis:
    """All tables of one run over ``events`` (normalized event schema).

    The address aggregate is shuffled once; with ``reuse`` it is written to the shared folder
    so detections and hostile addresses read it instead of the events. Look-ups for the at most
    ``cap`` incidents filter the events by broadcast keys. Events without an hour go by their ``index``, the place of
    the event: ``event_index`` of stored files, else ``ingest_seq``. ``files`` (name, hash, ordinal) may be a function of the
    names of the contributing files, such as ``Ingest.evidence_of``, so that only these are hashed.
    """

    def __init__(self, events: DataFrame, files: DataFrame | Callable[[DataFrame], DataFrame] | None = None, label: str = "", run_label: str = "",
                 cap: int = fv.MAX_INCIDENTS, index: str | None = None, strict: bool = True,
                 lead_assignee: str = "Unassigned", reuse: bool = False):
        self.events, self.files, self.label, self.run_label = events, files, label, run_label
        index = index or ("event_index" if "event_index" in events.columns else "ingest_seq")
        self.cap, self.index, self.strict, self.lead_assignee, self.reuse = cap, index, strict, lead_assignee, reuse
        self._shown = None  # the files table, once asked for

    @cached_property
    def by_address(self) -> DataFrame:
        features = detect.ip_features(self.events)
        return written(features, "addresses") if self.reuse else features

    @cached_property
    def kept(self) -> DataFrame:
        found = detect.detections(self.by_address, detect.endpoint_features(self.events))
        return pin(detect.rank_and_cap(found, self.cap))

    @cached_property
    def samples(self) -> DataFrame:
        return pin(detect.sample_events(self.kept, self.events, bounded=True))

    @cached_property
    def incidents(self) -> DataFrame:
        described = detect.describe(self.kept, self.events, bounded=True)
        return pin(incidents.incidents(described, self.samples, self.lead_assignee))

    timeline = property(lambda self: incidents.timelines(self.incidents, self.samples))
    risk_factors = property(lambda self: incidents.risk_factors(self.incidents))
    responses = property(lambda self: incidents.response_actions(self.incidents))
    techniques = property(lambda self: incidents.technique_chain(self.incidents))
    entities = property(lambda self: incidents.entities(self.incidents))
    explanations = property(lambda self: incidents.explanations(self.incidents))
    edges = property(lambda self: incidents.entity_edges(self.incidents))

    @property
    def evidence(self) -> DataFrame:
        if self.files is None:
            raise ValueError("evidence needs a files table (name, hash, ordinal)")
        if self._shown is None:
            self._shown = pin(self.files(self.samples.select("file").distinct())) if callable(self.files) else self.files
        return incidents.evidence(self.incidents, self.samples, self._shown, self.run_label)

    @cached_property
    def cube(self) -> DataFrame:
        cube = reports.event_cube(self.events, self.index, self.strict)
        return written(cube, "cube") if self.reuse else cube

    @cached_property
    def activity(self) -> DataFrame:
        return pin(reports.activity_series(self.cube))

    @cached_property
    def totals(self) -> DataFrame:
        return pin(reports.totals(self.cube))

    @cached_property
    def threats(self) -> DataFrame:
        return pin(reports.top_threats(self.cube))

    @cached_property
    def hostile(self) -> DataFrame:
        return pin(reports.hostile_ips(self.by_address))

    @cached_property
    def profiles(self) -> DataFrame:
        return pin(reports.user_profiles(self.events))

    @cached_property
    def assets(self) -> DataFrame:
        return pin(reports.asset_inventory(self.events, self.incidents))

    @cached_property
    def is_empty(self) -> bool:
        return self.totals.first().n_events == 0

    @cached_property
    def health(self) -> DataFrame:
        dimensions = pin(reports.health_dimensions(self.incidents, self.profiles))
        return reports.zeroed(dimensions, "value") if self.is_empty else dimensions

    @property
    def summary(self) -> DataFrame:
        row = reports.report_summary(self.incidents, self.totals, self.score, self.label)
        return reports.zeroed(row, "avg_response_mins") if self.is_empty else row

    @property
    def kpis(self) -> DataFrame:
        cards = reports.kpis(self.activity, self.incidents, self.totals)
        return cards.withColumn("spark", F.array().cast("array<bigint>")) if self.is_empty else cards

    @property
    def meta(self) -> DataFrame:
        """One row: label, run label, event count, file count, note."""
        n_files = None if self.files is None else self.files.count()
        row = self.totals.crossJoin(F.broadcast(self.incidents.agg(F.count("*").alias("n"))))
        found = F.concat(F.col("n").cast("string"), F.lit(" incident(s) detected across "), F.col("n_events").cast("string"), F.lit(" events"))
        return row.select(
            F.lit(self.label).alias("label"), run_label(self.run_label).alias("generated_at"), F.col("n_events").alias("event_count"),
            F.lit(n_files).cast("bigint").alias("file_count"),
            F.when(F.col("n_events") == 0, reports.EMPTY_NOTE).otherwise(found).alias("note"))

    @property
    def fallback(self) -> DataFrame:
        answer = reports.analyst_fallback(self.incidents)
        return answer.select(F.lit(reports.EMPTY_ANSWER).alias("answer")) if self.is_empty else answer

    intel = property(lambda self: reports.threat_intel(self.hostile, self.run_label))
    score = property(lambda self: reports.health_score(self.health))
    progression = property(lambda self: reports.technique_progression(self.incidents))
    attack_types = property(lambda self: reports.attack_type_shares(self.threats))
    top_techniques = property(lambda self: reports.top_techniques(self.incidents))
    notifications = property(lambda self: reports.notifications(self.incidents, self.hostile))
    pool = property(lambda self: reports.event_pool(self.events))
    script = property(lambda self: reports.analyst_script(self.incidents, self.hostile))
    suggestions = property(lambda self: reports.suggestions(self.incidents, self.hostile))

    TABLES = (
        "incidents", "timeline", "risk_factors", "responses", "techniques", "entities", "explanations", "edges",
        "activity", "totals", "threats", "hostile", "intel", "profiles", "assets", "health", "score", "progression",
        "summary", "attack_types", "top_techniques", "notifications", "kpis", "pool", "script", "suggestions", "fallback", "meta",
    )

    def publish(self, folder: str, fmt: str = "parquet") -> None:
        """Write every output table below ``folder``."""
        names = self.TABLES + (("evidence",) if self.files is not None else ())
        for name in names:
            getattr(self, name).write.format(fmt).save(f"{folder.rstrip('/')}/{name}")
