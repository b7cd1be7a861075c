"""Registered queries for models, reasons and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import work_path
from logwarden.models import forest, search
from logwarden.models.iforest import IsolationForest
from logwarden.models.lof import LocalOutlierFactor
from logwarden.models.ocsvm import OneClassSvm
from logwarden.models.reasons import Baseline
from logwarden.models.scoring import Detector
from logwarden.operators import detect, evaluate, features
from logwarden.plans.driver_tables import event_projection, events, line_projection, raw_events, table
from logwarden.streaming import escalation, streams


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as records: class 0 plays the attack, the rest is normal."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 0).cast("int").alias("y"))


def _normal_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return features.split(df.where("y = 0"), F.col("id"), 0.75)


def _records(spark, sf_dir) -> DataFrame:
    """Events as partial connection records."""
    return raw_events(spark, sf_dir).select(
        "event_id", F.col("value").alias("src_bytes"), F.col("k").cast("double").alias("count"), F.concat(F.lit("u"), "user_id").alias("service"),
        F.col("event_type").alias("flag"), F.col("event_type").isin("error", "click").alias("attack"))


def _reasons(spark, sf_dir) -> DataFrame:
    df = _records(spark, sf_dir)
    base = Baseline(["src_bytes", "count"], ["flag"]).fit(df.where(~F.col("attack")))
    found = base.explain(df).select("event_id", F.posexplode("reasons").alias("position", "r"))
    return found.select("event_id", F.col("position").cast("bigint").alias("position"), "r.feature", "r.description", F.round("r.magnitude", 4).alias("magnitude"))


def _forest_scores(spark, sf_dir) -> DataFrame:
    df = _vectors(spark, sf_dir)
    fit, _ = _normal_split(df)
    model = IsolationForest(n_trees=100, max_samples=128).fit(fit, F.col("id"))
    return model.decision(df).select("id", "y", F.round("score", 6).alias("score"))


def _full_forest(spark, sf_dir) -> DataFrame:
    """Trees over all normal rows, grown level by level."""
    df = _vectors(spark, sf_dir)
    model = IsolationForest(n_trees=10, max_samples=1.0, max_features=0.7, max_tree_rows=250).fit(df.where("y = 0"), F.col("id"))
    return model.decision(df).select("id", "y", F.round("score", 6).alias("score"))


def _batch_scores(spark, sf_dir) -> DataFrame:
    df = _records(spark, sf_dir)
    detector = Detector.train(df, F.col("event_id"), F.col("attack"), ["flag"], ["src_bytes", "count"], IsolationForest(n_trees=50))
    return detector.score(df).select("event_id", "is_anomaly", "risk_score", "risk_level", F.size("reasons").alias("n_reasons"))


def _lof(spark, sf_dir) -> DataFrame:
    df = _vectors(spark, sf_dir).withColumnRenamed("features", "x")
    fit, _ = _normal_split(df)
    scores = LocalOutlierFactor(k=20).fit(fit.select("id", "x")).decision(df.select("id", "x"))
    return scores.select("id", F.round("score", 6).alias("score"))


def _svm(spark, sf_dir) -> DataFrame:
    df = _vectors(spark, sf_dir)
    fit, _ = _normal_split(df)
    return OneClassSvm(n_features=64, steps=5).fit(fit).decision(df).select("id", F.round("score", 4).alias("score"))


def _supervised(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    key = F.concat("l_orderkey", F.lit("-"), "l_linenumber")
    train, test = features.split(df, key, 0.8)
    encoder = features.Encoder(["l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"]).fit(train)
    model = forest.Forest(n_trees=10, max_depth=5).fit(encoder.transform(train))
    return model, encoder, test


def _forest_metrics(spark, sf_dir) -> DataFrame:
    model, encoder, test = _supervised(spark, sf_dir)
    scored = forest.probability(model, encoder.transform(test))
    return evaluate.fixed_sweep(scored, (0.3, 0.4, 0.5, 0.6, 0.7), "probability")


def _importances(spark, sf_dir) -> DataFrame:
    model, encoder, _ = _supervised(spark, sf_dir)
    return forest.top_importances(model, encoder.feature_names)


def _grid(spark, sf_dir) -> DataFrame:
    df = _vectors(spark, sf_dir)
    fit, held_out = _normal_split(df)
    return search.grid_search(fit, held_out, df, F.col("id"), {"n_trees": [25, 50], "max_samples": [64]})


def _detectors(spark, sf_dir) -> DataFrame:
    df = _vectors(spark, sf_dir)
    fit, held_out = _normal_split(df)
    trees = IsolationForest(n_trees=50, max_samples=64).fit(fit, F.col("id"))
    factor = LocalOutlierFactor(k=20).fit(fit.select("id", F.col("features").alias("x")))
    factors = factor.decision(df.select("id", F.col("features").alias("x")))
    return search.compare_detectors({
        "isolation_forest": (trees.decision(held_out), trees.decision(df)),
        "lof": (factors.join(held_out.select("id"), "id"), factors.join(df.select("id", "y"), "id")),
    }, (0.05, 0.1))


# ---- streams over the events table ------------------------------------------


def _event_stream(spark, sf_dir, projection) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k").selectExpr(*projection)


def _run(spark, stream: DataFrame, name: str, mode: str) -> DataFrame:
    return streams.run_available(stream, work_path(spark, name), work_path(spark, f"{name}-state"), mode)


def _stamp(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _stream_parse(spark, sf_dir) -> DataFrame:
    lines = _event_stream(spark, sf_dir, line_projection("spark"))
    parsed = streams.normalized_stream(lines.select("file", "ingest_seq", "value"))
    return _run(spark, parsed, "parsed", "append").selectExpr(
        "ingest_seq", "file", "time_label", "hour", "source_ip", "dest_ip", "user as account", "host", "action", "status", "port")


def _stream_brute_force(spark, sf_dir) -> DataFrame:
    found = streams.brute_force_windows(_event_stream(spark, sf_dir, event_projection("spark")), "1 day", "6 hours", 2)
    rows = streams.latest(_run(spark, found, "windows", "update"), ["source_ip", "window_start", "window_end"])
    return rows.select("source_ip", _stamp("window_start"), _stamp("window_end"), "n_failed")


def _stream_sessions(spark, sf_dir) -> DataFrame:
    found = streams.activity_sessions(_event_stream(spark, sf_dir, event_projection("spark")), "12 hours")
    return _run(spark, found, "sessions", "append").select("source_ip", _stamp("session_start"), _stamp("session_end"), "n_events", "n_alerts")


def _stream_hostile(spark, sf_dir) -> DataFrame:
    found = streams.hostile_counts(_event_stream(spark, sf_dir, event_projection("spark")))
    return streams.latest(_run(spark, found, "hostile", "update"), ["source_ip"])


def _stream_scores(spark, sf_dir) -> DataFrame:
    records = _records(spark, sf_dir)
    detector = Detector.train(records, F.col("event_id"), F.col("attack"), ["flag"], ["src_bytes", "count"], IsolationForest(n_trees=25))
    arriving = _event_stream(spark, sf_dir, ["event_id", "value as src_bytes", "cast(k as double) as count", "event_type as flag"])
    return _run(spark, detector.score(arriving), "scored", "append").select("event_id", "is_anomaly", "risk_score", "risk_level")


def _replayed(spark, sf_dir, cuts: list[tuple[float, float]]) -> DataFrame:
    """States of addresses after the events arrived in lots, in the given order of shares of the event numbers."""
    folder, landed, state = (work_path(spark, name) for name in ("replay", "escalation", "escalation-state"))
    rows = events(spark, sf_dir)
    last = rows.agg(F.max("ingest_seq")).first()[0] or 0
    for k, (low, high) in enumerate(cuts):  # one start of the stream a lot: state and progress come back from the checkpoint
        rows.where((F.col("ingest_seq") >= low * (last + 1)) & (F.col("ingest_seq") < high * (last + 1))).write.parquet(f"{folder}/lot-{k}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/lot-*")
        out = streams.run_available(escalation.address_states(arriving), landed, state, "update")
    return out


def _stream_rules(spark, sf_dir) -> DataFrame:
    """Detections of the address rules after two lots; the second start takes up the state of the first."""
    found = escalation.running(_replayed(spark, sf_dir, [(0, 0.5), (0.5, 1)]))
    none = spark.createDataFrame([], "endpoint string, n_events bigint, n_confirmed bigint, first_seq bigint")
    return detect.detections(found, none)


def _stream_late(spark, sf_dir) -> DataFrame:
    """Late rows of each address when the later half of the events arrives first."""
    return escalation.late(_replayed(spark, sf_dir, [(0.5, 1), (0, 0.5)])).groupBy("source_ip").agg(
        F.sum("n_events").alias("n_late"), F.sum("n_failed").alias("n_failed"), F.min("first_seq").alias("first_seq"), F.min("minute").alias("first_minute"))


QUERIES = {
    "stream_rules": _stream_rules,
    "stream_late_rows": _stream_late,
    "reason_codes": _reasons,
    "full_sample_forest": _full_forest,
    "isolation_forest_scores": _forest_scores,
    "batch_scores": _batch_scores,
    "lof_scores": _lof,
    "one_class_scores": _svm,
    "forest_sweep": _forest_metrics,
    "forest_importances": _importances,
    "grid_search": _grid,
    "detector_operating_points": _detectors,
    "stream_parse": _stream_parse,
    "stream_brute_force": _stream_brute_force,
    "stream_sessions": _stream_sessions,
    "stream_hostile": _stream_hostile,
    "stream_scores": _stream_scores,
}
