"""Registered queries for parsing, extraction, classification and display text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions import text as tx
from logwarden.plans.driver_tables import CSV_HEADER, FIELD_LINES, fields, lines, table, texts
from logwarden.sources import logs

EVENT_FIELDS = ("ingest_seq", "file", "time_label", "hour", "source_ip", "dest_ip", "user as account", "host", "action", "status", "port")


def _log_lines(spark, sf_dir) -> DataFrame:
    return logs.text_events(lines(spark, sf_dir)).selectExpr(*EVENT_FIELDS)


def _round_trip(spark, sf_dir) -> DataFrame:
    found = lines(spark, sf_dir).select(
        "true_ip", "true_user", tx.first_ip(F.col("value")).alias("ip"), tx.extract_user(F.col("value")).alias("usr"))
    return found.agg(F.count("*").alias("n_lines"), F.count_if(F.col("ip") == F.col("true_ip")).alias("n_ip"),
                     F.count_if(F.col("usr") == F.col("true_user")).alias("n_user"))


def _header(spark, file: str) -> DataFrame:
    return spark.range(1).select(F.lit(file).alias("file"), F.lit(-1).cast("bigint").alias("ingest_seq"), F.lit(CSV_HEADER).alias("value"))


def _file_lines(spark, sf_dir, file: str, kind: str) -> DataFrame:
    # formed once a row, and after the rows are dealt: filters on the text stay above
    body = tx.once(fields(spark, sf_dir), value=F.expr(FIELD_LINES[kind])).select(F.lit(file).alias("file"), "ingest_seq", "value")
    return body.unionByName(_header(spark, file)) if kind == "csv" else body


def _parsed(file: str, kind: str):
    def build(spark, sf_dir) -> DataFrame:
        rows = _file_lines(spark, sf_dir, file, kind)
        return logs.parse_lines(rows, logs.line_formats(logs.sniff(rows))).selectExpr(*EVENT_FIELDS)
    return build


def _json_documents(spark, sf_dir) -> DataFrame:
    """One document per event: a list, a wrapped list, a single record, a scalar, a broken text, an empty list."""
    text = F.expr(f"""case k % 6 when 0 then concat('[ ', rec, ', 7, ', rec, ' ]') when 1 then concat('{{"n": 1, "logs": [', rec, ', null]}}')
        when 2 then rec when 3 then '42' when 4 then concat('[', rec) else '[]' end""")
    docs = fields(spark, sf_dir).withColumn("rec", F.expr(FIELD_LINES["record"])).select(
        F.concat(F.lit("doc-"), "ingest_seq", F.lit(".json")).alias("file"), (F.col("ingest_seq") * 8).alias("ingest_seq"), text.alias("text"))
    records = logs.document_records(docs).where(F.col("records").isNotNull())
    return logs.parse_documents(records).selectExpr(*EVENT_FIELDS)


def _file_formats(spark, sf_dir) -> DataFrame:
    base = fields(spark, sf_dir).withColumn("rec", F.expr(FIELD_LINES["record"]))
    texts = {"a.csv": FIELD_LINES["csv"], "b.txt": FIELD_LINES["csv"], "c.jsonl": "rec", "d.log": "concat('line ', k)", "e.data": "rec"}
    exploded = base.select("ingest_seq", F.inline(F.array(*[
        F.struct(F.lit(f).alias("file"), F.expr(t).alias("value")) for f, t in texts.items()])))
    rows = exploded.unionByName(_header(spark, "a.csv")).unionByName(_header(spark, "b.txt"))
    formats = logs.line_formats(logs.sniff(rows))
    counted = logs.parse_lines(rows, formats).groupBy("file").agg(F.count("*").alias("n_events"))
    return formats.select("file", "format").join(counted, "file")


def _classified(name: str, text: str, *keys: str):
    def build(spark, sf_dir) -> DataFrame:
        df = texts(spark, sf_dir, name, *keys, text).select(*keys, tx.classify(F.col(text)).alias("c"))
        return df.select(*keys, "c.action", "c.status")
    return build


def _class_counts(spark, sf_dir) -> DataFrame:
    return _classified("documents", "text", "lang")(spark, sf_dir).groupBy("lang", "action", "status").agg(F.count("*").alias("n"))


def _addresses(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", F.size(tx.all_ips(t)).cast("bigint").alias("n_ips"), tx.first_ip(t).alias("first_ip"), tx.second_ip(t).alias("second_ip"))


def _text_fields(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    df = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", "text", tx.parse_time(t).alias("t"))
    return df.select("doc_id", tx.extract_user(t).alias("account"), tx.extract_host(t).alias("host"), tx.extract_port(t).alias("port"),
                     "t.time_label", "t.hour")


def _status_words(spark, sf_dir) -> DataFrame:
    words = ("OK", "Unsuccessful", "denied", "403 forbidden", "HTTP 204", "Blocked", "Suspicious", "invalid token", "reject", "anomaly",
             "denied auth", "n/a")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 12 + 1).cast("int"))
    raw = F.concat(F.lit(" "), "event_type", F.lit(" - Type "), (F.col("user_id") % 5).cast("string"), F.lit("!"))
    df = table(spark, sf_dir, "events").select(
        "event_id", tx.normalize_action(raw).alias("action"), tx.normalize_status(word, F.lit("info")).alias("status"))
    return df.select("*", tx.is_alert(F.col("status")).alias("alert"), tx.feed_status(F.col("status")).alias("feed"))


def _display(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.truncate(t, 96).alias("short"), F.sha2(t, 256).alias("digest"), tx.sha256_short(t).alias("digest_short"),
        F.md5(tx.normalize_question(t)).alias("normalized"))


def _shifted(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select("event_id", tx.shift_time(F.date_format("ts", "HH:mm"), (F.col("event_id") % 4000 - 2000).cast("int")).alias("shifted"))


def _bands(spark, sf_dir) -> DataFrame:
    r = F.col("r")
    severity = tx.severity_from_risk(r)
    return table(spark, sf_dir, "events").select("event_id", tx.risk_score(F.col("value"), 5.0, 150.0).alias("r")).select(
        "event_id", severity.alias("severity"), tx.status_from_severity(severity).alias("status"), tx.risk_bucket(r).alias("bucket"),
        tx.score_tone(r).alias("tone"), F.round(r, 4).alias("risk"))


def _humanized(spark, sf_dir) -> DataFrame:
    action = F.when(F.col("event_type") == "error", "failed_login").when(F.col("event_type") == "view", "DNS_query_v2").otherwise(F.col("event_type"))
    name = F.when(F.col("event_type").isin("view", "error"), F.lit("SQL-Auth-1")).otherwise("WWW-edge")
    return table(spark, sf_dir, "events").select("event_id", tx.humanize_action(action).alias("title"), tx.asset_type(name).alias("asset_type"))


def _latest(spark, sf_dir) -> DataFrame:
    feeds = table(spark, sf_dir, "events").select(
        F.concat(F.lit("feed-"), (F.col("event_id") % 97).cast("string")).alias("name"), F.col("event_id").alias("load_order"))
    return logs.latest_by_name(feeds).select("name", "load_order", "ordinal")


def _labels(spark, sf_dir) -> DataFrame:
    names = F.when(F.count("*") == 1, F.array(F.concat(F.lit("u"), F.min("event_id").cast("string"), F.lit(".log"))))
    n = F.count("*").cast("int")
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.coalesce(names, F.array_repeat(F.lit("f"), n)).alias("names"))
    return df.select("user_id", tx.dataset_label(F.col("names")).alias("label"))


QUERIES = {
    "parse_log_lines": _log_lines,
    "round_trip_fields": _round_trip,
    "parse_csv_lines": _parsed("export.csv", "csv"),
    "parse_jsonl_lines": _parsed("export.jsonl", "jsonl"),
    "parse_json_documents": _json_documents,
    "file_formats": _file_formats,
    "text_addresses": _addresses,
    "text_fields": _text_fields,
    "classify_documents": _classified("documents", "text", "doc_id"),
    "classify_pages": _classified("pages", "html", "page_id"),
    "classify_conversations": _classified("conversations", "text", "conv_id", "turn"),
    "class_counts": _class_counts,
    "status_words": _status_words,
    "display_text": _display,
    "shifted_times": _shifted,
    "url_names": lambda s, d: table(s, d, "pages").select("page_id", tx.source_name(F.col("url")).alias("name")),
    "score_bands": _bands,
    "humanized_actions": _humanized,
    "source_latest_by_name": _latest,
    "source_labels": _labels,
}
