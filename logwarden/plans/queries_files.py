"""Registered queries over files: log lines, CSV rows and JSON Lines are written from the events table and ingested again."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import work_path
from logwarden.operators import reports
from logwarden.plans.analysis import Analysis
from logwarden.plans.driver_tables import CSV_HEADER, FIELD_LINES, UNDATED, field_projection, line_projection, raw_events, table
from logwarden.sources import digests, records
from logwarden.sources.logs import Ingest

PARTS = 4
CAPTURE_ROWS = 2_000_000  # of both days, for each file of the first


def written_files(spark, sf_dir: str) -> dict[str, str]:
    """Three folders of four files each, lines in the order of events; every third event goes to a folder."""
    base = work_path(spark, "source-files")
    rows = raw_events(spark, sf_dir)
    ordered = lambda df: df.repartitionByRange(PARTS, "event_id").sortWithinPartitions("event_id")
    # events are ordered, not their texts
    third = lambda n: ordered(rows.where(f"event_id % 3 = {n}"))
    log = third(0).selectExpr("event_id", "k", *line_projection("spark")).selectExpr(f"{UNDATED['log']} as value")

    def given(n: int) -> DataFrame:
        found = third(n).selectExpr("event_id", "k", *field_projection("spark"))
        return found.withColumn("f_timestamp", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("f_timestamp")))

    names = [c.strip().lower() for c in CSV_HEADER.split(",")]
    rows_of_csv = given(1)
    cells = [F.col(c).alias(n) for c, n in zip([c for c in rows_of_csv.columns if c.startswith("f_")], names)]
    table_of = rows_of_csv.select(*cells).write.options(header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    records_of = given(2).selectExpr(f"{FIELD_LINES['record']} as value").write
    writes = [lambda: log.write.text(f"{base}/a-log"), lambda: table_of.csv(f"{base}/b-csv"), lambda: records_of.text(f"{base}/c-lines")]
    with ThreadPoolExecutor(len(writes)) as pool:  # a folder has few files, so the folders are written side by side
        for done in [pool.submit(w) for w in writes]:
            done.result()
    return {name: f"{base}/{name}" for name in ("a-log", "b-csv", "c-lines")}


def _ingest(spark, sf_dir: str, **options) -> Ingest:
    return Ingest(spark, list(written_files(spark, sf_dir).values()), **options)


def _events(spark, sf_dir) -> DataFrame:
    return _ingest(spark, sf_dir).stored().select(
        "event_index", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "time_label", "hour", "source_ip", "dest_ip",
        F.col("user").alias("account"), "host", "action", "status", "port")


def _activity(spark, sf_dir) -> DataFrame:
    """Hourly activity of ingested files; events without an hour go by their place among all events."""
    return Analysis(_ingest(spark, sf_dir).stored()).activity


def _summary(spark, sf_dir) -> DataFrame:
    """Files and events per folder and format."""
    ingest = _ingest(spark, sf_dir)
    folder = F.regexp_extract("path", r"/(a-log|b-csv|c-lines)/", 1)
    listed = ingest.files.select(F.col("name").alias("file"), folder.alias("folder"))
    return ingest.summary(ingest.stored()).join(listed, "file").groupBy("folder", "format").agg(
        F.count("*").alias("n_files"), F.sum("n_events").alias("n_events"))


def _limited(spark, sf_dir) -> DataFrame:
    """What is left when files over a size are skipped: of each folder the events of the files that are not larger than the largest CSV file."""
    paths = written_files(spark, sf_dir)
    sizes = Ingest(spark, list(paths.values())).files
    largest = sizes.where(F.col("path").contains("/b-csv/")).agg(F.max("length")).first()[0]
    ingest = Ingest(spark, list(paths.values()), max_file_bytes=largest)
    over = ingest.files.where(F.col("length") > largest).count()
    csv = ingest.events.where(F.col("file").startswith("part-") & F.col("file").endswith(".csv"))
    return csv.agg(F.count("*").alias("n_events")).withColumn("n_over", F.lit(over).cast("bigint"))


def _flow_files(spark, sf_dir) -> DataFrame:
    """Flows written as captures of two days whose headers differ in order and in one column, and read back in one call."""
    base = work_path(spark, "captures")
    flows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(" Flow Id"), F.col("l_linenumber").alias(" Segment"), F.when(F.col("l_quantity") > 45, "Infinity").otherwise(F.col("l_quantity").cast("string")).alias("Flow Bytes/s"),
        F.col("l_tax").alias(" Idle"), F.when(F.col("l_returnflag") == "R", "DoS Hulk").otherwise("BENIGN").alias(" Label"))
    files = max(2, -(-flows.count() // CAPTURE_ROWS))  # dealt by flow: a round robin would sort all rows first
    flows.where("` Flow Id` % 2 = 0").repartition(files, "` Flow Id`").write.csv(f"{base}/Monday-WorkingHours", header=True, ignoreLeadingWhiteSpace=False)
    shuffled = flows.where("` Flow Id` % 2 = 1").select(" Label", "Flow Bytes/s", " Segment", " Flow Id")
    shuffled.write.csv(f"{base}/Friday-WorkingHours", header=True, ignoreLeadingWhiteSpace=False)
    read = records.read_flows(spark, [f"{base}/Monday-WorkingHours", f"{base}/Friday-WorkingHours"])
    return read.select(F.col("Flow Id").cast("bigint").alias("flow"), F.col("Segment").cast("bigint").alias("segment"), F.col("Flow Bytes/s").alias("rate"),
                       F.round("Idle", 6).alias("idle"), F.col("Label").alias("label"), F.col("is_attack").cast("int").alias("attack"))


def _digests(spark, sf_dir) -> DataFrame:
    """SHA-256 of four files that hold all log lines, streamed in order of their lines."""
    base = work_path(spark, "evidence-files")
    lines = raw_events(spark, sf_dir).selectExpr("event_id % 4 as lot", *line_projection("spark"))
    # one task a file, as a file has one order
    lines.repartition("lot").sortWithinPartitions("lot", "ingest_seq").select("lot", "value").write.partitionBy("lot").text(base)
    files = Ingest(spark, base).files
    found = digests.file_digests(spark, [(r.path, r.length) for r in files.toLocalIterator()], whole_bytes=0)
    lot = F.regexp_extract("path", r"/lot=(\d+)/", 1).cast("bigint").alias("lot")
    return files.join(found, "path").select(lot, F.col("length").alias("n_bytes"), "sha256")


QUERIES = {"file_digests": _digests, "flow_files": _flow_files, "file_events": _events, "file_activity": _activity, "file_summary": _summary, "file_size_limit": _limited}
