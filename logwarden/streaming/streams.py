"""Structured Streaming forms of ingest, detection and scoring.

The same column functions serve batch and stream. Aggregates carry a watermark; results that
change over time are written per batch and read back as the latest row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.functions.text import is_alert
from logwarden.operators.detect import is_failed_login
from logwarden.sources.logs import text_events


def read_line_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """file, ingest_seq, value of text files arriving in ``folder``.

    A stream has no total input order, so ingest_seq is 0.
    """
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
        .select(F.col("_metadata.file_name").alias("file"), F.lit(0).cast("bigint").alias("ingest_seq"), "value"))


def normalized_stream(lines: DataFrame, default_year: int | None = None) -> DataFrame:
    """Events of arriving lines; ``default_year`` dates syslog lines, which name no year."""
    events = text_events(lines)
    if default_year is None:
        return events
    stamp = F.regexp_extract("raw", r"(?<!\w)([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})(?!\w)", 1)
    dated = F.try_to_timestamp(F.concat(F.lit(f"{default_year} "), F.regexp_replace(stamp, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return events.withColumn("ts", F.coalesce("ts", F.when(F.length(stamp) > 0, dated)))


def timed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a time, and those without one for a side output."""
    return events.where(F.col("ts").isNotNull()), events.where(F.col("ts").isNull())


def brute_force_windows(events: DataFrame, window: str = "2 minutes", slide: str = "30 seconds", more_than: int = 10,
                        watermark: str = "10 minutes") -> DataFrame:
    """Addresses with more than ``more_than`` failed logins inside a sliding window."""
    failed = events.where(F.col("ts").isNotNull() & (F.length("source_ip") > 0) & is_failed_login())
    return (
        failed.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide).alias("w"), "source_ip")
        .agg(F.count("*").alias("n_failed")).where(F.col("n_failed") > more_than)
        .select("source_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_failed"))


def activity_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """One address's activity grouped into sessions; rows later than the watermark are dropped."""
    seen = events.where(F.col("ts").isNotNull() & (F.length("source_ip") > 0))
    return (
        seen.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "source_ip")
        .agg(F.count("*").alias("n_events"), F.count_if(is_alert(F.col("status"))).alias("n_alerts"))
        .select("source_ip", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "n_alerts"))


def hostile_counts(events: DataFrame) -> DataFrame:
    """Running totals and alerts per address (update mode)."""
    return events.where(F.length("source_ip") > 0).groupBy("source_ip").agg(
        F.count("*").alias("n_events"), F.count_if(is_alert(F.col("status"))).alias("n_alerts"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: int | None = None) -> DataFrame:
    """Process everything that has arrived and stop; every batch lands in its own folder.

    Waits without limit, or raises when ``timeout`` seconds were not enough: a part is never returned as the whole. A batch that is retried overwrites its own folder, so results stay exact after a failure.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(land).start()
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream not done after {timeout} s; its checkpoint lets the next call go on")
    finally:
        query.stop()
    spark = stream.sparkSession
    schema = T.StructType(list(stream.schema.fields) + [T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def latest(landed: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The newest row per key of an update-mode result."""
    values = [c for c in landed.columns if c not in keys and c != "batch_id"]
    return landed.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")
