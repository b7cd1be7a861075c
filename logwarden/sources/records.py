"""Connection-record sources: labelled records, flow captures, traffic tables; and report sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden.operators.features import attack_family, day_role, is_attack, numeric_or_null
from logwarden.schema import KDD_SCHEMA, UNSW_SCHEMA


def label_records(df: DataFrame) -> DataFrame:
    """Drop ``difficulty``; add ``attack_category`` and ``is_anomaly``."""
    return df.drop("difficulty").withColumns({
        "attack_category": attack_family(F.col("label")), "is_anomaly": (F.col("label") != "normal").cast("int")})


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless CSV of 41 features, label and difficulty."""
    return label_records(spark.read.schema(KDD_SCHEMA).csv(path))


def read_traffic(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with header in the 45-column traffic schema."""
    return spark.read.schema(UNSW_SCHEMA).csv(path, header=True)


def _flow_names(header: str) -> list[str]:
    """Trimmed header names; a repeated one gets ``.1``, ``.2``, ..."""
    seen: dict[str, int] = {}
    names = []
    for raw in header.split(","):
        name = raw.strip().lstrip("﻿")
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(name if n == 0 else f"{name}.{n}")
    return names


def flow_layouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, header: the first line of every file, from the split that starts it. Empty files have none."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("header"))

    def first_lines(batches):
        """Lines come in the order of their file, so the first one of a path is kept and no line is sorted."""
        seen = set()
        for batch in batches:
            paths = batch.column("path")
            new = [p for p in pc.unique(paths).to_pylist() if p not in seen]
            seen.update(new)
            if new:
                yield batch.take(pa.array([pc.index(paths, p).as_py() for p in new], pa.int64()))

    return lines.where("block = 0").select("path", "header").mapInArrow(first_lines, "path string, header string")


def read_flows(spark: SparkSession, paths: str | list[str], label: str = "Label") -> DataFrame:
    """Flow captures: trimmed names, numbers cleaned, ``file`` and ``role`` by capture day.

    Each file is read by its own header: files of one layout share a typed read, and layouts are united by name; a column
    that a layout lacks is null there. ``file`` comes from the scan's metadata, so filters on it skip whole files.
    """
    layouts: dict[str, list[str]] = {}
    for r in flow_layouts(spark, paths).orderBy("path").collect():  # a row a file, as the listing itself
        layouts.setdefault(r.header, []).append(r.path)
    if not layouts:
        raise ValueError(f"column {label!r} not found: no lines in {paths}")
    parts = []
    for header, files in layouts.items():
        names = _flow_names(header)
        if label not in names:
            raise ValueError(f"column {label!r} not found in {files[0]}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).csv(files, header=True, enforceSchema=True).select(
            *[F.col(f"`{n}`") for n in names], F.col("_metadata.file_name").alias("file"))
        parts.append(df.select(*[F.col(f"`{n}`") if n == label else numeric_or_null(F.col(f"`{n}`")).alias(n) for n in names], "file"))
    cleaned = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return cleaned.withColumns({"role": day_role(F.col("file")), "is_attack": is_attack(F.col(label))})


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A report table as JSON, CSV (with header) or Parquet."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_features(df: DataFrame, path: str, split: str = "split", columns: Sequence[str] = ("features",)) -> None:
    """Feature vectors partitioned by split: each split reads back without the others."""
    df.select(split, *columns).write.partitionBy(split).parquet(path)
