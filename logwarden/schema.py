"""Schemas of the normalized event and of connection records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logwarden import fixed_values as fv

EVENT_SCHEMA = T.StructType([
    T.StructField("ingest_seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("time_label", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("action", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("port", T.IntegerType()),
    T.StructField("raw", T.StringType(), False),
    T.StructField("file", T.StringType(), False),
])
EVENT_COLUMNS = tuple(f.name for f in EVENT_SCHEMA.fields)

KDD_SCHEMA = T.StructType([
    T.StructField(
        name,
        T.StringType() if name in fv.KDD_CATEGORICAL or name == "label"
        else T.IntegerType() if name == "difficulty" else T.DoubleType(),
    )
    for name in fv.KDD_COLUMNS
])
KDD_NUMERIC = tuple(c for c in fv.KDD_COLUMNS if c not in fv.KDD_CATEGORICAL + ("label", "difficulty"))
KDD_FEATURES = fv.KDD_CATEGORICAL + KDD_NUMERIC

UNSW_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("dur", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in fv.UNSW_CATEGORICAL]
    + [T.StructField(c, T.DoubleType()) for c in fv.UNSW_NUMERIC if c != "dur"]
    + [T.StructField("attack_cat", T.StringType()), T.StructField("label", T.IntegerType())]
)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """``df`` itself, or a ValueError naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
