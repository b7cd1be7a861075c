"""Data audit: nulls, duplicates, class shares, numeric and categorical profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden import fixed_values as fv
from logwarden.cluster import written
from logwarden.operators import ranks


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unpivoted(df: DataFrame, columns: Sequence[str], kind: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """Long form: feature, value (and kept columns), one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def _long(wide: DataFrame, columns: Sequence[str], fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One aggregate row (per kept key) with ``field__i`` columns to one row per column."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{f}__{i}").alias(f) for f in fields]) for i, c in enumerate(columns)])
    return wide.select(*keep, F.inline(rows))


def null_counts(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls__{i}") for i, c in enumerate(df.columns)])
    return _long(wide, df.columns, ["nulls"])


def type_family(kind: T.DataType) -> str:
    """whole, real, text, time, flag or other."""
    if isinstance(kind, T.IntegralType):
        return "whole"
    if isinstance(kind, T.NumericType):
        return "real"
    families = ((T.StringType, "text"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "time"), (T.BooleanType, "flag"))
    return next((name for types, name in families if isinstance(kind, types)), "other")


def column_audit(df: DataFrame) -> DataFrame:
    """Type and null cells of every column."""
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, type_family(f.dataType))])
    return null_counts(df).select("feature", kinds[F.col("feature")].alias("kind"), "nulls")


# ---- duplicate rows: fingerprints travel, rows only where a fingerprint repeats -------------------


def _fingerprint(columns: Sequence[str], schema: T.StructType) -> Column:
    """128 bits of a row. Nulls have a place of their own, and -0.0 is 0.0, as in grouping."""
    def plain(c: str) -> Column:
        real = isinstance(schema[c].dataType, (T.DoubleType, T.FloatType))
        return F.col(f"`{c}`") + F.lit(0.0) if real else F.col(f"`{c}`")

    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    values = [plain(c) for c in columns]
    return F.struct(F.xxhash64(nulls, *values).alias("a"), F.xxhash64(F.lit("second"), *values[::-1], nulls).alias("b"))


def _distinct_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Number of different rows (per kept key).

    Rows travel as 16 bytes. Those whose fingerprint occurs once are different from all others; the rest, as whole rows,
    are compared by value, equal ones combined in the task that reads them.
    """
    marked = df.withColumn("_print", _fingerprint(columns, df.schema))
    prints = marked.groupBy(*keep, "_print").agg(F.count("*").alias("_n"))
    single = prints.where("_n = 1").groupBy(*keep).agg(F.count("*").alias("_different"))
    again = prints.where("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col("_print").alias("_again"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keep)]
    repeated = marked.join(again, reduce(lambda x, y: x & y, same, F.col("_print") == F.col("_again")), "left_semi")
    whole = repeated.groupBy(*keep, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)]).agg(F.lit(1).alias("_one"))
    several = whole.groupBy(*keep).agg(F.count("*").alias("_different"))
    return single.unionByName(several).groupBy(*keep).agg(F.sum("_different").alias("n_different"))


def audit(df: DataFrame) -> DataFrame:
    """Rows, columns, null cells and duplicate rows (beyond the first of equal ones) of a dataset, over all its columns."""
    cells = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    totals = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("null_cells"))
    different = _distinct_rows(df, df.columns).select(F.coalesce("n_different", F.lit(0)).alias("n_different"))
    return totals.crossJoin(F.broadcast(different)).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "null_cells", (F.col("n_rows") - F.col("n_different")).alias("duplicate_rows"))


def audit_by_file(df: DataFrame, file: str) -> DataFrame:
    """Rows, null cells and duplicate rows per file, and of all files together (file = null).

    A row repeated in another file counts as a duplicate only in the combined line.
    """
    data = [c for c in df.columns if c != file]
    cells = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in data), F.lit(0))
    named = df.withColumn("_file", F.col(file).cast("string")).drop(file)
    per_file = named.groupBy("_file").agg(F.count("*").alias("n_rows"), F.sum(cells).alias("null_cells"))
    different = _distinct_rows(named, data, ["_file"]).withColumnRenamed("_file", "_of")
    each = per_file.join(different, F.col("_file").eqNullSafe(F.col("_of"))).drop("_of")
    whole = per_file.agg(F.lit(None).cast("string").alias("_file"), F.sum("n_rows").alias("n_rows"), F.sum("null_cells").alias("null_cells"))
    everything = whole.crossJoin(F.broadcast(_distinct_rows(named, data)))
    return each.unionByName(everything).select(F.col("_file").alias(file), "n_rows", "null_cells", (F.col("n_rows") - F.col("n_different")).alias("duplicate_rows"))


def label_counts(df: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows per value of each label column (per kept key); nulls are a value of their own."""
    return unpivoted(df, labels, "string", keep).groupBy(*keep, "feature", "value").agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, dataset: str, label: str, category: str) -> DataFrame:
    """Counts and percentages of the dataset by class and by category (grouping sets). Null classes and categories are left out."""
    counted = df.groupingSets([[dataset, label], [dataset, category]], dataset, label, category).agg(
        F.count("*").alias("n"), F.grouping(F.col(category)).alias("by_class"))
    is_class = F.col("by_class") == 1
    value = F.when(is_class, F.col(label).cast("string")).otherwise(F.col(category).cast("string"))
    told = counted.select(dataset, F.when(is_class, "class").otherwise("category").alias("level"), value.alias("value"), "n").where("value is not null")
    return told.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(dataset, "level")))


def moments(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, sample std, zeros, nulls and infinities per column in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        infinite = F.abs(v) == F.lit(float("inf"))
        finite = F.when(~infinite & ~F.isnan(v), v)
        aggs += [
            F.count(v).alias(f"n__{i}"), F.min(v).alias(f"min__{i}"), F.max(v).alias(f"max__{i}"),
            F.avg(v).alias(f"mean__{i}"), F.stddev_samp(v).alias(f"std__{i}"), F.count_if(v == 0).alias(f"zeros__{i}"),
            F.count_if(v.isNull()).alias(f"nulls__{i}"), F.count_if(infinite).alias(f"infinities__{i}"),
            F.skewness(finite).alias(f"skew_pop__{i}"), F.count(finite).alias(f"n_finite__{i}"),
        ]
    fields = ["n", "min", "max", "mean", "std", "zeros", "nulls", "infinities", "skew_pop", "n_finite"]
    return _long(df.groupBy(*keep).agg(*aggs), columns, fields, keep)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct, min, max, mean, median, std, zeros and constant flag per numeric column.

    One pass for the moments; distinct and median come from one count per (feature, value).
    """
    columns = list(columns or numeric_columns(df))
    long = unpivoted(df, columns)
    distinct = ranks.value_counts(long, "value", ["feature"]).groupBy("feature").agg(F.count("*").alias("distinct"))
    median = ranks.medians(long, "value", ["feature"])
    return (
        moments(df, columns).join(F.broadcast(distinct), "feature", "left").join(F.broadcast(median), "feature", "left")
        .select("feature", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max", "mean", "median", "std", "zeros",
                (F.col("zeros") * 100.0 / (F.col("n") + F.col("nulls"))).alias("zero_percent"), "nulls", "infinities",
                (F.coalesce("distinct", F.lit(0)) <= 1).alias("constant"))
    )


def constant_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct value: min equals max, found in one pass."""
    return moments(df, list(columns or numeric_columns(df))).where(
        F.col("min").isNull() | (F.col("min") == F.col("max"))).select("feature")


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-adjusted skewness per column."""
    n = F.col("n_finite")
    adjusted = F.col("skew_pop") * F.sqrt(n * (n - 1)) / (n - 2)
    return moments(df, list(columns or numeric_columns(df))).select("feature", F.when(n > 2, adjusted).alias("skew"))


def skewed_features(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 10.0) -> DataFrame:
    return skewness(df, columns).where(F.abs("skew") > limit)


def top_values(df: DataFrame, columns: Sequence[str], n: int = 15) -> DataFrame:
    """Most frequent values per column; ties in value order.

    The rank filter is pruned inside each task before the shuffle by column.
    """
    counted = unpivoted(df, columns, "string").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("value"))
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def value_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of every column: place of the column, value as text, count; nulls left out. Written once.

    Each column is read and counted by itself, in its own type where its text tells the same values apart, so rows are not
    spread to one row a cell. Store costly input.
    """
    same = (T.IntegralType, T.DecimalType, T.DateType, T.BooleanType)
    parts = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`") if isinstance(df.schema[c].dataType, same) else F.col(f"`{c}`").cast("string")
        counted = df.select(v.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
        parts.append(counted.select(F.lit(i).alias("at"), F.col("value").cast("string").alias("value"), "n"))
    return written(reduce(lambda x, y: x.unionByName(y), parts), "value-totals")


def heavy_hitters(df: DataFrame, columns: Sequence[str], n: int = 10, capacity: int = 2048, totals: DataFrame | None = None) -> DataFrame:
    """The ``n`` most frequent values of every column with exact counts; ties in value order, nulls left out.

    Each task keeps a Misra-Gries summary of at most ``capacity`` values a column: where it overflows, the count of the
    largest value that goes is taken off all others. Summed over tasks, these deductions bound what a summary can miss,
    so only values that may still be among the first are counted, in one pass. A column where that proves nothing, as
    all its values are about equally rare, is counted in full. Where the caller has counted all values
    (``totals``, of ``value_totals``) only the first of each column are taken.
    """
    columns = list(columns)
    if totals is not None:
        return _firsts([totals.where(F.col("at") == i).orderBy(F.desc("n"), F.asc("value")).limit(n) for i in range(len(columns))], columns, n)

    def summarise(batches):
        counts, lost = [pd.Series(dtype="int64") for _ in columns], [0] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                found = batch.column(i).drop_null().value_counts()
                fresh = pd.Series(found.field("counts").to_numpy(), index=found.field("values").to_pylist())
                held = counts[i].add(fresh, fill_value=0).astype("int64") if len(counts[i]) else fresh
                if len(held) > capacity:
                    cut = int(held.nlargest(capacity + 1).iloc[-1])
                    lost[i] += cut
                    held = held[held > cut] - cut
                counts[i] = held
        for i, held in enumerate(counts):
            values = [None, *held.index]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(values), pa.int32()), pa.array(values, pa.string()), pa.array([lost[i], *held], pa.int64())], names=["at", "value", "n"])

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    summed = written(texts.mapInArrow(summarise, "at int, value string, n bigint").groupBy("at", "value").agg(F.sum("n").alias("n")), "summaries")
    least = Window.partitionBy("at").orderBy(F.desc("n"))
    firm = summed.where("value is not null").withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= n)
    firm = firm.groupBy("at").agg(F.min("n").alias("least"), F.count("*").alias("found"))
    lost = summed.where("value is null").select("at", F.col("n").alias("lost"))
    bounds = lost.join(firm, "at", "left").withColumn("least", F.when(F.col("found") < n, 0).otherwise(F.coalesce("least", F.lit(0))))
    # what a summary has, and may have missed, against what the n-th value has at least; a row a column
    open_values = summed.where("value is not null").join(F.broadcast(bounds), "at").where(F.col("n") + F.col("lost") >= F.col("least"))
    per_column = {r.at: r for r in bounds.join(open_values.groupBy("at").agg(F.count("*").alias("open")), "at", "left").collect()}
    exact = [i for i, r in per_column.items() if r.lost == 0]
    unsure = [i for i, r in per_column.items() if r.lost and (r.least <= r.lost or r.open > 50 * capacity)]
    close = [i for i in per_column if i not in exact and i not in unsure]
    parts = [summed.where(F.col("at").isin(exact) & F.col("value").isNotNull()).select("at", "value", "n")] if exact else []
    if close:
        pairs = lambda chosen: F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("value")) for i in chosen])
        asked = F.broadcast(open_values.where(F.col("at").isin(close)).select("at", "value"))  # at most 50 x capacity a column
        parts.append(texts.select(F.inline(pairs(close))).join(asked, ["at", "value"], "left_semi").groupBy("at", "value").agg(F.count("*").alias("n")))
    if unsure:
        each = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("value")) for i in unsure])
        parts.append(texts.select(F.inline(each)).where("value is not null").groupBy("at", "value").agg(F.count("*").alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, value string, n bigint, rank int")
    return _firsts(parts, columns, n)


def _firsts(parts: Sequence[DataFrame], columns: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent values of each column, of counts by its place."""
    names = F.array(*[F.lit(c) for c in columns])
    order = Window.partitionBy("at").orderBy(F.desc("n"), F.asc("value"))
    counted = reduce(lambda x, y: x.unionByName(y), parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return counted.select(F.get(names, F.col("at")).alias("feature"), "value", "n", "rank")


def inspection(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Type, rows, nulls, distinct values, least and greatest value, zeros, infinities and the ``n`` most frequent values of every column.

    Numbers have ``min`` and ``max``, other columns ``first`` and ``last`` as text.
    """
    columns = list(columns or df.columns)
    kinds = {c: type_family(df.schema[c].dataType) for c in columns}
    aggs = []
    for i, c in enumerate(columns):
        v, number = F.col(f"`{c}`"), kinds[c] in ("whole", "real")
        as_number = v.cast("double") if number else F.lit(None).cast("double")
        as_text = F.lit(None).cast("string") if number else v.cast("string")
        aggs += [F.count(v).alias(f"n__{i}"), F.count_if(v.isNull()).alias(f"nulls__{i}"), F.min(as_number).alias(f"min__{i}"), F.max(as_number).alias(f"max__{i}"),
                 F.min(as_text).alias(f"first__{i}"), F.max(as_text).alias(f"last__{i}"), F.count_if(as_number == 0).alias(f"zeros__{i}"),
                 F.count_if(F.abs(as_number) == float("inf")).alias(f"infinities__{i}")]
    wide = _long(df.agg(*aggs), columns, ["n", "nulls", "min", "max", "first", "last", "zeros", "infinities"])
    # one count of all values serves both the number of different ones and the most frequent ones
    totals = value_totals(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    distinct = totals.groupBy("at").agg(F.count("*").alias("distinct")).select(F.get(names, F.col("at")).alias("feature"), "distinct")
    top = heavy_hitters(df, columns, n, totals=totals).groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    kind = F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])])
    return wide.join(F.broadcast(distinct), "feature", "left").join(F.broadcast(top), "feature", "left").select(
        "feature", kind[F.col("feature")].alias("kind"), "n", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max", "first", "last", "zeros", "infinities",
        F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("n"))).alias("top"))


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None, n: int = 15) -> DataFrame:
    """Distinct values and the most frequent ones per categorical column."""
    columns = list(columns or categorical_columns(df))
    counted = unpivoted(df, columns, "string").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    distinct = counted.groupBy("feature").agg(F.count("*").alias("distinct"))
    return top_values(df, columns, n).join(F.broadcast(distinct), "feature")


def leakage_candidates(df: DataFrame, whole_words: bool = False) -> DataFrame:
    """Column names holding an identifier keyword, as a substring or as whole words."""
    spark: SparkSession = df.sparkSession
    def hit(name: str) -> bool:
        lowered = name.lower()
        words = " " + " ".join(lowered.replace("_", " ").split()) + " "
        return any((f" {k} " in words) if whole_words else (k in lowered) for k in fv.LEAKAGE_KEYWORDS)
    return spark.createDataFrame([(c, i) for i, c in enumerate(df.columns) if hit(c)], "feature string, position int")


def column_roles(df: DataFrame, label: str | None = None, identifiers: Sequence[str] = ()) -> DataFrame:
    """Every column with its type and role."""
    def role(f: T.StructField) -> str:
        if f.name == label:
            return "label"
        if f.name in identifiers:
            return "identifier"
        return "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
    rows = [(f.name, f.dataType.simpleString(), role(f), i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "feature string, type string, role string, position int")


def head(df: DataFrame, n: int = 5, order: Sequence[Column | str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)
