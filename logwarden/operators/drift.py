"""Distribution shift: effect sizes against normal, train/test shift, category shares, score shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.operators import ranks
from logwarden.operators.profile import moments, unpivoted


def effect_sizes(df: DataFrame, columns: Sequence[str], family: str, normal: str, top: int | None = 15, with_median: bool = True) -> DataFrame:
    """abs(mean difference) / normal std per feature and attack family, strongest first.

    Null cells count as 0. Each family is compared with the normal rows of the same pass.
    """
    filled = df.select(family, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in columns])
    stats = moments(filled, columns, [family]).select(family, "feature", "mean", "std")
    if with_median:
        long = unpivoted(filled, columns, keep=[family])
        stats = stats.join(ranks.medians(long, "value", [family, "feature"]), [family, "feature"])
    else:
        stats = stats.withColumn("median", F.lit(None).cast("double"))
    base = stats.where(F.col(family) == normal).select(
        "feature", F.col("mean").alias("normal_mean"), F.col("std").alias("normal_std"), F.col("median").alias("normal_median"))
    effect = F.when(F.col("normal_std") > 0, F.abs(F.col("mean") - F.col("normal_mean")) / F.col("normal_std")).otherwise(0.0)
    out = stats.where(F.col(family) != normal).join(F.broadcast(base), "feature").select(
        family, "feature", "normal_mean", F.col("mean").alias("attack_mean"), "normal_median", F.col("median").alias("attack_median"),
        effect.alias("effect_size"), F.abs(F.col("median") - F.col("normal_median")).alias("median_difference"))
    if top is None:
        return out
    w = Window.partitionBy(family).orderBy(F.desc("effect_size"), "feature")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def numeric_shift(df: DataFrame, columns: Sequence[str], split: str, first: str, second: str) -> DataFrame:
    """abs(mean difference) / sqrt((s1^2 + s2^2) / 2) per feature between two splits."""
    stats = moments(df, columns, [split])
    pick = lambda c, s: F.max(F.when(F.col(split) == s, F.col(c)))
    wide = stats.groupBy("feature").agg(
        pick("mean", first).alias("first_mean"), pick("mean", second).alias("second_mean"),
        pick("std", first).alias("first_std"), pick("std", second).alias("second_std"))
    pooled = F.sqrt((F.col("first_std") ** 2 + F.col("second_std") ** 2) / 2)
    return wide.withColumn("shift", F.when(pooled > 0, F.abs(F.col("first_mean") - F.col("second_mean")) / pooled).otherwise(0.0))


def _shares(df: DataFrame, columns: Sequence[str], split: str, values: Sequence[str]) -> DataFrame:
    """Counts and shares per (feature, value) in each split; absent values have share 0."""
    long = unpivoted(df, columns, "string", [split])
    counted = long.groupBy("feature", "value").agg(*[
        F.count_if(F.col(split) == v).alias(f"n_{i}") for i, v in enumerate(values)])
    totals = df.agg(*[F.count_if(F.col(split) == v).alias(f"t_{i}") for i, v in enumerate(values)])
    return counted.crossJoin(F.broadcast(totals)).select(
        "feature", "value", *[f"n_{i}" for i in range(len(values))],
        *[F.coalesce(F.try_divide(F.col(f"n_{i}"), F.col(f"t_{i}")), F.lit(0.0)).alias(f"share_{i}") for i in range(len(values))])


def categorical_shift(df: DataFrame, columns: Sequence[str], split: str, first: str, second: str) -> DataFrame:
    """Share per split and the change in percentage points; values of either split appear."""
    return _shares(df.where(F.col(split).isin(first, second)), columns, split, [first, second]).select(
        "feature", "value", F.col("n_0").alias("first_n"), F.col("n_1").alias("second_n"), F.col("share_0").alias("first_share"),
        F.col("share_1").alias("second_share"), ((F.col("share_1") - F.col("share_0")) * 100).alias("change_points"))


def category_shares(df: DataFrame, columns: Sequence[str], family: str, normal: str, families: Sequence[str]) -> DataFrame:
    """Share of each category value in every family against its share in normal rows."""
    wide = _shares(df, columns, family, [normal, *families])
    rows = F.array(*[
        F.struct(F.lit(f).alias("family"), F.col("share_0").alias("normal_share"), F.col(f"share_{i}").alias("family_share"),
                 F.abs(F.col(f"share_{i}") - F.col("share_0")).alias("difference")) for i, f in enumerate(families, 1)])
    return wide.select("feature", "value", F.inline(rows))


SCORE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def score_shift(scored: DataFrame, split: str, score: str = "score") -> DataFrame:
    """Count, mean, std, min, max and percentiles of scores per split."""
    base = scored.groupBy(split).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))
    return base.join(ranks.exact_quantiles(scored, score, SCORE_QUANTILES, [split]).drop("total_n"), split)


def split_fprs(normal: DataFrame, split: str, cuts: Sequence[float], score: str = "score") -> DataFrame:
    """False-positive rate of normal rows at fixed probability cuts, per split, in one pass."""
    wide = normal.groupBy(split).agg(F.count("*").alias("n"), *[
        F.count_if(F.col(score) >= float(c)).alias(f"c__{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(float(c)).alias("threshold"), (F.col(f"c__{i}") / F.col("n")).alias("fpr")) for i, c in enumerate(cuts)])
    return wide.select(split, F.inline(rows))


def transform_comparison(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness of each column before and after log1p."""
    from logwarden.operators.features import log1p_columns
    from logwarden.operators.profile import skewness

    before = skewness(df, columns).withColumnRenamed("skew", "skew_before")
    after = skewness(log1p_columns(df, columns), columns).withColumnRenamed("skew", "skew_after")
    return before.join(F.broadcast(after), "feature")
