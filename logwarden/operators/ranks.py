"""Exact order statistics and running sums over any number of rows, without a global sort.

Order statistics narrow brackets of values around the wanted ranks and order only what the last brackets hold. For
running sums, values are first counted (map-side combine keeps a value that fills a third of the rows to one
row per task), then spread over value ranges of a fixed number of buckets per group. Bucket
totals are small and give each bucket its offset; ordering happens only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.cluster import broadcast_if_small, written

MAX_BUCKETS = 8192
#: Brackets of one round of narrowing (a power of two), and rows that a bracket may hold when it is ordered.
BRACKETS = 1024
LAST_ROWS = 1 << 18


def bucket_count(df: DataFrame) -> int:
    """A power of two, at least twice the shuffle partitions, so every task gets ranges to order."""
    wanted = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, 1 << max(4, (wanted - 1).bit_length()))


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, value), nulls and NaN left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*groups, value).agg(F.count("*").alias("n"))


def bucketed(counts: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """``counts`` with a value-range bucket per group, from quantile-sketch bounds.

    The bucket (the number of bounds below the value) is found by halving, one projection a step.
    """
    buckets = bucket_count(counts)
    probs = F.split(F.lit(" ".join(str(i / buckets) for i in range(1, buckets))), " ").cast("array<double>")
    bounds = counts.groupBy(*groups).agg(F.percentile_approx(value, probs, max(1000, 4 * buckets)).alias("bounds"))
    joined = counts.join(bounds, list(groups)) if groups else counts.crossJoin(F.broadcast(bounds))
    found = joined.withColumn("bucket", F.lit(0))
    step = buckets // 2
    while step:
        above = F.col(value) > F.get("bounds", F.col("bucket") + (step - 1))
        found = found.withColumn("bucket", F.col("bucket") + F.when(above, step).otherwise(0))
        step //= 2
    return found.drop("bounds")


def _offsets(parts: DataFrame, groups: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per bucket: totals, totals of earlier buckets and of the group; at most ``MAX_BUCKETS`` rows a group."""
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = parts.groupBy(*groups, "bucket").agg(*[F.sum(c).alias(f"bucket_{c}") for c in sums])
    return totals.select(
        *groups, "bucket", *[f"bucket_{c}" for c in sums],
        *[F.coalesce(F.sum(f"bucket_{c}").over(earlier), zero).alias(f"offset_{c}") for c in sums],
        *[F.sum(f"bucket_{c}").over(whole).alias(f"total_{c}") for c in sums])


def _inside(groups: Sequence[str], value: str):
    return Window.partitionBy(*groups, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(counts: DataFrame, value: str, sums: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``before_x`` (sum over smaller values) and ``total_x`` for each summed column ``x``."""
    parts = bucketed(counts, value, groups)
    joined = parts.join(_offsets(parts, groups, sums), [*groups, "bucket"])
    zero = F.lit(0).cast("bigint")
    before = [
        (F.col(f"offset_{c}") + F.coalesce(F.sum(c).over(_inside(groups, value)), zero)).alias(f"before_{c}") for c in sums]
    return joined.select(*groups, value, *sums, *before, *[f"total_{c}" for c in sums])


def _valued(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Group columns and the value as ``_v``, nulls and NaN left out."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*groups, v.alias("_v"))


def _cells(rows: DataFrame, keys: Sequence[str], brackets: int) -> DataFrame:
    """Per key and bracket of a sketch: exact number of rows, smallest and largest value, rows before it and of the key.

    Two passes, each an aggregate that tasks combine before they send: sketches, then at most twice ``brackets`` counts a key.
    """
    probs = F.split(F.lit(" ".join(str(i / brackets) for i in range(1, brackets))), " ").cast("array<double>")
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_v", probs, max(1000, 4 * brackets)).alias("_bounds"))
    found = (rows.join(broadcast_if_small(bounds), list(keys)) if keys else rows.crossJoin(F.broadcast(bounds))).withColumn("_at", F.lit(0))
    step = brackets // 2
    while step:
        above = F.col("_v") > F.get("_bounds", F.col("_at") + (step - 1))
        found = found.withColumn("_at", F.col("_at") + F.when(above, step).otherwise(0))
        step //= 2
    # a value that is itself a bound, as a frequent one must be, gets a bracket of its own
    found = found.withColumn("_at", 2 * F.col("_at") + F.when(F.get("_bounds", F.col("_at")) == F.col("_v"), 1).otherwise(0))
    counted = found.groupBy(*keys, "_at").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select(*keys, "_lo", "_hi", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))


def bracketed(df: DataFrame, value: str, ranks: dict[str, Column], groups: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, int]:
    """For each wanted rank the bracket of values that holds it, narrowed until it has at most ``LAST_ROWS`` rows.

    Returns the wanted ranks (group, ``_name``, ``_rank``, ``_total``, ``_lo``, ``_hi``, ``_before``: rows below ``_lo``),
    one row a group and rank; the rows inside open brackets, where ``_lo`` < ``_hi``; and the number of rounds. Each round
    counts rows per bracket and looks closer only at those that hold a rank, so a round divides them by ``BRACKETS``.
    """
    rows = _valued(df, value, groups)
    names = F.array(*[F.struct(F.lit(n).alias("_name"), r.cast("bigint").alias("_rank")) for n, r in ranks.items()])
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    cells = _cells(rows, groups, BRACKETS)
    kept = ["_name", "_rank", "_total", "_lo", "_hi", "_before", "_n"]
    found = cells.withColumn("total_n", F.col("_total")).select("*", F.inline(names)).where(inside)
    wanted = written(found.select(*groups, *kept), "brackets")
    rounds, last = 1, None
    while True:
        brackets = wanted.where("_lo < _hi").select(*groups, "_lo", "_hi", "_before", "_n").distinct()
        renamed = brackets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_lo").alias("_low"), F.col("_hi").alias("_high"), F.col("_before").alias("_below"), "_n")
        same = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(groups)]
        narrow = reduce(lambda a, b: a & b, [*same, F.col("_v").between(F.col("_low"), F.col("_high"))])
        largest = wanted.where("_lo < _hi").agg(F.max("_n")).first()[0]
        if not largest or largest <= LAST_ROWS or largest == last:
            return wanted, rows.join(broadcast_if_small(renamed), narrow).select(*groups, "_low", "_below", "_v"), rounds
        last = largest
        # the brackets are the groups of the next round; ranks stay counted from the group's smallest value
        keys = [*groups, "_low", "_below"]
        cells = _cells(rows.join(broadcast_if_small(renamed), narrow).select(*keys, "_v"), keys, BRACKETS)
        cells = cells.select(*groups, F.col("_low").alias("_of"), F.col("_lo").alias("_new_lo"), F.col("_hi").alias("_new_hi"),
                             (F.col("_before") + F.col("_below")).alias("_new_before"), F.col("_n").alias("_new_n"))
        open_ranks = wanted.where("_lo < _hi").join(broadcast_if_small(cells), [*groups] or F.lit(True)).where(
            (F.col("_lo") == F.col("_of")) & (F.col("_rank") >= F.col("_new_before")) & (F.col("_rank") < F.col("_new_before") + F.col("_new_n")))
        closer = open_ranks.select(*groups, "_name", "_rank", "_total", F.col("_new_lo").alias("_lo"), F.col("_new_hi").alias("_hi"),
                                   F.col("_new_before").alias("_before"), F.col("_new_n").alias("_n"))
        wanted = written(wanted.where("_lo = _hi").unionByName(closer), "brackets")
        rounds += 1


def order_statistics(df: DataFrame, value: str, ranks: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Values at 0-based ranks per group; a rank is a Column over ``total_n``, the group's rows.

    Only the rows of the last brackets are counted by value and ordered: at most ``LAST_ROWS`` for each rank, however
    many rows there are. A value that fills a bracket needs neither. Groups without a wanted rank give no row.
    """
    wanted, rows, _ = bracketed(df, value, ranks, groups)
    counts = rows.withColumnRenamed("_low", "_bucket").groupBy(*groups, "_bucket", "_below", "_v").agg(F.count("*").alias("_times"))
    earlier = Window.partitionBy(*groups, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_first", F.col("_below") + F.coalesce(F.sum("_times").over(earlier), F.lit(0)))
    placed = placed.select(*[F.col(g).alias(f"_p{i}") for i, g in enumerate(groups)], "_bucket", "_v", "_first", (F.col("_first") + F.col("_times")).alias("_end"))
    same = [F.col(g) == F.col(f"_p{i}") for i, g in enumerate(groups)]
    here = reduce(lambda a, b: a & b, [*same, F.col("_lo") < F.col("_hi"), F.col("_lo") == F.col("_bucket"), F.col("_rank") >= F.col("_first"), F.col("_rank") < F.col("_end")])
    told = wanted.join(placed, here, "left").withColumn("_value", F.coalesce("_v", "_lo"))
    at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_value")))
    return told.groupBy(*groups).agg(*[at(n).alias(n) for n in ranks], F.max("_total").alias("total_n"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, one column per name, plus the row count ``total_n``."""
    position = {name: F.lit(float(p)) * (F.col("total_n") - 1) for name, p in probs.items()}
    ranks = {}
    for i, name in enumerate(probs):
        ranks[f"lo_{i}"] = F.floor(position[name])
        ranks[f"hi_{i}"] = F.ceil(position[name])
    found = order_statistics(df, value, ranks, groups)

    def between(i: int, name: str) -> Column:
        lo, hi = F.col(f"lo_{i}").cast("double"), F.col(f"hi_{i}").cast("double")
        return lo + (hi - lo) * (position[name] - F.floor(position[name]))

    return found.select(*groups, *[between(i, n).alias(n) for i, n in enumerate(probs)], "total_n")


def medians(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, groups).drop("total_n")


def dense_index(df: DataFrame, order: str, name: str = "event_index") -> DataFrame:
    """0-based position of every row by a unique ``order`` column."""
    unique = df.select(order).withColumn("n", F.lit(1).cast("bigint"))
    positions = running_sums(unique, order, ["n"]).select(order, F.col("before_n").alias(name))
    return df.join(positions, order)
