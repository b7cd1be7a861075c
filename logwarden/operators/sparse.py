"""One-hot encoding without a limit of categories: sparse vectors, with the category table joined instead of held on the driver.

A vector is a struct of ``size``, ``indices`` (ascending) and ``values``. Categories are numbered in value order, feature by
feature, in a range partitioning: a value's slot is the size of the partitions before it plus its row in its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.cluster import broadcast_if_small, written
from logwarden.operators.features import Encoder
from logwarden.operators.profile import unpivoted

_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[str], name: str = "slot") -> DataFrame:
    """``df`` with 0-based positions in ``order`` (which must be unique): sorted inside ranges, added up over ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    stored = written(ranged, "numbered")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored.join(F.broadcast(bases), part == F.col("_part")).withColumn(name, F.col("_base") + row).drop("_place", "_part", "_base")


@dataclass
class SparseEncoder:
    """Sparse one-hot slots, then scaled numbers. Values not seen in fitting have no slot.

    ``impute`` fills missing categories with the most frequent one (of equals the first) and missing numbers with the
    median. ``scale_slots`` divides each slot by the deviation of its indicator, without centring, so vectors stay sparse.
    """

    categorical: list[str]
    numeric: list[str]
    impute: bool = False
    scale_slots: bool = False
    categories: DataFrame | None = None  # feature, value, n, slot
    n_rows: int = 0
    n_slots: int = 0
    frequent: dict[str, str] = field(default_factory=dict)
    numbers: Encoder | None = None

    def fit(self, df: DataFrame) -> SparseEncoder:
        self.numbers = Encoder([], self.numeric, self.impute).fit(df)
        position = F.create_map(*[F.lit(x) for i, c in enumerate(self.categorical) for x in (c, i)])
        counted = unpivoted(df, self.categorical, "string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
        ordered = counted.withColumn("_feature", position[F.col("feature")])
        self.categories = written(numbered(ordered, ["_feature", "value"]).drop("_feature"), "categories")
        self.n_slots = self.categories.count()
        self.n_rows = df.count()
        first = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
        self.frequent = {r.feature: r.value for r in self.categories.groupBy("feature").agg(first.alias("value")).collect()}  # a row a column
        if self.impute:  # what fills counts as seen
            filled = {c: df.where(F.col(f"`{c}`").isNull()).count() for c in self.frequent} if self.scale_slots else {}
            added = F.coalesce(*[F.when((F.col("feature") == c) & (F.col("value") == self.frequent[c]), n) for c, n in filled.items()], F.lit(0))
            self.categories = self.categories.withColumn("n", F.col("n") + added)
        return self

    def _slot_value(self) -> Column:
        share = F.col("n") / F.lit(float(max(self.n_rows, 1)))
        spread = F.sqrt(share * (1 - share))
        return F.when(spread > 0, 1.0 / spread).otherwise(1.0) if self.scale_slots else F.lit(1.0)

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """One join a categorical column: broadcast where its categories are proven few, else by shuffle."""
        out, entries = df, []
        for i, c in enumerate(self.categorical):
            mine = self.categories.where(F.col("feature") == c).select(F.col("value").alias(f"_v{i}"), F.struct(F.col("slot").alias("i"), self._slot_value().alias("v")).alias(f"_e{i}"))
            value = F.col(f"`{c}`").cast("string")
            if self.impute and c in self.frequent:
                value = F.coalesce(value, F.lit(self.frequent[c]))
            out = out.withColumn(f"_x{i}", value).join(broadcast_if_small(mine), F.col(f"_x{i}") == F.col(f"_v{i}"), "left").drop(f"_x{i}", f"_v{i}")
            entries.append(F.col(f"_e{i}"))
        scaled = self.numbers.transform(out, "_scaled")
        numbers = F.transform("_scaled", lambda v, i: F.struct((i + F.lit(self.n_slots)).cast("bigint").alias("i"), v.alias("v")))
        all_entries = F.concat(F.filter(F.array(*entries), lambda e: e.isNotNull()), numbers) if entries else numbers
        vector = F.struct(F.lit(self.n_slots + len(self.numeric)).cast("bigint").alias("size"), F.col("_all.i").alias("indices"), F.col("_all.v").alias("values"))
        return scaled.withColumn("_all", all_entries).withColumn(output, vector).drop("_all", "_scaled", *[f"_e{i}" for i in range(len(entries))])


def scores(df: DataFrame, key: Sequence[str], weights: DataFrame, vector: str = "features", output: str = "score") -> DataFrame:
    """Sum of value times weight over each vector; ``weights``: slot, weight; slots without one count 0."""
    entries = df.select(*key, F.explode_outer(F.arrays_zip(F.col(f"{vector}.indices").alias("i"), F.col(f"{vector}.values").alias("v"))).alias("_e"))
    joined = entries.select(*key, F.col("_e.i").alias("_slot"), F.col("_e.v").alias("_v")).join(
        broadcast_if_small(weights.select(F.col("slot").alias("_s"), "weight")), F.col("_slot") == F.col("_s"), "left")
    return joined.groupBy(*key).agg(F.coalesce(F.sum(F.col("_v") * F.col("weight")), F.lit(0.0)).alias(output))
