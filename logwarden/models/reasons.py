"""Reason codes: which fields of a record stand out from normal traffic.

The baseline (a mean and deviation per number, a share per category value) is a few hundred
values held as literals, so explaining a row needs no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.operators.profile import unpivoted

Z_LIMIT, RARE_SHARE, TOP_REASONS, NO_DEVIATION = 2.0, 0.01, 5, 1e-6


def friendly(name: str) -> str:
    return fv.FRIENDLY_NAMES.get(name, name.replace("_", " "))


def general_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, as printf's %g."""
    scientific = F.format_string("%.5e", x)
    exponent = F.substring_index(scientific, "e", -1).cast("int")
    stripped = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = stripped(scientific.cast("double").cast("decimal(38,10)").cast("string"))
    powered = F.concat(stripped(F.substring_index(scientific, "e", 1)), F.lit("e"), F.substring_index(scientific, "e", -1))
    return F.when(x == 0, "0").when((exponent < -4) | (exponent >= 6), powered).otherwise(fixed)


@dataclass
class Baseline:
    """Fitted on normal records; ``explain`` works on any table with the same columns."""

    numeric: list[str]
    categorical: list[str]
    max_categories: int = 10_000
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    share: dict[str, dict[str, float]] = field(default_factory=dict)

    def fit(self, normal: DataFrame) -> Baseline:
        stats = normal.agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.numeric)],
            *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(self.numeric)]).first()
        for i, c in enumerate(self.numeric):
            self.mean[c] = float(stats[f"m{i}"] or 0.0)
            self.std[c] = float(stats[f"s{i}"] or 0.0) or NO_DEVIATION
        if self.categorical:
            limit = self.max_categories * len(self.categorical)
            counted = unpivoted(normal, self.categorical, "string").where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))
            total = F.sum("n").over(Window.partitionBy("feature"))
            rows = counted.withColumn("share", F.col("n") / total).limit(limit + 1).collect()  # bounded by max_categories
            if len(rows) > limit:
                raise ValueError(f"more than {self.max_categories} values in a categorical column")
            for c in self.categorical:
                self.share[c] = {r.value: r.share for r in rows if r.feature == c}
        return self

    def explain(self, df: DataFrame, output: str = "reasons", top: int = TOP_REASONS) -> DataFrame:
        """``output``: array of (feature, description, magnitude), strongest first."""
        found = []
        for i, c in enumerate(self.numeric):
            value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            z = (value - F.lit(self.mean[c])) / F.lit(self.std[c])
            found.append(F.when(F.abs(z) >= Z_LIMIT, self._found(-F.abs(z), i, c, value, F.lit(self.mean[c]), z > 0, F.lit(None).cast("string"))))
        for i, c in enumerate(self.categorical, len(self.numeric)):
            value = F.col(c).cast("string")
            shares = F.create_map(*chain.from_iterable((F.lit(v), F.lit(float(s))) for v, s in self.share[c].items())) if self.share[c] else None
            share = F.coalesce(F.try_element_at(shares, value), F.lit(0.0)) if shares is not None else F.lit(0.0)
            found.append(F.when(share < RARE_SHARE, self._found((share - 1.0) * 3.0, i, c, share, F.lit(0.0), F.lit(False), F.coalesce(value, F.lit("None")))))
        best = F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, top)
        return df.withColumn(output, F.transform(best, self._described))

    @staticmethod
    def _found(order: Column, position: int, name: str, value: Column, mean: Column, higher: Column, text: Column) -> Column:
        return F.struct(order.alias("order"), F.lit(position).alias("position"), F.lit(name).alias("feature"), F.lit(friendly(name)).alias("phrase"),
                        value.alias("value"), mean.alias("mean"), higher.alias("higher"), text.alias("text"))

    @staticmethod
    def _described(r: Column) -> Column:
        number = F.concat(
            r["phrase"], F.lit(" is "), F.when(r["higher"], "much higher than").otherwise("much lower than"), F.lit(" typical baseline (value="),
            general_number(r["value"]), F.lit(", normal avg≈"), F.format_string("%.2f", r["mean"]), F.lit(")"))
        category = F.concat(
            r["phrase"], F.lit("='"), r["text"], F.lit("' is rare/absent in normal baseline traffic (seen in "),
            F.format_string("%.2f", r["value"] * 100), F.lit("% of normal cases)"))
        return F.struct(r["feature"].alias("feature"), F.when(r["text"].isNull(), number).otherwise(category).alias("description"),
                        (-r["order"]).alias("magnitude"))

    def rows(self) -> list[tuple]:
        out = [(c, None, "mean", self.mean[c]) for c in self.numeric] + [(c, None, "std", self.std[c]) for c in self.numeric]
        return out + [(c, v, "share", s) for c in self.categorical for v, s in self.share[c].items()]

    def save(self, spark, path: str) -> None:
        spark.createDataFrame(self.rows(), "feature string, value string, kind string, number double").write.parquet(path)

    @classmethod
    def load(cls, spark, path: str, numeric: list[str], categorical: list[str]) -> Baseline:
        made = cls(numeric, categorical, share={c: {} for c in categorical})
        for r in spark.read.parquet(path).collect():  # fitted statistics only
            if r.kind == "share":
                made.share[r.feature][r.value] = r.number
            else:
                getattr(made, r.kind)[r.feature] = r.number
        return made
