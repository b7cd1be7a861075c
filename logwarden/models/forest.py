"""Supervised random forests on Spark ML with balanced class weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Forest:
    """``maxDepth`` is at most 30 in Spark ML; class weights apply to the whole table, not per bootstrap."""

    n_trees: int = 300
    max_depth: int = 20
    min_leaf: int = 1
    seed: int = 42

    @classmethod
    def specialist(cls, **settings) -> Forest:
        """Settings for the rare remote-access and privilege families."""
        return cls(**({"n_trees": 500, "min_leaf": 2} | settings))

    def fit(self, df: DataFrame, label: str = "y", features: str = "features") -> RandomForestClassificationModel:
        counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
        total = sum(counts.values())
        weight = F.lit(1.0)
        for value, n in counts.items():
            weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
        rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("vector"), weight.alias("weight"))
        return RandomForestClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight", numTrees=self.n_trees, maxDepth=self.max_depth,
            minInstancesPerNode=self.min_leaf, featureSubsetStrategy="sqrt", seed=self.seed).fit(rows)


def probability(model: RandomForestClassificationModel, df: DataFrame, features: str = "features", output: str = "probability") -> DataFrame:
    """``df`` with the attack probability."""
    scored = model.transform(df.withColumn("vector", array_to_vector(features)))
    out = scored.withColumn("_attack", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*df.columns, F.col("_attack").alias(output))


def top_importances(model: RandomForestClassificationModel, names: Sequence[str], n: int = 20) -> DataFrame:
    from pyspark.sql import SparkSession

    pairs = [(name, float(v)) for name, v in zip(names, model.featureImportances.toArray())]
    rows = SparkSession.active().createDataFrame(pairs, "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(n)
