"""Batch and stream scoring of records: decision value, verdict, risk, bucket and reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.text import risk_bucket, risk_score
from logwarden.models.iforest import IsolationForest, IsolationForestModel
from logwarden.models.reasons import Baseline
from logwarden.operators import evaluate
from logwarden.operators.features import Encoder, split


@dataclass
class Detector:
    """Encoder, forest, threshold and risk bounds fitted together; ``score`` is one row-local transform."""

    encoder: Encoder
    forest: IsolationForestModel
    baseline: Baseline
    threshold: float
    score_low: float
    score_high: float

    @classmethod
    def train(cls, records: DataFrame, key: Column, attack: Column, categorical: list[str], numeric: list[str],
              forest: IsolationForest | None = None, target_fpr: float = 0.05, seed: str = "42") -> Detector:
        """Fit on three quarters of the normal rows, calibrate on the rest and on sampled attacks."""
        normal, attacks = records.where(~attack), records.where(attack)
        fit_rows, held_out = split(normal, key, 0.75, seed)
        encoder = Encoder(categorical, numeric).fit(fit_rows)
        model = (forest or IsolationForest()).fit(encoder.transform(fit_rows), key)
        calibrated = model.decision(encoder.transform(held_out))
        attacked = model.decision(encoder.transform(attacks))
        threshold = evaluate.fpr_thresholds(calibrated, fprs=(target_fpr,)).first().threshold
        bounds = evaluate.risk_bounds(calibrated, attacked, key).first()
        return cls(encoder, model, Baseline(numeric, categorical).fit(fit_rows), threshold, bounds.score_low, bounds.score_high)

    def score(self, records: DataFrame, explain: bool = True) -> DataFrame:
        """``records`` with score, is_anomaly, risk_score, risk_level and, if asked, reasons."""
        scored = self.forest.decision(self.encoder.transform(records)).drop("features")
        risk = risk_score(F.col("score"), self.score_low, self.score_high)
        out = scored.withColumn("_risk", risk).withColumns({
            "is_anomaly": F.col("score") < F.lit(float(self.threshold)), "risk_score": F.round("_risk", 2),
            "risk_level": risk_bucket(F.col("_risk"))}).drop("_risk")
        return self.baseline.explain(out) if explain else out

    def save(self, spark, path: str) -> None:
        self.encoder.save(spark, f"{path}/encoder")
        self.forest.save(spark, f"{path}/forest")
        self.baseline.save(spark, f"{path}/baseline")
        row = [(float(self.threshold), float(self.score_low), float(self.score_high))]
        spark.createDataFrame(row, "threshold double, score_low double, score_high double").write.parquet(f"{path}/calibration")

    @classmethod
    def load(cls, spark, path: str) -> Detector:
        encoder = Encoder.load(spark, f"{path}/encoder")
        c = spark.read.parquet(f"{path}/calibration").first()
        baseline = Baseline.load(spark, f"{path}/baseline", encoder.numeric, encoder.categorical)
        return cls(encoder, IsolationForestModel.load(spark, f"{path}/forest"), baseline, c.threshold, c.score_low, c.score_high)
