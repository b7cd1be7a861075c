"""Hyper-parameter grids and detector comparison on one prepared table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import written
from logwarden.models.iforest import IsolationForest
from logwarden.operators import evaluate, ranks


def judge(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: confusion cells, rates and both areas for scores below ``threshold`` flagged."""
    return evaluate.metrics(scored, F.col("score") < F.lit(float(threshold))).crossJoin(F.broadcast(evaluate.auc(scored)))


def grid(settings: Mapping[str, Sequence]) -> list[dict]:
    """Every combination, the last setting varying fastest."""
    return [dict(zip(settings, values)) for values in product(*settings.values())]


def grid_search(fit_rows: DataFrame, calibration: DataFrame, test: DataFrame, key: Column, settings: Mapping[str, Sequence],
                target_fpr: float = 0.05) -> DataFrame:
    """Isolation forests over a grid; best F1, then recall, then average precision first.

    The prepared tables are written once; every combination fits on the same rows, takes its
    threshold from the calibration scores and is judged on ``test`` (features, y). Combinations that differ
    in ``n_trees`` alone are one fit: the first trees of the largest forest are the smaller one, and one walk
    scores them all.
    """
    fit_rows, calibration, test = (written(df, "grid") for df in (fit_rows, calibration, test))
    usual = IsolationForest()
    sizes = sorted({int(n) for n in settings.get("n_trees", [usual.n_trees])})
    each = F.posexplode("score_samples").alias("at", "score")
    rows = []
    for combo in grid({k: v for k, v in settings.items() if k != "n_trees"}):
        forest = IsolationForest(**combo | {"n_trees": sizes[-1], "contamination": None})
        model = forest.fit(fit_rows, key)
        share = combo.get("contamination", usual.contamination)
        # long tables: one row a row and forest
        judged = written(model.prefix_scores(test, sizes).select("y", each), "grid-scores")
        held = written(model.prefix_scores(calibration, sizes).select(each), "grid-scores")
        offsets = dict.fromkeys(range(len(sizes)), -0.5)
        if share is not None:
            own = written(model.prefix_scores(fit_rows, sizes).select(each), "grid-scores")
            offsets = {r.at: r.q for r in ranks.exact_quantiles(own, "score", {"q": share}, ["at"]).collect()}
        cuts = {r.at: r.q for r in ranks.exact_quantiles(held, "score", {"q": target_fpr}, ["at"]).collect()}
        for at, size in enumerate(sizes):
            decision = judged.where(F.col("at") == at).select("y", (F.col("score") - F.lit(float(offsets[at]))).alias("score"))
            threshold = float(cuts[at]) - float(offsets[at])
            named = {k: size if k == "n_trees" else combo[k] for k in settings}
            rows.append(judge(decision, threshold).withColumns({"threshold": F.lit(threshold), "settings": F.lit(str(named))}))
    out = reduce(lambda x, y: x.unionByName(y), rows)
    return out.orderBy(F.desc("f1"), F.desc("recall"), F.desc("average_precision"), "settings")


def compare_detectors(scores: Mapping[str, tuple[DataFrame, DataFrame]], fprs: Sequence[float] = (0.05,)) -> DataFrame:
    """Detectors on the same split at several operating points; each has (calibration, test) score tables."""
    parts = []
    for name, (calibration, test) in scores.items():
        calibration, test = written(calibration.select("score"), "scores"), written(test.select("score", "y"), "scores")
        points = evaluate.fpr_thresholds(calibration, fprs=fprs)
        swept = evaluate.sweep(test, points, len(fprs)).crossJoin(F.broadcast(evaluate.auc(test)))
        parts.append(swept.withColumn("detector", F.lit(name)))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out.orderBy(F.desc("f1"), "detector", "operating_point")
