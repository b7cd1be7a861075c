"""Threshold calibration and detector evaluation over score tables.

Scores are decision values (higher = more normal): a row is flagged when its score lies below
the threshold. Probabilities flag at or above it. ``y`` is 1 for an attack.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.operators import ranks
from logwarden.operators.features import sample_exactly

TARGET_FPRS = tuple(i / 100 for i in range(1, 11))


# ---- thresholds -------------------------------------------------------------


def fpr_thresholds(normal: DataFrame, score: str = "score", fprs: Sequence[float] = TARGET_FPRS, upper: bool = False) -> DataFrame:
    """operating_point, target_fpr, threshold: quantiles of held-out normal scores.

    ``upper`` takes the 1 - FPR quantile, for probabilities that grow with suspicion.
    """
    names = [f"fpr_{round(f * 100, 4):g}pct" for f in fprs]
    found = ranks.exact_quantiles(normal, score, {n: (1 - f if upper else f) for n, f in zip(names, fprs)})
    rows = F.array(*[
        F.struct(F.lit(n).alias("operating_point"), F.lit(float(f)).alias("target_fpr"), F.col(n).alias("threshold"))
        for n, f in zip(names, fprs)])
    return found.select(F.inline(rows))


def risk_bounds(calibration: DataFrame, attacks: DataFrame, key: Column, score: str = "score", n_attacks: int | None = None) -> DataFrame:
    """score_low, score_high: 1st and 99th percentile of calibration plus attack scores (a sample of ``n_attacks``, if given)."""
    sampled = attacks if n_attacks is None else sample_exactly(attacks, key, n_attacks)
    both = calibration.select(score).unionByName(sampled.select(score))
    return ranks.exact_quantiles(both, score, {"score_low": 0.01, "score_high": 0.99}).select("score_low", "score_high")


# ---- metrics ----------------------------------------------------------------


def confusion(y: Column, flagged: Column, suffix: str = "") -> list[Column]:
    attack = y == 1
    return [
        F.count_if(~attack & ~flagged).alias(f"tn{suffix}"), F.count_if(~attack & flagged).alias(f"fp{suffix}"),
        F.count_if(attack & ~flagged).alias(f"fn{suffix}"), F.count_if(attack & flagged).alias(f"tp{suffix}"),
    ]


def _ratio(top: Column, bottom: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, false-positive rate and flag rate from tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return counts.select(
        "*", _ratio(tp + tn, n).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(fp, fp + tn).alias("fpr"), _ratio(tp + fp, n).alias("flag_rate"))


def metrics(scored: DataFrame, flagged: Column, y: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    return rates(scored.groupBy(*groups).agg(*confusion(F.col(y), flagged)))


def curve(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Per distinct score (flagging it and everything below): tp, fp and class totals."""
    attack = F.col(y) == 1
    counts = scored.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(attack).alias("pos"), F.count_if(~attack).alias("neg"))
    sums = ranks.running_sums(counts, score, ["pos", "neg"])
    return sums.select(
        F.col(score).alias("threshold"), "pos", "neg", (F.col("before_pos") + F.col("pos")).alias("tp"),
        (F.col("before_neg") + F.col("neg")).alias("fp"), "total_pos", "total_neg")


def auc(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """ROC-AUC with averaged ties and average precision (step sum), from one running sum.

    Lower scores are more suspicious; negate a probability first.
    """
    points = curve(scored, score, y)
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    # Negatives scored above a group rank below its positives; ties count half.
    ranked_below = pos * ((F.col("total_neg") - fp) + neg / 2)
    return points.agg(
        (F.sum(ranked_below) / (F.max("total_pos") * F.max("total_neg"))).alias("roc_auc"),
        (F.sum(pos * tp / (tp + fp)) / F.max("total_pos")).alias("average_precision"))


def roc_points(scored: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return curve(scored, score, y).select(
        "threshold", (F.col("fp") / F.col("total_neg")).alias("fpr"), (F.col("tp") / F.col("total_pos")).alias("tpr"))


def histogram(scored: DataFrame, score: str = "score", y: str = "y", bins: int = 60) -> DataFrame:
    """Counts per equal-width bin and class; empty bins are left out."""
    bounds = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(score) - F.col("lo")) / width), F.lit(bins - 1))).cast("bigint")
    return (
        scored.where(F.col(score).isNotNull()).crossJoin(F.broadcast(bounds))
        .groupBy(bin_.alias("bin"), F.col(y).alias("y")).agg(F.count("*").alias("n"), F.min(score).alias("smallest"), F.max(score).alias("largest")))


# ---- sweeps -----------------------------------------------------------------


def sweep(scored: DataFrame, thresholds: DataFrame, n_thresholds: int, score: str = "score", y: str = "y", upper: bool = False) -> DataFrame:
    """Metrics at every threshold row (operating_point, threshold), in one pass over the scores.

    The thresholds ride along as one array, so no row is multiplied. ``n_thresholds`` is their
    number, a configuration value.
    """
    listed = thresholds.agg(F.array_sort(F.collect_list(F.struct("threshold", "operating_point"))).alias("points"))
    at = lambda i: F.get("points", F.lit(i))["threshold"]
    hit = lambda i: (F.col(score) >= at(i)) if upper else (F.col(score) < at(i))
    wide = scored.select(score, y).crossJoin(F.broadcast(listed)).agg(
        F.first("points").alias("points"), *[c for i in range(n_thresholds) for c in confusion(F.col(y), hit(i), f"__{i}")])
    cells = ("tn", "fp", "fn", "tp")
    rows = F.array(*[
        F.struct(F.get("points", F.lit(i))["operating_point"].alias("operating_point"), at(i).alias("threshold"),
                 *[F.col(f"{c}__{i}").alias(c) for c in cells]) for i in range(n_thresholds)])
    return rates(wide.select(F.inline(rows)))


def fixed_sweep(scored: DataFrame, cuts: Sequence[float], score: str = "score", y: str = "y", upper: bool = True) -> DataFrame:
    points = scored.sparkSession.createDataFrame([(f"{c:g}", float(c)) for c in cuts], "operating_point string, threshold double")
    return sweep(scored, points, len(cuts), score, y, upper)


def even_sweep(scored: DataFrame, n: int = 40, score: str = "score", y: str = "y") -> DataFrame:
    """``n`` thresholds evenly spaced between the score's extremes."""
    bounds = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.concat(F.lit("step_"), i.cast("string")).alias("operating_point"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (n - 1)).alias("threshold")))
    return sweep(scored, bounds.select(F.inline(steps)), n, score, y)


def best_points(swept: DataFrame, target_fpr: float = 0.05) -> DataFrame:
    """The best-F1 row and the row closest to a target FPR (lowest threshold on ties)."""
    row = F.struct("operating_point", "threshold", "precision", "recall", "f1", "fpr")
    low = -F.col("threshold")
    best = swept.agg(
        F.max_by(row, F.struct(F.col("f1"), low)).alias("best_f1"),
        F.min_by(row, F.struct(F.abs(F.col("fpr") - target_fpr), F.col("threshold"))).alias("closest_fpr"))
    return best.select(F.inline(F.array(
        F.struct(F.lit("best_f1").alias("choice"), F.col("best_f1").alias("p")),
        F.struct(F.lit("closest_fpr").alias("choice"), F.col("closest_fpr").alias("p"))))).select("choice", "p.*")


def best_under_limits(swept: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Best F1 whose FPR stays within each limit; equal thresholds are kept once, at the lowest limit.

    A range join of a small limit table with the sweep rows.
    """
    spark = swept.sparkSession
    table = spark.createDataFrame([(float(x),) for x in limits], "fpr_limit double")
    row = F.struct("operating_point", "threshold", "precision", "recall", "f1", "fpr")
    best = (
        swept.join(F.broadcast(table), F.col("fpr") <= F.col("fpr_limit"))
        .groupBy("fpr_limit").agg(F.max_by(row, F.struct(F.col("f1"), -F.col("threshold"))).alias("p")).select("fpr_limit", "p.*"))
    first = Window.partitionBy("threshold").orderBy("fpr_limit")
    return best.withColumn("k", F.row_number().over(first)).where(F.col("k") == 1).drop("k")


# ---- recall by family and label ---------------------------------------------


def recall_by(scored: DataFrame, key: str, flagged: Column) -> DataFrame:
    """Total, detected, missed and recall per family or label."""
    return scored.groupBy(key).agg(F.count("*").alias("total"), F.count_if(flagged).alias("detected")).select(
        key, "total", "detected", (F.col("total") - F.col("detected")).alias("missed"), _ratio(F.col("detected"), F.col("total")).alias("recall"))


def recall_by_label(scored: DataFrame, label: str, flagged: Column, score: str = "score", worst: int = 20) -> DataFrame:
    """The labels with the lowest recall, with mean and median score."""
    base = scored.groupBy(label).agg(
        F.count("*").alias("total"), F.count_if(flagged).alias("detected"), F.avg(score).alias("mean_score"))
    median = ranks.medians(scored, score, [label], "median_score")
    return (
        base.join(median, label, "left")
        .select(label, "total", "detected", _ratio(F.col("detected"), F.col("total")).alias("recall"), "mean_score", "median_score")
        .orderBy("recall", label).limit(worst))


def score_distribution(scored: DataFrame, family: str, score: str = "score") -> DataFrame:
    base = scored.groupBy(family).agg(
        F.count("*").alias("total"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"))
    return base.join(ranks.medians(scored, score, [family]), family, "left")


def unseen_recall(scored: DataFrame, train: DataFrame, label: str, flagged: Column, y: str = "y") -> DataFrame:
    """Recall on attack labels absent from training: an anti join on the distinct training labels."""
    seen = train.select(label).distinct()
    novel = scored.where(F.col(y) == 1).join(seen, label, "left_anti")
    return novel.agg(
        F.count("*").alias("n_rows"), F.count_distinct(label).alias("n_labels"), F.avg(flagged.cast("double")).alias("recall"))


# ---- comparing detectors ----------------------------------------------------


def compare(rows: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One-row metric tables of several detectors, best F1 first."""
    named = [df.withColumn("detector", F.lit(name)) for name, df in rows]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out.orderBy(F.desc("f1"), F.desc("recall"), "detector")


def select_candidates(table: DataFrame, minority: str, baseline: str) -> DataFrame:
    """Best F1, best minority recall and the baseline; a detector chosen twice appears once."""
    chosen = table.agg(
        F.max_by("detector", F.struct(F.col("f1"), F.col("detector"))).alias("a"),
        F.max_by("detector", F.struct(F.col(minority), F.col("detector"))).alias("b"))
    names = chosen.select(F.explode(F.array_distinct(F.array("a", "b", F.lit(baseline)))).alias("detector"))
    return table.join(F.broadcast(names), "detector", "left_semi")


def metric_deltas(table: DataFrame, baseline: str, names: Sequence[str] = ("precision", "recall", "f1", "fpr")) -> DataFrame:
    """Every detector's metrics minus the baseline's."""
    base = table.where(F.col("detector") == baseline).select(*[F.col(c).alias(f"base_{c}") for c in names])
    return table.where(F.col("detector") != baseline).crossJoin(F.broadcast(base)).select(
        "detector", *[(F.col(c) - F.col(f"base_{c}")).alias(f"{c}_delta") for c in names])


def hybrid(first: Column, second: Column) -> dict[str, Column]:
    """Both detectors must agree, or either suffices."""
    return {"and": first & second, "or": first | second}
