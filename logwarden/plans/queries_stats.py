"""Registered queries for profiling, features, calibration, evaluation and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.operators import drift, evaluate, features, profile, ranks, sparse
from logwarden.plans.driver_tables import events, raw_events, table

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CUTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; integers widened to bigint."""
    def fix(name: str, kind: str):
        if kind == "double":
            return F.round(name, digits).alias(name)
        return F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint") else F.col(name)
    return df.select(*[fix(n, k) for n, k in df.dtypes])


def scored(spark, sf_dir) -> DataFrame:
    """Events as scored records: value is the decision value, errors and clicks are the attacks."""
    return raw_events(spark, sf_dir).select(
        "event_id", F.col("value").alias("score"), F.col("event_type").alias("family"),
        F.col("event_type").isin("error", "click").cast("int").alias("y"),
        F.concat("event_type", F.lit("-"), (F.col("k") % 7).cast("string")).alias("label"),
        features.in_fraction(F.col("event_id"), 0.75).alias("fit"))


def _probability(spark, sf_dir) -> DataFrame:
    return scored(spark, sf_dir).withColumn("score", F.col("score") / (F.col("score") + 40))


def calibration_normals(df: DataFrame) -> DataFrame:
    return df.where((F.col("y") == 0) & ~F.col("fit"))


def _lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _split_lineitem(spark, sf_dir) -> DataFrame:
    key = F.concat("l_orderkey", F.lit("-"), "l_linenumber")
    return _lineitem(spark, sf_dir).withColumn("split", F.when(features.in_fraction(key, 0.75), "train").otherwise("test"))


def _audited(spark, sf_dir) -> DataFrame:
    """All columns of lineitem, with some null cells; every seventh order is there twice, and once more under the other status."""
    df = _lineitem(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    again = df.where("l_orderkey % 7 = 0")
    other = again.where("l_orderkey % 2 = 0").withColumn("l_linestatus", F.when(F.col("l_linestatus") == "O", "F").otherwise("O"))
    return df.unionByName(again).unionByName(other)


def _inspected_events(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _shown(df: DataFrame) -> DataFrame:
    return rounded(profile.inspection(df).withColumn("top", F.array_join(F.transform("top", lambda t: F.concat_ws("=", t["value"], t["n"].cast("string"))), "|")))


def _class_distribution(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir).select(F.col("l_linestatus").alias("dataset"), (F.col("l_returnflag") != "N").cast("int").alias("label"),
                                         F.col("l_returnflag").alias("category"))
    return profile.class_distribution(df, "dataset", "label", "category")


def _constant(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir).withColumn("fixed", F.lit(3.0)).withColumn("absent", F.lit(None).cast("double"))
    return profile.constant_features(df.select("l_quantity", "fixed", "absent", "l_tax"))


def _skew(spark, sf_dir) -> DataFrame:
    return profile.skewness(_skewed(spark, sf_dir), ["value", "heavy"])


def _skewed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("value", F.pow("value", F.lit(4)).alias("heavy"))


def unsw_records(spark, sf_dir) -> DataFrame:
    """lineitem with the traffic columns the engineered features read."""
    return _lineitem(spark, sf_dir).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice as sbytes", "l_quantity * (l_linenumber - 1) as dbytes", "l_linenumber as spkts", "l_quantity % 5 as dpkts",
        "l_linenumber % 3 as sloss", "l_quantity % 2 as dloss", "l_tax * 1000 as sload", "l_discount * 100 as dload",
        "l_suppkey % 10 as ct_srv_src", "l_suppkey % 7 as ct_srv_dst", "l_partkey % 6 as ct_dst_ltm", "l_partkey % 9 as ct_src_ltm",
        "l_partkey % 4 as ct_dst_src_ltm", "l_discount as synack", "l_tax as ackdat", "l_discount + l_tax as tcprtt",
        "l_returnflag as proto", "l_linestatus as state")


def _flows(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir).selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "(l_partkey % 5) * 1000 as `Flow Duration`", "l_linenumber as `Total Fwd Packets`",
        "cast(l_quantity % 4 as int) as `Total Backward Packets`", "l_extendedprice as `Total Length of Fwd Packets`",
        "l_quantity as `Total Length of Bwd Packets`")
    out = features.flow_features(df)
    return rounded(out.select("l_orderkey", "l_partkey", "l_linenumber", *[c for c in out.columns if c.startswith("engineered_")]), 8)


_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _traffic(spark, sf_dir) -> DataFrame:
    out = features.traffic_features(unsw_records(spark, sf_dir))
    return rounded(out.select(*_KEYS, "bytes_per_packet", "src_dst_byte_ratio", "packet_ratio", "loss_rate", "connection_rate"), 8)


def _targeted(spark, sf_dir) -> DataFrame:
    out = features.targeted_features(unsw_records(spark, sf_dir))
    return rounded(out.select(*_KEYS, "total_bytes", "total_packets", "byte_ratio", "packet_ratio", "load_ratio", "loss_rate",
                              "connection_activity", "tcp_handshake_time"), 8)


def _cleaned(spark, sf_dir) -> DataFrame:
    text = F.when(F.col("event_id") % 9 == 0, "Infinity").when(F.col("event_id") % 9 == 1, "n/a").when(
        F.col("event_id") % 9 == 2, "NaN").otherwise((F.col("event_id") - 500).cast("string"))
    df = table(spark, sf_dir, "events").select("event_id", text.alias("v"))
    clean = features.clean_numeric(df, ["v"])
    return rounded(clean.withColumn("logged", F.log1p(F.greatest(F.col("v"), F.lit(0.0)))).select("event_id", F.col("v").alias("number"), "logged"))


def _labels(spark, sf_dir) -> DataFrame:
    names = ["BENIGN", " benign ", "DoS Hulk", "DDoS", "PortScan", "FTP-Patator", "Web Attack - XSS", "Infiltration", "Bot", "Heartbleed", "Odd"]
    kdd = ["normal", "neptune", "satan", "spy", "perl", "mystery"]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", pick(names).alias("flow"), pick(kdd).alias("record"))
    family = features.attack_family(F.col("record"))
    return df.select("event_id", features.flow_family(F.col("flow")).alias("flow_family"), features.is_attack(F.col("flow")).cast("bigint").alias("flow_attack"),
                     family.alias("family"), features.is_attack(F.col("record"), "normal").cast("bigint").alias("attack"),
                     F.array_join(features.family_techniques(family), " ").alias("techniques"))


def _stratified(spark, sf_dir) -> DataFrame:
    df = scored(spark, sf_dir)
    return features.stratified_split(df, F.col("event_id"), "family", 0.8).select("event_id", "family", "in_train")


def _down(spark, sf_dir) -> DataFrame:
    df = scored(spark, sf_dir)
    special = F.col("label").isin("error-3", "click-5")
    return features.down_sample(df, F.col("event_id"), special).select("event_id", special.alias("special"))


def _encoded(spark, sf_dir) -> DataFrame:
    """Encoder fitted on half of the rows without the returned ones, applied to all rows."""
    df = _split_lineitem(spark, sf_dir)
    encoder = features.Encoder(["l_returnflag", "l_linestatus"], list(LINE_NUMBERS), impute=True).fit(
        df.where((F.col("split") == "train") & (F.col("l_returnflag") != "R")))
    out = encoder.transform(df)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.size("features").cast("bigint").alias("width"),
                              F.get("features", F.lit(0)).alias("first_slot"), total.alias("total")), 4)


def _sparse(spark, sf_dir) -> DataFrame:
    """Parts, suppliers and flags of lineitem as sparse slots, fitted on one half; missing flags and taxes are filled."""
    df = _split_lineitem(spark, sf_dir).withColumns({
        "l_returnflag": F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")), "l_tax": F.when(F.col("l_quantity") != 7, F.col("l_tax"))})
    encoder = sparse.SparseEncoder(["l_returnflag", "l_partkey", "l_suppkey"], ["l_tax", "l_quantity"], impute=True).fit(df.where("split = 'train'"))
    v = F.col("features")
    total = F.aggregate(v["values"], F.lit(0.0), lambda a, x: a + x)
    return rounded(encoder.transform(df).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), v["size"].alias("width"), F.size(v["indices"]).cast("bigint").alias("entries"),
        F.get(v["indices"], F.lit(0)).alias("flag_slot"), F.aggregate(v["indices"], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("slot_sum"), total.alias("total")), 4)


def _medians(spark, sf_dir) -> DataFrame:
    long = profile.unpivoted(_lineitem(spark, sf_dir), LINE_NUMBERS, keep=["l_returnflag"])
    return rounded(ranks.medians(long, "value", ["l_returnflag", "feature"]))


def _sweep(spark, sf_dir) -> DataFrame:
    df = scored(spark, sf_dir)
    thresholds = evaluate.fpr_thresholds(calibration_normals(df))
    return evaluate.sweep(df.where(~F.col("fit")), thresholds, len(evaluate.TARGET_FPRS))


def _flagged():
    return F.col("score") < 12.5


def _candidates(spark, sf_dir) -> DataFrame:
    """Four detectors (score below a cut) with overall and minority metrics."""
    df = scored(spark, sf_dir)
    cuts = {"cut_5": 5.0, "cut_15": 15.0, "cut_40": 40.0, "cut_90": 90.0}
    minority = F.col("label").isin("error-3", "click-5")
    wide = df.agg(*[c for i, cut in enumerate(cuts.values()) for c in evaluate.confusion(F.col("y"), F.col("score") < cut, f"__{i}")],
                  *[F.avg(F.when(minority, (F.col("score") < cut).cast("double"))).alias(f"minority__{i}") for i, cut in enumerate(cuts.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("detector"), *[F.col(f"{c}__{i}").alias(c) for c in ("tn", "fp", "fn", "tp", "minority")])
                     for i, n in enumerate(cuts)])
    return evaluate.rates(wide.select(F.inline(rows)))


def _comparison(spark, sf_dir) -> DataFrame:
    table_ = _candidates(spark, sf_dir)
    parts = [(n, table_.where(F.col("detector") == n).drop("detector", "minority")) for n in ("cut_5", "cut_15", "cut_40", "cut_90")]
    return rounded(evaluate.compare(parts).select("detector", "precision", "recall", "f1", "fpr"))


def _hybrid(spark, sf_dir) -> DataFrame:
    df = scored(spark, sf_dir)
    both = evaluate.hybrid(F.col("score") < 20, F.col("label").endswith("3") | F.col("label").endswith("5"))
    parts = [(n, evaluate.metrics(df, flag)) for n, flag in both.items()]
    return rounded(evaluate.compare(parts))


def _category_shares(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    return rounded(drift.category_shares(df, ["l_linestatus", "l_linenumber"], "l_returnflag", "N", ["A", "R"]))


def _subsets(spark, sf_dir) -> DataFrame:
    """Named feature subsets as columns of the records table: how many features each selects."""
    n = table(spark, sf_dir, "region").agg(F.count("*").alias("n_regions"))
    rows = [(name, len(features.feature_subset(name))) for name in ("baseline_41", "behavioral", "minority_focused", "without_host_stats", "compact_hybrid")]
    return spark.createDataFrame(rows, "subset string, n_features bigint").crossJoin(n)


def _ablation(spark, sf_dir) -> DataFrame:
    """Spread of scaled feature sums with all, none and all but one of the engineered columns."""
    df = features.traffic_features(unsw_records(spark, sf_dir))
    engineered = ["bytes_per_packet", "src_dst_byte_ratio", "packet_ratio", "loss_rate", "connection_rate"]
    sets = features.ablation_sets(engineered)
    total = lambda cols: sum((F.col(c).cast("double") for c in cols), F.col("sbytes"))
    wide = df.agg(*[F.stddev_samp(total(cols)).alias(f"s__{i}") for i, cols in enumerate(sets.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.col(f"s__{i}").alias("spread")) for i, n in enumerate(sets)])
    return rounded(wide.select(F.inline(rows)), 2)


def _dense(spark, sf_dir) -> DataFrame:
    gapped = table(spark, sf_dir, "events").select((F.col("event_id") * 7 + 3).alias("ingest_seq"))
    return ranks.dense_index(gapped, "ingest_seq")


def _defaults(spark, sf_dir) -> DataFrame:
    part = raw_events(spark, sf_dir).select("event_id", F.when(F.col("k") % 3 == 0, F.col("value")).alias("src_bytes"),
                                            F.when(F.col("k") % 5 == 0, "http").alias("service"))
    full = features.fill_defaults(part, service_level=True)
    return features.lock_features(full, ["protocol_type", "service", "flag", "src_bytes", "count", "same_srv_rate", "hot"], ["event_id"])


QUERIES = {
    "dataset_audit": lambda s, d: profile.audit(_audited(s, d)),
    "dataset_nulls": lambda s, d: profile.column_audit(events(s, d)),
    "audit_by_file": lambda s, d: profile.audit_by_file(_audited(s, d), "l_linestatus"),
    "audit_labels": lambda s, d: profile.label_counts(_audited(s, d), ["l_returnflag", "l_linenumber", "l_tax"], ["l_linestatus"]),
    "class_distribution": lambda s, d: rounded(_class_distribution(s, d)),
    "numeric_profile": lambda s, d: rounded(profile.numeric_profile(_lineitem(s, d), LINE_NUMBERS).drop("infinities"), 4),
    "categorical_profile": lambda s, d: rounded(profile.categorical_profile(table(s, d, "part"), ["p_brand", "p_type", "p_name"])),
    "constant_features": _constant,
    "skewness_screen": lambda s, d: rounded(_skew(s, d), 5),
    "skewed_features": lambda s, d: rounded(profile.skewed_features(_skewed(s, d), ["value", "heavy"], 3.0), 5),
    "feature_inspection": lambda s, d: _shown(_lineitem(s, d).withColumn("ratio", F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.round(1 / F.col("l_tax"), 3)))),
    "event_inspection": lambda s, d: _shown(_inspected_events(s, d)),
    "leakage_candidates": lambda s, d: profile.leakage_candidates(events(s, d)).select("feature"),
    "column_roles": lambda s, d: profile.column_roles(_lineitem(s, d), "l_returnflag", ["l_orderkey"]).select("feature", "role"),
    "table_head": lambda s, d: profile.head(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), 5, ["o_orderkey"]),
    "numeric_cleaning": _cleaned,
    "attack_families": _labels,
    "default_fill": _defaults,
    "flow_features": _flows,
    "traffic_features": _traffic,
    "targeted_features": _targeted,
    "feature_subsets": _subsets,
    "ablation_sets": _ablation,
    "hash_split": lambda s, d: scored(s, d).select("event_id", "fit"),
    "stratified_split": _stratified,
    "down_sample": _down,
    "exact_sample": lambda s, d: features.sample_exactly(scored(s, d), F.col("event_id"), 3000).select("event_id"),
    "day_roles": lambda s, d: table(s, d, "events").select("event_id", features.day_role(F.concat(F.date_format("ts", "EEEE"), F.lit("-WorkingHours.csv"))).alias("role")),
    "one_hot_and_scale": _encoded,
    "sparse_one_hot": _sparse,
    "group_medians": _medians,
    "log_comparison": lambda s, d: rounded(drift.transform_comparison(_skewed(s, d), ["value", "heavy"]), 4),
    "dense_index": _dense,
    "fpr_thresholds": lambda s, d: rounded(evaluate.fpr_thresholds(calibration_normals(scored(s, d)))),
    "upper_tail_threshold": lambda s, d: rounded(evaluate.fpr_thresholds(calibration_normals(_probability(s, d)), fprs=(0.05,), upper=True)),
    "risk_bounds": lambda s, d: rounded(evaluate.risk_bounds(calibration_normals(scored(s, d)), scored(s, d).where("y = 1"), F.col("event_id"))),
    "detector_metrics": lambda s, d: rounded(evaluate.metrics(scored(s, d), _flagged())),
    "auc": lambda s, d: rounded(evaluate.auc(scored(s, d))),
    "toxicity_auc": lambda s, d: rounded(evaluate.auc(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("toxic").alias("y")))),
    "threshold_sweep": lambda s, d: rounded(_sweep(s, d)),
    "fixed_sweep": lambda s, d: rounded(evaluate.fixed_sweep(_probability(s, d), CUTS)),
    "even_sweep": lambda s, d: rounded(evaluate.even_sweep(scored(s, d))),
    "best_points": lambda s, d: rounded(evaluate.best_points(evaluate.fixed_sweep(_probability(s, d), CUTS))),
    "best_under_fpr_limits": lambda s, d: rounded(evaluate.best_under_limits(evaluate.fixed_sweep(_probability(s, d), CUTS), (0.05, 0.2, 0.3, 0.5))),
    "recall_by_family": lambda s, d: rounded(evaluate.recall_by(scored(s, d).where("y = 1"), "family", _flagged())),
    "recall_by_label": lambda s, d: rounded(evaluate.recall_by_label(scored(s, d).where("y = 1"), "label", _flagged(), worst=10)),
    "score_distribution": lambda s, d: rounded(evaluate.score_distribution(scored(s, d), "family")),
    "unseen_recall": lambda s, d: rounded(evaluate.unseen_recall(
        scored(s, d).where("not fit"), scored(s, d).where("fit and label not in ('error-2', 'click-6')"), "label", _flagged())),
    "detector_comparison": _comparison,
    "candidate_selection": lambda s, d: rounded(evaluate.select_candidates(_candidates(s, d), "minority", "cut_15").select("detector", "f1", "minority")),
    "metric_deltas": lambda s, d: rounded(evaluate.metric_deltas(_candidates(s, d), "cut_15")),
    "hybrid_and_or": _hybrid,
    "score_histogram": lambda s, d: rounded(evaluate.histogram(scored(s, d)).select("bin", "y", "n")),
    "roc_points": lambda s, d: rounded(evaluate.roc_points(scored(s, d))),
    "effect_sizes": lambda s, d: rounded(drift.effect_sizes(_lineitem(s, d), LINE_NUMBERS, "l_returnflag", "N", top=3), 5),
    "numeric_shift": lambda s, d: rounded(drift.numeric_shift(_split_lineitem(s, d), LINE_NUMBERS, "split", "train", "test"), 5),
    "categorical_shift": lambda s, d: rounded(drift.categorical_shift(_split_lineitem(s, d), ["l_returnflag", "l_suppkey"], "split", "train", "test")),
    "category_shares": _category_shares,
    "score_shift": lambda s, d: rounded(drift.score_shift(_probability(s, d).where("y = 0").withColumn("split", F.when(F.col("fit"), "fit").otherwise("rest")), "split"), 5),
    "split_fprs": lambda s, d: rounded(drift.split_fprs(_probability(s, d).where("y = 0").withColumn("split", F.when(F.col("fit"), "fit").otherwise("rest")), "split", CUTS)),
}
