"""Connection-record features: cleaning, engineered columns, splits, encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.cluster import broadcast_if_small
from logwarden.operators import ranks
from logwarden.schema import KDD_FEATURES, KDD_NUMERIC, require_columns

# ---- labels and cleaning ----------------------------------------------------


def attack_family(label: Column) -> Column:
    """Family of a fine label, ``unknown`` when unlisted."""
    known = F.create_map(*chain.from_iterable(
        (F.lit(name), F.lit(family)) for family, names in fv.ATTACK_FAMILIES.items() for name in names))
    return F.coalesce(F.try_element_at(known, label), F.lit("unknown"))


def family_techniques(family: Column) -> Column:
    known = F.create_map(*chain.from_iterable(
        (F.lit(f), F.array(*[F.lit(t) for t in codes]).cast("array<string>")) for f, codes in fv.FAMILY_TECHNIQUES.items()))
    return F.coalesce(F.try_element_at(known, family), F.array().cast("array<string>"))


def flow_family(label: Column) -> Column:
    """Family of a flow label by ordered substring tests."""
    lowered = F.lower(label)
    return reduce(
        lambda acc, t: acc.when(lowered.contains(t[0]), t[1]), fv.CIC_FAMILY_TESTS, F.when(F.upper(F.trim(label)) == "BENIGN", "BENIGN")
    ).otherwise("OtherAttack")


def is_attack(label: Column, normal: str = "BENIGN") -> Column:
    return (F.upper(F.trim(label)) != normal.upper()).cast("int")


def numeric_or_null(value: Column) -> Column:
    """A number; text that is none, NaN and infinities become null."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def clean_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric_or_null(F.col(f"`{c}`")) for c in columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop by list; names the table lacks are ignored."""
    return df.drop(*columns)


def lock_features(df: DataFrame, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the training features in training order; a missing one is an error."""
    return require_columns(df, order).select(*keep, *[f"`{c}`" for c in order])


def log1p_columns(df: DataFrame, columns: Sequence[str] = fv.UNSW_SKEWED) -> DataFrame:
    """log(1 + x) with negatives clipped to 0; absent columns are skipped."""
    return df.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in columns if c in df.columns})


def fill_defaults(df: DataFrame, service_level: bool = False) -> DataFrame:
    """Complete partial events: absent or null features get their default."""
    defaults = {c: 0.0 for c in KDD_NUMERIC} | fv.MODEL_DEFAULTS | (fv.SERVICE_DEFAULTS if service_level else {})
    def value(c: str) -> Column:
        kind = "string" if c in fv.KDD_CATEGORICAL else "double"
        given = F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
        return F.coalesce(given, F.lit(defaults[c]).cast(kind))
    return df.withColumns({c: value(c) for c in KDD_FEATURES})


# ---- engineered columns -----------------------------------------------------


def flow_features(df: DataFrame) -> DataFrame:
    """Packets, bytes, their rates per second (duration in microseconds) and the direction ratio."""
    fwd, bwd = F.col("Total Fwd Packets"), F.col("Total Backward Packets")
    seconds = F.nullif(F.col("Flow Duration").cast("double"), F.lit(0.0)) / 1_000_000
    packets = fwd + bwd
    size = F.col("Total Length of Fwd Packets") + F.col("Total Length of Bwd Packets")
    return df.withColumns({
        "engineered_packet_count": packets,
        "engineered_byte_count": size,
        "engineered_packets_per_second": packets / seconds,
        "engineered_bytes_per_second": size / seconds,
        "engineered_fwd_bwd_packet_ratio": F.try_divide(fwd.cast("double"), bwd.cast("double")),
    })


def _per_extra(top: Column, bottom: Column) -> Column:
    return top / (bottom + 1)


def traffic_features(df: DataFrame) -> DataFrame:
    """Bytes per packet, byte and packet ratios, loss rate and connection rate."""
    c = F.col
    guarded = lambda a, b: a / (F.nullif((b + 1).cast("double"), F.lit(0.0)) + 1e-9)
    return df.withColumns({
        "bytes_per_packet": _per_extra(c("sbytes") + c("dbytes"), c("spkts") + c("dpkts")),
        "src_dst_byte_ratio": guarded(c("sbytes"), c("dbytes")),
        "packet_ratio": guarded(c("spkts"), c("dpkts")),
        "loss_rate": _per_extra(c("sloss") + c("dloss"), c("spkts") + c("dpkts")),
        "connection_rate": c("ct_srv_src") + c("ct_dst_ltm") + c("ct_src_ltm"),
    })


def targeted_features(df: DataFrame) -> DataFrame:
    """Volume, imbalance, load, loss, activity and handshake columns."""
    c = F.col
    return df.withColumns({
        "total_bytes": c("sbytes") + c("dbytes"),
        "total_packets": c("spkts") + c("dpkts"),
        "byte_ratio": _per_extra(c("sbytes"), c("dbytes")),
        "packet_ratio": _per_extra(c("spkts"), c("dpkts")),
        "load_ratio": _per_extra(c("sload"), c("dload")),
        "loss_rate": _per_extra(c("sloss") + c("dloss"), c("spkts") + c("dpkts")),
        "connection_activity": c("ct_srv_src") + c("ct_srv_dst") + c("ct_dst_ltm") + c("ct_src_ltm") + c("ct_dst_src_ltm"),
        "tcp_handshake_time": c("synack") + c("ackdat") + c("tcprtt"),
    })


# Our own five record features; no committed definition of the originals survives.
RECORD_FEATURES = ("byte_balance", "error_pressure", "access_attempts", "host_focus", "root_activity")


def record_features(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "byte_balance": F.log1p(c("src_bytes")) - F.log1p(c("dst_bytes")),
        "error_pressure": (c("serror_rate") + c("rerror_rate")) * F.log1p(c("count")),
        "access_attempts": c("num_failed_logins") + c("hot") + c("num_access_files"),
        "host_focus": c("dst_host_same_srv_rate") - c("dst_host_diff_srv_rate"),
        "root_activity": c("root_shell") + c("su_attempted") + c("num_root") + c("num_shells"),
    })


def feature_subset(name: str) -> list[str]:
    """Columns of a named subset of the 41 features."""
    if name == "baseline_41":
        return list(KDD_FEATURES)
    if name == "without_host_stats":
        return [c for c in KDD_FEATURES if not c.startswith("dst_host_")]
    return list(fv.FEATURE_SUBSETS[name])


def ablation_sets(engineered: Sequence[str]) -> dict[str, list[str]]:
    """All engineered features, none, and all but each one."""
    sets = {"all": list(engineered), "none": []}
    return sets | {f"without_{drop}": [c for c in engineered if c != drop] for drop in engineered}


# ---- splits by keyed hash: repeatable, no shuffle ---------------------------


def key_hash(key: Column, seed: str = "42") -> Column:
    """60 bits of MD5(key + seed)."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("bigint")


def in_fraction(key: Column, fraction: float, seed: str = "42") -> Column:
    """True for about ``fraction`` of the keys; the negation is the exact complement."""
    small = F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(seed))), F.lit(8)), 16, 10).cast("bigint")
    return (small % 10_000) < F.lit(round(fraction * 10_000))


def split(df: DataFrame, key: Column, fraction: float = 0.75, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    chosen = in_fraction(key, fraction, seed)
    return df.where(chosen), df.where(~chosen)


def stratified_split(df: DataFrame, key: Column, label: str, fraction: float = 0.8, seed: str = "42") -> DataFrame:
    """``in_train`` per row with exactly ceil(fraction * n) training rows in every class.

    The cut is the class's exact hash quantile, found without ordering a whole class.
    """
    hashed = df.withColumn("split_hash", key_hash(key, seed))
    cut = ranks.order_statistics(
        hashed, "split_hash", {"cut": F.ceil(F.lit(fraction) * F.col("total_n")) - 1}, [label]).select(label, "cut")
    return hashed.join(broadcast_if_small(cut), label).withColumn("in_train", F.col("split_hash") <= F.col("cut")).drop("split_hash", "cut")


def sample_exactly(df: DataFrame, key: Column, n: int | Column, seed: str = "42") -> DataFrame:
    """The ``n`` rows with the smallest key hash (all rows when fewer); ``n`` may use ``total_n``."""
    hashed = df.withColumn("split_hash", key_hash(key, seed))
    wanted = F.lit(n) if isinstance(n, int) else n
    cut = ranks.order_statistics(hashed, "split_hash", {"cut": F.least(wanted, F.col("total_n")) - 1}).select("cut")
    return hashed.crossJoin(F.broadcast(cut)).where(F.col("split_hash") <= F.col("cut")).drop("split_hash", "cut")


def down_sample(df: DataFrame, key: Column, special: Column, ratio: int = 3, seed: str = "42") -> DataFrame:
    """All special rows and ``ratio`` times as many of the others."""
    n_special = df.where(special).agg((F.count("*") * ratio).alias("wanted"))
    others = df.where(~special).withColumn("split_hash", key_hash(key, seed))
    per_hash = others.crossJoin(F.broadcast(n_special))
    cut = ranks.order_statistics(
        per_hash, "split_hash", {"cut": F.least(F.col("wanted"), F.col("total_n")) - 1}, ["wanted"]).select("cut")
    kept = others.crossJoin(F.broadcast(cut)).where(F.col("split_hash") <= F.col("cut")).drop("split_hash", "cut")
    return df.where(special).unionByName(kept)


def day_role(file: Column) -> Column:
    """train / calibration / test by the capture day in a file name."""
    lowered = F.lower(file)
    days = list(fv.CIC_DAY_ROLES.items())
    return reduce(lambda acc, d: acc.when(lowered.contains(d[0]), d[1]), days[1:], F.when(lowered.contains(days[0][0]), days[0][1]))


# ---- encoding and scaling ---------------------------------------------------


@dataclass
class Encoder:
    """One-hot categories (unseen -> all zeros), imputation and standard scaling as one projection.

    Fitting takes one aggregate over the numeric columns, one exact median pass when imputing,
    and one count per category value; only these small statistics reach the driver.
    """

    categorical: list[str]
    numeric: list[str]
    impute: bool = False
    max_categories: int = 10_000
    categories: dict[str, list[str]] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    fill: dict[str, float] = field(default_factory=dict)
    frequent: dict[str, str] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Encoder:
        from logwarden.operators.profile import unpivoted

        if self.categorical:
            counted = (
                unpivoted(df, self.categorical, "string").where(F.col("value").isNotNull())
                .groupBy("feature", "value").agg(F.count("*").alias("n")))
            limit = self.max_categories * len(self.categorical)
            rows = counted.limit(limit + 1).collect()  # bounded by max_categories per column
            if len(rows) > limit:
                raise ValueError(f"more than {self.max_categories} categories per column; hash or drop the widest column")
            for c in self.categorical:
                mine = [(r.value, r.n) for r in rows if r.feature == c]
                self.categories[c] = sorted(v for v, _ in mine)
                if mine:
                    self.frequent[c] = min(mine, key=lambda vn: (-vn[1], vn[0]))[0]
        if self.impute and self.numeric:
            found = ranks.medians(unpivoted(df, self.numeric), "value", ["feature"]).collect()  # one row per column
            self.fill = {r.feature: r.median for r in found}
        if self.numeric:
            stats = df.select([self._number(c).alias(c) for c in self.numeric]).agg(
                *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(self.numeric)],
                *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(self.numeric)]).first()
            for i, c in enumerate(self.numeric):
                self.mean[c] = stats[f"m{i}"] or 0.0
                self.scale[c] = stats[f"s{i}"] or 1.0  # zero variance scales by 1
        return self

    def _number(self, c: str) -> Column:
        v = F.col(f"`{c}`").cast("double")
        return F.coalesce(v, F.lit(float(self.fill.get(c, 0.0)))) if self.impute else v

    def _category(self, c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        return F.coalesce(v, F.lit(self.frequent[c])) if self.impute and c in self.frequent else v

    @property
    def feature_names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.categorical for v in self.categories[c]] + list(self.numeric)

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """``output``: array<double> of one-hot slots, then scaled numbers (null counts as the mean)."""
        def slots(c: str) -> Column:
            values = F.array(*[F.lit(v) for v in self.categories[c]]).cast("array<string>")
            return F.transform(values, lambda v: F.coalesce((v == self._category(c)).cast("double"), F.lit(0.0)))

        hot = [slots(c) for c in self.categorical]
        scaled = F.array(*[
            F.coalesce((self._number(c) - F.lit(float(self.mean[c]))) / F.lit(float(self.scale[c])), F.lit(0.0)) for c in self.numeric
        ]).cast("array<double>")
        return df.withColumn(output, F.concat(*hot, scaled))

    def rows(self) -> list[tuple]:
        """The fitted state as (feature, kind, text, number) rows, for the model sink."""
        out = [(c, "category", v, float(i)) for c in self.categorical for i, v in enumerate(self.categories[c])]
        out += [(c, "frequent", v, None) for c, v in self.frequent.items()]
        out += [(c, "column", "categorical", float(i)) for i, c in enumerate(self.categorical)]
        out += [(c, "column", "numeric", float(i)) for i, c in enumerate(self.numeric)]
        for kind, values in (("mean", self.mean), ("scale", self.scale), ("fill", self.fill)):
            out += [(c, kind, None, float(v)) for c, v in values.items()]
        return out

    def save(self, spark, path: str) -> None:
        spark.createDataFrame(self.rows(), "feature string, kind string, text string, number double").write.parquet(path)

    @classmethod
    def load(cls, spark, path: str, impute: bool = False) -> Encoder:
        rows = spark.read.parquet(path).collect()  # fitted statistics only
        made = cls([], [], impute)
        for r in sorted(rows, key=lambda r: (r.kind, r.number or 0.0)):
            if r.kind == "category":
                made.categories.setdefault(r.feature, []).append(r.text)
            elif r.kind == "frequent":
                made.frequent[r.feature] = r.text
            elif r.kind == "column":
                getattr(made, r.text).append(r.feature)
            else:
                getattr(made, r.kind)[r.feature] = r.number
        return made
