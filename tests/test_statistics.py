import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logwarden.operators import drift, evaluate, features, profile, ranks, sparse
from logwarden.schema import KDD_FEATURES, require_columns


def scores(spark, rows):
    return spark.createDataFrame([(float(s), int(y)) for s, y in rows], "score double, y int")


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p < n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_average_precision(rows):
    total, out, last = sum(y for _, y in rows), 0.0, 0
    for t in sorted({s for s, _ in rows}):
        flagged = [y for s, y in rows if s <= t]
        out += (sum(flagged) - last) / total * sum(flagged) / len(flagged)
        last = sum(flagged)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=4, max_size=60))
def test_areas_equal_brute_force(spark, rows):
    rows = rows + [(3, 0), (4, 1)]
    got = evaluate.auc(scores(spark, rows)).first()
    assert math.isclose(got.roc_auc, brute_auc(rows), abs_tol=1e-9)
    assert math.isclose(got.average_precision, brute_average_precision(rows), abs_tol=1e-9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=300), st.integers(1, 6))
def test_quantiles_equal_numpy_for_any_partitioning(spark, values, parts):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(parts)
    got = ranks.exact_quantiles(df, "v", {"a": 0.01, "b": 0.5, "c": 0.95}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(values, [0.01, 0.5, 0.95]), atol=1e-9)


def test_grouped_medians_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=20_000)] + [("same", 4.0)] * 5000 + [("cold", 1.0), ("cold", 2.0), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in ranks.medians(df, "v", ["g"]).collect()}
    assert set(got) == {"hot", "same", "cold"} and got["same"] == 4.0 and got["cold"] == 1.5
    assert math.isclose(got["hot"], float(np.median([v for g, v in rows if g == "hot"])), abs_tol=1e-12)


def test_running_sums_and_dense_index(spark):
    df = spark.createDataFrame([(v, 1) for v in (5, 1, 9, 7, 3)], "v bigint, n bigint")
    assert {r.v: r.before_n for r in ranks.running_sums(df, "v", ["n"]).collect()} == {1: 0, 3: 1, 5: 2, 7: 3, 9: 4}
    assert {r.v: r.event_index for r in ranks.dense_index(df, "v").collect()} == {1: 0, 3: 1, 5: 2, 7: 3, 9: 4}


def test_confusion_cells_sum_and_zero_division(spark):
    df = scores(spark, [(1, 0), (2, 0)])
    got = evaluate.metrics(df, F.col("score") < 0).first()
    assert got.tn + got.fp + got.fn + got.tp == 2 and got.precision == got.recall == got.f1 == 0.0


def test_best_under_limits_drops_repeated_thresholds(spark):
    df = spark.createDataFrame([("a", 0.1, 0.9, 0.5, 0.6, 0.01), ("b", 0.2, 0.8, 0.9, 0.8, 0.2)],
                               "operating_point string, threshold double, precision double, recall double, f1 double, fpr double")
    got = evaluate.best_under_limits(df, [0.05, 0.1, 0.3]).orderBy("fpr_limit").collect()
    assert [(r.fpr_limit, r.operating_point) for r in got] == [(0.05, "a"), (0.3, "b")]


def test_subsets_and_ablation():
    sizes = {n: len(features.feature_subset(n)) for n in ("baseline_41", "behavioral", "minority_focused", "without_host_stats", "compact_hybrid")}
    assert sizes == {"baseline_41": 41, "behavioral": 25, "minority_focused": 27, "without_host_stats": 31, "compact_hybrid": 29}
    assert list(features.ablation_sets(["a", "b"]).items()) == [("all", ["a", "b"]), ("none", []), ("without_a", ["b"]), ("without_b", ["a"])]


def test_splits_are_complements_and_exact(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("label"))
    a, b = features.split(df, F.col("id"), 0.75)
    assert a.count() + b.count() == 2000 and 1400 < a.count() < 1600 and a.join(b, "id").count() == 0
    counted = {(r.label, r.in_train): r["count"] for r in features.stratified_split(df, F.col("id"), "label").groupBy("label", "in_train").count().collect()}
    assert counted == {("rare", True): 32, ("rare", False): 8, ("common", True): 1568, ("common", False): 392}
    assert features.sample_exactly(df, F.col("id"), 123).count() == 123 and features.sample_exactly(df, F.col("id"), 9999).count() == 2000
    assert features.down_sample(df, F.col("id"), F.col("label") == "rare").count() == 160


def test_encoder_unknown_null_constant_and_reload(spark, tmp_path):
    train = spark.createDataFrame([("tcp", 1.0, 5.0), ("udp", 3.0, 5.0), (None, None, 5.0)], "p string, x double, c double")
    made = features.Encoder(["p"], ["x", "c"]).fit(train)
    assert made.feature_names == ["p_tcp", "p_udp", "x", "c"]
    rows = spark.createDataFrame([("tcp", 1.0, 5.0), ("icmp", None, 6.0)], "p string, x double, c double")
    want = [[1.0, 0.0, -1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    assert [list(r.features) for r in made.transform(rows).collect()] == want
    made.save(spark, str(tmp_path / "e"))
    assert [list(r.features) for r in features.Encoder.load(spark, str(tmp_path / "e")).transform(rows).collect()] == want
    with pytest.raises(ValueError):
        features.Encoder(["p"], [], max_categories=1).fit(train)


def test_partial_events_and_record_features(spark):
    part = spark.createDataFrame([(7.0, None)], "src_bytes double, service string")
    full = features.fill_defaults(part).first()
    assert (full.src_bytes, full.service, full.protocol_type, full.flag, full["count"]) == (7.0, "other", "tcp", "SF", 0.0)
    assert features.fill_defaults(part, service_level=True).first()["count"] == 1.0
    out = features.record_features(features.fill_defaults(part))
    assert all(c in out.columns for c in features.RECORD_FEATURES)
    assert len(features.lock_features(out, KDD_FEATURES).columns) == 41
    with pytest.raises(ValueError, match="missing columns: nope"):
        require_columns(part, ["nope"])


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (float("inf"), None, "b"), (0.0, None, "a")], "x double, n double, s string")
    rows = {r.feature: r for r in profile.moments(df, ["x", "n"]).collect()}
    assert rows["x"].infinities == 1 and rows["x"].zeros == 1 and rows["n"].nulls == 3
    assert [r.feature for r in profile.constant_features(df).collect()] == ["n"]
    flows = spark.createDataFrame([(1, 2, 3)], "`Idle Mean` int, `Src IP` int, Packets int")
    assert [r.feature for r in profile.leakage_candidates(flows).collect()] == ["Idle Mean", "Src IP"]
    assert [r.feature for r in profile.leakage_candidates(flows, whole_words=True).collect()] == ["Src IP"]
    copies = spark.createDataFrame([(1, None)] * 3 + [(2, "x")], "a int, b string")
    assert profile.audit(copies).first().duplicate_rows == 2


def test_shift_counts_values_of_either_split(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("test", "c"), ("test", "a")], "split string, s string")
    got = {r.value: r.change_points for r in drift.categorical_shift(df, ["s"], "split", "train", "test").collect()}
    assert got == {"a": 0.0, "b": -50.0, "c": 50.0}


@pytest.mark.parametrize("brackets,last", [(16, 40), (1024, 1 << 18)])
def test_order_statistics_by_narrowing_brackets(spark, monkeypatch, brackets, last):
    """Several rounds, a hot value, infinities and heavy tails; what is ordered does not grow with the rows."""
    monkeypatch.setattr(ranks, "BRACKETS", brackets)
    monkeypatch.setattr(ranks, "LAST_ROWS", last)
    rng = np.random.default_rng(5)
    for n in (300, 3000):
        hot, tail = [7.25] * (n // 3), list(np.exp(40 * rng.normal(size=n)))
        values = {"hot": hot + list(rng.normal(size=n)), "tail": tail + [float("inf"), float("-inf"), -0.0, 0.0], "one": [3.5], "whole": [float(v) for v in rng.integers(0, 5, n)]}
        rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
        df = spark.createDataFrame(rows, "g string, v double").repartition(5)
        wanted = {"low": F.lit(0), "third": F.floor(F.col("total_n") / 3), "top": F.col("total_n") - 1}
        got = {r.g: r for r in ranks.order_statistics(df, "v", wanted, ["g"]).collect()}
        assert set(got) == set(values)
        for g, vs in values.items():
            vs = sorted(vs)
            assert (got[g].low, got[g].third, got[g].top, got[g].total_n) == (vs[0], vs[len(vs) // 3], vs[-1], len(vs))
        _, ordered, rounds = ranks.bracketed(df, "v", wanted, ["g"])
        assert ordered.count() <= last * len(wanted) * len(values) and (rounds > 1 or last > 1000 or n == 300)


def test_order_statistics_of_whole_numbers_without_groups(spark):
    values = [2**60 + 3 * i for i in range(1000)] + [-(2**60)] * 50
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = ranks.order_statistics(df, "v", {"a": F.lit(49), "b": F.lit(50), "c": F.lit(1049), "gone": F.lit(5000)}).first()
    assert (got.a, got.b, got.c, got.gone, got.total_n) == (-(2**60), 2**60, 2**60 + 2997, None, 1050)
    assert ranks.order_statistics(df.limit(0), "v", {"a": F.lit(0)}).first().a is None


def test_heavy_hitters_equal_full_counts(spark):
    """Skewed, nearly flat, unique, few and absent values, with summaries much smaller than the columns."""
    from collections import Counter

    rng = np.random.default_rng(2)
    n = 6000
    skewed = [f"s{int(v)}" for v in np.minimum(rng.zipf(1.6, n), 4000)]
    flat, unique = [f"f{int(v)}" for v in rng.integers(0, 900, n)], [f"u{i}" for i in range(n)]
    late = ["common" if i >= n - 1500 else f"x{i}" for i in range(n)]
    rows = [(skewed[i], flat[i], unique[i], i % 4, None, late[i] if i % 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "skewed string, flat string, uniq string, few int, absent string, late string").repartition(6)
    got = {}
    for r in profile.heavy_hitters(df, df.columns, 5, capacity=40).collect():
        got.setdefault(r.feature, []).append((r["rank"], r.value, r.n))
    for i, c in enumerate(df.columns):
        counts = Counter(str(r[i]) for r in rows if r[i] is not None)
        want = sorted(counts.items(), key=lambda vn: (-vn[1], vn[0]))[:5]
        assert sorted(got.get(c, [])) == [(k + 1, v, m) for k, (v, m) in enumerate(want)], c
    assert profile.heavy_hitters(df.limit(0), df.columns).count() == 0


def test_inspection_counts_each_value_once(spark, monkeypatch):
    """Distinct and most frequent values come from one count, by text: -0.0 and 0.0 differ, as do 1 and 1.00 of other columns."""
    from datetime import date
    from decimal import Decimal

    rows = [(i % 7, float(-0.0 if i % 2 else 0.0) if i % 5 else float("nan"), f"t{i}", Decimal(i % 3), date(2024, 1, 1 + i % 4), None, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b double, c string, d decimal(8,2), e date, f string, g boolean")
    monkeypatch.setattr(profile, "unpivoted", None)
    got = {r.feature: r for r in profile.inspection(df, n=2).collect()}
    assert {c: r.distinct for c, r in got.items()} == {"a": 7, "b": 3, "c": 60, "d": 3, "e": 4, "f": 0, "g": 2}
    tops = {c: [tuple(t) for t in r.top or []] for c, r in got.items()}
    assert tops == {"a": [("0", 9), ("1", 9)], "b": [("-0.0", 24), ("0.0", 24)], "c": [("t0", 1), ("t1", 1)], "d": [("0.00", 20), ("1.00", 20)],
                    "e": [("2024-01-01", 15), ("2024-01-02", 15)], "f": [], "g": [("false", 30), ("true", 30)]}
    assert profile.inspection(df.limit(0)).where("n = 0 and distinct = 0 and top is null").count() == 7


def test_audit_tells_rows_apart_by_value(spark, monkeypatch):
    """Swapped nulls are different rows, -0.0 and 0.0 the same, and equal fingerprints are settled by the rows."""
    rows = [("f", None, "a", 0.0), ("f", "a", None, 0.0), ("f", "a", None, -0.0), ("g", "a", None, 0.0), ("g", "a", None, 0.0), (None, None, None, None), (None, None, None, None), ("g", "x", "y", float("nan"))]
    df = spark.createDataFrame(rows, "file string, p string, q string, v double")
    for weak in (False, True):
        if weak:  # every row has the same fingerprint
            monkeypatch.setattr(profile, "_fingerprint", lambda columns, schema: F.lit(1))
        got = {r.file if r.n_rows < 8 else "all": (r.n_rows, r.null_cells, r.duplicate_rows) for r in profile.audit_by_file(df, "file").collect()}
        assert got == {"f": (3, 3, 1), "g": (3, 2, 1), None: (2, 6, 1), "all": (8, 11, 4)}
        assert tuple(profile.audit(df).first()) == (8, 4, 13, 3)
    assert tuple(profile.audit(df.limit(0)).first()) == (0, 4, 0, 0)


def test_sparse_vectors_equal_dense_ones(spark):
    """Unseen, missing and many categories; slots in value order over several partitions; scaled slots and scores."""
    rows = [(i, None if i % 9 == 0 else f"c{i % 40:02d}", i % 3, float(i % 11) if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, a string, b int, x double").repartition(4)
    fit = df.where("id < 200 and (a is null or a <> 'c07')")
    dense = features.Encoder(["a", "b"], ["x"], impute=True).fit(fit)
    made = sparse.SparseEncoder(["a", "b"], ["x"], impute=True).fit(fit)
    want = {r.id: r.features for r in dense.transform(df).collect()}
    got = {r.id: r.features for r in made.transform(df).collect()}
    for i, v in got.items():
        flat = [0.0] * v.size
        for at, value in zip(v["indices"], v["values"]):
            flat[at] = value
        assert np.allclose(flat, want[i]) and list(v["indices"]) == sorted(v["indices"])
    weights = spark.createDataFrame([(s, float(s)) for s in range(0, made.n_slots, 2)], "slot bigint, weight double")
    scored = {r.id: r.score for r in sparse.scores(made.transform(df), ["id"], weights).collect()}
    assert all(math.isclose(scored[i], sum(w * v for w, v in enumerate(want[i][: made.n_slots]) if w % 2 == 0), abs_tol=1e-9) for i in want)
    spread = sparse.SparseEncoder(["b"], [], scale_slots=True).fit(df)
    one = spread.transform(df).where("id = 0").first().features
    assert np.isclose(one["values"][0], 1 / math.sqrt(1 / 3 * 2 / 3)) and one.size == 3
