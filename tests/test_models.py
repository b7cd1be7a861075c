import ast

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.models import forest, levels, lof, search
from logwarden.models.iforest import IsolationForest, IsolationForestModel, average_path
from logwarden.models.lof import LocalOutlierFactor, nearest, nearest_counted
from logwarden.models.ocsvm import OneClassSvm
from logwarden.models.reasons import Baseline, general_number
from logwarden.models.scoring import Detector
from logwarden.operators import evaluate


@pytest.fixture(scope="module")
def planted(spark):
    """600 normal rows around 0 and 30 far ones."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(600, 4)), rng.normal(loc=7, size=(30, 4))])
    rows = [(i, [float(v) for v in r], int(i >= 600)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, features array<double>, y int").cache()


def area(df):
    return evaluate.auc(df).first().roc_auc


def test_forest_finds_outliers_reloads_and_ignores_partitioning(spark, planted, tmp_path):
    fit = planted.where("y = 0")
    model = IsolationForest(n_trees=60, max_samples=128).fit(fit, F.col("id"))
    scored = model.decision(planted)
    assert area(scored) > 0.98
    flagged = model.decision(fit).agg(F.avg((F.col("score") < 0).cast("double"))).first()[0]
    assert 0.005 <= flagged <= 0.02  # contamination 0.01 of the training rows
    again = IsolationForest(n_trees=60, max_samples=128).fit(fit.repartition(5), F.col("id"))
    one = {r.id: r.score for r in scored.collect()}
    assert one == {r.id: r.score for r in again.decision(planted.repartition(3)).collect()}
    model.save(spark, str(tmp_path / "m"))
    assert one == {r.id: r.score for r in IsolationForestModel.load(spark, str(tmp_path / "m")).decision(planted).collect()}


def test_forest_samples_large_tables_without_copying_rows(spark):
    df = spark.range(40_000).select("id", F.array(F.rand(1), F.rand(2)).alias("features"))
    made = IsolationForest(n_trees=10, max_samples=64)._assign(df.select(F.col("id").alias("k"), F.col("features").alias("x")), 40_000, 64)
    sizes = [r["count"] for r in made.groupBy("tree").count().collect()]
    assert len(sizes) == 10 and 40 < min(sizes) and max(sizes) < 160
    assert float(average_path(2)) == 1.0 and abs(float(average_path(256)) - 10.2448) < 1e-3


def reference_tree(x, tree, columns, limit, seed):
    """Plain recursive growth with the same draws."""
    out = {}

    def grow(rows, heap, depth):
        part = rows[:, columns]
        at, cut = levels.draw(seed, tree, np.array([heap]), part.min(axis=0)[None, :], part.max(axis=0)[None, :])
        if len(rows) <= 1 or depth >= limit or at[0] < 0:
            out[heap] = (-1, 0.0, depth + float(average_path(len(rows))))
            return
        right = part[:, at[0]] > cut[0]
        out[heap] = (int(columns[at[0]]), float(cut[0]), 0.0)
        grow(rows[~right], 2 * heap, depth + 1)
        grow(rows[right], 2 * heap + 1, depth + 1)

    grow(x, 1, 0)
    return out


@pytest.mark.parametrize("node_rows,share,samples", [(60, 1.0, 1.0), (5000, 0.7, 1.0), (20, 0.5, 0.5)])
def test_full_sample_trees_equal_recursive_growth(spark, node_rows, share, samples):
    """A third of the rows are one row; no group that finishes a node has more than its rows."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(400, 5)), np.tile(rng.normal(size=5), (200, 1))]).round(2)
    x[:, 4] = 1.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>").repartition(5)
    psi = int(samples * len(x))
    nodes = levels.grown(df, F.col("id"), "features", len(x), psi, 5, 4, share, 42, node_rows, average_path).toPandas()
    keys = np.array([r.k for r in df.select("id", F.xxhash64("id").alias("k")).orderBy("id").collect()])
    for tree in range(4):
        own = x[levels.members(42, tree, keys, psi / len(x))]
        want = reference_tree(own, tree, levels.columns_of(tree, 5, share, 42), int(np.ceil(np.log2(psi))), 42)
        got = {r.heap: (r.feature, r.threshold, r.path) for r in nodes[nodes.tree == tree].itertuples()}
        assert got == want


def test_full_sample_forest_finds_outliers(spark, planted):
    fit = planted.where("y = 0")
    model = IsolationForest(n_trees=15, max_samples=1.0, max_features=0.7, max_tree_rows=150).fit(fit, F.col("id"))
    assert model.psi == 600 and area(model.decision(planted)) > 0.98


def brute_lof(train, queries, k):
    def near(q, skip=None):
        d = np.sqrt(((train - q) ** 2).sum(axis=1))
        if skip is not None:
            d[skip] = np.inf
        at = np.argsort(d, kind="stable")[:k]
        return at, d[at]

    found = [near(t, i) for i, t in enumerate(train)]
    kd = np.array([d.max() for _, d in found])
    lrd = np.array([1 / (np.maximum(d, kd[at]).mean() + 1e-10) for at, d in found])
    out = []
    for q in queries:
        at, d = near(q)
        out.append(-lrd[at].mean() * (np.maximum(d, kd[at]).mean() + 1e-10))
    return np.array(out)


def test_lof_equals_brute_force_over_many_blocks(spark, planted):
    rows = planted.limit(630).collect()
    train = planted.where("y = 0 and id < 200").select("id", F.col("features").alias("x"))
    model = LocalOutlierFactor(k=10, block_rows=64).fit(train)
    queries = planted.where("id >= 500").select("id", F.col("features").alias("x"))
    got = {r.id: r.score - 1.5 for r in model.decision(queries).collect()}
    x = {r.id: np.array(r.features) for r in rows}
    want = brute_lof(np.array([x[i] for i in range(200)]), [x[i] for i in range(500, 630)], 10)
    assert np.allclose([got[i] for i in range(500, 630)], want, atol=1e-9)
    own = nearest(train, train, 3, same=True, block_rows=50).where("id = 7").first()
    assert len(own.neighbours) == 3 and 7 not in [n.neighbour for n in own.neighbours]


def test_one_class_score_separates(spark, planted):
    model = OneClassSvm(n_features=128, steps=5).fit(planted.where("y = 0"))
    scored = model.decision(planted)
    assert area(scored) > 0.95
    outside = scored.where("y = 0").agg(F.avg((F.col("score") < 0).cast("double"))).first()[0]
    assert outside < 0.03


def test_supervised_forest(spark, planted):
    model = forest.Forest(n_trees=8, max_depth=4).fit(planted)
    scored = forest.probability(model, planted)
    assert evaluate.auc(scored.withColumn("score", -F.col("probability"))).first().roc_auc > 0.99
    names = forest.top_importances(model, ["a", "b", "c", "d"], 2).collect()
    assert len(names) == 2 and names[0].importance >= names[1].importance
    assert forest.Forest.specialist().n_trees == 500 and forest.Forest.specialist(n_trees=5).min_leaf == 2


def test_general_number(spark):
    values = [0.0, 1.0, 123.0, 0.5, 1234567.0, 0.00001234, 123456.7, -2.5, 100000.0, 999999.5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in rows.orderBy("i").select(general_number(F.col("v"))).collect()]
    assert got == [f"{v:g}" for v in values]


def test_reasons_rank_and_describe(spark):
    normal = spark.createDataFrame([(1.0, 3.0, "http")] * 60 + [(3.0, 3.0, "http")] * 60 + [(2.0, 3.0, "rare")], "src_bytes double, hot double, service string")
    base = Baseline(["src_bytes", "hot"], ["service"]).fit(normal)
    asked = spark.createDataFrame([(50.0, 3.0, "http"), (2.0, 4.0, "rare"), (2.0, 3.0, None)], "src_bytes double, hot double, service string")
    got = [r.reasons for r in base.explain(asked).collect()]
    assert [x.feature for x in got[0]] == ["src_bytes"]
    assert got[0][0].description == "bytes sent to destination is much higher than typical baseline (value=50, normal avg≈2.00)"
    assert [x.feature for x in got[1]] == ["hot", "service"]  # no deviation: any other value is far away
    assert got[1][1].description == "network service='rare' is rare/absent in normal baseline traffic (seen in 0.83% of normal cases)"
    assert got[2][0].magnitude == 3.0 and "'None'" in got[2][0].description


def test_detector_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal()), "tcp", False) for i in range(400)] + [(400 + i, 30.0 + i, "icmp", True) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, x double, proto string, attack boolean")
    made = Detector.train(df, F.col("id"), F.col("attack"), ["proto"], ["x"], IsolationForest(n_trees=40, max_samples=64))
    scored = {r.id: r for r in made.score(df).collect()}
    assert all(scored[i].is_anomaly and scored[i].risk_level in ("High", "Critical") for i in range(400, 420))
    assert sum(scored[i].is_anomaly for i in range(400)) < 60 and scored[410].reasons[0].feature == "x"
    made.save(spark, str(tmp_path / "d"))
    again = {r.id: (r.is_anomaly, r.risk_score) for r in Detector.load(spark, str(tmp_path / "d")).score(df, explain=False).collect()}
    assert again == {i: (r.is_anomaly, r.risk_score) for i, r in scored.items()}


@pytest.mark.parametrize("same,block_rows,pivots", [(True, 64, 1024), (False, 8192, 5), (True, 8192, 1)])
def test_neighbours_by_cells_equal_brute_force(spark, same, block_rows, pivots):
    """Clusters, a far row, and one row there 150 times (ties go to the smaller id only in distance, so distances are compared)."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(loc=c, scale=0.3, size=(120, 3)) for c in (0, 4, 9)] + [np.tile([1.0, 1.0, 1.0], (150, 1)), [[50.0, 0, 0]]])
    train = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)
    q = x if same else rng.normal(loc=3, scale=4, size=(60, 3))
    queries = train if same else spark.createDataFrame([(1000 + i, [float(v) for v in r]) for i, r in enumerate(q)], "id bigint, x array<double>")
    near, pairs = nearest_counted(queries, train, 6, same, block_rows, pivots)
    got = {r.id: r.neighbours for r in near.collect()}
    assert len(got) == len(q)
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        if same:
            d[i] = np.inf
        mine = got[i if same else 1000 + i]
        assert np.allclose([m.distance for m in mine], np.sort(d)[:6], atol=1e-9)
        assert len({m.neighbour for m in mine}) == 6 and np.allclose([d[m.neighbour] for m in mine], [m.distance for m in mine], atol=1e-9)
    assert pairs < 0.5 * len(q) * len(x) or pivots < 1024  # few pivots rule out little
    assert nearest(queries, train.limit(0), 3).count() == 0


def test_grid_of_forest_sizes_equals_single_fits(spark, planted):
    fit, held = planted.where("y = 0 and id % 3 > 0"), planted.where("y = 0 and id % 3 = 0")
    fits = []
    plain = IsolationForest.fit
    IsolationForest.fit = lambda self, *a, **k: fits.append(self.n_trees) or plain(self, *a, **k)
    try:
        found = search.grid_search(fit, held, planted, F.col("id"), {"n_trees": [5, 20, 9], "max_samples": [32, 64], "contamination": [0.02]}).collect()
    finally:
        IsolationForest.fit = plain
    assert fits == [20, 20] and len(found) == 6
    for r in found:
        options = ast.literal_eval(r.settings)
        model = IsolationForest(**options).fit(fit, F.col("id"))
        threshold = evaluate.fpr_thresholds(model.decision(held), fprs=(0.05,)).first().threshold
        want = search.judge(model.decision(planted), threshold).first()
        assert abs(r.threshold - threshold) < 1e-9 and (r.tp, r.fp, r.fn) == (want.tp, want.fp, want.fn) and abs(r.roc_auc - want.roc_auc) < 1e-9


def test_wide_rows_ask_lumps_not_cells(spark, monkeypatch):
    """Where distances rule out nothing, a query is sent once a lump: rows asked do not grow with the number of cells."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32))
    train = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)
    sizes, plain = [], lof.written
    monkeypatch.setattr(lof, "written", lambda df, name: sizes.append((name, plain(df, name))) or sizes[-1][1])
    got = {r.id: r.neighbours for r in nearest(train.where("id < 300"), train, 5).collect()}
    for i in range(300):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert [m.neighbour for m in got[i]] == np.argsort(d)[:5].tolist()
    asked = [df.count() for name, df in sizes if name == "lof-asked"]
    assert len(asked) == 2 and asked[1] > 300 * 10, "nothing is ruled out here"
    n_lumps = dict(sizes)["lof-asked"].agg(F.max("lump")).first()[0] + 1
    assert asked[1] <= 300 * n_lumps and n_lumps > 30
    lumps = lof._lumps(rng.normal(size=(38, 32)), np.full(38, 1000), 8192)
    assert np.bincount(lumps).max() * 1000 <= 8192 and lumps.max() + 1 < 10
    assert set(lof._lumps(np.zeros((1, 1)), np.array([5]), 2)) == {0}
