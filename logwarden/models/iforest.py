"""Isolation forest: trees grown on small hashed samples in parallel, scored by broadcast nodes.

Each tree sees at most ``max_samples`` rows (256 unless asked otherwise), whatever the table
size, so fitting shuffles about trees x samples rows. Trees over more than ``max_tree_rows`` rows, up to all
of them, grow level by level (``levels``), and no task holds the rows of a tree. The forest is a node table of bounded
size; scoring sends only the feature column to Python, in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.cluster import written
from logwarden.models import levels
from logwarden.operators import ranks

NODE_SCHEMA = "tree int, node int, feature int, threshold double, `left` int, `right` int, path double"
_HASH_RANGE = 1 << 30


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def _grow(x: np.ndarray, columns: np.ndarray, limit: int, rng: np.random.Generator) -> dict[str, list]:
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "path")}

    def add() -> int:
        for key, blank in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("path", 0.0)):
            nodes[key].append(blank)
        return len(nodes["feature"]) - 1

    stack = [(add(), np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows][:, columns]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes["path"][node] = depth + float(average_path(len(rows)))
            continue
        chosen = rng.choice(varied)
        cut = rng.uniform(low[chosen], high[chosen])
        goes_left = part[:, chosen] <= cut
        left, right = add(), add()
        nodes["feature"][node], nodes["threshold"][node] = int(columns[chosen]), float(cut)
        nodes["left"][node], nodes["right"][node] = left, right
        stack += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


@dataclass
class IsolationForest:
    n_trees: int = 300
    max_samples: int | float = 256  # a float is a fraction of the rows
    max_features: float = 1.0
    contamination: float | None = 0.01  # None: the fixed offset -0.5
    seed: int = 42
    max_tree_rows: int = 100_000

    def fit(self, df: DataFrame, key: Column, features: str = "features") -> IsolationForestModel:
        """``key`` identifies a row; its hash decides which trees sample it."""
        n, width = df.agg(F.count("*"), F.max(F.size(features))).first()
        if not n:
            raise ValueError("cannot fit a forest on an empty table")
        psi = min(n, self.max_samples) if isinstance(self.max_samples, int) else max(1, int(self.max_samples * n))
        if psi > self.max_tree_rows:
            nodes = levels.grown(df, key, features, n, psi, width, self.n_trees, self.max_features, self.seed, self.max_tree_rows, average_path)
            # Bounded by configuration: n_trees * (2 * psi - 1) node rows.
            return self._calibrated(IsolationForestModel(levels.linked(nodes.toPandas()), psi, -0.5, width), df, features)
        assigned = self._assign(df.select(key.alias("k"), F.col(features).alias("x")), n, psi)
        limit, seed, share = math.ceil(math.log2(max(psi, 2))), self.seed, self.max_features

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            rows = pdf.nsmallest(psi, "h") if len(pdf) > psi else pdf
            rows = rows.sort_values("h")
            x = np.vstack(rows["x"].to_numpy())
            rng = np.random.default_rng((seed, tree))
            count = max(1, int(share * x.shape[1]))
            columns = np.sort(rng.choice(x.shape[1], count, replace=False))
            nodes = _grow(x, columns, limit, rng)
            return pd.DataFrame({"tree": tree, "node": range(len(nodes["feature"])), **nodes})

        nodes = assigned.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
        # Bounded by configuration: n_trees * (2 * psi - 1) node rows.
        return self._calibrated(IsolationForestModel(nodes.toPandas().sort_values(["tree", "node"]), psi, -0.5, width), df, features)

    def _calibrated(self, model: IsolationForestModel, df: DataFrame, features: str) -> IsolationForestModel:
        if self.contamination is not None:
            # written, as several passes look for the quantile
            scored = written(model.score_samples(df, features).select("score_sample"), "forest-scores")
            model.offset = ranks.exact_quantiles(scored, "score_sample", {"q": self.contamination}).first().q
        return model

    def _assign(self, rows: DataFrame, n: int, psi: int) -> DataFrame:
        """tree, h, x: the sampled rows of every tree, slightly more than ``psi`` each.

        A round cuts the range of a row hash into as many stretches as the table has samples, one for each tree; further
        trees take further rounds with another hash. So a tree's rows do not depend on how many trees there are.
        """
        wanted = psi + 4.0 * math.sqrt(psi)
        width = int(min(1.0, wanted / n) * _HASH_RANGE)
        a_round = max(1, _HASH_RANGE // width)
        rounds = F.sequence(F.lit(0), F.lit((self.n_trees - 1) // a_round))
        stretch = lambda r: F.floor(F.pmod(F.xxhash64("k", r, F.lit(self.seed)), F.lit(_HASH_RANGE)) / width)
        trees = F.transform(rounds, lambda r: F.when(stretch(r) < a_round, (r * a_round + stretch(r)).cast("int")))
        chosen = rows.select("k", "x", F.explode(trees).alias("tree")).where(F.col("tree") < self.n_trees)
        return chosen.select("tree", F.xxhash64("k", "tree").alias("h"), "x")


def _prefix_scores(x: pd.Series, flat: tuple, scale: float, sizes: list[int]) -> list[np.ndarray]:
    """Scores of the forests of the first ``sizes`` trees: path lengths are summed tree by tree."""
    roots, feature, threshold, left, right, path, depth = flat
    if not len(x):
        return [np.zeros(0) for _ in sizes]
    matrix = np.vstack(x.to_numpy())
    rows = np.arange(len(matrix))
    total, found = np.zeros(len(matrix)), {}
    for count, root in enumerate(roots, 1):
        at = np.full(len(matrix), root)
        for _ in range(depth):
            at = np.where(matrix[rows, feature[at]] <= threshold[at], left[at], right[at])
        total += path[at]
        if count in sizes:
            found[count] = -(2.0 ** (-total / count / scale))
    return [found[size] for size in sizes]


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame
    psi: int
    offset: float
    width: int

    def _flat(self):
        """Node columns of all trees end to end, with child links made absolute."""
        start = self.nodes.groupby("tree").size().cumsum().shift(fill_value=0)
        base = self.nodes["tree"].map(start).to_numpy()
        leaf = self.nodes["feature"].to_numpy() < 0
        own = base + self.nodes["node"].to_numpy()
        left = np.where(leaf, own, base + self.nodes["left"].to_numpy())
        right = np.where(leaf, own, base + self.nodes["right"].to_numpy())
        return (start.to_numpy(), np.where(leaf, 0, self.nodes["feature"]).astype(np.int32), self.nodes["threshold"].to_numpy(),
                left.astype(np.int64), right.astype(np.int64), self.nodes["path"].to_numpy(), int(math.ceil(math.log2(max(self.psi, 2)))))

    def score_samples(self, df: DataFrame, features: str = "features", output: str = "score_sample") -> DataFrame:
        """Minus the anomaly score: in (-1, 0), lower is more anomalous."""
        shared = df.sparkSession.sparkContext.broadcast(self._flat())
        scale = float(average_path(self.psi)) or 1.0

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(_prefix_scores(x, shared.value, scale, [len(shared.value[0])])[0])

        return df.withColumn(output, score(F.col(features)))

    def prefix_scores(self, df: DataFrame, sizes: list[int], features: str = "features", output: str = "score_samples") -> DataFrame:
        """``output``: array of what ``score_samples`` of the forests of the first ``sizes`` trees give, from one walk through the largest."""
        shared = df.sparkSession.sparkContext.broadcast(self._flat())
        scale, sizes = float(average_path(self.psi)) or 1.0, list(sizes)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(_prefix_scores(x, shared.value, scale, sizes), axis=1)))

        return df.withColumn(output, score(F.col(features)))

    def decision(self, df: DataFrame, features: str = "features", output: str = "score") -> DataFrame:
        """Decision value: below 0 for the contaminated share; higher is more normal."""
        scored = self.score_samples(df, features, "_sample")
        return scored.withColumn(output, F.col("_sample") - F.lit(float(self.offset))).drop("_sample")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.psi, float(self.offset), self.width)], "psi int, offset double, width int").write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])  # bounded model state
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls(nodes, settings.psi, settings.offset, settings.width)
