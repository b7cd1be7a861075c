"""Isolation trees over samples of any size, grown level by level.

While a node holds more than ``node_rows`` rows, no task sees its rows together: one pass walks every row down the broadcast
upper trees and sends, per task, the count, minimum and maximum of each feature in each open node; one aggregate merges
them, and the driver draws a split for each open node (at most trees x rows / ``node_rows`` of them). Smaller nodes are
finished at once, each in one task that gets only that node's rows. Splits are drawn from a hash of seed, tree and node,
so a tree is the same however it is distributed.

Nodes carry heap numbers: the root is 1, the children of ``i`` are ``2i`` and ``2i + 1``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import written

GROWN = "tree int, heap bigint, feature int, threshold double, path double"
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(seed: int, tree: np.ndarray | int, item: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1), one for each (tree, item), the same everywhere."""
    with np.errstate(over="ignore"):
        start = _mixed(np.asarray(tree, dtype=np.int64).astype(_U) * _U(0x9E3779B97F4A7C15) + _U((seed * 1009 + turn) & 0xFFFFFFFFFFFFFFFF))
        return (_mixed(start ^ np.asarray(item, dtype=np.int64).astype(_U) * _U(0xD1342543DE82EF95)) >> _U(11)).astype(float) * 2.0**-53


def columns_of(tree: int, width: int, share: float, seed: int) -> np.ndarray:
    """The features that a tree may split on."""
    count = max(1, int(share * width))
    return np.sort(np.argsort(uniform(seed, tree, np.arange(width), 1), kind="stable")[:count])


def members(seed: int, tree: int, keys: np.ndarray, rate: float) -> np.ndarray:
    return np.ones(len(keys), dtype=bool) if rate >= 1 else uniform(seed, tree, keys, 2) < rate


def draw(seed: int, tree: np.ndarray | int, heap: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the feature and threshold of each node; -1 where no feature varies."""
    varied = high > low
    n = varied.sum(axis=1)
    nth = np.floor(uniform(seed, tree, heap, 3) * n).astype(np.int64)
    at = np.argmax(np.cumsum(varied, axis=1) > nth[:, None], axis=1)
    rows = np.arange(len(heap))
    a, b = low[rows, at], high[rows, at]
    cut = a + uniform(seed, tree, heap, 4) * (b - a)
    return np.where(n > 0, at, -1), np.where(cut < b, cut, a)  # rows on both sides of every split


def finish(x: np.ndarray, heap: int, depth: int, limit: int, tree: int, seed: int, average_path) -> dict[str, np.ndarray]:
    """The whole subtree below a node that holds ``x``, a level at a time."""
    out: dict[str, list] = {k: [] for k in ("heap", "feature", "threshold", "path")}
    own = np.full(len(x), heap, dtype=np.int64)
    while len(x):
        order = np.argsort(own, kind="stable")
        x, own = x[order], own[order]
        nodes, start, n = np.unique(own, return_index=True, return_counts=True)
        at, cut = draw(seed, tree, nodes, np.minimum.reduceat(x, start, axis=0), np.maximum.reduceat(x, start, axis=0))
        leaf = (at < 0) | (n <= 1) | (depth >= limit)
        out["heap"].append(nodes)
        out["feature"].append(np.where(leaf, -1, at))
        out["threshold"].append(np.where(leaf, 0.0, cut))
        out["path"].append(np.where(leaf, depth + average_path(n), 0.0))
        which = np.repeat(np.arange(len(nodes)), n)
        keep = ~leaf[which]
        x, which = x[keep], which[keep]
        own = 2 * nodes[which] + (x[np.arange(len(x)), at[which]] > cut[which])
        depth += 1
    return {k: np.concatenate(v) for k, v in out.items()}


class Upper:
    """Upper part of all trees: split nodes, and where rows wait (open nodes) or are handed over."""

    def __init__(self, n_trees: int):
        self.feature = [{} for _ in range(n_trees)]
        self.threshold = [{} for _ in range(n_trees)]
        self.open = {(t, 1): None for t in range(n_trees)}
        self.handed: dict[tuple[int, int], int] = {}
        self.leaves: list[tuple[int, int, float]] = []

    def flat(self, waiting) -> list[tuple]:
        """Per tree: sorted heap numbers of split nodes with feature and threshold, and sorted heap numbers of ``waiting`` nodes with their position."""
        own: list[list] = [[] for _ in self.feature]
        for position, (tree, heap) in enumerate(waiting):
            own[tree].append((heap, position))
        out = []
        for tree, split in enumerate(self.feature):
            heaps = np.array(sorted(split), dtype=np.int64)
            feature = np.array([split[h] for h in heaps.tolist()], dtype=np.int64)
            threshold = np.array([self.threshold[tree][h] for h in heaps.tolist()], dtype=float)
            ends = sorted(own[tree])
            out.append((heaps, feature, threshold, np.array([h for h, _ in ends], dtype=np.int64), np.array([p for _, p in ends], dtype=np.int64)))
        return out


def _places(tree_part: tuple, x: np.ndarray) -> np.ndarray:
    """Position of the waiting node that each row reaches, -1 if it ends elsewhere."""
    heaps, feature, threshold, ends, position = tree_part
    at = np.ones(len(x), dtype=np.int64)
    moving = np.arange(len(x))
    while len(moving) and len(heaps):
        found = np.searchsorted(heaps, at[moving])
        inside = (found < len(heaps)) & (heaps[np.minimum(found, len(heaps) - 1)] == at[moving])
        moving, found = moving[inside], found[inside]
        at[moving] = 2 * at[moving] + (x[moving, feature[found]] > threshold[found])
    if not len(ends):
        return np.full(len(x), -1)
    found = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
    return np.where(ends[found] == at, position[found], -1)


def grown(df: DataFrame, key: Column, features: str, n: int, psi: int, width: int, n_trees: int, share: float, seed: int, node_rows: int, average_path) -> DataFrame:
    """tree, heap, feature, threshold, path: all nodes of all trees. A row is in a tree's sample with probability ``psi`` / ``n``."""
    limit, rate = math.ceil(math.log2(max(psi, 2))), psi / n
    rows = written(df.select(F.xxhash64(key).alias("k"), F.col(features).alias("x")), "forest-rows")
    columns = [columns_of(t, width, share, seed) for t in range(n_trees)]
    context = df.sparkSession.sparkContext
    upper, depth = Upper(n_trees), 0
    while upper.open:
        waiting = sorted(upper.open)
        shared = context.broadcast(upper.flat(waiting))

        def extremes(batches):
            count, low, high = np.zeros(len(waiting), dtype=np.int64), {}, {}
            for batch in batches:
                x, keys = np.vstack(batch["x"].to_numpy()), batch["k"].to_numpy()
                for tree, part in enumerate(shared.value):
                    if not len(part[3]):
                        continue
                    mine = members(seed, tree, keys, rate)
                    own = x[mine]
                    place = _places(part, own)
                    own, place = own[place >= 0][:, columns[tree]], place[place >= 0]
                    if not len(place):
                        continue
                    order = np.argsort(place, kind="stable")
                    nodes, start, m = np.unique(place[order], return_index=True, return_counts=True)
                    least, most = np.minimum.reduceat(own[order], start, axis=0), np.maximum.reduceat(own[order], start, axis=0)
                    count[nodes] += m
                    for node, a, b in zip(nodes.tolist(), least, most):
                        low[node] = np.minimum(low[node], a) if node in low else a
                        high[node] = np.maximum(high[node], b) if node in high else b
            for node in low:
                yield pd.DataFrame({"node": node, "position": np.arange(len(low[node])), "n": count[node], "low": low[node], "high": high[node]})

        found = rows.mapInPandas(extremes, "node int, position int, n bigint, low double, high double")
        merged = found.groupBy("node", "position").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        merged = merged.sort_values(["node", "position"])  # trees x rows / node_rows nodes at most, a row a feature
        upper.open = {}
        for node, part in merged.groupby("node"):
            tree, heap = waiting[node]
            m = int(part["n"].iloc[0])
            at, cut = draw(seed, tree, np.array([heap]), part["low"].to_numpy()[None, :], part["high"].to_numpy()[None, :])
            if m <= node_rows and depth < limit and at[0] >= 0 and m > 1:
                upper.handed[tree, heap] = depth
            elif m <= 1 or depth >= limit or at[0] < 0:
                upper.leaves.append((tree, heap, depth + float(average_path(m))))
            else:
                upper.feature[tree][heap], upper.threshold[tree][heap] = int(columns[tree][at[0]]), float(cut[0])
                upper.open |= {(tree, 2 * heap): None, (tree, 2 * heap + 1): None}
        depth += 1

    handed = sorted(upper.handed)
    shared = context.broadcast(upper.flat(handed))

    def sent(batches):
        for batch in batches:
            x, keys = np.vstack(batch["x"].to_numpy()), batch["k"].to_numpy()
            for tree, part in enumerate(shared.value):
                mine = members(seed, tree, keys, rate)
                place = _places(part, x[mine])
                at = np.flatnonzero(place >= 0)
                if len(at):
                    yield pd.DataFrame({"node": place[at], "x": list(x[mine][at][:, columns[tree]])})

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, heap = handed[int(pdf["node"].iloc[0])]
        nodes = finish(np.vstack(pdf["x"].to_numpy()), heap, upper.handed[tree, heap], limit, tree, seed, average_path)
        nodes["feature"] = np.where(nodes["feature"] >= 0, columns[tree][nodes["feature"]], -1)
        return pd.DataFrame({"tree": tree, **nodes})

    below = rows.mapInPandas(sent, "node int, x array<double>").groupBy("node").applyInPandas(finished, GROWN)
    above = [(t, h, f, upper.threshold[t][h], 0.0) for t, split in enumerate(upper.feature) for h, f in split.items()]
    above += [(t, h, -1, 0.0, p) for t, h, p in upper.leaves]
    return below.unionByName(df.sparkSession.createDataFrame(above, GROWN)) if above else below


def linked(nodes: pd.DataFrame) -> pd.DataFrame:
    """Heap-numbered nodes with dense numbers (the root is 0) and links to their children."""
    nodes = nodes.sort_values(["tree", "heap"], ignore_index=True)
    number = nodes.groupby("tree").cumcount()
    at = pd.Series(number.to_numpy(), index=pd.MultiIndex.from_frame(nodes[["tree", "heap"]]))
    inner = nodes["feature"].to_numpy() >= 0
    child = lambda side: np.where(inner, at.reindex(pd.MultiIndex.from_arrays([nodes["tree"], 2 * nodes["heap"] + side])).fillna(-1).to_numpy(), -1).astype(int)
    return pd.DataFrame({"tree": nodes["tree"], "node": number, "feature": nodes["feature"], "threshold": nodes["threshold"], "left": child(0), "right": child(1), "path": nodes["path"]})
