"""Nearest neighbours by largest inner product, from a forest of random-projection trees.

*Fit.* Trees are grown on the driver from at most ``sample_rows`` vectors: each node splits at the median along the
difference of two random vectors, to about ``leaf_rows`` rows a leaf (never under 8 sample rows). *Index.* Every vector
gets its leaf in every tree. Equal vectors are one entry with its ``k + 1`` smallest ids, all that a result can need, so
a vector that a third of the rows share is one row. *Search.* Nodes of all trees wait in one queue, the one whose worst
margin on the way is best goes first, until ``probes`` leaves are found; the vectors in them are ranked exactly, block of
leaves by block, and the best of all blocks are kept. Each query is first ranked against a quarter of the rows, at most
the sample: a block then tells only what is no worse than the ``k + 1`` best found there, which are candidates too.

``probes`` is set by measuring: for ``tune_queries`` queries (bounded) the true neighbours are found over all rows, and
as many leaves are searched as reach ``recall``. Data without structure need a large share of the leaves; the index cannot help that.

Rows without an id, and vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do
vectors of another length than most of the sample's. Rows equal in id and vector count once. Ties go to the smaller id. Other
columns are ignored. An empty table gives an empty result; one with a single vector has no neighbours.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.cluster import written

SLICE = 16_384  # pairs whose exact products are worked out together


def entries(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """One row per different vector: ``entry`` (its smallest id), ``vec`` and the ``k + 1`` smallest ids."""
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(F.coalesce(good, F.lit(False))).withColumn("vec", F.transform("vec", lambda x: x + 0.0)).distinct()
    order = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    return rows.withColumn("n", order).filter(F.col("n") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("entry"), "vec", "ids")


class Forest:
    """Complete binary trees: node ``i`` has children ``2 i + 1`` and ``2 i + 2``; the last level's nodes are the leaves."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        inner = 2**depth - 1
        self.trees, self.depth, self.inner = trees, depth, inner
        self.axes = np.zeros((trees, inner, sample.shape[1]), dtype=np.float32)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            held = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = held.pop(node)
                if len(rows) > 1:
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    axis = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                else:
                    axis = rng.standard_normal(sample.shape[1]) / np.sqrt(sample.shape[1])
                self.axes[t, node] = axis
                along = sample[rows] @ self.axes[t, node].astype(float)
                self.cuts[t, node] = np.median(along) if len(rows) else 0.0
                side = along > self.cuts[t, node]
                held[2 * node + 1], held[2 * node + 2] = rows[~side], rows[side]

    @property
    def leaves(self) -> int:
        return 2**self.depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree: rows by trees."""
        out = np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", x, self.axes[t, node].astype(float))
                node = 2 * node + 1 + (along > self.cuts[t, node])
            out[:, t] = node - self.inner
        return out

    def search(self, query: np.ndarray, probes: int) -> list[int]:
        """Leaves (tree * leaves + leaf) in the order in which the shared queue gives them."""
        margins = (self.axes.reshape(-1, self.axes.shape[2]) @ query).reshape(self.trees, -1).astype(float) - self.cuts
        margins = margins.tolist()
        queue, found, inner = [(-np.inf, t, 0) for t in range(self.trees)], [], self.inner
        while queue and len(found) < probes:
            worst, t, node = heapq.heappop(queue)
            # the near child is followed at once, its margin can only be the better one
            while node < inner:
                margin = margins[t][node]
                near, far = (2, 1) if margin > 0 else (1, 2)
                heapq.heappush(queue, (max(worst, abs(margin)), t, 2 * node + far))
                node = 2 * node + near
            found.append(t * self.leaves + node - inner)
        return found


def _best(query: np.ndarray, entry: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best values of each query, ties to the smaller entry."""
    order = np.lexsort((entry, -value, query))
    q = query[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[rank < k]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row; the order of summing does not depend on the neighbours."""
    return (q * x).sum(axis=1)


def _searched(x: np.ndarray, entry: np.ndarray, leaf: np.ndarray, q: np.ndarray, least: np.ndarray, owner: np.ndarray, probed: np.ndarray,
              k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, entry and exact score of each query's ``k + 6`` best rows of its leaves, if no worse than its ``least``.

    ``x``, ``entry`` and ``leaf`` are the rows (one per tree that has them here), ``owner`` and ``probed`` the queries' leaves."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in np.unique(leaf):
        at, who = np.flatnonzero(leaf == one), owner[probed == one]
        for part in (who[i : i + 2048] for i in range(0, len(who), 2048)):
            value = q[part] @ x[at].T
            n = min(k + 6, len(at))
            top = np.argpartition(-value, n - 1, axis=1)[:, :n]
            kept.append((np.repeat(part, n), at[top].reshape(-1), np.take_along_axis(value, top, axis=1).reshape(-1)))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # products of the matrix may differ from the exact ones in their last bits: all that could be among the best stay
    slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
    who, what, near = (np.concatenate(v) for v in zip(*kept))
    close = near >= (least - slack)[who]
    who, what, near = who[close], what[close], near[close]
    _, first, one = np.unique(entry, return_index=True, return_inverse=True)
    both, at = np.unique(who * len(x) + first[one[what]], return_index=True)  # an entry may be in leaves of several trees
    who, what, near = both // len(x), both % len(x), near[at]
    order = np.lexsort((-near, who))
    who, what, near = who[order], what[order], near[order]
    begin = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
    length = np.diff(np.append(begin, len(who)))
    cut = near[begin + np.minimum(k + 5, length - 1)]
    close = near >= np.repeat(cut, length) - slack[who]
    who, what = who[close], what[close]
    value = np.concatenate([np.zeros(0), *[_exact(q[who[i : i + SLICE]], x[what[i : i + SLICE]]) for i in range(0, len(who), SLICE)]])
    best = _best(who, entry[what], value, k + 6)
    best = best[value[best] >= least[who[best]]]
    return who[best], entry[what[best]], value[best]


def brute_force(table: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """True ``k`` best entries of a bounded set of queries over all rows: query (its number), entry, vec, score."""
    sent = table.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            if not len(x) or x.shape[1] != sent.value.shape[1]:
                continue
            entry, scores = np.array(batch.column(0).to_pylist(), dtype=np.int64), x @ sent.value.T
            top = np.argsort(-scores, axis=0, kind="stable")[: k + 5]
            q = np.tile(np.arange(top.shape[1]), top.shape[0])
            rows = top.reshape(-1)
            exact = _exact(sent.value[q], x[rows])
            keep = _best(q, entry[rows], exact, k)
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(entry[rows[keep]]), batch.column(1).take(pa.array(rows[keep])), pa.array(exact[keep])],
                                             names=["query", "entry", "vec", "score"])

    found = table.select("entry", "vec").mapInArrow(run, "query long, entry long, vec array<double>, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    return found.withColumn("n", rank).filter(F.col("n") <= k).drop("n")


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 4,
            leaf_rows: int = 256, sample_rows: int = 65_536, recall: float = 0.95, tune_queries: int = 256, block_rows: int = 8_192) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``query_every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    table = written(entries(vectors, id_col, vector_col, k), "entries")
    drawn = table.select("vec", F.xxhash64("entry").alias("h"), "entry").orderBy("h", "entry").limit(sample_rows).select("vec", "entry").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], empty)
    sample = drawn.column("vec").to_numpy()
    sizes = np.array([len(v) for v in sample])
    size = int(np.bincount(sizes).argmax())
    named, sample = drawn.column("entry").to_numpy()[sizes == size], np.stack(sample[sizes == size])
    table = table.filter(F.size("vec") == size)
    total = table.count()
    depth = int(np.ceil(np.log2(max(1, min(total / leaf_rows, len(sample) / 8)))))
    forest = Forest(sample, trees, depth)
    sent = spark.sparkContext.broadcast(forest)
    # ids of all queries, also those behind the k + 1 smallest of their entry, by way of the vector
    ids = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0).alias("vec"))
    ids = ids.filter((F.col("query_id") % query_every == 0) & F.col("vec").isNotNull()).distinct()
    asked = written(ids.join(table.select("vec", "entry"), "vec").select("query_id", "entry"), "queries")
    asking = table.join(asked.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("query"), "vec")
    tune = np.array([r.vec for r in asking.select("vec", F.xxhash64("query").alias("h"), "query").orderBy("h", "query").limit(tune_queries).collect()])
    if not len(tune):
        return spark.createDataFrame([], empty)
    truth = brute_force(table, tune, k + 1).toPandas()
    where = forest.place(np.array(truth.vec.tolist())) + np.arange(trees) * forest.leaves
    orders = np.zeros((len(tune), trees * forest.leaves), dtype=np.int64)
    for i, q in enumerate(tune):
        orders[i, forest.search(q, trees * forest.leaves)] = np.arange(trees * forest.leaves)
    needed = np.sort(orders[truth["query"].to_numpy()[:, None], where].min(axis=1)) + 1
    probes = int(max(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))], min(2 * trees, trees * forest.leaves)))

    blocks = int(max(1, min(trees * forest.leaves, np.ceil(total * trees / block_rows))))
    per_block = -(-trees * forest.leaves // blocks)
    # queries are dealt over several copies of a block, so that a group stays small however many there are
    copies = int(max(1, np.ceil(asked.count() / 50_000)))

    some = min(len(sample), max(k + 1, -(-total // 4)))
    seen = spark.sparkContext.broadcast((named[:some], sample[:some]))

    def seeded(batches):
        """The best of the seen rows for each query, and the score that others must reach."""
        names, x = seen.value
        zero = np.zeros(len(x), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                q = np.array(part.column(1).to_pylist(), dtype=float).reshape(part.num_rows, -1)
                owner, probed = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
                who, entry, value = _searched(x, names, zero, q, np.full(len(q), -np.inf), owner, probed, k)
                found = [np.flatnonzero(who == i)[: k + 1] for i in range(len(q))]
                least = [value[f[-1]] if len(f) > k else -np.inf for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(least, pa.float64()), pa.array([entry[f] for f in found], pa.list_(pa.int64())),
                     pa.array([value[f] for f in found], pa.list_(pa.float64()))], names=["query", "vec", "least", "entries", "scores"])

    seeds = written(asking.mapInArrow(seeded, "query long, vec array<double>, least double, entries array<long>, scores array<double>"), "seeds")

    def index(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            leaf = (sent.value.place(x) + np.arange(sent.value.trees) * sent.value.leaves).reshape(-1)
            rows = np.repeat(np.arange(len(x)), sent.value.trees)
            for copy in range(copies):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf // per_block), pa.array(np.full(len(leaf), copy)), pa.array([[v] for v in leaf.tolist()], pa.list_(pa.int64())),
                     batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.nulls(len(rows), pa.float64())],
                    names=["block", "copy", "leaves", "entry", "vec", "least"])

    def probe(batches):
        for batch in batches:
            out = []
            for query, vec, least in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                leaves = np.sort(np.array(sent.value.search(np.array(vec), probes)))
                cut = np.flatnonzero(np.diff(leaves // per_block)) + 1
                out += [(int(part[0]) // per_block, query % copies, part.tolist(), query, vec, least) for part in np.split(leaves, cut)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64()), pa.float64()))],
                                                 names=["block", "copy", "leaves", "entry", "vec", "least"])

    schema = "block long, copy long, leaves array<long>, entry long, vec array<double>, least double"

    def rank(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, q = np.array(rows["vec"].tolist()), np.array(asks["vec"].tolist())
        owner = np.repeat(np.arange(len(asks)), [len(v) for v in asks["leaves"]])
        who, entry, value = _searched(x, rows["entry"].to_numpy(), np.array([v[0] for v in rows["leaves"]]), q, asks["least"].to_numpy(), owner,
                                      np.concatenate(asks["leaves"].to_numpy()), k)
        return pd.DataFrame({"query": asks["entry"].to_numpy()[who], "entry": entry, "score": value})

    left = table.select("entry", "vec").mapInArrow(index, schema).groupBy("block", "copy")
    right = seeds.select("query", "vec", "least").mapInArrow(probe, schema).groupBy("block", "copy")
    found = left.cogroup(right).applyInPandas(rank, "query long, entry long, score double")
    found = found.union(seeds.select("query", F.inline(F.arrays_zip(F.col("entries").alias("entry"), F.col("scores").alias("score")))))
    best = found.groupBy("query", "entry").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    best = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    by_id = best.join(table.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    by_id = by_id.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    rows = asked.join(by_id, asked.entry == by_id["query"]).filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
