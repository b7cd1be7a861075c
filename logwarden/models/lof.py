"""Local outlier factor for novelty: exact nearest neighbours by cells around pivots.

Training rows go to the cell of their nearest pivot (a bounded sample of rows). A query looks into the cells around it and
then only into those that may hold a nearer row, taken together in lumps of neighbouring cells. Lumps and queries meet in
blocks of bounded size that keep the ``k`` nearest rows per query, so neither pairs nor whole tables are materialized. How much is ruled out depends on the data:
much in clusters and few dimensions, little where all distances are alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import broadcast_if_small, written
from logwarden.operators import ranks

_EPSILON = 1e-10


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    step = max(1, (1 << 20) // pivots.size)  # differences of 8 MB at a time
    for at in range(0, len(x), step):
        out[at:at + step] = np.sqrt(((x[at:at + step, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    return out


def _lumps(pivots: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """A lump a cell: neighbouring cells of up to ``most`` rows together, halved along the widest axis of their pivots."""
    lump, n, stack = np.zeros(len(pivots), dtype=np.int32), 0, [np.arange(len(pivots))]
    while stack:
        cells = stack.pop()
        if len(cells) > 1 and count[cells].sum() > most:
            near = pivots[cells]
            cells = cells[np.argsort(near[:, (near.max(axis=0) - near.min(axis=0)).argmax()], kind="stable")]
            stack += [cells[:len(cells) // 2], cells[len(cells) // 2:]]
        else:
            lump[cells], n = n, n + 1
    return lump


@dataclass
class Cells:
    """Training rows by their nearest pivot. ``count`` and ``radius`` have a number a pivot."""

    rows: DataFrame  # id, x, cell
    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, train: DataFrame, max_pivots: int) -> Cells:
        n = min(max_pivots, max(1, math.isqrt(train.count())))
        sample = train.select("x").orderBy(F.xxhash64("id", F.lit(7))).limit(n).collect()  # at most max_pivots vectors
        pivots = np.unique(np.array([r.x for r in sample], dtype=float), axis=0) if sample else np.zeros((1, 1))

        def assign(batches):
            for batch in batches:
                d = _distances(np.vstack(batch["x"].to_numpy()), pivots)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"id": batch["id"], "x": batch["x"], "cell": cell, "d": d[np.arange(len(d)), cell]})

        rows = written(train.select("id", "x").mapInPandas(assign, "id bigint, x array<double>, cell int, d double"), "lof-cells")
        count, radius = np.zeros(len(pivots), dtype=np.int64), np.full(len(pivots), -np.inf)
        for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():  # a row a pivot
            count[r.cell], radius[r.cell] = r.n, r.r
        return cls(rows.drop("d"), pivots, count, radius)

    def nearest_first(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Least possible distance to each cell's rows, and which cells are searched first: the nearest that hold ``k`` rows together."""
        d = _distances(x, self.pivots)
        least = np.where(self.count > 0, np.maximum(d - self.radius, 0.0), np.inf)
        order = np.lexsort((d, least))
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        first = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(first, order, (before < k) & (self.count[order] > 0), axis=1)
        return least, first


def _search(asked: DataFrame, rows: DataFrame, count: np.ndarray, n_cells: int, k: int, same: bool, block_rows: int) -> tuple[DataFrame, int]:
    """Up to ``k`` nearest rows (at most ``bound`` away) of each asked (id, lump), and how many pairs were compared.

    ``rows`` (id, x, cell, lump) has ``count`` rows a lump; rows in the cells of ``done`` are left out. Lumps and their
    queries are dealt in blocks of ``block_rows``, so one crowded lump is the work of many tasks.
    """
    wanted = np.zeros(len(count), dtype=np.int64)
    for r in asked.groupBy("lump").agg(F.count("*").alias("n")).collect():  # a row a lump
        wanted[r.lump] = r.n
    blocks = [(int(c), int(-(-count[c] // block_rows)), int(-(-wanted[c] // block_rows))) for c in np.flatnonzero(wanted)]
    spark = asked.sparkSession
    dealt = F.broadcast(spark.createDataFrame(blocks, "lump int, n_train int, n_asked int"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(dealt, "lump").select("id", "x", "bound", "done", "lump", part("n_asked").alias("qb"), every("n_train").alias("tb"))
    right = rows.join(dealt, "lump").select("id", "x", "cell", "lump", part("n_train").alias("tb"), every("n_asked").alias("qb"))

    def best(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "d": [], "n": []})
        a, b, ids, own, bound = np.vstack(q["x"].to_numpy()), np.vstack(t["x"].to_numpy()), t["id"].to_numpy(), q["id"].to_numpy(), q["bound"].to_numpy()
        cell, done = t["cell"].to_numpy(), q["done"].to_numpy()
        b2 = (b * b).sum(axis=1)
        out_d, out_n = [], []
        for start in range(0, len(a), 256):
            x, mine = a[start:start + 256], slice(start, start + 256)
            near = b2 - 2.0 * x @ b.T
            seen = np.zeros((len(x), n_cells), dtype=bool)
            for row, cells in enumerate(done[mine]):
                seen[row, np.asarray(cells, dtype=np.int64)] = True
            out = seen[:, cell]
            if same:
                out |= own[mine][:, None] == ids[None, :]
            near[out] = np.inf
            top = min(k, near.shape[1])
            at = np.argpartition(near, top - 1, axis=1)[:, :top]
            exact = np.sqrt(((b[at] - x[:, None, :]) ** 2).sum(axis=2))
            keep = (exact <= bound[mine][:, None]) & ~np.take_along_axis(out, at, axis=1)
            for d, n, kept in zip(exact, ids[at], keep):
                out_d.append(d[kept].tolist())
                out_n.append(n[kept].tolist())
        return pd.DataFrame({"id": own, "d": out_d, "n": out_n})

    pairs = left.groupBy("lump", "qb", "tb").cogroup(right.groupBy("lump", "qb", "tb")).applyInPandas(best, "id bigint, d array<double>, n array<bigint>")
    return pairs, int((wanted * count).sum())


def _merged(found: DataFrame, k: int) -> DataFrame:
    each = F.arrays_zip(F.col("d").alias("distance"), F.col("n").alias("neighbour"))
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k).alias("neighbours"))


def nearest_counted(queries: DataFrame, train: DataFrame, k: int, same: bool = False, block_rows: int = 8192, max_pivots: int = 1024) -> tuple[DataFrame, int]:
    """``nearest``, and the number of pairs of rows that were compared."""
    cells = Cells.of(train, max_pivots)
    n_cells = len(cells.count)
    lump = _lumps(cells.pivots, cells.count, min(block_rows, max(1, int(cells.count.sum()) // 32)))
    in_lump = np.bincount(lump, weights=cells.count).astype(np.int64)
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((cells.pivots, cells.count, cells.radius, lump))  # at most max_pivots rows
    needed = k + int(same)

    def ring(widened: bool):
        def ask(batches):
            pivots, count, radius, lump = shared.value
            own = Cells(None, pivots, count, radius)
            step = max(1, (1 << 14) // (len(in_lump) if widened else needed))  # few rows at a time, as each is asked often
            for batch in batches:
                for start in range(0, len(batch), step):
                    some = batch.iloc[start:start + step]
                    ids, x, bound = (some[c].to_numpy() for c in ("id", "x", "bound"))
                    least, first = own.nearest_first(np.vstack(x), needed)
                    done = np.empty(len(some), dtype=object)
                    done[:] = [np.flatnonzero(f).astype(np.int32) if widened else np.zeros(0, dtype=np.int32) for f in first]
                    if widened:
                        # no row of a cell is nearer than its least distance; a little slack for rounding
                        chosen = ~first & (least <= bound[:, None] * (1 + 1e-9) + 1e-12) & (count > 0)
                        at, cell = np.nonzero(chosen)
                        asked = np.zeros((len(some), len(in_lump)), dtype=bool)
                        asked[at, lump[cell]] = True
                        row, where = np.nonzero(asked)
                    else:
                        row, where = np.nonzero(first)
                    if len(row):
                        yield pd.DataFrame({"id": ids[row], "x": x[row], "bound": bound[row], "done": done[row], "lump": where.astype(np.int32)})
        return ask

    asked_as = "id bigint, x array<double>, bound double, done array<int>, lump int"
    points = queries.select("id", "x")
    first = written(points.withColumn("bound", F.lit(float("inf"))).mapInPandas(ring(False), asked_as), "lof-asked")
    found, n_first = _search(first, cells.rows.withColumn("lump", F.col("cell")), cells.count, n_cells, k, same, block_rows)
    near = written(_merged(found, k), "lof-near")
    reach = F.when(F.size("neighbours") >= k, F.element_at("neighbours", -1)["distance"]).otherwise(F.lit(float("inf")))
    bounded = points.join(near.select("id", reach.alias("bound")), "id")
    # a query asks a lump once, not each of its cells
    wider = written(bounded.mapInPandas(ring(True), asked_as), "lof-asked")
    of_cell = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lump)], "cell int, lump int"))
    more, n_more = _search(wider, cells.rows.join(of_cell, "cell"), in_lump, n_cells, k, same, block_rows)
    held = near.select("id", F.col("neighbours.distance").alias("d"), F.col("neighbours.neighbour").alias("n"))
    return _merged(held.unionByName(more.where(F.size("d") > 0)), k), n_first + n_more


def nearest(queries: DataFrame, train: DataFrame, k: int, same: bool = False, block_rows: int = 8192, max_pivots: int = 1024) -> DataFrame:
    """id, neighbours: the ``k`` nearest training rows as array of (distance, id), nearest first.

    Both inputs have id (bigint) and x (array<double>); ``same`` leaves out a row's own id. Each query first searches the
    cells around it that hold ``k`` rows; their k-th distance then rules out, by the triangle inequality, all cells whose
    rows must be farther, and only the others are searched. A query without any training row has no neighbours.
    """
    return nearest_counted(queries, train, k, same, block_rows, max_pivots)[0]


def _flat(near: DataFrame) -> DataFrame:
    return near.select("id", F.inline("neighbours"))


def _density(flat: DataFrame, k_distance: DataFrame) -> DataFrame:
    """id, lrd, neighbours' ids kept: local reachability density from reach distances."""
    side = broadcast_if_small(k_distance.select(F.col("id").alias("neighbour"), "k_distance"))
    reach = F.greatest(F.col("distance"), F.col("k_distance"))
    return flat.join(side, "neighbour").groupBy("id").agg((1.0 / (F.avg(reach) + _EPSILON)).alias("lrd"))


@dataclass
class LocalOutlierFactor:
    k: int = 20
    contamination: float | None = None  # None: the fixed offset -1.5
    block_rows: int = 8192

    def fit(self, train: DataFrame) -> LofModel:
        """``train``: id, x. The fitted state is a table of the training rows, kept in the shared folder."""
        near = written(nearest(train, train, self.k, same=True, block_rows=self.block_rows), "lof-neighbours")
        k_distance = near.select("id", F.array_max("neighbours.distance").alias("k_distance"))
        density = _density(_flat(near), k_distance)
        state = written(train.select("id", "x").join(k_distance, "id").join(density, "id"), "lof-state")
        model = LofModel(state, self.k, -1.5, self.block_rows)
        if self.contamination is not None:
            own = model._factors(_flat(near), state.select("id", "lrd"))
            model.offset = ranks.exact_quantiles(own, "factor", {"q": self.contamination}).first().q
        return model


@dataclass
class LofModel:
    state: DataFrame
    k: int
    offset: float
    block_rows: int

    def _factors(self, flat: DataFrame, own: DataFrame) -> DataFrame:
        """id, factor: minus the outlier factor."""
        side = broadcast_if_small(self.state.select(F.col("id").alias("neighbour"), F.col("lrd").alias("their_lrd")))
        theirs = flat.join(side, "neighbour").groupBy("id").agg(F.avg("their_lrd").alias("mean_lrd"))
        return theirs.join(own, "id").select("id", (-F.col("mean_lrd") / F.col("lrd")).alias("factor"))

    def decision(self, queries: DataFrame) -> DataFrame:
        """id, score: higher is more normal, below 0 is an outlier."""
        near = written(nearest(queries, self.state, self.k, block_rows=self.block_rows), "lof-queries")
        flat = _flat(near)
        return self._factors(flat, _density(flat, self.state)).select("id", (F.col("factor") - F.lit(float(self.offset))).alias("score"))
