"""Near copies by improved consistent weighted sampling (ICWS) over TF-IDF shingles, verified by weighted Jaccard similarity.

*Weights.* A shingle is ``words`` words in a row (a shorter text is one shingle). Its weight is its count in the text times
``1 + ln(N / df)``; document frequencies under ``rare`` of all N documents count as that share, so only the frequent
shingles need a table, at most (shingles of a mean text) / ``rare`` rows whatever N is. It is found exactly in two
passes: a shingle that frequent is so in some chunk of documents (a task's, of thousands of documents whatever the files
are); the chunks' candidates are then counted everywhere.

*Signatures.* For each of ``bands * rows`` draws, ICWS picks a shingle and a step, equal for two texts with probability
equal to their weighted Jaccard similarity. Draws come from tables indexed by the shingle's hash. ``rows`` draws make a band.

*Links.* Texts are nodes, equal texts are one. In each bucket all are verified against one pivot, the text with the most
bucket mates overall; distance (1 - similarity)
is a metric, so of the other pairs only those in different groups, whose distances to the pivot differ by no more than
``1 - similarity``, need to be verified too, and of these only such whose shingles that occur in another text at all weigh
enough for a link. What two texts can share is bounded by their profiles, the weight of such shingles in each of ``PROFILE``
hash classes: they share at most the sum of the smaller weights. No link between candidates is lost, no bucket is expanded
into all pairs.
Groups of pairs are cut to ``GROUP`` texts, buckets are counted in the map tasks first. Linked texts form classes.

Null texts count as empty; texts without words are near copies of each other. Null ids are kept as such, and repeated rows
are copies. Ties: a class is named by its smallest id (null if all are null). Extra columns are ignored, an empty table gives
an empty result. Lost executors: intermediate tables are Parquet in the shared folder.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import written
from logwarden.llm.tokens import U, Words, chunks, encoded, mix

RARE = 0.001
CHUNK = 1 << 20
COUNTED = 2_000_000  # shingles counted together
CHUNK_DOCS = 8_000  # documents that a task counts at least, where there are as many for each core
TABLE_ROWS = 2_000_000  # largest candidate table sent to tasks; more are counted by a shuffle
GROUP = 256
DEAL_ROWS = 20_000  # rows of a group of cells
PROFILE = 128  # hash classes of shingles in a text's profile
_RNG = np.random.default_rng(5521)
_R = -np.log(_RNG.random(1 << 16) * _RNG.random(1 << 16))
_LOG_C = np.log(-np.log(_RNG.random(1 << 16) * _RNG.random(1 << 16)))
_BETA = _RNG.random(1 << 16)
_ODD = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles: text number (ascending), hash (ascending inside a text), count."""
    found = Words(texts)
    hashes, at = found.grams(words)
    owner = found.doc[at]
    few = np.flatnonzero(np.diff(found.first) < words)
    if len(few):
        whole = np.zeros(len(few), dtype=np.uint64)
        for j, i in enumerate(few):
            value = U(1)
            for h in found.hash[found.first[i] : found.first[i + 1]]:
                value = mix(np.array([value ^ h]))[0]
            whole[j] = value
        owner, hashes = np.concatenate([owner, few]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(owner)))


class Weights:
    """Inverse document frequencies: a sorted table of the frequent shingles, one value for all others."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, total: int, rare: float):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], 1 + np.log(max(1, total) / np.maximum(df[order], 1))
        self.light = 1 + math.log(max(1, total) / max(1.0, rare * total))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.light)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.idf[at[hit]]
        return out


def _merged(hashes: np.ndarray, counts: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and their counts, of a summary and of further ones that count once each."""
    found, at, n = np.unique(np.concatenate([hashes, *fresh]), return_index=True, return_counts=True)
    old = at < len(hashes)  # the summary comes first, so a hash of both is found there
    n[old] += counts[at[old]] - 1
    return found, n


def _chunk_counts(batches, words: int, share: float, wanted: np.ndarray | None):
    """(shingle, documents that hold it) per chunk: those in ``wanted``, or those that may be in at least ``share`` of the chunk.

    Without ``wanted`` a task is one chunk, in a summary of about ``COUNTED`` shingles: where it overflows, the rarest go, and
    ``lost`` bounds what each of them, or one that came back, had. Only where that could reach ``share`` a new chunk begins."""
    def told(hashes, counts):
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["shingle", "df"])

    hashes, counts, held, total, docs, lost = np.zeros(0, U), np.zeros(0, np.int64), [], 0, 0, 0
    for batch in batches:
        texts = [encoded(t) for t in batch.column(0).to_pylist()]
        for part in chunks([len(t) for t in texts], CHUNK):
            _, found, _ = shingles(texts[part], words)
            if wanted is not None and len(wanted):
                at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                found = found[wanted[at] == found]
            held.append(found)
            total += len(found)
            docs += part.stop - part.start
            if total < COUNTED:
                continue
            hashes, counts = _merged(hashes, counts, held)
            held, total = [], 0
            while len(hashes) > COUNTED // 2:
                least = int(counts.min())
                if wanted is not None or lost + least >= share * docs - 1e-9:
                    keep = counts + lost >= share * docs - 1e-9 if wanted is None else slice(None)
                    yield told(hashes[keep], counts[keep])
                    hashes, counts, docs, lost = hashes[:0], counts[:0], 0, 0
                else:
                    lost += least
                    hashes, counts = hashes[counts > least], counts[counts > least]
    hashes, counts = _merged(hashes, counts, held)
    keep = counts + lost >= share * docs - 1e-9 if wanted is None else slice(None)
    yield told(hashes[keep], counts[keep])


def frequencies(docs: DataFrame, text_col: str, words: int, rare: float) -> Weights:
    """Exact document frequencies of all shingles in at least ``rare`` of the documents (and in two)."""
    spark, total = docs.sparkSession, docs.count()
    least = max(2, math.ceil(rare * total))
    texts, schema = docs.select(text_col), "shingle long, df long"
    # a chunk says which shingles are frequent only if ``share`` of it is several documents; coalesce moves no rows
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, total // CHUNK_DOCS))
    share = least / max(1, total)
    found = texts.mapInArrow(lambda b: _chunk_counts(b, words, share, None), schema).select("shingle").distinct()
    found = written(found, "frequent")
    if found.count() <= TABLE_ROWS:
        wanted = spark.sparkContext.broadcast(np.sort(found.toPandas()["shingle"].to_numpy(dtype=np.int64).view(np.uint64)))
        counts = texts.mapInArrow(lambda b: _chunk_counts(b, words, share, wanted.value), schema)
    else:
        counts = texts.mapInArrow(lambda b: _chunk_counts(b, words, 0.0, None), schema).join(found, "shingle", "left_semi")
    table = counts.groupBy("shingle").agg(F.sum("df").alias("df")).filter(F.col("df") >= least).toPandas()
    return Weights(table["shingle"].to_numpy(dtype=np.int64).view(np.uint64), table["df"].to_numpy(dtype=float), total, rare)


def _draws(hashes: np.ndarray, weight: np.ndarray, common: np.ndarray, light: float, k: int, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rank and step of every shingle in draw ``k``. ``common`` marks shingles of the one usual weight, looked up in a ready table."""
    if light not in tables:
        step = np.floor(math.log(light) / _R + _BETA)
        tables[light] = _LOG_C - _R * (step - _BETA + 1), step
    at = (hashes * _ODD[k] >> U(48)).astype(np.int64)
    rank, step = tables[light][0][at], tables[light][1][at]
    other = at[~common]
    if len(other):
        r, beta = _R[other], _BETA[other]
        s = np.floor(np.log(weight[~common]) / r + beta)
        rank[~common], step[~common] = _LOG_C[other] - r * (s - beta + 1), s
    return rank, step


def signatures(texts: list[bytes], weights: Weights, words: int, bands: int, rows: int, tables: dict) -> np.ndarray:
    """One row of ``bands`` hashes per text."""
    owner, hashes, count = shingles(texts, words)
    weight = weights.of(hashes)
    common = (weight == weights.light) & (count == 1)
    weight = weight * count
    begin = np.searchsorted(owner, np.arange(len(texts)))
    out = np.zeros((len(texts), bands), dtype=np.uint64)
    for k in range(bands * rows):
        rank, step = _draws(hashes, weight, common, weights.light, k, tables)
        least = np.flatnonzero(rank == np.minimum.reduceat(rank, begin)[owner])
        first = least[np.searchsorted(owner[least], np.arange(len(texts)))]  # of ties the smallest hash
        pick = mix(hashes[first] ^ (step[first].astype(np.int64).view(np.uint64) * U(0x9E3779B97F4A7C15)))
        out[:, k // rows] = mix(out[:, k // rows] * U(31) + pick)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


def weighted_set(text: bytes, weights: Weights, words: int) -> tuple[np.ndarray, np.ndarray]:
    _, hashes, count = shingles([text], words)
    return hashes, weights.of(hashes) * count


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _signed_rows(docs: DataFrame, weights, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        tables: dict = {}
        for batch in batches:
            texts = [encoded(t) for t in batch.column(1).to_pylist()]
            seen: dict[bytes, int] = {}
            place = [seen.setdefault(t, len(seen)) for t in texts]  # equal texts of a batch are drawn once
            different = list(seen)
            made = [signatures(different[p], weights.value, words, bands, rows, tables) for p in chunks([len(t) for t in different], CHUNK)]
            made = np.concatenate(made)[place].view(np.int64) if made else np.zeros((0, bands), dtype=np.int64)
            keys = [hashlib.md5(t).digest() for t in different]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keys[p] for p in place], pa.binary()), pa.array(list(made), pa.list_(pa.int64()))],
                                             names=["id", "key", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, one: DataFrame, weights, words: int) -> DataFrame:
    """Similarity of pairs (pivot, key). A pivot's pairs are cut into groups; the table of texts is shuffled once, to the
    pairs' rows. ``one`` names a row of ``texts`` for each key (rows repeated in full give repeated pairs, dropped in the groups)."""
    sides = pairs.select("pivot", "key", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"))
    own = pairs.groupBy("pivot").agg(F.max("parts").alias("parts")).select(
        "pivot", F.col("pivot").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    sides = sides.union(own)
    place = sides.join(one, "key").select("pivot", "key", "part", F.col("one").alias("_one"))
    full = place.join(texts, (F.col("key") == F.col("_key")) & F.col("_one").eqNullSafe(F.col("_id"))).select("pivot", "key", "part", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pivot = group["pivot"].iloc[0]
        mine = group[group["key"] == pivot]
        base = weighted_set(encoded(mine["text"].iloc[0]), weights.value, words)
        others = group[group["key"] != pivot].drop_duplicates("key")
        found = [similarity(base, weighted_set(encoded(t), weights.value, words)) for t in others["text"]]
        return pd.DataFrame({"pivot": [pivot] * len(others), "key": others["key"].to_numpy(), "similarity": np.array(found, dtype=float)})

    return full.groupBy("pivot", "part").applyInPandas(run, "pivot binary, key binary, similarity double")


def _shareable(keys: DataFrame, texts: DataFrame, one: DataFrame, weights, words: int) -> DataFrame:
    """(key, total, shared, profile): weight of each text, and of those of its shingles that another of these texts holds too, whole and by hash class."""
    def run(batches):
        for batch in batches:
            found = [weighted_set(encoded(t), weights.value, words) for t in batch.column(1).to_pylist()]
            for at in range(0, len(found), 500):
                part = found[at : at + 500]
                row = np.repeat(np.arange(at, at + len(part)), [len(h) for h, _ in part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(np.concatenate([h for h, _ in part]).view(np.int64)), pa.array(np.concatenate([w for _, w in part]))],
                    names=["key", "shingle", "weight"])

    place = keys.join(one, "key").select("key", F.col("one").alias("_one"))
    full = place.join(texts, (F.col("key") == F.col("_key")) & F.col("_one").eqNullSafe(F.col("_id"))).select("key", "text").dropDuplicates(["key"])
    rows = written(full.mapInArrow(run, "key binary, shingle long, weight double"), "open-shingles")
    held = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle", F.lit(1).alias("held"))
    parts = rows.join(held, "shingle", "left").groupBy("key", F.pmod("shingle", F.lit(PROFILE)).cast("int").alias("part")).agg(
        F.sum("weight").alias("total"), F.sum(F.when(F.col("held") == 1, F.col("weight")).otherwise(0.0)).alias("shared"))
    whole = parts.groupBy("key").agg(F.sum("total").alias("total"), F.sum("shared").alias("shared"), F.map_from_entries(F.collect_list(F.struct("part", "shared"))).alias("by"))
    classes_ = F.sequence(F.lit(0), F.lit(PROFILE - 1))
    return whole.select("key", "total", "shared", F.transform(classes_, lambda i: F.coalesce(F.col("by")[i], F.lit(0.0))).alias("profile"))


def _open_pairs(open_: DataFrame, least: float) -> DataFrame:
    """Pairs (pivot, key) of one bucket with different labels that the bounds leave open. Buckets are cut into blocks of about ``GROUP`` texts,
    each pair of blocks is a cell, and cells are dealt to groups of bounded size."""
    open_ = written(open_, "open-profiles")
    sizes = open_.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / GROUP).cast("long"))
    rows = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    deals = max(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / DEAL_ROWS))
    cut = open_.join(sizes.drop("n"), ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    cells = cells.select(F.pmod(F.xxhash64("band", "bucket", "lo", "hi"), F.lit(deals)).alias("deal"), "band", "bucket", "lo", "hi",
                         (F.col("block") > F.col("other")).alias("second"), "key", "label", "far", "total", "profile")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[bytes, bytes]] = set()
        for (_, _, lo, hi), cell in group.groupby(["band", "bucket", "lo", "hi"], sort=False):
            key, label, second = cell["key"].to_numpy(), cell["label"].to_numpy(), cell["second"].to_numpy()
            far, total, profile = cell["far"].to_numpy(), cell["total"].to_numpy(), np.stack(cell["profile"].to_numpy())
            for i in range(len(key)):
                if lo != hi and second[i]:
                    continue
                at = np.arange(i + 1, len(key)) if lo == hi else np.flatnonzero(second)
                at = at[(label[at] != label[i]) & (np.abs(far[at] - far[i]) <= 1 - least + 1e-9)]
                common = np.minimum(profile[at], profile[i]).sum(axis=1)
                at = at[common >= least * (total[at] + total[i] - common) - 1e-9]
                found.update((min(key[i], key[j]), max(key[i], key[j])) for j in at)
        return pd.DataFrame(sorted(found), columns=["pivot", "key"])

    return cells.groupBy("deal").applyInPandas(run, "pivot binary, key binary").distinct()


def _with_parts(pairs: DataFrame) -> DataFrame:
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    return pairs.join(sizes, "pivot")


def components(links: DataFrame) -> DataFrame:
    """Node and smallest node of its component, from links (a, b); nodes without links are left out."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    while True:
        labels = written(labels, "labels")
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = moved.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = moved.join(jump, F.col("label") == F.col("_n"), "left").select("node", F.least(F.col("label"), F.coalesce("_l", "label")).alias("label"), "was")
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.filter("label <> was").limit(1).count():
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5, bands: int = 12, rows: int = 3,
            rare: float = RARE) -> DataFrame:
    """One row per row of ``docs``: id, ``key`` (MD5 of the text), ``class_key`` (smallest key of the class, its identity), ``class_id`` (smallest
    id of the class), ``class_size`` and ``n_links`` (verified links of the text to different ones)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    weights = spark.sparkContext.broadcast(frequencies(docs, text_col, words, rare))
    signed = written(_signed_rows(docs.select(F.col(id_col).alias("id"), text.alias("text")), weights, words, bands, rows), "signatures")
    nodes = signed.groupBy("key").agg(F.first("bands").alias("bands"), F.min("id").alias("one"))
    buckets = nodes.select("key", F.posexplode("bands").alias("band", "bucket"))
    sizes = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(buckets.join(sizes, ["band", "bucket"]), "bucket-sizes")
    # the pivot is the text with most bucket mates: an original has more than its copies, so most links are found from it
    mates = members.groupBy("key").agg(F.sum("n").alias("mates"))
    members = members.join(mates, "key").select("key", "band", "bucket", "mates")
    pivots = members.groupBy("band", "bucket").agg(F.max(F.struct("mates", "key")).alias("p")).select("band", "bucket", F.col("p.key").alias("pivot"))
    members = written(members.drop("mates").join(pivots, ["band", "bucket"]), "buckets")
    first = members.filter("key <> pivot").select("pivot", "key").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("text")).withColumn("_key", _key(F.col("text")))
    one = nodes.select("key", "one")
    tested = written(_verified(_with_parts(first), texts, one, weights, words), "tested")
    link = F.col("similarity") >= least
    labels = components(tested.filter(link).select(F.col("pivot").alias("a"), F.col("key").alias("b")))
    # distances to the bucket's pivot bound those between its members
    known = members.join(tested, ["pivot", "key"], "left").select("band", "bucket", "key", F.coalesce(1 - F.col("similarity"), F.lit(0.0)).alias("far"))
    known = known.join(labels, known.key == labels.node, "left").select("band", "bucket", "key", "far", F.coalesce("label", "key").alias("label"))
    split = known.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2")
    open_ = known.filter("far > 0").join(split.select("band", "bucket"), ["band", "bucket"], "left_semi")
    open_ = written(open_, "open")
    open_ = open_.join(_shareable(open_.select("key").distinct(), texts, one, weights, words).filter(F.col("shared") >= least * F.col("total") - 1e-9), "key")
    more = _open_pairs(open_, least)
    more = written(more.join(tested, ["pivot", "key"], "left_anti"), "more-pairs")
    links = tested
    if more.limit(1).count():
        links = links.union(written(_verified(_with_parts(more), texts, one, weights, words), "tested"))
    links = links.filter(link).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
    labels = components(links)
    degree = links.select("a").union(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    kinds = signed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    kinds = kinds.join(labels, kinds.key == labels.node, "left").withColumn("label", F.coalesce("label", "key")).join(degree, F.col("key") == degree.a, "left")
    named = kinds.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    kinds = kinds.join(named, "label").select("key", F.col("label").alias("class_key"), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select(F.col("id").alias(id_col), "key").join(kinds, "key").select(id_col, "key", "class_key", "class_id", "class_size", "n_links")
