"""Importance resampling towards a target: documents whose hashed features look like the target's are drawn first.

Features are runs of 1 to ``max_words`` words. A task lists the distinct features of some megabytes of text, lays those
of equal length under each other as a two-dimensional array of bytes, and brings all their CRCs forward by one column at
a time; the buckets are then scattered back to the places of the features. Only bucket numbers are stored, two or four
bytes a feature, so texts are read once; bucket counts meet in one aggregate of at most ``buckets`` rows a task, and the
gains (``buckets`` numbers, a parameter, not data) travel with the last pass. Scores are whole numbers between about
-60,000 and 80,000 at any size, so ranks come from counts by score: no global sort and no single task that sees all rows.

Null and empty texts, and texts without words, have no features: weight 0, and they are never drawn. Ties go to the
smaller id, null ids last; repeated rows are drawn each on its own. Very long texts are worked on alone, very long words
(over ``LONG`` bytes) one by one. Empty tables give an empty result; an empty target gives gains from the corpus alone.
Other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.cluster import written
from logwarden.llm.tokens import chunks

CHUNK = 4 << 20
LONG = 2048
_BYTE = np.arange(256)
#: Word bytes: digits, letters and all of non-ASCII characters (after A-Z became a-z).
WORD = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes: one matrix a length, one column of all its rows at a time."""
    out = np.zeros(len(start), dtype=np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, first[1:])):
        if length > LONG:
            out[rows] = [zlib.crc32(data[a : a + length]) for a in start[rows].tolist()]
            continue
        crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        matrix = data[np.arange(length)[:, None] + start[rows]]
        for column in matrix:
            crc = CRC[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def features(texts: list[bytes], max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then text number and bucket of every feature, texts in order."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    word = WORD[data]
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    doc = np.searchsorted(np.cumsum(sizes + 1), ends, side="right")
    word[ends] = True  # each word keeps one byte behind it, as the space of longer features
    data[ends] = 32
    data = data[word]
    stop = np.flatnonzero(data == 32) + 1  # of each word and its space
    bound = np.concatenate([[0], stop]).astype(np.int32)
    docs, found = [], []
    for n in range(1, max_words + 1):
        for shift in range(n):
            edge = np.ascontiguousarray(bound[shift::n])
            if len(edge) < 2:
                continue
            runs = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(data)]).dictionary_encode()
            at = np.frombuffer(runs.dictionary.buffers()[1], dtype=np.int32)[: len(runs.dictionary) + 1].astype(np.int64)
            held = np.frombuffer(runs.dictionary.buffers()[2], dtype=np.uint8)
            bucket = (crcs(held, at[:-1], np.diff(at) - 1) % np.uint32(buckets))[runs.indices.to_numpy()]
            begin = doc[shift::n][: len(bucket)]
            inside = begin == doc[shift + n - 1 :: n][: len(bucket)]
            docs.append(begin[inside])
            found.append(bucket[inside])
    if not docs:
        return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    of, bucket = np.concatenate(docs), np.concatenate(found)
    if max_words > 1:
        order = np.argsort(of, kind="stable")
        of, bucket = of[order], bucket[order]
    return np.bincount(doc, minlength=len(texts)), of, bucket


def hashed(docs: DataFrame, id_col: str, text_col: str, max_words: int, buckets: int) -> DataFrame:
    """Id, number of words, and the buckets of all features as packed numbers, a row a document."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            for part in chunks(pc.binary_length(texts).to_pylist(), CHUNK):
                rows = part.stop - part.start
                words, of, bucket = features(texts[part].to_pylist(), max_words, buckets)
                bound = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]) * kind.itemsize
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(bound.astype(np.int32)), pa.py_buffer(bucket.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(words, pa.int64()), packed], names=["id", "n_words", "packed"])

    of_id = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {of_id}, n_words long, packed binary")


def _numbers(packed: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a column of packed ones, and where each row ends."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    bound = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1]
    if packed.buffers()[2] is None:
        return np.zeros(0, dtype=kind), np.zeros(len(packed) + 1, dtype=np.int64)
    data = np.frombuffer(packed.buffers()[2], dtype=np.uint8)[bound[0] : bound[-1]]
    return data.view(kind), (bound.astype(np.int64) - bound[0]) // kind.itemsize


def bucket_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """Features in each bucket; a task sends its own sums."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return packed.select("packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in target and corpus, one added to each count, rounded down."""
    total, wanted = sum(source.values()), sum(target.values())
    ratio = [((target.get(b, 0) + 1) * (total + buckets)) / ((source.get(b, 0) + 1) * (wanted + buckets)) for b in range(buckets)]
    return np.floor(1000 * np.log(np.array(ratio, dtype=np.float64))).astype(np.int64)


def weighed(packed: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    """Number of features and mean gain of each document, rounded down."""
    kind = packed.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            number, bound = _numbers(batch.column(2), len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[number])])
            n = np.diff(bound)
            weight = (sums[bound[1:]] - sums[bound[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    made = packed.select("id", "n_words", "packed").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return made.withColumnRenamed("id", id_col)


def luck(seed: int, id_col: str) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id (a null id counts as an empty one)."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, id_col: str, percent: int, min_words: int) -> DataFrame:
    """``rank`` 1, 2, ... of the highest scores among documents of ``min_words`` words or more; null beyond ``percent``."""
    able = scored.filter(F.col("n_words") >= min_words)
    by_score = able.groupBy("score").agg(F.count("*").alias("held")).withColumn("step", F.floor(F.col("score") / 64))
    steps = by_score.groupBy("step").agg(F.sum("held").alias("step_held"))
    every = Window.partitionBy(F.lit(0))  # one row for each 64 thousandths: some thousands at any size
    above = every.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("step", F.coalesce(F.sum("step_held").over(above), F.lit(0)).alias("over"), F.floor(percent * F.sum("step_held").over(every) / 100).cast("long").alias("draws"))
    inside = Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = by_score.join(F.broadcast(steps), "step").select("score", "draws", (F.col("over") + F.coalesce(F.sum("held").over(inside), F.lit(0))).alias("before"))
    places = places.filter("before < draws").select(F.col("score").alias("_score"), "draws", "before")
    marked = scored.join(F.broadcast(places), (F.col("score") == F.col("_score")) & (F.col("n_words") >= min_words), "left")
    # equal rows travel as one row with their number
    alike = [id_col, "n_features", "weight", "score", "draws", "before"]
    several = marked.filter("draws is not null").groupBy(*alike).agg(F.count("*").alias("times"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last(id_col), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = several.withColumn("first", F.col("before") + F.coalesce(F.sum("times").over(order), F.lit(0)))
    one = placed.withColumn("place", F.explode(F.expr("sequence(first + 1, first + times)")))
    shown = [id_col, "n_features", "weight", "score"]
    ranked = one.select(*shown, F.when(F.col("place") <= F.col("draws"), F.col("place")).alias("rank"))
    return ranked.unionAll(marked.filter("draws is null").select(*shown, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1, buckets: int = 10_000,
              seed: int = 2024, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Id, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every document."""
    packed = written(hashed(docs, id_col, text_col, max_words, buckets), "features")
    aims = hashed(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text", max_words, buckets)
    # at most one row a bucket
    source = {r.bucket: r.n for r in bucket_counts(packed, buckets).collect()}
    wanted = {r.bucket: r.n for r in bucket_counts(aims, buckets).collect()}
    found = weighed(packed, gains(source, wanted, buckets), id_col)
    scored = written(found.withColumn("score", F.col("weight") + luck(seed, id_col)), "scores")
    return drawn(scored, id_col, percent, min_words)
