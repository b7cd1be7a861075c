"""SHA-256 of files of any size, in constant memory.

Small files are hashed whole, where they are read. Larger ones are read as lines by many tasks, packed into blocks, brought in
order file by file (the sort spills to disk) and hashed block after block: a task holds one Arrow batch, whatever the size. A
digest is sequential, so one file is one task; different files are hashed side by side. One line has 2 GB at most, and so has
a compressed file, as Spark's reader would unpack it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE_BYTES = 64 << 20
_PACKED_SUFFIXES = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd")
_MARK = b"\xef\xbb\xbf"


def _packed(batches):
    """Lines of a batch joined to one block for each run of equal (path, split)."""
    for batch in batches:
        paths, lengths, starts, rows, values = (batch.column(i) for i in range(5))
        starts_py, paths_py = starts.to_pylist(), paths.to_pylist()
        begin = 0
        for i in range(1, len(paths_py) + 1):
            if i == len(paths_py) or (paths_py[i], starts_py[i]) != (paths_py[begin], starts_py[begin]):
                lines = values[begin:i].to_pylist()
                block = pa.array([b"".join([line + b"\n" for line in lines])], pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([paths[begin : begin + 1], lengths[begin : begin + 1], starts[begin : begin + 1], rows[begin : begin + 1], block],
                                                 names=["path", "length", "start", "row", "block"])
                begin = i


def _hashed(batches):
    """Digest of each path; its blocks stand together and in order. The last line break counts only where the file has one."""
    def closed(path, length, digest, size, held):
        # The reader leaves out a byte order mark at the start of a file. Only the length tells at the end, so both digests are kept.
        gap = length - size
        if gap not in (-1, 0, 2, 3):
            raise ValueError(f"{path}: {size} bytes read, {length} listed")
        chosen = digest[1] if gap >= 2 else digest[0]
        chosen.update(held[:-1] if gap in (-1, 2) else held)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([chosen.hexdigest()])], names=["path", "sha256"])

    now = None
    for batch in batches:
        for path, length, _, _, block in zip(*batch.columns):
            path, length, block = path.as_py(), length.as_py(), block.as_py()
            if now is None or now[0] != path:
                if now:
                    yield closed(*now)
                now = [path, length, (hashlib.sha256(), hashlib.sha256(_MARK)), 0, b""]
            for digest in now[2]:
                digest.update(now[4])
            now[3] += len(block)
            now[4] = block
    if now:
        yield closed(*now)


def _streamed(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))
    blocks = lines.mapInArrow(_packed, "path string, length bigint, start bigint, row bigint, block binary")
    ordered = blocks.repartition("path").sortWithinPartitions("path", "start", "row")
    return ordered.mapInArrow(_hashed, "path string, sha256 string")


def file_digests(spark: SparkSession, files: list[tuple[str, int]], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """path, sha256 (lower-case hex) of the given (path, length); an empty file has the digest of no bytes."""
    empty = [(p, hashlib.sha256().hexdigest()) for p, n in files if not n]
    large = [p for p, n in files if n > whole_bytes and not p.lower().endswith(_PACKED_SUFFIXES)]
    small = [p for p, n in files if n and p not in set(large)]
    found = spark.createDataFrame(empty, "path string, sha256 string")
    if small:
        read = spark.read.format("binaryFile").load(small)
        found = found.unionByName(read.select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256")))
    return found.unionByName(_streamed(spark, large)) if large else found
