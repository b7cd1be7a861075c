"""Repeated stretches of text by a radix sort of suffixes that stops at the threshold.

Only the first ``window`` tokens of a suffix matter: suffixes that are equal that far are the repeated windows. The
sort goes from the most significant digit on, a digit being the hash of several tokens, and after each pass only
buckets with two or more suffixes go on.

1. *Route.* A suffix goes to the bucket of its window's least ``gram``-token stretch. Equal windows share it, at the
   same place, so a bucket can stand for all suffixes between two such stretches: one row per run of suffixes.
2. *Whole runs.* Runs with equal text repeat in full. Unique buckets are dropped, each kind of run goes on once.
3. *Suffixes.* What is left is opened into single suffixes, ordered by the rest of their ``window`` tokens: bucket by bucket
   from the text of its runs, or, for buckets of more than ``GROUP`` kinds of runs, spread over tasks by the whole key.

Keys are 128 bits in all (bucket and rest), so that chance collisions stay unlikely beyond 10**15 windows.

Hot stretches: runs are counted with map-side combining, and a task sends any one suffix key once, however many texts
hold it. Texts are cut into pieces with ``window - 1`` tokens of overlap, so long ones need no more memory.
Lost executors: intermediate tables are Parquet in the shared folder, everything else is recomputed.

Null texts count as empty. Rows with equal id and text are separate documents (all of them are repeats, of each other).
Null ids are kept. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.cluster import written
from logwarden.llm.tokens import BASES, BYTE_CODES, Rolling, U, Words, encoded, lots, mix

PIECE = 1 << 19  # window starts handled at once
LOT_BYTES = 1 << 22  # texts whose runs are found, or that are cut, before their rows leave the task
GROUP = 4096
_WORD = re.compile(rb"[^\t-\r ]+[\t-\r ]*")


def _codes(text: bytes, tokens: str) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(text, dtype=np.uint8)] if tokens == "bytes" else Words([text]).hash


def _pieces(keys: list, texts: list[bytes], tokens: str, window: int):
    """Groups of (key, first token's number, codes) of about ``PIECE`` tokens; texts too short for a window are left out."""
    group, total = [], 0
    for key, text in zip(keys, texts):
        if len(text) < window:
            continue
        codes = _codes(text, tokens)
        for base in range(0, len(codes) - window + 1, PIECE):
            part = codes[base : base + PIECE + window - 1]
            group.append((key, base, part))
            total += len(part)
            if total >= PIECE:
                yield group
                group, total = [], 0
    if group:
        yield group


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima running forth and back inside blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def _runs(group, window: int, gram: int):
    """Runs of neighbouring windows with one least gram: piece, first start, number of starts, bucket, hash of the text."""
    codes = np.concatenate([c for *_, c in group])
    sizes = np.array([len(c) for *_, c in group])
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    grams, rest = Rolling(codes, BASES[0]), Rolling(codes, BASES[1])
    value = mix(grams.all(gram)) & U(0xFFFFFFFF00000000) | np.arange(len(codes) - gram + 1, dtype=np.uint64)
    least = (_sliding_min(value, window - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(group)), sizes)[: len(least)]
    inside = np.arange(len(least)) + window <= (begins + sizes)[piece]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
    lo = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.append(new | ~inside, True))
    hi = stop[np.searchsorted(stop, lo, side="right")] - 1
    at = least[lo]
    bucket = mix(grams.at(at, at + gram))
    text = mix(mix(rest.at(lo, hi + window)) ^ ((at - lo).astype(np.uint64) << U(32) | (hi - lo).astype(np.uint64)))
    return begins, rest, piece[lo], lo, hi - lo + 1, bucket, text


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_runs(tokens: str, window: int, gram: int):
    def run(batches):
        for batch in lots(batches, 2, LOT_BYTES):
            ids, marks, texts = batch.column(0), batch.column(1).to_pylist(), [encoded(t) for t in batch.column(2).to_pylist()]
            for group in _pieces(list(range(len(texts))), texts, tokens, window):
                begins, _, piece, lo, n, bucket, text = _runs(group, window, gram)
                row = np.array([g[0] for g in group])[piece]
                base = np.array([g[1] for g in group])[piece]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(np.array(marks, dtype=np.int64)[row]), pa.array(lo - begins[piece] + base),
                     pa.array(n.astype(np.int32)), _signed(bucket), _signed(text)],
                    names=["id", "mark", "lo", "n", "bucket", "rest"])

    return run


def _texts_of_runs(tokens: str, window: int):
    """The tokens of each run, as bytes: of the text itself, or eight for each word."""
    kind = np.uint8 if tokens == "bytes" else np.uint64

    def run(batches):
        names = ["bucket", "kinds", "id", "mark", "lo", "n", "solved", "codes"]
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                text, runs = encoded(batch.column("text")[i].as_py()), batch.column("runs")[i]
                codes = np.frombuffer(text, dtype=np.uint8) if tokens == "bytes" else _codes(text, tokens)
                mark = batch.column("mark")[i].as_py()
                for r in runs.as_py():
                    data = codes[r["lo"] : r["lo"] + r["n"] + window - 1].astype(kind).tobytes()
                    held.append((r["bucket"], r["kinds"], i, mark, r["lo"], r["n"], r["solved"], data))
                    size += len(data)
                if size >= 8 * PIECE or i + 1 == batch.num_rows and held:
                    columns = list(zip(*held))
                    kinds = [pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(c)) if k is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                    held, size = [], 0

    return run


def _opened(rows: pa.Table, tokens: str, window: int):
    """All suffixes of the runs: run number, place in the run, bucket, rest; and which of them stand for runs solved already."""
    data = [np.frombuffer(c, dtype=np.uint8) for c in rows.column("codes").to_pylist()]
    flat = np.concatenate(data)
    codes = BYTE_CODES[flat] if tokens == "bytes" else flat.view(np.uint64)
    n = rows.column("n").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.concatenate([[0], np.cumsum(n + window - 1)])[:-1]
    at = begin[owner] + place
    rest = mix(Rolling(codes, BASES[1]).at(at, at + window))
    return owner, place, rows.column("bucket").to_numpy().astype(np.int64)[owner].view(np.uint64), rest, rows.column("solved").to_numpy(zero_copy_only=False)[owner]


def _equal_groups(bucket: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, first of each group in it, and size of each group."""
    order = np.lexsort((rest, bucket))
    b, r = bucket[order], rest[order]
    new = np.ones(len(b), dtype=bool)
    new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(b)))


def _stretches(rows: pa.Table, owner: np.ndarray, place: np.ndarray, hit: np.ndarray, window: int) -> pa.RecordBatch:
    """Neighbouring repeated suffixes of a run as one stretch of tokens."""
    o, p = owner[hit], place[hit]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o))[: len(first)] - 1
    run = o[first]
    start = rows.column("lo").to_numpy()[run] + p[first]
    take = lambda c: rows.column(c).combine_chunks().take(pa.array(run))
    return pa.RecordBatch.from_arrays([take("id"), take("mark"), pa.array(start), pa.array(p[last] - p[first] + window)], names=["id", "mark", "start", "n_tokens"])


def _inside_buckets(tokens: str, window: int):
    """Repeated stretches of runs that come ordered by bucket, so that each bucket is whole."""
    size = 1 if tokens == "bytes" else 8

    def told(rows: pa.Table):
        owner, place, bucket, rest, solved = _opened(rows, tokens, window)
        order, _, count = _equal_groups(bucket, rest)
        twice = np.zeros(len(order), dtype=bool)
        twice[order] = np.repeat(count > 1, count)
        hit = twice & ~solved
        if hit.any():
            yield _stretches(rows, owner, place, hit, window)

    def run(batches):
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
            bucket = rows.column("bucket").to_numpy()
            edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            total = np.cumsum([len(c.as_buffer()) for c in rows.column("codes")]) // size
            begin = 0
            for edge in edges.tolist():
                if total[edge - 1] - (total[begin - 1] if begin else 0) >= PIECE or edge == edges[-1]:
                    yield from told(rows.slice(begin, edge - begin).combine_chunks())
                    begin = edge
            left = rows.slice(begin)
        if left is not None and left.num_rows:
            yield from told(left.combine_chunks())

    return run


def _across_tasks(tokens: str, window: int):
    """Suffixes of hot buckets, each key once from a group of runs: with its place if it may yet be single, else without; and
    (bucket null) the places of keys that the group itself holds twice."""
    names = ["id", "mark", "start", "bucket", "rest"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = pa.Table.from_batches([batch.slice(at, 2048)])
                owner, place, bucket, rest, solved = _opened(rows, tokens, window)
                order, first, count = _equal_groups(bucket, rest)
                lone = (count == 1) & ~solved[order[first]]
                keep = order[first]
                start = rows.column("lo").to_numpy()[owner] + place
                take = lambda c, i: rows.column(c).combine_chunks().take(pa.array(owner[i]))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take("id", keep), take("mark", keep), pa.array(np.where(lone, start[keep], -1)), _signed(bucket[keep]), _signed(rest[keep])],
                                                 names=names)
                twice = np.zeros(len(order), dtype=bool)
                twice[order] = np.repeat(count > 1, count)
                known = np.flatnonzero(twice & ~solved)
                none = pa.nulls(len(known), pa.int64())
                yield pa.RecordBatch.from_arrays([take("id", known), take("mark", known), pa.array(start[known]), none, none], names=names)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, tokens: str = "bytes",
                   gram: int | None = None) -> DataFrame:
    """Where windows of ``window`` tokens lie that also start elsewhere, in any text of ``docs``.

    Columns id, mark (hash of id and text), start and n_tokens; stretches of one document may overlap.
    ``tokens`` is ``bytes`` (of the UTF-8 form) or ``words``. ``gram`` is the first digit's length, a quarter of the window by default.
    """
    gram = gram or max(1, window // 4)
    texts = _marked(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    runs = written(texts.mapInArrow(_find_runs(tokens, window, gram), f"id {kind}, mark long, lo long, n int, bucket long, rest long"), "runs")
    kinds = runs.groupBy("bucket", "rest", "n").agg(F.count("*").alias("rows"), F.min(F.struct("id", "mark", "lo")).alias("one"))
    # of the kinds that occur once, only those that share their bucket are needed
    shared = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"))
    kinds = written(kinds.join(shared, "bucket").filter("rows > 1 or kinds > 1"), "run-kinds")
    solved = kinds.filter("rows > 1").select("bucket", "rest", "n")
    whole = runs.join(solved, ["bucket", "rest", "n"]).select("id", "mark", F.col("lo").alias("start"), (F.col("n") + window - 1).cast("long").alias("n_tokens"))
    opened = (kinds.filter("kinds > 1").select("one.*", "n", "bucket", "kinds", (F.col("rows") > 1).alias("solved"))
              .groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "n", "bucket", "kinds", "solved")).alias("runs")))
    left = opened.withColumnRenamed("id", "_id").withColumnRenamed("mark", "_mark")
    there = texts.join(left, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("id", "mark", "text", "runs")
    there = written(there.mapInArrow(_texts_of_runs(tokens, window), f"bucket long, kinds long, id {kind}, mark long, lo long, n int, solved boolean, codes binary"), "open-runs")
    few = there.filter(F.col("kinds") <= GROUP).repartition("bucket").sortWithinPartitions("bucket")
    single = few.mapInArrow(_inside_buckets(tokens, window), f"id {kind}, mark long, start long, n_tokens long")
    many = there.filter(F.col("kinds") > GROUP).mapInArrow(_across_tasks(tokens, window), f"id {kind}, mark long, start long, bucket long, rest long")
    counted = many.filter("bucket is not null").withColumn("rows", F.count("*").over(Window.partitionBy("bucket", "rest")))
    hot = counted.filter("rows > 1 and start >= 0").select("id", "mark", "start").union(many.filter("bucket is null").select("id", "mark", "start"))
    return whole.union(single).union(hot.withColumn("n_tokens", F.lit(window).cast("long")))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("mark"), text.alias("text"))


def _ranges(spans, text: bytes, tokens: str) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the spans; words take the white space behind them along."""
    if len(spans) == 0:
        return []
    start, size = np.asarray(spans.values.field("start")), np.asarray(spans.values.field("n_tokens"))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + size)[order])
    new = np.append(True, start[1:] > end[:-1])
    lo, hi = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    if tokens == "words":
        edges = np.array([m.span() for m in _WORD.finditer(text)])
        lo, hi = edges[lo, 0], edges[hi - 1, 1]
    return list(zip(lo.tolist(), hi.tolist()))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, tokens: str = "bytes",
                    gram: int | None = None) -> DataFrame:
    """``docs`` (all columns and rows) with ``text_col`` freed of every repeated window, and n_bytes, n_removed, n_spans.

    Every occurrence goes, the first too. ``n_bytes`` is the size before, ``n_spans`` the number of maximal removed stretches.
    Columns of these names, or starting with ``_cut_``, are replaced.
    """
    spans = repeated_spans(docs, id_col, text_col, window, tokens, gram)
    spans = spans.groupBy(F.col("id").alias("_cut_id"), F.col("mark").alias("_cut_mark")).agg(F.collect_list(F.struct("start", "n_tokens")).alias("_cut_spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("_cut_key", F.xxhash64(F.col(id_col), text)).drop("n_bytes", "n_removed", "n_spans")
    joined = base.join(spans, (F.col("_cut_key") == F.col("_cut_mark")) & F.col(id_col).eqNullSafe(F.col("_cut_id")), "left")
    joined = joined.withColumn("_cut_spans", F.coalesce("_cut_spans", F.array().cast("array<struct<start:bigint,n_tokens:bigint>>"))).drop("_cut_id", "_cut_mark", "_cut_key")
    kept = [c for c in joined.columns if c != "_cut_spans"]
    fields = [f for f in joined.schema.fields if f.name in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_bytes long, n_removed long, n_spans long"

    def cut(batches):
        for batch in lots(batches, text_col, LOT_BYTES):
            out, before, removed, n_spans = [], [], [], []
            texts, spans_ = batch.column(text_col), batch.column("_cut_spans")
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                data = encoded(value)
                ranges = _ranges(spans_[i], data, tokens)
                gone = sum(b - a for a, b in ranges)
                before.append(len(data)), removed.append(gone), n_spans.append(len(ranges))
                if gone:
                    edges = [0, *(x for r in ranges for x in r), len(data)]
                    data = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append(data if gone or value is not None else None)
            columns = [pa.array(out, pa.binary()) if c == text_col else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())],
                                             names=[*kept, "n_bytes", "n_removed", "n_spans"])

    made = joined.mapInArrow(cut, schema.replace(f"`{text_col}` string", f"`{text_col}` binary"))
    return made


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """Per document: the removed bytes and the SHA-256 of what is left. Text is kept as bytes, as a cut may fall inside a character."""
    cut = without_repeats(docs.select(id_col, text_col), id_col, text_col, window)
    return cut.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce(F.col(text_col), F.lit(b"")), 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], window: int) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows; for small tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                hit[p : p + window] = b"\1" * window
        kept = bytes(c for c, h in zip(t, hit) if not h)
        out.append((len(t), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return out
