"""Which tokens of two tokenizers cover the same bytes, per document and over the corpus.

A byte-level tokenizer (A) and a SentencePiece model (B) both end a token before every blank that follows something
other than white space, so a text falls into segments whose tokens do not depend on each other. A task numbers the
segments of some megabytes of text, encodes only the new ones, puts all A and B tokens into one list ordered by start
(lexsort) and runs the maximum of the ends over it: a group begins where a start reaches that maximum. Inside a group the
overlapping pairs are expanded. Documents are then sums over their segments.

Links are counted over the corpus without ever being shuffled one by one: each chunk of text sends its distinct id pairs
with their numbers to be summed, asks with one row a distinct pair for the sums, and gets them back by its key beside the
packed documents. The one broadcast table has a row for each id of B (its best count), bounded by the vocabulary.

Null and empty texts, and texts whose tokens do not spell them, have zeros and an empty digest. Repeated rows count each;
ties for the best count all count. Very long texts form a chunk of their own. Other columns are left out, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.cluster import written
from logwarden.llm.tokens import chunks

CHUNK = 2 << 20
TABLE_ROWS = 150_000
TABLE_BYTES = 24 << 20
LOT = 2048
BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if it is visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of every token of one tokenizer, end to end."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(s) for s in spelled], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        place = np.cumsum(size) - size
        return self.data[np.repeat(self.at[ids] - place, size) + np.arange(size.sum())]


def groups_of(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Group of every interval; a new one begins where a start reaches all ends before it."""
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), dtype=np.int64)
    fresh[1:] = start[order][1:] >= reach[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping intervals of two gap-free lists, as positions in both."""
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = np.maximum(high - low, 0)
    first = np.cumsum(n) - n
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(low - first, n)


class Aligner:
    """Both tokenizers of one worker, with a bounded table of segments that were aligned before."""

    def __init__(self, a_model: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        shape = json.loads(a_model)
        self.a = Tokenizer.from_buffer(a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if shape.get("normalizer") or (shape.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError("A must be byte-level, and B must put blanks in front of words")
        alphabet, a_names = byte_alphabet(), {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        a_spelled = [bytes(alphabet[c] for c in a_names[i]) if i in a_names and all(c in alphabet for c in a_names[i]) else b"" for i in range(max(a_names) + 1)]
        b_spelled = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.a_words, self.b_words, self.blank = Vocabulary(a_spelled), Vocabulary(b_spelled), self.b.piece_to_id(BLANK)
        self.n_b_ids = len(names)
        self.marks = [[str(i) + sign for i in range(max(len(a_spelled), len(names)))] for sign in ",|;\0"]
        self.clear()

    def clear(self) -> None:
        self.table: dict[str, int] = {}
        self.ends: dict[str, int] = {}  # segments that only the end of a text closes
        self.texts: list[str] = []
        self.held = 0
        self.sums = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.sound = np.zeros(0, dtype=bool)
        self.pairs, self.pair_at = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def numbers(self, text: str, fresh: list[str]) -> list[int]:
        """Numbers of the segments of blank + ``text``; what is new is put into ``fresh``."""
        words = text.split(" ")
        found = list(map(self.table.get, words))
        if None not in found:
            return found
        out, i, last = [], 0, len(words) - 1
        while i <= last:
            word = words[i]
            while i < last and (not word or word[-1].isspace() or word[-1] == BLANK):
                i += 1
                word += " " + words[i]
            closed = word and not word[-1].isspace() and word[-1] != BLANK
            table = self.table if closed else self.ends
            number = table.get(word)
            if number is None:
                number = table[word] = len(self.texts) + len(fresh)
                fresh.append(word)
                self.held += len(word)
            out.append(number)
            i += 1
        return out

    def align(self, fresh: list[str]) -> None:
        """Adds new segments to the table."""
        # in small lots, as the library returns far more than ids
        a_lists = [x.ids for at in range(0, len(fresh), LOT) for x in self.a.encode_batch_fast([" " + w for w in fresh[at : at + LOT]], add_special_tokens=False)]
        b_lists = [x if w else [self.blank] for w, x in zip(fresh, self.b.encode(fresh, num_threads=1))]
        n_a, n_b = np.array([len(x) for x in a_lists]), np.array([len(x) for x in b_lists])
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (a_lists, b_lists))
        raw = [b" " + w.encode() for w in fresh]
        size = np.array([len(r) for r in raw])
        a_of, b_of = np.repeat(np.arange(len(fresh)), n_a), np.repeat(np.arange(len(fresh)), n_b)
        sound = (np.bincount(a_of, self.a_words.size[a], len(fresh)) == size) & (np.bincount(b_of, self.b_words.size[b], len(fresh)) == size)
        want = np.frombuffer(b"".join(r for r, s in zip(raw, sound) if s), dtype=np.uint8)
        place = np.repeat(np.flatnonzero(sound), size[sound])
        for words, ids, of in ((self.a_words, a, a_of), (self.b_words, b, b_of)):
            sound[place[words.joined(ids[np.isin(of, place)]) != want]] = False
        a, a_of, b, b_of = a[sound[a_of]], a_of[sound[a_of]], b[sound[b_of]], b_of[sound[b_of]]
        a_end, b_end = np.cumsum(self.a_words.size[a]), np.cumsum(self.b_words.size[b])
        a_start, b_start = a_end - self.a_words.size[a], b_end - self.b_words.size[b]
        kind = np.repeat([0, 1], [len(a), len(b)])
        group = groups_of(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), kind)
        i, j = overlaps(a_start, a_end, b_start, b_end)
        links = np.bincount(a_of[i], minlength=len(fresh))
        of = np.concatenate([a_of, b_of])
        n_groups = np.bincount(of[np.unique(group, return_index=True)[1]], minlength=len(fresh))
        sums = np.stack([np.where(sound, n_a, 0), np.where(sound, n_b, 0), n_groups, links], axis=1)
        # written form: ids by group, A before B, each with the sign that follows it
        order = np.lexsort((np.arange(len(of)), kind, group))
        g, k, s = group[order], kind[order], of[order]
        sign = np.full(len(order), 3)
        if len(order):
            sign[:-1] = np.where(s[1:] != s[:-1], 3, np.where(g[1:] != g[:-1], 2, np.where(k[1:] != k[:-1], 1, 0)))
        marks = self.marks
        texts = iter("".join([marks[x][y] for x, y in zip(sign.tolist(), np.concatenate([a, b])[order].tolist())]).split("\0"))
        self.texts += [next(texts) if x else "" for x in sound.tolist()]
        self.sums, self.sound = np.concatenate([self.sums, sums]), np.concatenate([self.sound, sound])
        self.pairs = np.concatenate([self.pairs, a[i] * self.n_b_ids + b[j]])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(links)])

    def chunk(self, texts: list[str]) -> dict:
        """Sums and digests of some texts, their segments as packed numbers, and the distinct pairs of those."""
        if len(self.texts) > TABLE_ROWS or self.held > TABLE_BYTES:
            self.clear()
        fresh: list[str] = []
        rows = [self.numbers(t, fresh) if t else [] for t in texts]
        if fresh:
            self.align(fresh)
        n = np.array([len(r) for r in rows], dtype=np.int64)
        number = np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=n.sum())
        doc = np.repeat(np.arange(len(rows)), n)
        bad = np.bincount(doc[~self.sound[number]], minlength=len(rows)) > 0
        number, doc = number[~bad[doc]], doc[~bad[doc]]
        n[bad] = 0
        sums = np.zeros((len(rows), 4), dtype=np.int64)
        for c in range(4):
            sums[:, c] = np.bincount(doc, self.sums[number, c], len(rows)).astype(np.int64)
        shown = self.texts
        digest = ["" if b or not r else hashlib.sha256(";".join([shown[i] for i in r]).encode()).hexdigest() for r, b in zip(rows, bad)]
        own, local = np.unique(number, return_inverse=True)
        size = self.pair_at[own + 1] - self.pair_at[own]
        first = np.cumsum(size) - size
        flat = self.pairs[np.arange(size.sum()) + np.repeat(self.pair_at[own] - first, size)]
        pairs, link = np.unique(flat, return_inverse=True)
        times = np.bincount(link, np.repeat(np.bincount(local, minlength=len(own)), size), len(pairs)).astype(np.int64)
        return {"sums": sums, "digest": digest, "n": n, "local": local, "size": size, "pairs": pairs, "link": link, "times": times}


@lru_cache(maxsize=1)
def loaded(a_model: bytes, b_model: bytes) -> Aligner:
    return Aligner(a_model, b_model)


def _packed(numbers: np.ndarray) -> bytes:
    return len(numbers).to_bytes(4, "little") + pa.compress(numbers.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), dtype=np.uint32)


SUMS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every text.

    ``a_path`` is a byte-level file of the ``tokenizers`` library, ``b_path`` a SentencePiece model.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    models = []
    for path in (a_path, b_path):  # files of the driver, some megabytes
        with open(path, "rb") as file:
            models.append(docs.sparkSession.sparkContext.broadcast(file.read()))

    def run(batches):
        aligner = loaded(models[0].value, models[1].value)
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column(1).fill_null("")
            for part in chunks(pc.binary_length(column).to_pylist(), CHUNK):
                found = aligner.chunk(column[part].to_pylist())
                ids = batch.column(0)[part]
                whole = pa.StructArray.from_arrays([ids, *[pa.array(found["sums"][:, c]) for c in range(4)], pa.array(found["n"]), pa.array(found["digest"], pa.string())],
                                                   names=["id", *SUMS, "n", "groups_sha256"])
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), one(whole), one(pa.array(found["pairs"])), one(pa.array(found["times"])),
                     pa.array([_packed(found["local"])], pa.binary()), pa.array([_packed(found["size"])], pa.binary()), pa.array([_packed(found["link"])], pa.binary())],
                    names=["chunk", "docs", "pairs", "times", "local", "size", "link"])
                key += 1

    row = f"id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, n: bigint, groups_sha256: string"
    made = docs.select(id_col, text_col).mapInArrow(
        run, f"chunk long, docs array<struct<{row}>>, pairs array<bigint>, times array<bigint>, local binary, size binary, link binary")
    packed = written(made, "chunks")
    with open(b_path, "rb") as file:
        n_b_ids = _piece_count(file.read())
    asked = packed.select(F.col("chunk").alias("asker"), F.posexplode("pairs").alias("pos", "pair"))
    each = packed.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = written(each.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    b = (F.col("pair") % n_b_ids).alias("b")
    best = counts.groupBy(b).agg(F.max("count").alias("most"))  # a row an id of B
    judged = counts.join(F.broadcast(best), (counts.pair % n_b_ids) == best.b).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.join(judged, "pair").select("asker", "pos", "count", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        count, top = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=np.int64)
        pos = right.column("pos").to_numpy()
        count[pos], top[pos] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        out = []
        for row_ in range(left.num_rows):
            local, size, link = (_unpacked(left.column(c)[row_].as_py()) for c in ("local", "size", "link"))
            segment = np.repeat(np.arange(len(size)), size)
            whole = left.column("docs")[row_].values
            doc = np.repeat(np.arange(len(whole)), whole.field("n").to_numpy())
            added = []
            for values in (top, count):
                sums = np.zeros(len(size), dtype=np.int64)
                np.add.at(sums, segment, values[link])
                of_doc = np.zeros(len(whole), dtype=np.int64)
                np.add.at(of_doc, doc, sums[local])
                added.append(pa.array(of_doc))
            out.append(pa.Table.from_arrays([whole.field("id"), *[whole.field(c) for c in SUMS], *added, whole.field("groups_sha256")], names=["id", *SUMS, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], left.schema.field("docs").type.value_type.field("id").type), **{c: pa.array([], pa.int64()) for c in (*SUMS, "n_best", "count_sum")}, "groups_sha256": pa.array([], pa.string())})

    sides = packed.select("chunk", "docs", "local", "size", "link").groupBy("chunk").cogroup(answers.groupBy("asker"))
    made = sides.applyInArrow(summed, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return made.withColumnRenamed("id", id_col)


def _piece_count(model: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
