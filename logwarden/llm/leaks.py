"""Test items that leaked into training texts: rare n-gram seeds, then Smith-Waterman alignment of words.

*Seeds.* How many documents hold each ``gram``-word run of the items is counted over all documents. A run is a seed if at most
``rare`` of the documents (or ``FEW``) hold it, or not many more than hold the item's other runs, or if it is the rarest among
``spacing`` neighbours, so a passage that a third of the documents copy keeps its seeds. *Passages.* Every seed found in a document proposes the stretch in which the rest of the
item would lie, with half an item of room for insertions; overlapping stretches become one. *Alignment.* The best local
alignment (match 2, mismatch and gap -1) over that of the whole item with itself is the score; edited and paraphrased
copies keep a high one.

Items go to the tasks in blocks of ``block_words`` words, one pass over the documents for each block, so any number of items
works. Documents are never shuffled; only their alignments are. Words are runs of letters, digits and ``_`` in lower case.

Null texts and items count as empty and match nothing; items under ``gram`` words are found by their whole run of words. Repeated
items give a result each. Repeated document rows too, unless equal in id and result. Ties in score go to the earlier
passage. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
FEW = 20  # documents that may hold a run of words for it to be rare in any case
SCHEMA = "doc_id long, item_id long, score double, start_word long, end_word long, n_matches long"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Local alignment scores of all pairs of prefixes (match 2, mismatch -1, gap -1)."""
    steps = np.arange(len(b) + 1)
    out = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    for i, word in enumerate(a):
        row = out[i + 1]
        row[1:] = np.maximum(out[i, :-1] + np.where(b == word, 2, -1), out[i, 1:] - 1)
        np.maximum(row, 0, out=row)
        np.maximum(row, np.maximum.accumulate(row + steps) - steps, out=row)  # gaps in a: each costs one
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best score and the stretch of ``b`` (begin, end) that has it, the earliest of equals."""
    table = _table(a, b)
    best = int(table.max(initial=0))
    if not best:
        return 0, 0, 0
    i, j = min(zip(*np.nonzero(table == best)), key=lambda x: (x[1], x[0]))
    back = _table(a[:i][::-1], b[:j][::-1])
    begin = min(int(y) for x, y in zip(*np.nonzero(back == best)))
    return best, int(j) - begin, int(j)


class Items:
    """A block of test items: vocabulary, words, and where each run of words stands."""

    def __init__(self, rows: list[tuple[int, str | None]], gram: int):
        self.gram, self.vocabulary, self.items = gram, {}, []
        for item_id, text in rows:
            found = words_of(text)
            if found:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found])))
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            n = min(gram, len(w))
            for at in range(len(w) - n + 1):
                self.places[tuple(w[at : at + n].tolist())].append((k, at))
        self.numbers = {g: i for i, g in enumerate(self.places)}
        self.lengths = sorted({len(g) for g in self.places})
        #: runs by a mixed key, to look up whole texts at once; equal keys are compared in full afterwards
        self.keys = {}
        for n in self.lengths:
            grams = [g for g in self.places if len(g) == n]
            keys = self._key(np.array(grams, dtype=np.int64).T)
            order = np.argsort(keys, kind="stable")
            self.keys[n] = keys[order], [grams[i] for i in order]

    @staticmethod
    def _key(columns) -> np.ndarray:
        key = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def found(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, tuple]]]:
        """Word numbers of a text (-1 for others) and the runs in it: (place, run)."""
        get = self.vocabulary.get
        numbers = np.array([get(w, -1) for w in words], dtype=np.int64)
        out = []
        known = numbers >= 0
        for n in self.lengths:
            if len(numbers) < n:
                continue
            last = len(numbers) - n + 1
            whole = known[:last].copy()
            for j in range(1, n):
                whole &= known[j : last + j]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            keys, grams = self.keys[n]
            mine = self._key([numbers[at + j] for j in range(n)])
            lo = np.searchsorted(keys, mine)
            hit = (lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == mine)
            for p, k in zip(at[hit].tolist(), lo[hit].tolist()):
                run, key = tuple(numbers[p : p + n].tolist()), keys[k]
                while k < len(grams) and keys[k] == key:
                    if grams[k] == run:
                        out.append((p, run))
                        break
                    k += 1
        return numbers, out

    def seeds(self, df: dict[int, int], most: float, spacing: int) -> dict[tuple, list[tuple[int, int]]]:
        """Runs that are rare, or the rarest of some ``spacing`` neighbours in an item."""
        kept: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            n = min(self.gram, len(w))
            runs = [tuple(w[at : at + n].tolist()) for at in range(len(w) - n + 1)]
            counts = [df.get(self.numbers[g], 0) for g in runs]
            usual = sorted(counts)[len(counts) // 4]  # runs of an item that is copied n times occur n times: no reason to leave them out
            chosen = {at for at, c in enumerate(counts) if c <= max(most, FEW, 4 * usual)}
            for at in range(max(1, len(runs) - spacing + 1)):
                chosen.add(min(range(at, min(at + spacing, len(runs))), key=lambda j: (counts[j], j)))
            for at in chosen:
                kept[runs[at]].append((k, at))
        return kept


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """Items as lists of at most ``block_words`` words (one item at least), read one partition at a time."""
    held, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        words = len(words_of(row[1]))
        if held and size + words > block_words:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += words
    if held:
        yield held


def alignments(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
               least: float = 0.5, gram: int = 4, rare: float = 0.001, spacing: int = 4, block_words: int = 500_000) -> DataFrame:
    """Pairs of document and item with a score of at least ``least``: doc_id, item_id, score, start_word, end_word, n_matches.

    The best alignment of each pair; words are counted from 0, the end is behind the last. ``n_matches`` is the number of seeds in it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total, parts = None, []
    for rows in _blocks(items, item_id_col, item_text_col, block_words):
        block = Items(rows, gram)
        if not block.items:
            continue
        total = docs.count() if total is None else total
        sent = spark.sparkContext.broadcast(block)  # bounded by block_words

        def count(batches, sent=sent):
            for batch in batches:
                df: dict[int, int] = defaultdict(int)
                for text in batch.column(0).to_pylist():
                    for run in {run for _, run in sent.value.found(words_of(text))[1]}:
                        df[sent.value.numbers[run]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.int64()), pa.array(df.values(), pa.int64())], names=["run", "df"])

        counts = texts.select("text").mapInArrow(count, "run long, df long").groupBy("run").agg(F.sum("df").alias("df"))
        chosen = spark.sparkContext.broadcast(block.seeds({r["run"]: r["df"] for r in counts.collect()}, rare * total, spacing))

        def match(batches, sent=sent, chosen=chosen):
            items, seeds = sent.value.items, chosen.value

            @lru_cache(maxsize=20_000)
            def aligned(k: int, passage: bytes) -> tuple[int, int, int]:
                return align(items[k][1], np.frombuffer(passage, dtype=np.int64))

            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    numbers, runs = sent.value.found(words_of(text))
                    stretches = defaultdict(list)
                    for place, run in runs:
                        for k, at in seeds.get(run, ()):
                            size = len(items[k][1])
                            room = size // 2
                            stretches[k].append((max(0, place - at - room), min(len(numbers), place + size - at + room), place))
                    for k, found in stretches.items():
                        found.sort()
                        merged = [list(found[0][:2]) + [1]]
                        for lo, hi, _ in found[1:]:
                            if lo <= merged[-1][1]:
                                merged[-1][1] = max(hi, merged[-1][1])
                                merged[-1][2] += 1
                            else:
                                merged.append([lo, hi, 1])
                        best = (0, 0, 0, 0)
                        for lo, hi, n in merged:
                            score, begin, end = aligned(k, numbers[lo:hi].tobytes())
                            if score > best[0]:
                                best = score, lo + begin, lo + end, n
                        score = best[0] / (2 * len(items[k][1]))
                        if score >= least:
                            out.append((doc_id, items[k][0], score, *best[1:]))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        parts.append(texts.mapInArrow(match, SCHEMA))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.distinct()
