"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking instead of merging.

A text is split where no piece can cross: before runs of blanks (pieces hold blanks only in front) and around
characters outside the vocabulary. In each part an Aho-Corasick automaton finds all pieces; from the left the longest is
taken that is *compatible* with the one before it, that is, merging the characters of both anew gives just these two.
If none fits, the position is marked in a bitfield as failed and the piece before it is exchanged for a shorter one. As
the result of merging is the only sequence of pieces with all neighbours compatible, this finds it, in time near linear
in the length. Runs of blanks, whose merges all rank last and equal, are merged from the left, as ties are.

Parts repeat, so each task keeps their ids in a table of bounded size, dropped at its end. Null texts count as empty; ties in rank go to the
left; very long texts and words need memory in proportion to themselves only. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logwarden.llm.tokens import lots

LOT_BYTES = 1 << 20  # texts that are encoded before their rows leave the task
BLANK = "▁"
TABLE_ROWS = 100_000  # most parts are rare, so larger tables hold more of what is not asked for again
_RUNS = re.compile(f"({BLANK}*)([^{BLANK}]*)")


class Pieces:
    """Encoder and decoder for one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [source.id_to_piece(i) for i in range(source.get_piece_size())]
        self.ids, self.scores, self.bytes, self.silent = {}, {}, {}, set()
        for i, name in enumerate(self.names):
            if source.is_byte(i):
                self.bytes[i] = int(name[3:5], 16)
            elif source.is_control(i) or source.is_unknown(i):
                self.silent.add(i)
            else:
                self.ids[name], self.scores[name] = i, source.get_score(i)
        if source.encode("x", out_type=str)[0][0] != BLANK or any(BLANK in n.lstrip(BLANK) for n in self.ids):
            raise ValueError("only models that put blanks in front of words are supported")
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.end = source.eos_id()
        self.automaton = ahocorasick.Automaton()
        for name in self.ids:
            if name.strip(BLANK) or name == BLANK:
                self.automaton.add_word(name, (len(name) - 1, name))
        self.automaton.make_automaton()
        self.singles = {n for n in self.ids if len(n) == 1}
        self.joints = {n[i : i + 2] for n in self.ids for i in range(len(n) - 1)}  # two characters that some piece holds side by side
        self.breaks = "\n" not in self.ids
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.tables: tuple[dict, dict] = ({}, {})  # words at the start of a line, and words after a blank
        self.older: tuple[dict, dict] = ({}, {})  # what they held before they were last full
        self.newline = self._entry(self._unknown("\n"))

    def forget(self) -> None:
        """Empties the tables of parts: a worker goes on with tasks of other stages, which need the memory."""
        self.tables, self.older = ({}, {}), ({}, {})

    def merged(self, text: str) -> list[str]:
        """Plain merging: always the pair of the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 4 * TABLE_ROWS:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def reachable(self, piece: str) -> bool:
        """Whether merging the piece's own characters gives the piece."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def _unknown(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def _word(self, word: str) -> list[int]:
        """Ids of a part that holds no blank but perhaps one in front."""
        if word in self.ids and self.reachable(word):
            return [self.ids[word]]
        at: list[list[str]] = [[] for _ in word]
        for last, (back, piece) in self.automaton.iter(word):
            at[last - back].append(piece)  # ends grow, so the longest piece comes last
        if self.singles.issuperset(word):
            return self._known(word, at)
        out: list[int] = []
        begin = 0
        for i, found in enumerate(at):
            if word[i] not in self.singles:
                out += self._known(word[begin:i], at[begin:i]) + self._unknown(word[i])
                begin = i + 1
        return out + self._known(word[begin:], at[begin:])

    def _known(self, word: str, at: list[list[str]]) -> list[int]:
        """The backtracking search proper; every character of ``word`` is a piece."""
        size, pos, stack = len(word), 0, []
        if not size:
            return []
        failed, fits = bytearray(size // 8 + 1), self.fits
        tried = len(at[0])
        while True:
            choices, before = at[pos], stack[-1][0] if stack else None
            while tried:
                tried -= 1
                piece = choices[tried]
                end = pos + len(piece)
                if end <= size and not failed[end >> 3] >> (end & 7) & 1 and (self.reachable(piece) if before is None else fits.get((before, piece)) or self.compatible(before, piece)):
                    stack.append((piece, tried))
                    pos = end
                    break
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece, tried = stack.pop()
                pos -= len(piece)
                continue
            if pos == size:
                return [self.ids[p] for p, _ in stack]
            tried = len(at[pos])

    def _blanks(self, n: int) -> list[int]:
        """A run of blanks, merged from the left."""
        size, after, before = dict.fromkeys(range(n), 1), {i: i + 1 for i in range(n - 1)}, {i: i - 1 for i in range(1, n)}
        queue = [(-self.scores[BLANK * 2], i, 2) for i in range(n - 1)] if BLANK * 2 in self.scores else []
        while queue:
            _, i, total = heapq.heappop(queue)
            j = after.get(i)
            if i not in size or j is None or size[i] + size[j] != total:
                continue
            size[i] = total
            del size[j]
            k = after.pop(j, None)
            if k is None:
                del after[i]
            else:
                after[i], before[k] = k, i
            for a, b in ((before.get(i), i), (i, k)):
                if a is not None and b is not None and BLANK * (size[a] + size[b]) in self.scores:
                    heapq.heappush(queue, (-self.scores[BLANK * (size[a] + size[b])], a, size[a] + size[b]))
        return [self.ids[BLANK * s] for _, s in sorted(size.items())]

    def _with_run(self, n: int, word: str) -> list[int]:
        ids = self._word(BLANK + word if n else word)
        if n < 2:
            return ids
        lone = ids[0] == self.ids[BLANK]
        return self._blanks(n if lone else n - 1) + (ids[1:] if lone else ids)

    def _new(self, word: str, kind: int) -> tuple[str, int, str]:
        """Entry of a word missing in table ``kind``. The table is bounded: when full it becomes the older one, read before it goes."""
        entry = self.older[kind].get(word)
        if entry is None and not word.isalpha() and len(word) > 1:
            # no piece spans these two characters, so the parts stand alone, and there are fewer different ones
            cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joints), len(word)]
            if len(cuts) > 2:
                parts = [self.tables[kind if not a else 0].get(word[a:b]) or self._new(word[a:b], kind if not a else 0) for a, b in zip(cuts, cuts[1:])]
                entry = " ".join([p[0] for p in parts]), sum([p[1] for p in parts]), "".join([p[2] for p in parts])
        if entry is None:
            entry = self._entry(self._with_run(kind, word))
        if len(self.tables[kind]) >= TABLE_ROWS:
            self.older = tuple(dict(self.tables[kind]) if j == kind else self.older[j] for j in (0, 1))
            self.tables[kind].clear()
        self.tables[kind][word] = entry
        return entry

    def _entry(self, ids: list[int]) -> tuple[str, int, str]:
        return " ".join(map(str, ids)), len(ids), self.spelled(ids)

    def spelled(self, ids: list[int]) -> str:
        """Text of the pieces, blanks in front included."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(_bytes_text(bytes(held)))
                held = bytearray()
            if i >= 0 and i not in self.silent:
                out.append(self.names[i].replace(BLANK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a sequence of ids: the blank put in front of the first word is taken off again."""
        text = self.spelled(ids)
        seen = [i for i in ids if i not in self.silent]
        return text[1:] if seen and self.names[seen[0]].startswith(BLANK) else text

    def parts(self, text: str | None) -> list[tuple[str, int, str]]:
        """The text as consecutive (ids as decimal text, number of ids, spelling)."""
        if not text:
            return []
        text = text.replace(BLANK, " ")
        out = []
        for k, line in enumerate(text.split("\n") if self.breaks else [text]):
            if k:
                out.append(self.newline)
            words = line.split(" ")
            if "" in words[1 if k else 0 : -1]:
                found = _RUNS.findall((BLANK if not k else "") + line.replace(" ", BLANK))
                out += [self._entry(self._with_run(len(run), word)) for run, word in found if run or word]
                continue
            for i, word in enumerate(words):
                table = self.tables[0 if k and not i else 1]
                entry = table.get(word)
                if entry is None:
                    entry = self._new(word, 0 if k and not i else 1)
                out.append(entry)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, n, _ in self.parts(text) if n for i in ids.split(" ")]

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, and digests of the ids and of the decoded text."""
        parts = self.parts(text)
        ids = " ".join([p[0] for p in parts if p[1]] + [str(self.end)])
        first = next((p[2] for p in parts if p[1]), "")
        spelled = "".join([p[2] for p in parts])
        if first.startswith(" "):
            spelled = spelled[1:]
        return sum(p[1] for p in parts) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(spelled.encode("utf-8", "surrogatepass")).hexdigest()


def _bytes_text(data: bytes) -> str:
    """Bytes as text; each byte that is not part of a character becomes one replacement mark."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def loaded(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(batches, pieces: Pieces, lot_bytes: int):
    try:
        for part in lots(batches, 1, lot_bytes):
            ids, decoded, ends = [], [], [0]
            for text in part.column(1):
                found = pieces.encode(text.as_py())
                found.append(pieces.end)
                decoded.append(pieces.decode(found))
                ids.append(np.array(found, dtype=np.int32))
                ends.append(ends[-1] + len(found))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])
    finally:
        pieces.forget()


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, token ids (end id last) and decoded text of each row; a null text is empty. Other columns are left out.

    A task holds the ids and spellings of one lot of texts (1 MB, or one longer text), as packed integers.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        yield from _encoded(batches, loaded(model.value), LOT_BYTES)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encoded_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encoded``, but only the number of ids and SHA-256 digests of ids and decoded text."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        pieces = loaded(model.value)
        try:
            for batch in batches:
                rows = [pieces.digests(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            pieces.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("id", id_col)
