"""Token counts of whole texts, huge ones in overlapping chunks that are joined where both encodings provably agree.

Texts up to ``CHUNK`` characters go through the library in batches. Of a longer one, each chunk starts ``OVERLAP``
characters before the end of the one before, and both are encoded with offsets. They are spliced at a place in the
overlap where a token starts in both and that is *stable*: no token can hold the characters on its two sides together,
so nothing left of it can change what stands right of it, in either chunk or in the whole text. Where the overlap holds
no such place, it is widened, twofold each time, and when it has reached the start of the chunk, the two become one. So
memory is that of a chunk, except for stretches without any stable place (one letter repeated for megabytes).

Null and empty texts have no tokens and no bytes. Repeated rows are counted each, there are no ties to break, and other
columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logwarden.llm.tokens import chunks

CHUNK = 1 << 15
OVERLAP = 256
BATCH = 1 << 20
BLANK = "▁"


class PieceTokens:
    """A SentencePiece model. A place is stable if no piece holds the two characters around it side by side."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.source = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.source.id_to_piece(i) for i in range(self.source.get_piece_size())]
        self.joints = {n[i : i + 2] for n in names for i in range(len(n) - 1)}
        # a model that rewrites characters has no places known to be stable
        probe = "ﬁ  Å①"
        self.plain = self.source.normalize(probe).replace(BLANK, " ").strip(" ") == probe and "  " in self.source.normalize(probe).replace(BLANK, " ")

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.source.encode(texts, return_type="numpy", num_threads=1)]

    def starts(self, text: str) -> np.ndarray:
        return np.array([a for a, _ in self.source.encode(text, return_type="offset_mapping")["offsets"]], dtype=np.int64)

    def stable(self, text: str, at: int) -> bool:
        return self.plain and text[at - 1 : at + 1].replace(" ", BLANK) not in self.joints


class RankTokens:
    """A byte-level tokenizer of the ``tokenizers`` library. No token holds a blank behind anything that is not blank."""

    def __init__(self, model: bytes):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        self.source = Tokenizer.from_buffer(model)
        self.source.no_truncation()
        self.source.no_padding()
        shape = json.loads(model)
        before = shape.get("pre_tokenizer") or {}
        added = shape.get("added_tokens", [])
        self.plain = (shape.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                      and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in added))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.source.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str) -> np.ndarray:
        return np.array([a for a, _ in self.source.encode(text, add_special_tokens=False).offsets], dtype=np.int64)

    def stable(self, text: str, at: int) -> bool:
        return self.plain and text[at] == " " and not text[at - 1].isspace()


def resynchronised(text: str, starts: Callable[[str], np.ndarray], stable: Callable[[str, int], bool], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of ``text``, and how often an overlap had to be widened."""
    total = widened = begin = proven = 0
    end = min(len(text), chunk)
    left = starts(text[:end])
    while end < len(text):
        width = overlap
        while True:
            next_begin = max(begin, end - width)
            next_end = min(len(text), end + max(chunk, width))
            right = starts(text[next_begin:next_end]) + next_begin
            both = np.intersect1d(left, right)
            both = both[(both >= proven) & (both > next_begin) & (both < end)]
            at = next((p for p in both[::-1].tolist() if stable(text, p)), None)
            if at is not None or next_begin == begin:
                break
            width *= 2
            widened += 1
        if at is not None:
            total += int(np.searchsorted(left, at) - np.searchsorted(left, proven))
            begin, proven = next_begin, at
        left, end = right, next_end  # without a stable place the wider chunk holds all of the narrower one
    return total + len(left) - int(np.searchsorted(left, proven)), widened


@lru_cache(maxsize=2)
def loaded(model: bytes, pieces: bool) -> PieceTokens | RankTokens:
    return PieceTokens(model) if pieces else RankTokens(model)


def counted(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every text. ``model_path`` ends in ``.model`` (sentencepiece) or ``.json`` (tokenizers)."""
    with open(model_path, "rb") as file:  # a file of the driver, some megabytes
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    pieces = model_path.endswith(".model")

    def run(batches):
        tokens = loaded(model.value, pieces)
        for batch in batches:
            column = batch.column(1).fill_null("")
            sizes = pc.binary_length(column)
            for part in chunks(sizes.to_pylist(), BATCH):
                texts = column[part].to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                found = np.zeros(len(texts), dtype=np.int64)
                found[short] = tokens.counts([texts[i] for i in short])
                for i, text in enumerate(texts):
                    if len(text) > chunk:
                        found[i] = resynchronised(text, tokens.starts, tokens.stable, chunk, overlap)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], sizes[part].cast(pa.int64()), pa.array(found), pa.array(found > limit)],
                                                 names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return made.withColumnRenamed("id", id_col)
