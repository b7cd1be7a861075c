"""Array helpers used inside tasks: rolling hashes over bytes and words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(90417)
BYTE_CODES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that they have inverses modulo 2**64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (one to one)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _POWERS[base] = have = out
    return have[:n]


class Rolling:
    """Hashes of any stretch of ``codes`` in constant time; equal stretches hash equally wherever they stand."""

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes)
        self.inverse = pow(base, -1, 2**64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * powers(base, n), out=self.sums[1:])
        self.back = powers(self.inverse, n + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def all(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]


class Words:
    """The words (runs of bytes other than ASCII white space) of several texts: hash, place, and text of each."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.bytes = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        blank = _BLANK[self.bytes]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash = mix(Rolling(BYTE_CODES[self.bytes], BASES[0]).at(self.start, self.end))
        #: first word of each text, and the number of words
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one text, and the index of each run's first word."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        last = len(self.hash) - n + 1
        out = self.hash[:last].copy()
        for k in range(1, n):
            out = mix(out) * U(BASES[1]) + self.hash[k : last + k]
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        return mix(out[at]), at


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lots(batches: Iterable[pa.RecordBatch], text_col: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts take at most ``limit`` bytes (single larger rows stand alone)."""
    for batch in batches:
        for lot in chunks([v or 0 for v in pc.binary_length(batch.column(text_col)).to_pylist()], limit):
            yield batch.slice(lot.start, lot.stop - lot.start)


def chunks(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to at most ``limit`` (single larger rows stand alone)."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += size + 1
    if begin < len(sizes):
        yield slice(begin, len(sizes))
