"""Document quality by Bradley-Terry pairwise ranking.

Every labelled good document is preferred to a labelled bad one; the logistic loss of such pairs on the *difference* of
their features gives weights, and a document's strength is its weighted features. The threshold is a quantile of the
training strengths: the one at which fewest training labels are wrong. Strengths are mapped to 0..1 so that the
threshold lies at ``CUT``.

Features come from the text alone (sizes, kinds of characters, repetition), one pass over whole texts. The fit uses at
most ``sample_rows`` labelled rows of each class, those with the smallest hash of the id; all else covers all rows.

Null texts count as empty; an empty text has the features of nothing and is scored like any other. Null labels are left
out; a document labelled more than once counts once for each label row. With one class only, or no labels, every score is
0.5. Ties in strength get equal scores. Ids are hashed as decimal text; null ids are never held out. Repeated rows repeat
their score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.tokens import Words, chunks, encoded, lots

CUT = 0.3
NAMES = ("log_words", "word_size", "upper", "symbols", "marks", "digits", "other_bytes", "bars", "distinct", "same_next", "top_word", "same_lines",
         "long_words", "mark_runs", "sentence_ends", "log_line")
CHUNK = 1 << 20


def _classes() -> np.ndarray:
    """Upper-case letters, symbols, sentence marks, digits, bytes beyond ASCII, bars, line feeds: one row of 256 flags each."""
    table = np.zeros((7, 256))
    table[0, 65:91] = 1
    table[1, [ord(c) for c in "#$%&*+<=>@\\^_`{}~"]] = 1
    table[2, [ord(c) for c in "!?.,;:'\"-()[]/"]] = 1
    table[3, 48:58] = 1
    table[4, 128:] = 1
    table[5, ord("|")] = 1
    table[6, 10] = 1
    return table


_CLASSES = _classes()


def _share_of_repeats(owner: np.ndarray, hashes: np.ndarray, n: int, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: distinct values over all, and the share of the most frequent value."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[first], sizes)
    return np.bincount(o[first], minlength=n) / per, top / per


def features(texts: list[bytes]) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    n = len(texts)
    words = Words(texts)
    sizes = np.maximum(words.sizes, 1).astype(float)
    owner = np.repeat(np.arange(n), words.sizes + 1)
    counts = np.stack([np.bincount(owner, weights=row[words.bytes], minlength=n) for row in _CLASSES])
    shares = counts / sizes
    per = np.maximum(np.diff(words.first), 1).astype(float)
    length = words.end - words.start
    distinct, top = _share_of_repeats(words.doc, words.hash, n, per)
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    last = words.bytes[words.end - 1] if len(words.end) else np.zeros(0, dtype=np.uint8)
    before = words.bytes[np.maximum(words.end - 2, 0)] if len(words.end) else last
    mark = (_CLASSES[1] + _CLASSES[2])[last] > 0
    lines = [[hash(line) & 0x7FFFFFFFFFFFFFFF for line in t.split(b"\n") if line.strip()] for t in texts]
    held = np.array([len(x) for x in lines])
    same_lines = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    count = lambda flag: np.bincount(words.doc, weights=flag, minlength=n) / per
    return np.stack([
        np.log1p(np.diff(words.first)), np.bincount(words.doc, weights=length, minlength=n) / per, shares[0], shares[1], shares[2], shares[3], shares[4],
        shares[5], distinct, np.bincount(words.doc[1:], weights=same, minlength=n) / per if len(same) else np.zeros(n), top, same_lines,
        count(length > 20), count(mark & (last == before)), count(last == 46), np.log1p(per / np.maximum(held, 1))], axis=1)


def _spread(x: np.ndarray, model: dict) -> np.ndarray:
    """Scaled features with, for each, soft steps between its quantiles, so that the linear strength can bend."""
    z = (x - model["mean"]) / model["scale"]
    steps = [np.clip((x - a) / b, 0, 1) for a, b in zip(model["from"], model["width"])]
    return np.concatenate([np.clip(z, -4, 4), *steps], axis=1)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, rounds: int = 300, penalty: float = 1e-4) -> dict | None:
    """Weights from preference pairs; None unless both classes occur."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    edges = np.quantile(x, [0.0, 0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95, 1.0], axis=0)
    model = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-9, "from": edges[:-1], "width": np.diff(edges, axis=0) + 1e-6}
    f = _spread(x, model)
    rng = np.random.default_rng(7)
    each = max(pairs, len(good), len(bad))
    a = np.concatenate([rng.permutation(good) for _ in range(-(-each // len(good)))])[:each]
    b = np.concatenate([rng.permutation(bad) for _ in range(-(-each // len(bad)))])[:each]
    w = np.zeros(f.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    size = 8192
    for step in range(1, rounds * max(1, each // size // 8) + 1):
        pick = rng.integers(0, each, size)
        d = f[a[pick]] - f[b[pick]]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(axis=0) + penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        rate = 0.05 if step < 400 else 0.01
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model["weights"] = w
    strength = f @ w
    order = np.argsort(strength, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(np.where(y[order] == 1, 1, -1))])  # good ones below less bad ones below
    s = strength[order]
    open_ = np.concatenate([[True], s[1:] > s[:-1], [True]])  # a cut between equals is none
    at = int(np.argmin(np.where(open_, wrong, len(y) + 1)))
    model["quantile"] = at / len(y)
    model["threshold"] = float(s[0] - 1 if at == 0 else s[-1] + 1 if at == len(s) else (s[at - 1] + s[at]) / 2)
    return model


def score(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z = np.clip(_spread(x, model) @ model["weights"] - model["threshold"], -30, 30)
    return 1 / (1 + (1 - CUT) / CUT * np.exp(-z))


def held_out(id_: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = 5_000) -> dict | None:
    """The ranking model, from at most ``sample_rows`` labelled rows of each class that are not held out."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    told = told.filter(~held_out(F.col("id")))
    picked = [told.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for v in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))  # 2 * sample_rows rows at most
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, F.col("_id") == F.col("id")).select("id", "y", "text")

    def run(batches):
        for batch in batches:
            texts = [encoded(t) for t in batch.column(2).to_pylist()]
            for part in chunks([len(t) for t in texts], CHUNK):
                x = features(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part].cast(pa.int64()), batch.column(1)[part], pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    found = rows.withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, y int, x array<double>").toPandas().sort_values(["id", "y"], kind="stable")
    # repeated document rows may bring more rows than were picked; the bound holds all the same
    found = found.groupby("y").head(sample_rows)
    if not len(found):
        return None
    return fit(np.array(found.x.tolist()), found.y.to_numpy())


def scored(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` (1 from ``CUT`` on); columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    base = docs.select(*kept)

    def run(batches):
        for part in lots(batches, text_col, CHUNK):
            found = score(features([encoded(t) for t in part.column(text_col).to_pylist()]), model)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= CUT).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, score double, predicted int")
