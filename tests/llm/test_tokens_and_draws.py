"""Token crosswalk, token counts and importance draws against brute force, with odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logwarden.llm import crosswalk, importance, token_counts

R = random.Random(8)
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FUZZ = ["".join(R.choice(" \n\tab.ethéß▁日<s>x0\U0001f600 ' " + " " * 5) for _ in range(R.randint(0, 60))) for _ in range(150)]
PROSE = [" ".join("".join(R.choice("aeinrst") for _ in range(R.randint(1, 8))) for _ in range(R.randint(1, 90))) for _ in range(40)]
ODD = [None, "", " ", "  ", "\n", " a ", "a ", "a  ", "<|endoftext|> <s> </s>", "a<|endoftext|>b", "it's we'll\0x", "▁", "x ▁ y", "ﬁ Å①", "wide space　 z",
       "tie tie tie", "tie tie tie", "word " * 6000, "e" * 3000, "ab12CD_ef ÀÉ 日本"]
TEXTS = [*ODD, *PROSE, *FUZZ]


def frame(spark, texts, first=0):
    """Rows with further columns that clash with names used inside."""
    return spark.createDataFrame([(first + i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, score int")


def linked(texts):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    alphabet = crosswalk.byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def places(ids, spelled):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(spelled[i]), i))
            at += len(spelled[i])
        return out

    docs = []
    for text in texts:
        want = b" " + (text or "").encode()
        xs, ys = a.encode(want.decode(), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in xs) != want or b"".join(b_bytes[i] for i in ys) != want:
            docs.append(None)
            continue
        xs, ys = places(xs, a_bytes), places(ys, b_bytes)
        cuts, groups, links, before = sorted({x[1] for x in xs} & {y[1] for y in ys}), [], [], 0
        for cut in cuts:
            p, q = ([z for z in zs if before <= z[0] < cut] for zs in (xs, ys))
            groups.append(",".join(str(z[2]) for z in p) + "|" + ",".join(str(z[2]) for z in q))
            links += [(x[2], y[2]) for x in p for y in q if x[0] < y[1] and y[0] < x[1]]
            before = cut
        docs.append((len(xs), len(ys), groups, links))
    n, best = Counter(k for d in docs if d for k in d[3]), Counter()
    for (_, j), c in n.items():
        best[j] = max(best[j], c)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (
        d[0], d[1], len(d[2]), len(d[3]), sum(n[k] == best[k[1]] for k in d[3]), sum(n[k] for k in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


@pytest.mark.parametrize("small", [False, True])
def test_crosswalk_equals_brute_force(spark, monkeypatch, small):
    texts = [t for t in TEXTS if not small or t is None or len(t) < 400]
    if small:  # several chunks a task, a table that is emptied between them
        frame_of = frame(spark, texts).coalesce(1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    else:
        frame_of = frame(spark, texts)
    try:
        got = crosswalk.aligned(frame_of, BYTE, PIECE).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r)[1:] for r in got] == linked(texts) and [r[0] for r in got] == list(range(len(texts)))


def test_crosswalk_table_is_bounded_and_odd_ids(spark, monkeypatch):
    aligner = crosswalk.Aligner(*(open(p, "rb").read() for p in (BYTE, PIECE)))
    monkeypatch.setattr(crosswalk, "TABLE_ROWS", 3)
    one = aligner.chunk(["one two three four", "five"])
    again = aligner.chunk(["one two three four", "five"])
    assert len(aligner.texts) == 5 and one["digest"] == again["digest"] and (one["pairs"] == again["pairs"]).all()
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = crosswalk.aligned(rows, BYTE, PIECE).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in got) == [(False, 0), (True, 2), (True, 2)] and {r.count_sum for r in got} == {0, 4}
    assert crosswalk.aligned(rows.limit(0), BYTE, PIECE).count() == 0


def test_overlapping_intervals():
    group = crosswalk.groups_of(np.array([0, 2, 5, 0, 3]), np.array([2, 5, 7, 3, 7]), np.array([0, 0, 0, 1, 1]))
    assert group.tolist() == [0, 0, 0, 0, 0]
    assert crosswalk.groups_of(np.array([0, 2, 0, 2]), np.array([2, 5, 2, 5]), np.array([0, 0, 1, 1])).tolist() == [0, 1, 0, 1]
    i, j = crosswalk.overlaps(np.array([0, 2, 5]), np.array([2, 5, 7]), np.array([0, 3]), np.array([3, 7]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("path", [PIECE, BYTE])
def test_counts_equal_the_library(spark, path):
    if path == PIECE:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(library.encode(t or "")) for t in TEXTS]
    else:
        want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    for chunk, overlap in ((1 << 15, 256), (40, 6)):
        got = token_counts.counted(frame(spark, TEXTS), path, limit=500, chunk=chunk, overlap=overlap).orderBy("doc_id").collect()
        assert [(r.n_tokens, r.n_bytes, r.over_limit) for r in got] == [(n, len((t or "").encode()), n > 500) for n, t in zip(want, TEXTS)]
    assert token_counts.counted(frame(spark, []), path).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [tuple(r) for r in token_counts.counted(twice, path).collect()] == [(None, 1, 1, False)] * 2


def test_overlaps_are_widened_until_a_stable_place():
    with open(PIECE, "rb") as file:
        tokens = token_counts.PieceTokens(file.read())
    for text in ("a" * 4000, " " * 3000, "the cat " * 30 + "ab" * 900 + " sat" * 300, "ऄ" * 600):
        n, widened = token_counts.resynchronised(text, tokens.starts, tokens.stable, 64, 4)
        assert n == tokens.counts([text])[0]
        assert widened > 0 or "ऄ" in text
    calls = []
    prose = "alpha beta gamma " * 4000
    token_counts.resynchronised(prose, lambda t: calls.append(len(t)) or tokens.starts(t), tokens.stable, 1000, 50)
    assert max(calls) <= 1050 and len(calls) > 60  # memory is that of a chunk


def draws(texts, target, ids, max_words=1, buckets=10_000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def found(text):
        words = word.findall((text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]

    docs, aims = [found(t) for t in texts], [found(t) for t in target]
    s, t = Counter(b for _, d in docs for b in d), Counter(b for _, d in aims for b in d)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, (n, d) in zip(ids, docs):
        weight = sum(gain[b] for b in d) // len(d) if d else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(d), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    order = order[: 10 * len(order) // 100]
    left = Counter(r[:4] for r in order)
    ranks = {}
    for k, r in enumerate(order):
        ranks.setdefault(r[:4], []).append(k + 1)
    out = []
    for r in rows:
        out.append((*r[:4], ranks[r[:4]].pop() if left[r[:4]] and ranks[r[:4]] else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_words,buckets", [(1, 10_000), (3, 70_000), (2, 7)])
def test_draws_equal_brute_force(spark, max_words, buckets):
    texts = [*TEXTS, "A1-b2_C3 ÀÉ\x7fz " * 30, "x" * 5000 + " y", *["very hot copy of a text " * 6] * 60]
    target = [PROSE[0], PROSE[1] * 3, None, ""]
    ids = [*range(len(texts) - 40), *[9000] * 40]  # a row repeated 40 times
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, bucket string, score int").repartition(7)
    got = importance.resampled(docs, frame(spark, target), max_words=max_words, buckets=buckets)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == draws(texts, target, ids, max_words, buckets)


def test_draws_of_empty_tables_and_null_ids(spark):
    assert importance.resampled(frame(spark, []), frame(spark, ["a"])).count() == 0
    rows = spark.createDataFrame([(None, "a b c " * 20)] * 30 + [(1, None)], "doc_id long, text string")
    got = importance.resampled(rows, frame(spark, [])).collect()
    assert len(got) == 31 and sorted(r.rank for r in got if r.rank) == [1, 2, 3]


def test_crc_of_equal_lengths():
    data = bytes(R.randrange(256) for _ in range(9000))
    start = np.array([0, 5, 5, 100, 3000, 0, 17])
    size = np.array([9, 9, 0, 1, 2048, 5000, 300])
    assert importance.crcs(np.frombuffer(data, dtype=np.uint8), start, size).tolist() == [zlib.crc32(data[a : a + n]) for a, n in zip(start, size)]
