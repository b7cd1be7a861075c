"""Small checks of the corpus operators: brute force, round trips, and odd input (nulls, empty and long texts, repeats)."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import articles, backoff, forest, leaks, licences, pieces, queries, ranking, suffixes, trigrams, warc, weighted

R = random.Random(3)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def frame(spark, texts):
    """Documents with a clashing extra column; ids from 0."""
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")


SHARED = prose(70)
ODD = [None, "", " ", "\n", "a", SHARED, SHARED, prose(40) + " " + SHARED + " " + prose(40), prose(2000), "é" * 50 + SHARED, SHARED + " tail", "the the the " * 60]


def test_archives_round_trip_and_salvage(spark, tmp_path):
    rows = [(1, "http://a/\r\nb", "<p>é</p>", 1), (2, None, "<p>é</p>", 1), (3, "u", None, 1), (4, "u", "", 1), (None, "u", "WARC/1.0\r\n inside", 1), (5, "u", "x" * 200000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write(pages, f"{tmp_path}/a")
    records, gaps = warc.read(spark, f"{tmp_path}/a")
    got = {r.record_id: r for r in records.collect()}
    assert gaps.count() == 0 and len(got) == 6
    assert got["<urn:record:1>"].record_type == "revisit" and got["<urn:record:1>"].refers_to == "<urn:record:2>" and got["<urn:record:1>"].payload_bytes == 9
    assert got["<urn:record:3>"].refers_to == "<urn:record:4>" and got["<urn:record:>"].payload == b"WARC/1.0\r\n inside"
    warc.write(pages.limit(0), f"{tmp_path}/none")
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*")))
    whole, none = warc.salvage(plain)
    assert len(whole) == 6 and not none
    second = whole[1].offset
    hurt = plain[: second + 40] + b"\0\0\0" + plain[second + 43 :]
    left, lost = warc.salvage(hurt)
    assert len(left) == 5 and lost == [(second, whole[2].offset - second)]
    left, lost = warc.salvage(b"junk" + plain[:-30])
    assert len(left) == 5 and lost[0] == (0, 4) and len(lost) == 2
    edges = [r.offset for r in whole] + [len(plain)]
    members = [gzip.compress(plain[a:b]) for a, b in zip(edges, edges[1:])]
    bad = bytearray(members[2])
    bad[len(bad) // 2] ^= 255
    packed = b"".join([*members[:2], bytes(bad), *members[3:]])
    left, lost = warc.salvage(packed)
    assert [r.record_id for r in left] == [r.record_id for i, r in enumerate(whole) if i != 2]
    assert lost == [(len(members[0]) + len(members[1]), len(bad))]


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_bytes(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    texts = [*ODD, *[prose(30) + SHARED[:200] + prose(30) for _ in range(6)]]
    got = suffixes.digests(frame(spark, texts), window=60).orderBy("doc_id").collect()
    want = suffixes.brute_force([(t or "").encode() for t in texts], 60)
    assert [tuple(r)[1:] for r in got] == want
    assert suffixes.digests(frame(spark, texts).limit(0), window=60).count() == 0


def test_repeated_words_and_repeated_rows(spark):
    docs = frame(spark, ["one " + SHARED + " two", "x " + SHARED + " y", prose(80)])
    got = {r.doc_id: r.text.decode() for r in suffixes.without_repeats(docs, window=50, tokens="words").collect()}
    assert got[0].split() == ["one", "two"] and got[1].split() == ["x", "y"] and len(got[2].split()) == 80
    twice = docs.filter("doc_id = 2").union(docs.filter("doc_id = 2"))
    assert [r.text for r in suffixes.without_repeats(twice, window=50, tokens="words").collect()] == [b"", b""]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8))
    x[100:200] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (None, [1.0] * 8), (2080, [1.0] * 3)]
    rows.append(rows[5])
    got = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=32).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        mine = got[got.query_id == q].sort_values("rank")
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(600), -score))[:20]
        hits += len(set(order) & set(mine.vec_id))
        assert len(mine) == 20 and list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine.score, score[mine.vec_id])
    assert hits / 600 >= 0.9 and set(got.query_id) == set(range(0, 600, 20))
    assert forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_search_of_a_block_is_bounded_in_memory():
    """Every query in every leaf: equal to brute force, ties included, without a row of numbers for each pair found."""
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x[1500:1540] = x[1500]
    entry, leaf, q = np.arange(2000) * 3, np.arange(2000) % 40, rng.standard_normal((300, 64))
    x, entry, leaf = np.concatenate([x, x]), np.concatenate([entry, entry]), np.concatenate([leaf, 40 + leaf])  # two trees
    owner, probed = np.repeat(np.arange(300), 80), np.tile(np.arange(80), 300)
    exact = np.stack([(q * v).sum(axis=1) for v in x[:2000]], axis=1)
    for least in (np.full(300, -np.inf), np.sort(exact, axis=1)[:, -5]):
        tracemalloc.start()
        who, found, value = forest._searched(x, entry, leaf, q, least, owner, probed, 20)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100_000_000
        for i in range(300):
            order = [j for j in np.lexsort((np.arange(2000), -exact[i]))[:26] if exact[i, j] >= least[i]]
            assert found[who == i].tolist() == [3 * j for j in order]
            assert value[who == i].tolist() == exact[i, order].tolist()


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, other = pieces.Pieces(pieces.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    fuzz = ["".join(R.choice(" \n\tab.ethé▁日<s>x0\U0001f600ß" + " " * 5) for _ in range(R.randint(0, 60))) for _ in range(1500)]
    for text in [t for t in ODD if t is not None] + fuzz + [" " * n for n in range(50)] + ["e" * 2000]:
        ids = other.encode(text)
        assert own.encode(text) == ids and own.decode([*ids, 2]) == other.decode([*ids, 2])
        spelled = other.decode([*ids, 2])
        assert own.digests(text) == (len(ids) + 1, hashlib.sha256(" ".join(map(str, [*ids, 2])).encode()).hexdigest(), hashlib.sha256(spelled.encode()).hexdigest())
    rows = pieces.encoded(frame(spark, ODD), path).orderBy("doc_id").collect()
    assert rows[0].ids == [2] and rows[0].decoded == "" and [r.decoded for r in rows[3:]] == ODD[3:]
    assert pieces.encoded_digests(frame(spark, []), path).count() == 0


def test_piece_rows_leave_in_lots(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*ODD, None, "", *(prose(20) for _ in range(30)), "wort " * 3000, "", None]
    whole = pieces.encoded(frame(spark, texts), path).orderBy("doc_id").collect()
    monkeypatch.setattr(pieces, "LOT_BYTES", 50)
    assert pieces.encoded(frame(spark, texts), path).orderBy("doc_id").collect() == whole and len(whole) == len(texts)
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    assert all(r.ids == [*other.encode(t or ""), 2] for r, t in zip(whole, texts))
    assert pieces.encoded(frame(spark, []), path).count() == 0


def test_pieces_of_a_task_are_forgotten():
    own = pieces.Pieces(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([prose(40, random.Random(1)), None])], names=["id", "text"])
    assert sum(part.num_rows for part in pieces._encoded([batch], own, 1 << 20)) == 2
    assert not any((*own.tables, *own.older))
    assert own.encode("ab\ncd ef") == pieces.Pieces(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))).encode("ab\ncd ef")


def test_leaks_copied_edited_clean(spark):
    r = random.Random(9)
    item = prose(40, r).split()
    edited = [w if i % 6 else "zz" for i, w in enumerate(item)]
    texts = [prose(100, r) + " " + " ".join(item) + ". " + prose(50, r), prose(60, r) + " " + " ".join(edited).upper() + " end", prose(300, r), None, "", " ".join(item[:8])]
    items = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "", 1), (10, "solo word", 1)], "item_id long, text string, score int")
    got = {(r_.doc_id, r_.item_id): r_.score for r_ in leaks.alignments(frame(spark, texts), items).collect()}
    assert set(got) == {(0, 7), (1, 7)} and got[0, 7] == 1.0 and 0.5 <= got[1, 7] < 1
    assert leaks.alignments(frame(spark, texts), items, block_words=5).count() == 2
    assert leaks.alignments(frame(spark, texts), items.limit(0)).count() == 0 and leaks.alignments(frame(spark, []), items).count() == 0


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(row) for row in h)


def test_alignment_scores():
    for _ in range(100):
        a, b = (np.array([R.randrange(5) for _ in range(R.randint(1, 15))]) for _ in range(2))
        score, begin, end = leaks.align(a, b)
        assert score == slow_align(a, b) == slow_align(a, b[begin:end])


def test_quality_ranking(spark):
    good = [prose(60) + "." for _ in range(60)]
    bad = [" ".join(w + "%%%" for w in prose(60).split()) for _ in range(60)]
    docs = frame(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = ranking.train(docs, labels)
    got = ranking.scored(docs, model).withColumn("held", ranking.held_out(F.col("doc_id"))).toPandas()
    held = got[got.held & (got.doc_id < 120)]
    assert len(held) and (held.predicted == (held.doc_id < 60)).all() and got.score.between(0, 1).all() and len(got) == 122
    assert ranking.train(docs, labels.limit(0)) is None and set(ranking.scored(docs, None).toPandas().score) == {0.5}


def test_backoff_by_hand(spark):
    got = {r.doc_id: r for r in backoff.scores(frame(spark, ["a b", "a b", "a c", None, ""])).collect()}
    # begin mark 3 times, a 3, b 2, c 1, 6 words; pairs (begin a) 3, (a b) 2, (a c) 1
    assert np.isclose(got[0].score, np.log(3 / 3) + np.log(2 / 3)) and np.isclose(got[2].score, np.log(0.4 * 1 / 6))
    assert got[3].n_words == 0 and got[3].score == 0 and got[3].mean_score is None and len(got) == 5
    assert backoff.scores(frame(spark, [])).count() == 0
    rare = {r.doc_id: r for r in backoff.scores(frame(spark, ["a b", "a b", "a c", None, ""]), common=0.5).collect()}
    assert all(np.isclose(rare[i].score, got[i].score) for i in got)


@pytest.mark.parametrize("common, hot", [(1e-6, 1e-3), (0.02, 0.05), (0.5, 0.6)])
def test_backoff_of_rare_and_hot_words(spark, monkeypatch, common, hot):
    """Every split into rare, frequent and hot words gives the plain definition; equal and null ids are one document."""
    monkeypatch.setattr(backoff, "LEAST_BUCKETS", 8)
    r = random.Random(11)
    texts = [" ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 60))) for _ in range(60)]
    ids = [None, None, 5, 5, -7, *range(100, 155)]
    pairs = [[(v, w) for v, w in zip(["", *t.split()], t.split())] for t in texts]
    c2, c1 = Counter(p for x in pairs for p in x), Counter(w for x in pairs for _, w in x)
    c1[""], total = sum(1 for x in pairs if x), sum(map(len, pairs))
    want = Counter()
    for i, x in zip(ids, pairs):
        want[i] += sum(np.log(c2[p] / c1[p[0]]) if c2[p] >= 2 else np.log(0.4 * c1[p[1]] / total) for p in x)
    for cast in ("long", "string"):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(cast))
        got = backoff.scores(docs, common=common, hot=hot).collect()
        assert len(got) == 60
        for row in got:
            assert np.isclose(row.score, want[None if row.doc_id is None else int(row.doc_id)])


@pytest.mark.parametrize("least, common, hot", [(1, 1e-6, 1e-3), (1, 0.02, 0.02), (2, 0.02, 0.02), (3, 0.5, 0.6), (2, 1e-6, 1e-3)])
def test_trigram_backoff(spark, monkeypatch, least, common, hot):
    """Every count of trigrams, then pairs, then words; every split into rare and hot gives the plain definition."""
    monkeypatch.setattr(backoff, "LEAST_BUCKETS", 8)
    r = random.Random(12)
    texts = [" ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts[40:44] = ["w1 w1 w1", "w1", None, "w1 w1"]
    ids = [None, None, 5, 5, -7, *range(100, 155)]
    triples = [[*zip(["", "", *x], ["", *x], x)] for x in ((t or "").split() for t in texts)]
    c3, c2 = Counter(p for x in triples for p in x), Counter(p[1:] for x in triples for p in x)
    c1, total = Counter(w for x in triples for _, _, w in x), sum(map(len, triples))
    c1[""] = c2["", ""] = sum(1 for x in triples if x)
    want = Counter()
    for i, x in zip(ids, triples):
        want[i] += sum(np.log(c3[u, v, w] / c2[u, v]) if c3[u, v, w] >= least else np.log(0.4 * c2[v, w] / c1[v]) if c2[v, w] >= least
                       else np.log(0.16 * c1[w] / total) for u, v, w in x)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = trigrams.scores(docs, least=least, common=common, hot=hot).collect()
    assert len(got) == 60
    for row in got:
        assert np.isclose(row.score, want[row.doc_id])
    assert trigrams.scores(frame(spark, [])).count() == 0


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, ok.</div><div id=wrap><article><h1>Head &amp; line</h1><p>First, with <b>bold<br>words.<p>Second &eacute; para,
graph.<div class="ad">Buy, now, please</div><form>Name <input></form><ul><li>one<li>two</ul></article><aside>Other, things</aside>
<section class="comments"><p>Nice, post, really, very long comment text, with commas, and more commas, here.</p></section></div><footer>End</footer>"""


def test_main_text(spark):
    assert articles.main_text(PAGE) == "Head & line\nFirst, with bold words.\nSecond é para, graph.\none\ntwo"
    plain = "<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div class=story><p>One, two, three and so on.</p><p>Short.</p></div><div class=sidebar>x, y, z</div>"
    assert articles.main_text(plain) == "One, two, three and so on.\nShort."
    assert articles.main_text(None) == "" and articles.main_text("just text") == "just text" and articles.main_text("<<<>") is not None
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "<p" * 5000, 0)], "page_id long, url string, html string, text int")
    rows = articles.extracted(pages).orderBy("page_id").collect()
    assert rows[0].n_chars == len(rows[0].text) and rows[1].text == ""


def test_licences(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.c", "int x;"), (3, "a/b/y.c", "code\nLicensed under the Apache License, Version 2.0.\ncode"),
             (4, "z.c", None), (5, None, "This work is licensed under the GNU General Public License, version 3."), (6, "c/x.c", "a licence is not a template here, only prose")]
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame([*files, files[1]], "doc_id long, path string, text string"), F.col("path")).collect()}
    assert (rows[1].licence, rows[1].origin) == ("MIT", "header") and (rows[2].licence, rows[2].origin, rows[2].from_dir) == ("MIT", "inherited", "a")
    assert rows[3].licence == "Apache-2.0" and rows[4].origin == "none" and rows[5].licence == "GPL-3.0" and rows[6].licence is None
    assert licences.scan(spark.createDataFrame([], "doc_id long, path string, text string"), F.col("path")).count() == 0


def test_licences_work_out_windows_once(spark):
    """Windows are cut in one job, and their terms are weighed where the window is: no term goes through a shuffle."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b.py", "x = 1")], "doc_id long, path string, text string")
    found = licences.scan(files, F.col("path"))
    assert "posexplode" not in plan(found) and sorted((r.doc_id, r.licence, r.origin) for r in found.collect()) == [(1, "MIT", "header"), (2, "MIT", "inherited")]
    rows = files.select("doc_id", licences.terms(F.col("text")).alias("terms"))
    told = licences.similar(rows, ["doc_id"], licences.templates(spark), 0.75)
    assert [tuple(r) for r in told.collect()] == [(1, "MIT", 1.0)] and "hashpartitioning(doc_id" in plan(told)
    assert not [line for line in plan(told).splitlines() if "hashpartitioning(doc_id" in line and "term" in line.split("hashpartitioning(doc_id")[1].split("),")[0]]


def test_wrapped_notices_and_full_texts(spark):
    """Notices over several lines, in comments, inside one long line, and heads of full licence texts."""
    bsd = "Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions\n// are met:\n"
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
           "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n")
    head = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla\n * Public License, v. 2.0. If a copy of the MPL was not distributed */\n"
    asf = ("/* Licensed to the Apache Software Foundation (ASF) under one\n * or more contributor license agreements.  See the NOTICE file\n"
           " * distributed with this work for additional information\n * regarding copyright ownership. */\n")
    long = f"{prose(40)} Licensed under the Apache License, Version 2.0. {prose(40)}"
    texts = [f"{prose(30)}\n// {bsd}{prose(30)}", gpl + prose(30), head + prose(300), mpl + prose(9), asf + "int x;", long, prose(200)]
    files = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in licences.scan(files, F.col("path")).collect()}
    assert got == {0: "BSD-3-Clause", 1: "GPL-3.0", 2: "GPL-3.0", 3: "MPL-2.0", 4: "Apache-2.0", 5: "Apache-2.0", 6: None}


def test_licence_query_inherits(spark, tmp_path):
    texts = [(1, "s", "en", "plain"), (2, "s", "en", "Released under the MIT License."), (3, "s", "en", "Licensed under the Apache License, Version 2.0."),
             (4, "s", "de", "plain"), (5, None, "en", None)]
    spark.createDataFrame(texts, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_licence_scan(spark, str(tmp_path)).collect()}
    assert (got[1].licence, got[1].origin, got[1].from_dir) == ("MIT", "inherited", "s/en")
    assert got[2].path == "s/en/LICENSE" and got[3].path == "s/en/doc-3.txt" and (got[3].licence, got[3].origin) == ("Apache-2.0", "header")
    assert len(got) == 5 and got[4].origin == got[5].origin == "none"


def test_weighted_copies(spark):
    base = prose(200).split()
    near = [w if i != 100 else "zz" for i, w in enumerate(base)]
    texts = [" ".join(base), " ".join(near), " ".join(base), prose(200), "  ".join(base), None, "", "a b", "a  b", *[prose(50) for _ in range(5)]]
    got = {r.doc_id: r.class_id for r in weighted.classes(frame(spark, texts)).collect()}
    assert {got[i] for i in (0, 1, 2, 4)} == {0} and got[3] == 3 and got[5] == got[6] == 5 and got[7] == got[8] == 7
    assert all(got[i] == i for i in range(9, 14)) and weighted.classes(frame(spark, [])).count() == 0


def test_frequent_shingles_are_told_without_the_rare_ones_of_a_short_rest(monkeypatch):
    """A task whose summary overflows again and again tells every shingle of the wanted share, and few others."""
    monkeypatch.setattr(weighted, "COUNTED", 400)
    monkeypatch.setattr(weighted, "CHUNK", 2000)
    texts = [f"a{i} b{i} c{i} d{i} e{i}" if i % 9 else f"same five words stand here{i // 9 % 20 * (i % 2)}" for i in range(2005)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 300])], names=["text"]) for i in range(0, 2005, 300)]
    counts = Counter(int(h) for t in texts for h in weighted.shingles([t.encode()], 5)[1].view(np.int64))
    told = Counter()
    rows = 0
    for batch in weighted._chunk_counts(iter(batches), 5, 0.004, None):
        told.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        rows += batch.num_rows
    assert {h for h, n in counts.items() if n >= 0.004 * 2005} <= set(told) and rows < 60
    wanted = np.sort(np.array([h for h, n in counts.items() if n > 1][:10] + [5], dtype=np.int64).view(np.uint64))
    got = Counter()
    for batch in weighted._chunk_counts(iter(batches), 5, 0.004, wanted):
        got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    assert got == {int(h): counts[int(h)] for h in wanted.view(np.int64) if counts[int(h)]}
    every = Counter()
    for batch in weighted._chunk_counts(iter(batches), 5, 0.0, None):
        every.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    assert every == counts


@pytest.mark.parametrize("group", [7, 256])
def test_open_pairs_of_weighted_copies_lose_no_link(spark, monkeypatch, group):
    """One bucket of many edited copies, cut into one or several blocks: every linked pair stays, and few others do."""
    monkeypatch.setattr(weighted, "GROUP", group)
    monkeypatch.setattr(weighted, "DEAL_ROWS", 50)
    r = random.Random(21)
    base = prose(120, r).split()
    texts = [" ".join("".join(r.choice("xyz") for _ in range(9)) if i in spots else w for i, w in enumerate(base))
             for spots in (set(r.sample(range(120), r.randint(1, 6))) for _ in range(40))]
    light = weighted.Weights(np.zeros(0, dtype=np.uint64), np.zeros(0), 1000, 0.001)
    sets = [weighted.weighted_set(t.encode(), light, 5) for t in texts]
    links = {(i, j) for i in range(40) for j in range(i) if weighted.similarity(sets[i], sets[j]) >= 0.8}
    keys = [hashlib.md5(t.encode()).digest() for t in texts]
    place = {k: i for i, k in enumerate(keys)}
    rows = [(0, 5, k, 1 - weighted.similarity(sets[0], s), k) for k, s in zip(keys, sets)]
    open_ = spark.createDataFrame(rows, "band int, bucket long, key binary, far double, label binary").dropDuplicates(["key"])
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, keys))], "_id long, text string, _key binary")
    sent = spark.sparkContext.broadcast(light)
    shared = weighted._shareable(open_.select("key"), docs, docs.groupBy(F.col("_key").alias("key")).agg(F.min("_id").alias("one")), sent, 5)
    got = weighted._open_pairs(open_.join(shared, "key"), 0.8).collect()
    found = {tuple(sorted((place[bytes(x.pivot)], place[bytes(x.key)]), reverse=True)) for x in got}
    assert len(found) == len(got)
    assert links and links <= found
    assert len(found) < 2 * len(links), (len(found), len(links))


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(5)
    item, shared, near = prose(30, r), prose(60, r), prose(150, r)
    good = [prose(60, r) + "." for _ in range(30)]
    texts = [*good, *[" ".join(w + "%%%" for w in prose(60, r).split()) for _ in range(30)], near + ".", near + " end.", prose(80, r) + " " + shared + " " + prose(80, r) + ".",
             prose(90, r) + " " + shared + " " + prose(90, r) + ".", prose(60, r) + " " + item + " " + prose(60, r) + ".", prose(50, r) + ".", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {x.doc_id: x.decoded for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) - {66} == {*range(30), 60, 62, 63, 65} and shared not in rows[62] and shared not in rows[63] and rows[0] == good[0]


def test_stages_carry_texts_once(spark, monkeypatch):
    given = []
    for module, name in ((ranking, "scored"), (suffixes, "without_repeats")):
        def seen(df, *args, real=getattr(module, name), **more):
            given.append(df.schema.simpleString().count("text:string"))
            return real(df, *args, **more)
        monkeypatch.setattr(module, name, seen)
    r = random.Random(2)
    shared = prose(60, r)
    rows = [(4, "n", "a b c", 5), (1, "m", None, None), (2, None, prose(9, r) + " " + shared, 9), (3, "o", shared, 1), (3, "o", "", 0), (None, "p", "ä", 1)]
    docs = spark.createDataFrame([(note, i, text, n) for i, note, text, n in rows], "note string, doc_id long, text string, n_chars int")
    monkeypatch.setattr(suffixes, "LOT_BYTES", 50)
    monkeypatch.setattr(ranking, "train", lambda *_: None)  # all scores 0.5, so all rows stay
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.schema.simpleString() == docs.schema.simpleString() and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    cut = corpus_pipeline.repeats(spark, docs, "")
    first = rows[2][2][: -len(shared)]
    want = [("n", 4, "a b c", 5), ("m", 1, None, None), (None, 2, first, len(first)), ("o", 3, "", 0), ("o", 3, "", 0), ("p", None, "ä", 1)]
    assert cut.schema.simpleString() == docs.schema.simpleString() and sorted(map(str, map(tuple, cut.collect()))) == sorted(map(str, want))
    assert given == [1, 1]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
