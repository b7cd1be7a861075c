"""The registered queries of this subpackage, one for each operator, and their checking SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.cluster import broadcast_if_small, work_path
from logwarden.llm import articles, backoff, crosswalk, forest, importance, leaks, licences, pieces, ranking, suffixes, token_counts, trigrams, warc, weighted

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back by the salvage reader."""
    path = work_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    records, _ = warc.read(spark, path)
    return records.select(warc.record_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.record_number(F.col("refers_to")).alias("refers_to"))


_DIGITS = ("array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           "CAST(1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31) AS BIGINT), 1)), '')")
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m ON p.html = m.html"""


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents in 400-byte strings that also start elsewhere, removed."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return forest.nearest(table(spark, sf_dir, "embeddings"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with a merge-type model and decoded again."""
    return pieces.encoded_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, with their alignment."""
    return leaks.alignments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by pairwise ranking."""
    docs = table(spark, sf_dir, "documents")
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    return ranking.scored(docs.select("doc_id", "text"), model).select("doc_id", ranking.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram stupid-backoff score of every document under the whole corpus."""
    return backoff.scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\v\f\r ]+'), lambda x: x <> '') AS words FROM documents),
r AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM t),
b AS (SELECT doc_id, CASE WHEN i = 1 THEN '' ELSE words[i - 1] END AS v, words[i] AS w FROM r),
c1 AS (SELECT w, count(*) AS c FROM b GROUP BY w),
cv AS (SELECT v, count(*) AS c FROM b WHERE v = '' GROUP BY v UNION ALL SELECT w, c FROM c1),
c2 AS (SELECT v, w, count(*) AS c FROM b GROUP BY v, w),
n AS (SELECT count(*) AS n FROM b),
s AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN c2.c >= 2 THEN ln(c2.c) - ln(cv.c) ELSE ln(0.4 / n.n) + ln(c1.c) END) AS score
      FROM b JOIN c2 USING (v, w) JOIN cv ON cv.v = b.v JOIN c1 ON c1.w = b.w CROSS JOIN n GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(score, 0), 4) AS score, round(score / n_words, 6) AS mean_score
FROM documents LEFT JOIN s USING (doc_id)"""


def op7_trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document under the whole corpus, with every count."""
    return trigrams.scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


#: Every trigram of a document occurs in the corpus, so none steps back.
OP7_TRIGRAM_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\v\f\r ]+'), lambda x: x <> '') AS words FROM documents),
r AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM t),
b AS (SELECT doc_id, CASE WHEN i <= 2 THEN '' ELSE words[i - 2] END AS u, CASE WHEN i = 1 THEN '' ELSE words[i - 1] END AS v, words[i] AS w FROM r),
c3 AS (SELECT u, v, w, count(*) AS c FROM b GROUP BY u, v, w),
c2 AS (SELECT v AS u, w AS v, count(*) AS c FROM b GROUP BY v, w UNION ALL SELECT '', '', count(*) FROM b WHERE v = ''),
s AS (SELECT doc_id, count(*) AS n_words, sum(ln(c3.c) - ln(c2.c)) AS score FROM b JOIN c3 USING (u, v, w) JOIN c2 ON c2.u = b.u AND c2.v = b.v GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(score, 0), 4) AS score, round(score / n_words, 6) AS mean_score
FROM documents LEFT JOIN s USING (doc_id)"""


def op8_page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return articles.extracted(table(spark, sf_dir, "pages"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, taken as the file source/lang/doc-N.txt; the first one of a folder that holds a word of notices is its LICENSE."""
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", "lang")
    # one row a folder that has such a document
    first = docs.filter(F.col("text").rlike(f"(?i){licences.MARKERS}")).groupBy(folder.alias("_folder")).agg(F.min("doc_id").alias("_first"))
    named = docs.withColumn("_folder", folder).join(broadcast_if_small(first), "_folder", "left")
    name = F.when(F.col("doc_id") == F.col("_first"), "LICENSE").otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(named, F.concat_ws("/", "source", "lang", name))


def op10_weighted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return weighted.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op11_token_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over every document."""
    return crosswalk.aligned(table(spark, sf_dir, "documents"), BYTE_MODEL, PIECE_MODEL)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, long ones in overlapping chunks."""
    return token_counts.counted(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark."""
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) AS r(i))),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents),
x AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
d AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM w UNION SELECT f FROM x)),
k AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
        lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM d, crc_table),
s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM x JOIN k USING (f) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::BIGINT AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::BIGINT AS big_t),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (big_s + 10000))::DOUBLE / ((s + 1) * (big_t + 10000))::DOUBLE)) AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket) CROSS JOIN z),
m AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM w JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
v AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
      FROM documents LEFT JOIN m USING (doc_id)),
u AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM u WHERE n_features >= 20)
SELECT u.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM u LEFT JOIN r ON u.doc_id = r.doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_salvage, op2_repeated_bytes, op3_nearest_vectors, op4_piece_codec, op5_benchmark_leaks,
                         op6_quality_ranking, op7_backoff_scores, op8_page_articles, op9_licence_scan, op10_weighted_copies)}
#: Operators 11 to 13, and second queries of an operator, beside the one that its SQL holds to a smaller job.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op7_trigram_scores, op11_token_crosswalk, op12_token_counts, op13_importance_draw)}
SQL = {"op1_warc_salvage": OP1_SQL, "op7_backoff_scores": OP7_SQL, "op7_trigram_scores": OP7_TRIGRAM_SQL, "op13_importance_draw": OP13_SQL}
