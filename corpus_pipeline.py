"""Corpus clean-up in five stages, each written as Parquet and read again as the input of the next.

1. quality: documents that the pairwise quality ranking rejects go.
2. near_copies: of each class of near copies (five-word shingles, weighted Jaccard similarity 0.8 or more) the document with the
   smallest id stays; of repeated rows of it, one.
3. repeats: passages of 50 words that also start elsewhere in what is left are cut from the texts, every occurrence; the
   documents stay, an emptied one too.
4. leaks: documents that hold a passage of a benchmark item go.
5. pieces: the texts as token ids and decoded again.

Stages 1 to 4 return the columns of documents as they came (also further ones). Rows with a null id or text are kept
where they pass: a null text counts as empty. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.cluster import work_path
from logwarden.llm import leaks, pieces, ranking, suffixes, weighted
from logwarden.llm.queries import PIECE_MODEL, table


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text as ``row``: texts go to and from the tasks' Python once."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ranking.train(docs, table(spark, sf_dir, "labels"))
    marked = ranking.scored(_carried(docs).drop("doc_id"), model)
    return marked.filter("predicted = 1").select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = weighted.classes(docs)
    chosen = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_one"))
    chosen = chosen.select(F.col("_one.doc_id").alias("_id"), F.col("_one.key").alias("_chosen"))
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    kept = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_chosen")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_key"]).drop("_key")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(_carried(docs), window=50, tokens="words")
    text = F.col("text").cast("string")
    return cut.select(*[text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                        else F.col("row")[c].alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by id and text, as ids may be null or repeat
    keyed = docs.withColumn("_leak", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))
    hit = leaks.alignments(keyed, table(spark, sf_dir, "benchmark"), id_col="_leak").select(F.col("doc_id").alias("_hit")).distinct()
    return keyed.join(hit, F.col("_leak") == F.col("_hit"), "left_anti").drop("_leak")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, PIECE_MODEL)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("leaks", drop_leaks), ("pieces", encode)]
ORACLE_SQL = None  # fitted ranking, consistent sampling and piece codec are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
