"""Log sources: text files or line tables in, normalized events out.

Lines are parsed in one pass, whatever their format; a file's format, header and place in the
input order come from a small per-file table. Only JSON documents are read whole, because one
document cannot be split; JSON Lines is the form that scales.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden import fixed_values as fv
from logwarden.cluster import BROADCAST_ROW_BOUND, broadcast_if_small, pin, written
from logwarden.functions import text as tx
from logwarden.schema import EVENT_COLUMNS, EVENT_SCHEMA
from logwarden.sources import digests

# ingest_seq = slot << 33 | row number within the reading task. A file owns one slot per started
# MiB, and a file split starts at least one MiB after the last, so order follows (file, offset).
_ROW_BITS = 33
_SLOT_BYTES = 1 << 20
_JSON_OPTIONS = {"allowSingleQuotes": "false"}
_FIELDS = tuple(fv.FIELD_ALIASES)


# ---- listing and reading ----------------------------------------------------


def list_sources(spark: SparkSession, paths: list[str] | str, max_file_bytes: int | None = None,
                 keep_latest_by_name: bool = False) -> DataFrame:
    """One row per file: path, name, length, ordinal, slot. Reads no file content.

    Files named in ``paths`` keep that order; others follow their path. Equally named files go by their whole path.
    ``keep_latest_by_name`` is for uploads that replace each other: of equally named files the last is kept, in the
    place of the first. ``max_file_bytes`` skips larger files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    # One entry per file, as in Spark's own file index; scans leave out empty files.
    key = lambda uri: re.sub(r"^([a-z0-9]+):/+", r"\1:/", unquote(uri))
    found = {key(r.path): (r.path, r.length) for r in listed.toLocalIterator()}
    for uri in spark.read.text(paths).inputFiles():
        found.setdefault(key(uri), (uri, 0))
    place = {p: i for i, p in reversed(list(enumerate(paths)))}

    def order(path: str) -> tuple:
        plain = re.sub(r"^[a-z0-9]+:", "", path)
        return place.get(path, place.get(plain, len(place))), path

    bases = Counter(os.path.basename(p) for p in found)
    named = lambda p: os.path.basename(p) if keep_latest_by_name or bases[os.path.basename(p)] == 1 else p
    rows = [(found[p][0], named(p), found[p][1], i) for i, p in enumerate(sorted(found, key=order), 1)]
    files = spark.createDataFrame(rows, "path string, name string, length bigint, load_order int")
    if max_file_bytes is not None:
        files = files.where(F.col("length") <= max_file_bytes)
    files = latest_by_name(files) if keep_latest_by_name else files.withColumn("ordinal", F.col("load_order"))
    slots = F.floor(F.col("length") / _SLOT_BYTES) + 1
    before = F.sum(slots).over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))  # over files, not their rows
    return pin(files.select("path", "name", "length", "ordinal", F.coalesce(before, F.lit(0)).cast("bigint").alias("slot")))


def latest_by_name(files: DataFrame) -> DataFrame:
    """Of equally named sources the last loaded, placed where the first one stood."""
    by_name = Window.partitionBy("name")
    return (
        files.withColumn("ordinal", F.min("load_order").over(by_name))
        .withColumn("newest", F.row_number().over(by_name.orderBy(F.desc("load_order"))))
        .where(F.col("newest") == 1).drop("newest")
    )


def read_lines(spark: SparkSession, files: DataFrame, paths: list[str] | str) -> DataFrame:
    """file, ingest_seq, value for every line of the listed files; splits are read in parallel."""
    for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        # Splits are at least the smaller of the two; shorter ones would share a slot.
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) < _SLOT_BYTES:
            raise ValueError(f"{setting} must be at least {_SLOT_BYTES} bytes to keep the order of lines")
    row_mask = (1 << _ROW_BITS) - 1
    read = spark.read.text(paths if isinstance(paths, list) else [paths]).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.floor(F.col("_metadata.file_block_start") / _SLOT_BYTES).alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(row_mask)).alias("row"))
    known = files.select("path", F.col("name").alias("file"), "slot")
    return read.join(broadcast_if_small(known), "path").select(
        "file", F.shiftleft(F.col("slot") + F.col("block"), _ROW_BITS).bitwiseOR(F.col("row")).alias("ingest_seq"), "value")


def read_documents(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """file, ingest_seq, text of whole documents. One document is one row (2 GB at most)."""
    if not paths:
        return spark.createDataFrame([], "file string, ingest_seq bigint, text string")
    read = spark.read.text(paths, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    known = files.select("path", F.col("name").alias("file"), F.shiftleft("slot", _ROW_BITS).alias("ingest_seq"))
    return read.join(broadcast_if_small(known), "path").select("file", "ingest_seq", "text")


# ---- format of a file -------------------------------------------------------


def csv_cells(line: Column) -> Column:
    """Trimmed cells of one CSV row; quotes may hold commas and doubled quotes."""
    cell = r',((?:[^",]++|"(?:[^"]++|"")*+(?:"|$))*+)'
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(cell), F.lit(1))
    unquote = lambda c: F.replace(
        F.regexp_replace(c, r'"((?:[^"]++|"")*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: tx.strip(unquote(c)))


def _is_json_value_but_no_record(text: Column) -> Column:
    scalar = r'^(true|false|null|-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|"([^"\\]|\\.)*+")$'
    array = text.startswith("[") & text.endswith("]") & F.from_json(text, "array<string>", _JSON_OPTIONS).isNotNull()
    return text.rlike(scalar) | F.coalesce(array, F.lit(False))


def _record_map(text: Column) -> Column:
    whole = text.startswith("{") & text.endswith("}")
    return F.when(whole, F.from_json(text, "map<string,string>", _JSON_OPTIONS))


def sniff(lines: DataFrame) -> DataFrame:
    """Per file: first and last text, first line, header, and line counts.

    Two passes. The first keeps numbers only, so a file holding most rows costs no more than others and no line is sorted;
    the second fetches the three lines that they point to.
    """
    t = tx.strip(F.col("value"))
    seq, shown = F.col("ingest_seq"), F.when(F.length(t) > 0, F.col("ingest_seq"))
    full = F.length(t) > 0
    jsonl = full & ~t.startswith("//") & ~_is_json_value_but_no_record(t)
    counted = lines.groupBy("file").agg(
        F.min(seq).alias("_first"), F.min(shown).alias("header_seq"), F.max(shown).alias("_last"),
        F.count_if(full & ~t.rlike('^("")$')).alias("n_lines"),
        F.count_if(jsonl).alias("n_jsonl"),
    )
    counted = written(counted, "sniffed-numbers")
    places = counted.select(F.col("file").alias("_of"), "_first", "header_seq", "_last")
    pointed = lines.join(broadcast_if_small(places), F.col("file").eqNullSafe(F.col("_of"))).where(
        (seq == F.col("_first")) | (seq == F.col("header_seq")) | (seq == F.col("_last")))
    # a row or three a file
    at = lambda place: F.max(F.when((seq == F.col(place)) & ((F.length(t) > 0) | F.lit(place == "_first")), F.col("value")))
    texts = pointed.groupBy("_of").agg(at("_first").alias("first_line"), at("header_seq").alias("header_line"), at("_last").alias("_last_line"))
    texts = written(texts, "sniffed-lines")
    # Written as well: the formats are read by every later pass, the text is not scanned again.
    return written(counted.join(broadcast_if_small(texts), F.col("file").eqNullSafe(F.col("_of")), "left").select(
        "file", "first_line", "header_line", F.substring(tx.strip(F.col("header_line")), 1, 1).alias("first_char"),
        F.right(tx.strip(F.col("_last_line")), F.lit(1)).alias("last_char"), "header_seq", "n_lines", "n_jsonl"), "sniffed")


def _name_ends(*suffixes: str) -> Column:
    lowered = F.lower("file")
    found = F.lit(False)
    for s in suffixes:
        found = found | lowered.endswith(s)
    return found


def may_be_json() -> Column:
    """Necessary signs of a JSON document: its name or first character, and a closing bracket."""
    closed = ((F.col("first_char") == "[") & (F.col("last_char") == "]")) | (
        (F.col("first_char") == "{") & (F.col("last_char") == "}"))
    scalar = F.col("n_lines") == 1
    return (_name_ends(".json") & (closed | scalar)) | ((F.col("first_char") == "[") & closed)


def line_formats(sniffed: DataFrame) -> DataFrame:
    """Format of every file that is no JSON document, with the CSV header as cell positions."""
    header = F.transform(csv_cells(F.col("header_line")), lambda h: F.lower(h))
    csv_looking = F.contains("first_line", F.lit(",")) & F.col("first_line").rlike(tx.pattern(fv.CSV_HEADER_PATTERN))
    fmt = (
        F.when((_name_ends(".jsonl") | (F.col("first_char") == "{")) & (F.col("n_jsonl") > 0), "jsonl")
        .when((_name_ends(".csv") | csv_looking) & (F.col("n_lines") >= 2), "csv")
        .otherwise("log")
    )

    def positions(aliases: tuple[str, ...]) -> Column:
        # A repeated header name means its last column.
        last = lambda a: F.size("header") + 1 - F.array_position(F.reverse("header"), F.lit(a))
        return F.filter(F.array(*[F.when(F.array_contains("header", a), last(a)) for a in aliases]), lambda i: i.isNotNull())

    return sniffed.select("*", fmt.alias("format"), header.alias("header")).select(
        "file", "format", "header_seq", *[positions(fv.FIELD_ALIASES[f]).cast("array<int>").alias(f"at_{f}") for f in _FIELDS])


# ---- parsing ----------------------------------------------------------------


def parse_lines(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Events of JSON Lines, CSV and plain log lines in one pass over ``lines``.

    ``kept_row`` numbers what a task keeps, without gaps: its splits one after another, each in line order.
    """
    joined = lines.join(broadcast_if_small(formats), "file")
    trimmed = tx.strip(F.col("value"))
    fmt = F.col("format")
    kept = joined.withColumn("trimmed", trimmed).where(
        (F.length("trimmed") > 0)
        & F.when(fmt == "csv", (F.col("ingest_seq") > F.col("header_seq")) & ~F.col("trimmed").rlike('^("")$'))
        .when(fmt == "jsonl", ~F.col("trimmed").startswith("//") & ~_is_json_value_but_no_record(F.col("trimmed")))
        .otherwise(~F.col("trimmed").startswith("#"))
    )
    row_mask = (1 << _ROW_BITS) - 1
    split = kept.select(
        "*", F.monotonically_increasing_id().bitwiseAND(F.lit(row_mask)).alias("kept_row"), F.when(fmt == "csv", csv_cells(F.col("value"))).alias("cells"),
        F.when(fmt == "jsonl", _record_map(F.col("trimmed"))).alias("fields"))
    cell = lambda f: F.get(F.filter(
        F.transform(f"at_{f}", lambda i: F.try_element_at("cells", i)), lambda c: F.length(c) > 0), F.lit(0))
    compact = F.get(F.from_json(F.concat(F.lit("["), F.col("trimmed"), F.lit("]")), "array<string>"), F.lit(0))
    return normalize(split.select(
        "file", "ingest_seq", "kept_row", ((fmt == "csv") | F.col("fields").isNotNull()).alias("is_record"),
        F.when(fmt == "csv", F.col("value")).when(F.col("fields").isNotNull(), compact)
        .otherwise(F.col("trimmed")).alias("raw"),
        *[F.coalesce(cell(f), tx.pick(F.col("fields"), fv.FIELD_ALIASES[f])).alias(f"given_{f}") for f in _FIELDS],
    ), "kept_row")


def document_records(documents: DataFrame) -> DataFrame:
    """file, ingest_seq, records: the record texts of each JSON document, null when it does not parse."""
    text = tx.strip(F.col("text"))
    is_array = text.startswith("[") & text.endswith("]")
    is_object = text.startswith("{") & text.endswith("}")
    value = lambda k: F.try_element_at("object", F.lit(k))
    wrapped = F.coalesce(*[F.when(value(k).startswith("["), value(k)) for k in fv.JSON_WRAPPER_KEYS])
    as_list = (
        F.when(is_array, text)
        .when(F.col("object").isNotNull(), F.coalesce(wrapped, F.concat(F.lit("["), text, F.lit("]"))))
        .when(_is_json_value_but_no_record(text), F.lit("[]"))
    )
    opened = tx.once(documents, object=F.when(is_object, F.from_json(text, "map<string,string>", _JSON_OPTIONS)))
    records = F.filter(F.from_json("as_list", "array<string>", _JSON_OPTIONS), lambda r: r.startswith("{"))
    return tx.once(tx.once(opened, as_list=as_list), records=records).select("file", "ingest_seq", "records")


def parse_documents(records: DataFrame) -> DataFrame:
    """Events of parsed JSON documents."""
    each = records.select("file", (F.col("ingest_seq")).alias("base"), F.posexplode("records").alias("i", "raw"))
    fields = F.from_json("raw", "map<string,string>", _JSON_OPTIONS)
    return normalize(
        each.withColumn("fields", fields).select(
            "file", F.col("base").bitwiseOR(F.col("i").cast("bigint")).alias("ingest_seq"), F.col("i").cast("bigint").alias("kept_row"),
            F.lit(True).alias("is_record"), "raw",
            *[tx.pick(F.col("fields"), fv.FIELD_ALIASES[f]).alias(f"given_{f}") for f in _FIELDS]), "kept_row")


def normalize(records: DataFrame, *keep: str) -> DataFrame:
    """Records and text lines to events: given fields first, then extraction from the raw text.

    Only source address, user, port and time of a record fall back to its text. Columns named in ``keep`` go along.
    """
    raw, is_record = F.col("raw"), F.col("is_record")
    blank = F.lit("")
    judged = F.when(is_record, F.concat(
        F.coalesce("given_action", blank), F.lit(" "), F.coalesce("given_status", blank), F.lit(" "), raw)).otherwise(raw)
    staged = records.select(
        "*", tx.classify(judged).alias("c"), tx.parse_time(F.coalesce("given_timestamp", "raw")).alias("t"),
        tx.all_ips(raw).alias("ips"))
    status = F.when(F.col("given_status").isNotNull(), tx.normalize_status(F.col("given_status"), F.col("c.status")))
    ips = F.col("ips")
    return staged.select(
        "ingest_seq", "t.ts", "t.time_label", "t.hour",
        F.coalesce("given_source_ip", tx.first_ip(raw, ips)).alias("source_ip"),
        F.when(is_record, F.col("given_dest_ip")).otherwise(tx.second_ip(raw, ips)).alias("dest_ip"),
        F.coalesce("given_user", tx.extract_user(raw)).alias("user"),
        F.when(is_record, F.col("given_host")).otherwise(tx.extract_host(raw)).alias("host"),
        F.coalesce(tx.normalize_action(F.col("given_action")), F.col("c.action")).alias("action"),
        F.coalesce(status, F.col("c.status")).alias("status"),
        F.when(F.col("given_port").isNotNull(), tx.clamp_port(F.col("given_port"))).otherwise(tx.extract_port(raw)).alias("port"),
        "raw", "file", *keep,
    )


def text_events(lines: DataFrame) -> DataFrame:
    """Events of plain log lines, without looking at formats; also usable on a stream."""
    trimmed = lines.withColumn("raw", tx.strip(F.col("value"))).where(
        (F.length("raw") > 0) & ~F.col("raw").startswith("#"))
    given = [F.lit(None).cast("string").alias(f"given_{f}") for f in _FIELDS]
    return normalize(trimmed.select("file", "ingest_seq", F.lit(False).alias("is_record"), "raw", *given))


# ---- place of an event ------------------------------------------------------

_BLOCK_BITS = 12  # slots a block


def event_index(numbered: DataFrame, gap_free: bool = True) -> DataFrame:
    """``event_index``: the 0-based place of every event over all files, in input order.

    Two levels of prefix sums over small tables: events per split, cumulated inside blocks of 4,096 slots, and per block,
    cumulated over blocks. The place inside a split is ``kept_row`` less the split's first, so no event is sorted. Where
    kept rows have gaps, events are numbered split by split.
    """
    slot = F.shiftright("ingest_seq", _ROW_BITS)
    block = F.shiftright("_slot", _BLOCK_BITS)
    splits = numbered.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n"), F.min("kept_row").alias("_first")).withColumn("_block", block)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = splits.groupBy("_block").agg(F.sum("_n").alias("_block_n"))
    over_blocks = before(Window.partitionBy(F.lit(0)).orderBy("_block"))  # a row for each 4 GiB of text
    blocks = blocks.select("_block", F.coalesce(F.sum("_block_n").over(over_blocks), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_block").orderBy("_slot"))), F.lit(0))
    places = splits.join(broadcast_if_small(blocks), "_block").select("_slot", "_first", (F.col("_base") + inside).alias("_place"))
    joined = numbered.join(broadcast_if_small(places), slot == F.col("_slot"))
    row = F.col("kept_row") - F.col("_first")
    if not gap_free:
        row = F.row_number().over(Window.partitionBy("_slot").orderBy("ingest_seq")) - 1
    return joined.withColumn("event_index", (F.col("_place") + row).cast("bigint")).drop("_slot", "_first", "_place")


# ---- whole ingest -----------------------------------------------------------


class Ingest:
    """Events and per-file formats of a set of files.

    ``formats`` (file name -> format) skips sniffing for feeds whose format is known, which
    saves one pass over the text.
    """

    def __init__(self, spark: SparkSession, paths: list[str] | str, formats: dict[str, str] | None = None,
                 max_file_bytes: int | None = None, keep_latest_by_name: bool = False):
        self.paths = [paths] if isinstance(paths, str) else list(paths)
        self.files = list_sources(spark, self.paths, max_file_bytes, keep_latest_by_name)
        lines = read_lines(spark, self.files, self.paths)
        formats = formats or {}
        known_csv = [f for f, kind in formats.items() if kind == "csv"]
        unknown = ~F.col("file").isin(*formats) | F.col("file").isin(*known_csv)
        sniffed = sniff(lines.where(unknown) if formats else lines)
        # Paths of document candidates: one string per JSON file, as in the file listing itself.
        candidates = sniffed.where(may_be_json()).join(broadcast_if_small(self.files), F.col("file") == F.col("name")).select("path")
        paths_read = [r.path for r in candidates.toLocalIterator()]
        self.line_formats = line_formats(sniffed)
        self.formats = self.line_formats.select("file", "format")
        documents = None
        if paths_read:
            records = document_records(read_documents(spark, self.files, paths_read))
            documents = written(records.where(F.col("records").isNotNull()), "documents")
            parsed = documents.select("file", F.lit("json").alias("format"))
            self.line_formats = self.line_formats.join(parsed.select("file"), "file", "left_anti")
        if formats:
            given = spark.createDataFrame(list(formats.items()), "file string, given_format string")
            self.line_formats = (
                self.line_formats.join(F.broadcast(given), "file", "full")
                .withColumn("format", F.coalesce("given_format", "format")).drop("given_format"))
        self.line_formats = written(self.line_formats, "formats")
        self.formats = self.line_formats.select("file", "format")
        self.numbered = parse_lines(lines, self.line_formats).select(*EVENT_COLUMNS, "kept_row")
        if documents is not None:
            self.formats = self.formats.unionByName(parsed)
            self.numbered = self.numbered.unionByName(parse_documents(documents).select(*EVENT_COLUMNS, "kept_row"))
        self.events = self.numbered.select(*EVENT_COLUMNS)

    def stored(self, path: str | None = None) -> DataFrame:
        """Events written once as Parquet (in the shared folder unless ``path`` is given) and read back, with ``event_index``.

        Analyses read the events several times; storing them spares parsing the text each time.
        """
        if path is None:
            stored = written(self.numbered, "events")
        else:
            self.numbered.write.parquet(path)
            stored = self.numbered.sparkSession.read.parquet(path)
        # beyond the bound, formats are joined by a shuffle, and kept rows are no longer numbered split by split
        gap_free = self.line_formats.limit(BROADCAST_ROW_BOUND + 1).count() <= BROADCAST_ROW_BOUND
        return event_index(stored, gap_free).drop("kept_row")

    def summary(self, events: DataFrame | None = None) -> DataFrame:
        """Format and event count per file; a file without events counts 0, an unlisted format is log.

        Stored ``events`` spare parsing the text for the counts.
        """
        counted = (self.events if events is None else events).groupBy("file").agg(F.count("*").alias("n_events"))
        return (
            self.files.select(F.col("name").alias("file"), "ordinal")
            .join(self.formats, "file", "left").join(counted, "file", "left")
            .select("file", F.coalesce("format", F.lit("log")).alias("format"),
                    F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events"), "ordinal")
        )

    def evidence_files(self, spark: SparkSession, names: DataFrame | None = None, whole_bytes: int = digests.WHOLE_BYTES) -> DataFrame:
        """name, hash, ordinal for evidence links: short SHA-256 of each file's bytes, whatever its size.

        With ``names`` (a column ``file``; bounded, as the samples of incidents are) only those files are read, and the first
        one, which stands in where no file contributes.
        """
        shown = self.files
        if names is not None:
            wanted = names.select(F.col("file").alias("name")).distinct()
            first = self.files.orderBy("ordinal").limit(1).select("name")
            shown = shown.join(F.broadcast(wanted.union(first).distinct()), "name", "left_semi")
        found = digests.file_digests(spark, [(r.path, r.length) for r in shown.select("path", "length").toLocalIterator()], whole_bytes)
        short = found.select("path", tx.shortened(F.col("sha256")).alias("hash"))
        return self.files.join(short, "path").select("name", "hash", F.col("ordinal").cast("bigint").alias("ordinal"))

    def evidence_of(self, names: DataFrame) -> DataFrame:
        """``evidence_files`` of the files that are shown; given to ``Analysis`` as ``files``."""
        return self.evidence_files(self.files.sparkSession, names)


def parse_files(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    return Ingest(spark, paths, **options).events


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)
