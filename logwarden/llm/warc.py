"""Web archives (WARC 1.0): a writer with revisit records, and a salvage reader that gets over damage.

Writing is Spark's text sink: a record is one string ended by two line breaks, so any file system that Spark writes
works, and a lost executor's part files are written anew. Payloads are text (UTF-8).

Reading takes whole archives as binary files, plain or with one gzip member per record, one archive per task. Each
record is checked (version line, header, length, end mark, block and payload digest). After a failed check the reader
looks for the next member or version line from there, goes on with the later records, and logs the bytes in between.
The writer starts a new archive every ``records_per_file`` records; Spark reads binary files up to 2 GB.

Null payloads are empty. A null id is written as an empty id and read as such. Rows with equal id and payload are written
each; if their id is the largest of the payload, all of them are responses. Line breaks in addresses become blanks, a null
address is left out. Extra columns are ignored. An empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.cluster import broadcast_if_small

VERSION = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
_VERSIONS = re.compile(rb"WARC/\d\.\d\r\n")
_MEMBER = b"\x1f\x8b\x08"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits (5 hex digits) are four digits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z", records_per_file: int = 10_000) -> None:
    """One record per row under ``path``, ``records_per_file`` at most in an archive. Of equal payloads of at least ``least_bytes`` the row with the largest id is the response."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.length("payload").cast("long"))
    # one row per payload that occurs more than once: counted in the map tasks first, so a hot payload sends one row from each
    whole = rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # the payloads stay where they are while the repeated digests are few; beyond that both sides are shuffled
    rows = rows.join(broadcast_if_small(whole.select("digest", "size", "first")), ["digest", "size"], "left")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string")))
    address = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1f]", " "), F.lit("\r\n"))).otherwise("")
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")),
                                      F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\n"), address, refers, F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).text(path)


class Record(NamedTuple):
    offset: int
    kind: str
    record_id: str
    url: str | None
    refers_to: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes


def _parse(data: bytes, at: int) -> tuple[Record | None, int]:
    """The record at ``at`` and the place behind it; None if a check fails."""
    version = _VERSIONS.match(data, at)
    head_end = data.find(END, at, at + 65536) if version else -1
    if head_end < 0:
        return None, at
    fields = {}
    for line in data[version.end() : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None, at
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not length.isdigit() or b"warc-type" not in fields or b"warc-record-id" not in fields:
        return None, at
    begin = head_end + 4
    end = begin + int(length)
    if data[end : end + 4] != END:
        return None, at
    block = data[begin:end]
    digest = fields.get(b"warc-block-digest")
    if digest and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:]:
        return None, at
    kind, payload, size = fields[b"warc-type"], block, None
    if fields.get(b"content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        found = re.search(rb"^content-length:\s*(\d+)\s*$", http, re.I | re.M)
        size = int(found[1]) if found else None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    told = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if not told or size is None:
            return None, at
    elif told and told != own or size is not None and size != len(payload):
        return None, at
    return Record(at, kind, fields[b"warc-record-id"], fields.get(b"warc-target-uri"), fields.get(b"warc-refers-to"),
                  size if kind == "revisit" else len(payload), told if kind == "revisit" else own, payload), end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and the place behind it; -1 if it is damaged or cut off."""
    inner, out, place = zlib.decompressobj(31), [], at
    try:
        while not inner.eof and place < len(data):
            part = data[place : place + 65536]
            out.append(inner.decompress(part))
            place += len(part)
    except zlib.error:
        return b"", -1
    return b"".join(out), place - len(inner.unused_data) if inner.eof else -1


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int]]]:
    """All records of one archive that pass the checks, and the byte ranges (offset, length) that are in none."""
    records, gaps, at, bad = [], [], 0, None
    ahead = {"version": -1, "member": -1}  # the next candidates, searched again only when passed

    def after(place: int) -> int:
        if ahead["version"] < place:
            found = _VERSIONS.search(data, place)
            ahead["version"] = found.start() if found else len(data)
        if ahead["member"] < place:
            found = data.find(_MEMBER, place)
            ahead["member"] = found if found >= 0 else len(data)
        return min(ahead.values())

    while at < len(data):
        if data.startswith(_MEMBER, at):
            text, end = _member(data, at)
            record, behind = _parse(text, 0) if end > 0 else (None, 0)
            record = record._replace(offset=at) if record and behind == len(text) else None
        else:
            record, end = _parse(data, at)
        if record is None:
            bad = at if bad is None else bad
            at = after(at + 1)
            continue
        if bad is not None:
            gaps.append((bad, at - bad))
            bad = None
        records.append(record)
        at = end
    if bad is not None:
        gaps.append((bad, len(data) - bad))
    return records, gaps


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records (archive, offset, record_type, record_id, url, refers_to, payload_bytes, payload_digest, payload) and the
    quarantine log (archive, offset, n_bytes). A revisit has no payload; its size and digest are those of the full one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records, gaps = salvage(content.as_buffer().to_pybytes())
                rows = [(name, r.offset, r.kind, r.record_id, r.url, r.refers_to, r.payload_bytes, r.payload_digest, None if r.kind == "revisit" else r.payload)
                        for r in records] + [(name, at, None, None, None, None, n, None, None) for at, n in gaps]
                for k in range(0, len(rows), 1000):
                    part = list(zip(*rows[k : k + 1000]))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, kinds)], names=[
                        "archive", "offset", "record_type", "record_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload"])

    found = files.mapInArrow(run, "archive string, offset long, record_type string, record_id string, url string, refers_to string, "
                                  "payload_bytes long, payload_digest string, payload binary")
    gaps = found.filter("record_type is null").select("archive", "offset", F.col("payload_bytes").alias("n_bytes"))
    return found.filter("record_type is not null"), gaps


def record_number(urn: Column) -> Column:
    """The integer id in a record id that ``write`` made; null for an empty one."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:record:(-?\d+)>$", 1), F.lit("")).cast("long")
