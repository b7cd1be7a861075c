"""Streamed digests of files against hashlib; evidence of contributing files only."""

import hashlib
import random

from helpers import auth_log, network_csv, write
from logwarden.plans.analysis import Analysis
from logwarden.sources import digests
from logwarden.sources.logs import Ingest


def test_digests_of_any_bytes_in_many_splits(spark, tmp_path):
    r = random.Random(5)
    raw = bytes(r.randrange(256) for _ in range(60_000))
    bodies = {"a.log": b"one\ntwo", "b.log": b"one\r\ntwo\r\n", "c.log": b"\xef\xbb\xbfmark\n", "d.log": b"\xef\xbb\xbfmark\nend", "e.log": b"\n\n\n", "f.log": b"",
              "g.log": raw, "h.log": raw + b"\n", "i j.log": b"\xff\xfe\x00\n" * 9, "k.log": b"x" * 70_000}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "4096")
    try:
        (tmp_path / "in").mkdir()
        for name, body in bodies.items():
            (tmp_path / "in" / name).write_bytes(body)
        listed = [(f"file://{tmp_path}/in/{n}", len(b)) for n, b in bodies.items()]
        for whole in (0, 100, 1 << 20):
            got = {x.path.rsplit("/", 1)[1].replace("%20", " "): x.sha256 for x in digests.file_digests(spark, listed, whole).collect()}
            assert got == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert digests.file_digests(spark, []).count() == 0


def test_evidence_reads_contributing_files_only(spark, tmp_path):
    quiet = "\n".join(["2026-03-04T01:00:00 host=q nothing of note"] * 5)
    ingest = Ingest(spark, write(tmp_path, {"auth.log": auth_log(), "net.csv": network_csv(), "quiet.log": quiet}))
    every = {x.name: x.hash for x in ingest.evidence_files(spark).collect()}
    streamed = {x.name: x.hash for x in ingest.evidence_files(spark, whole_bytes=0).collect()}
    assert set(every) == {"auth.log", "net.csv", "quiet.log"} and streamed == every
    asked = []
    def shown(names):
        found = ingest.evidence_of(names)
        asked.extend(x.name for x in found.collect())
        return found

    events = ingest.stored()
    run = Analysis(events, files=shown, run_label="2026-03-04 10:00 UTC")
    whole = Analysis(events, files=ingest.evidence_files(spark), run_label="2026-03-04 10:00 UTC")
    key = lambda run: sorted((x.incident_id, x.name, x.hash) for x in run.evidence.collect())
    assert key(run) == key(whole) and sorted(asked) == ["auth.log", "net.csv"]
