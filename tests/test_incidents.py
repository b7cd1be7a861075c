from pyspark.sql import functions as F

from helpers import ATTACKER, GUESSER, LEAK, SCANNER, TUNNEL, auth_log, network_csv, write
from logwarden.operators import detect, incidents, reports
from logwarden.plans.analysis import Analysis
from logwarden.schema import EVENT_SCHEMA
from logwarden.sources.logs import Ingest, empty_events


def event(seq, ip=None, action="event", status="info", **more):
    base = dict(ingest_seq=seq, ts=None, time_label=None, hour=None, source_ip=ip, dest_ip=None, user=None, host=None, action=action,
                status=status, port=None, raw="r", file="f")
    return tuple((base | more)[f.name] for f in EVENT_SCHEMA.fields)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def test_two_logs_give_the_seven_expected_incidents(spark, tmp_path):
    ingest = Ingest(spark, write(tmp_path, {"auth.log": auth_log(), "net.csv": network_csv()}))
    counted = {r.file: (r.format, r.n_events) for r in ingest.summary().collect()}
    assert counted == {"auth.log": ("log", 46), "net.csv": ("csv", 12)}
    run = Analysis(ingest.stored(), files=ingest.evidence_files(spark), run_label="2026-03-04 10:00 UTC")
    got = [(r.incident_id, r.title, r.source_ip, r.asset, r.risk, r.severity) for r in run.incidents.orderBy("rank").collect()]
    assert got == [
        ("2001", "Possible Server Compromise", ATTACKER, "web-01", 97, "Critical"),
        ("2002", "Port Scan / Recon", SCANNER, "fw-02", 60, "High"),
        ("2003", "Possible DNS Exfiltration", TUNNEL, "db-01", 59, "High"),
        ("2004", "Port Scan / Recon", ATTACKER, "web-01", 58, "High"),
        ("2005", "Suspicious Outbound Activity", LEAK, "APP-05", 52, "High"),
        ("2006", "Malware Detected", None, "pc-114", 50, "Medium"),
        ("2007", "Brute-Force Attack", GUESSER, "GW-01", 49, "Medium"),
    ]
    top = run.incidents.where("rank = 1").first()
    assert (top.user, top.confidence, top.opened) == ("admin", 77, "02:10")
    # Failures fill the sample, so the success never reaches it.
    assert {r.action for r in run.samples.where("incident_id = '2001'").collect()} == {"failed_login"}
    evidence = {(r.incident_id, r.name) for r in run.evidence.collect()}
    assert ("2001", "auth.log") in evidence and ("2007", "net.csv") in evidence and len(evidence) == 7
    assert incidents.of_incident(run.timeline, "2001").count() == 6
    assert incidents.of_incident(run.timeline, "9999").count() == 0


def test_publish_writes_every_table(spark, tmp_path):
    ingest = Ingest(spark, write(tmp_path, {"auth.log": auth_log()}))
    run = Analysis(ingest.stored(), files=ingest.evidence_files(spark), run_label="2026-03-04 10:00 UTC", reuse=True)
    run.publish(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "incidents")).count() == 5
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(Analysis.TABLES + ("evidence",))


def test_ties_go_to_the_first_seen_and_order_of_rows_does_not_matter(spark):
    rows = [event(i, "9.9.9.9", "failed_login", "failed", host=h, user=u) for i, (h, u) in enumerate(
        [("b", "x"), ("a", "y"), ("a", "x"), ("b", "y"), ("c", None)])]
    rows += [event(10 + i, "1.1.1.1", "failed_login", "failed", host="z") for i in range(5)]
    seen = []
    for n, order in ((1, F.col("ingest_seq")), (5, F.desc("ingest_seq")), (3, F.xxhash64("ingest_seq"))):
        run = Analysis(frame(spark, rows).orderBy(order).repartition(n))
        seen.append([tuple(r) for r in run.incidents.select("incident_id", "source_ip", "asset", "user", "risk").orderBy("rank").collect()])
    assert seen[0] == [("2001", "9.9.9.9", "b", "x", 48), ("2002", "1.1.1.1", "z", None, 48)]
    assert seen[0] == seen[1] == seen[2]


def test_an_event_that_is_failure_and_success_is_sampled_twice(spark):
    rows = [event(i, "1.1.1.1", "failed_login", "failed") for i in range(4)] + [event(5, "1.1.1.1", "successful_login", "failed")]
    run = Analysis(frame(spark, rows))
    found = run.incidents.first()
    assert found.title == "Possible Account Compromise" and found.asset == "1.1.1.1"
    assert [r.ingest_seq for r in run.samples.orderBy("sample_rank").collect()] == [0, 1, 2, 3, 5, 5]


def test_rule_limits(spark):
    def kinds(rows):
        return sorted(r.kind for r in detect.detect(frame(spark, rows)).collect())

    assert kinds([event(i, "1.1.1.1", "failed_login", "failed") for i in range(4)]) == []
    assert kinds([event(0, "1.1.1.1", "priv_escalation", "flagged")]) == ["privesc"]
    assert kinds([event(0, "1.1.1.1", "priv_escalation"), event(1, "1.1.1.1", "successful_login")]) == []
    assert kinds([event(i, "1.1.1.1", port=i + 1) for i in range(14)]) == []
    assert kinds([event(i, "1.1.1.1", port=i + 1) for i in range(15)]) == ["portscan"]
    assert kinds([event(i, None, "dns_query") for i in range(20)]) == []
    assert kinds([event(i, None, "file_download", host="h") for i in range(2)]) == []
    assert kinds([event(i, None, "file_download", host="h") for i in range(3)]) == ["malware"]
    assert kinds([event(0, "1.1.1.1", "malware_detected")]) == ["malware"]


def test_one_address_with_most_rows(spark):
    hot = spark.range(60_000).select(F.col("id").alias("n"), F.lit("7.7.7.7").alias("ip"))
    cold = spark.range(20_000).select(F.col("id") + 60_000, F.concat(F.lit("8.8."), (F.col("id") % 200).cast("string"), F.lit(".1")))
    rows = hot.union(cold).select(
        F.col("n").alias("ingest_seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit("01:00").alias("time_label"), F.lit(1).alias("hour"),
        F.col("ip").alias("source_ip"), F.lit(None).cast("string").alias("dest_ip"), F.concat(F.lit("u"), (F.col("n") % 3).cast("string")).alias("user"),
        F.concat(F.lit("h"), (F.col("n") % 50).cast("string")).alias("host"), F.lit("failed_login").alias("action"), F.lit("failed").alias("status"),
        (F.col("n") % 65535 + 1).cast("int").alias("port"), F.lit("x").alias("raw"), F.lit("f").alias("file"))
    run = Analysis(rows)
    top = run.incidents.orderBy("rank").first()
    assert run.kept.where("key = '7.7.7.7' and rule_order = 2").first().n_ports == 60_000
    assert top.source_ip == "7.7.7.7" and top.title == "Port Scan / Recon" and top.risk == 90
    assert run.hostile.first().alerts == 60_000


def test_empty_input_is_complete_and_zero(spark):
    run = Analysis(empty_events(spark))
    assert run.incidents.count() == 0 and run.activity.count() == 24
    assert {r.value for r in run.health.collect()} == {0} and run.score.first().score == 0
    assert [list(r.spark) for r in run.kpis.collect()] == [[], [], [], []]
    assert run.summary.first().avg_response_mins == 0
    assert run.script.count() == 0 and "nothing to investigate" in run.fallback.first().answer
    assert run.meta.first().note.startswith("No events")


def test_queue_neighbours_and_answers(spark, tmp_path):
    run = Analysis(Ingest(spark, write(tmp_path, {"auth.log": auth_log()})).stored())
    assert incidents.queue(run.incidents, search="t1046").count() == 2
    assert incidents.queue(run.incidents, "Medium").count() == 1
    assert {r.neighbour for r in incidents.neighbours(run.edges, "web-01").where("incident_id = '2001'").collect()} == {ATTACKER, "admin"}
    asked = spark.createDataFrame([(1, "why is incident #2001 CRITICAL"), (2, "investigate first"), (3, "what about brute force?"), (4, "zzz"), (5, "!")],
                                  "question_id int, question string")
    got = {r.question_id: (r.position, r.how) for r in reports.answer_questions(asked, run.script).collect()}
    assert got[1] == (1, "exact") and got[2] == (2, "partial") and got[3][1] == "overlap"
    assert got[4] == (None, "fallback") and got[5] == (None, "fallback")


def test_hourless_rows_spread_or_share_a_bucket(spark):
    rows = [event(i, hour=h) for i, h in enumerate([None, 5, None, 99])]
    strict = {r.hour: r.events for r in reports.activity_series(reports.event_cube(frame(spark, rows))).where("events > 0").collect()}
    assert strict == {"00": 1, "05": 1, "02": 1, "03": 1}
    loose = reports.event_cube(frame(spark, rows), strict=False)
    assert loose.where("bucket = -1").first().n == 3
