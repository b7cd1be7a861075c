"""Stateful address rules: escalation over batches, late rows, closing of silent addresses."""

from pyspark.sql import functions as F

from logwarden.operators import detect
from logwarden.streaming import escalation, streams

SCHEMA = "ingest_seq bigint, ts timestamp, source_ip string, action string, status string, port int"
PLAIN = "ingest_seq bigint, t string, source_ip string, action string, status string, port int"


def replay(spark, base, lots, **options):
    """Each lot arrives before one start of the stream."""
    for k, rows in enumerate(lots):
        spark.createDataFrame(rows, PLAIN).withColumn("ts", F.to_timestamp("t")).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.parquet(
            f"{base}/in/lot-{k}")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{base}/in/lot-*")
        out = streams.run_available(escalation.address_states(arriving, **options), f"{base}/out", f"{base}/state", "update", 120)
    return out


def test_rules_escalate_and_late_rows_leave(spark, tmp_path):
    failed = lambda i, minute, ip="1.1.1.1": (i, f"2026-01-01 10:{minute:02d}:00", ip, "failed_login", "failed", 22 + i)
    lots = [
        [failed(i, i) for i in range(12)] + [(50, None, "1.1.1.1", "failed_login", "failed", 1), (51, "2026-01-01 10:00:00", "", "dns_query", "ok", None),
                                           (52, "2026-01-01 10:00:00", None, "dns_query", "ok", None), (53, "2026-01-01 10:00:00", "3.3.3.3", "dns_query", "ok", None)],
        [(100, "2026-01-01 10:30:00", "1.1.1.1", "successful_login", "success", 65535), failed(101, 0, "2.2.2.2")],
        [(200, "2026-01-01 10:31:00", "1.1.1.1", "priv_escalation", "flagged", None), failed(201, 19), failed(202, 20), failed(203, 1, "2.2.2.2")],
    ]
    landed = replay(spark, tmp_path, lots)
    got = {r.source_ip: r for r in escalation.running(landed).collect()}
    assert set(got) == {"1.1.1.1", "2.2.2.2", "3.3.3.3"}
    # 10:19 is more than ten minutes before 10:30, 10:20 is not
    late = escalation.late(landed).collect()
    assert [(r.source_ip, r.n_events, r.n_failed, r.first_seq, r.port) for r in late] == [("1.1.1.1", 1, 1, 201, 223)]
    kept = [r for lot in lots for r in lot if r[1] and r[0] != 201]
    batch = {r.source_ip: r for r in detect.ip_features(spark.createDataFrame(kept, PLAIN)).collect()}
    for ip, row in got.items():
        assert {c: row[c] for c in batch[ip].asDict()} == batch[ip].asDict()
    steps = [(r.title, r.risk) for r in escalation.escalations(landed).where("source_ip = '1.1.1.1' and rule_order = 0").orderBy("batch_id").collect()]
    assert [title for title, _ in steps] == ["Brute-Force Attack", "Possible Account Compromise", "Possible Server Compromise"]
    assert [risk for _, risk in steps] == sorted(risk for _, risk in steps)


def test_silent_addresses_close(spark, tmp_path):
    lots = [[(1, "2026-01-01 10:00:00", "1.1.1.1", "dns_query", "ok", 53)], [(2, "2026-01-01 10:00:00", "2.2.2.2", "dns_query", "ok", 53)]]
    landed = replay(spark, tmp_path, lots, idle="1 ms")
    closed = landed.where(F.col("part") == escalation.CLOSED).collect()
    assert [(r.source_ip, r.n_dns, r.n_ports, r.first_seq) for r in closed] == [("1.1.1.1", 1, 1, 1)]


def test_hot_address_is_combined_in_tasks(spark):
    rows = spark.range(0, 20_000, 1, 2).selectExpr(
        "id as ingest_seq", "timestamp_seconds(1700000000 + id % 60) as ts", "'9.9.9.9' as source_ip", "'dns_query' as action", "'ok' as status", "53 as port")
    made = escalation.combined(rows)
    assert made.count() <= 8 and made.agg(F.sum("n_dns")).first()[0] == 20_000
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert escalation.combined(rows.limit(0)).count() == 0
