from pyspark.sql import functions as F

from logwarden.functions import text as tx


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_addresses(spark):
    texts = ["from 10.0.0.1 to 10.0.0.2", "x 256.1.1.1 y 1.2.3.4", "src=999.1.1.1 8.8.8.8", "no", "1.2.3.4.5", "é1.2.3.4"]
    assert apply(spark, tx.first_ip, texts) == ["10.0.0.1", "1.2.3.4", "999.1.1.1", None, "1.2.3.4", "1.2.3.4"]
    assert apply(spark, tx.second_ip, texts) == ["10.0.0.2", None, None, None, None, None]


def test_ports(spark):
    assert apply(spark, tx.extract_port, ["port 22", "DPT=0", "dport: 70000", "dst_port=443 port 1", "port x"]) == [22, None, None, 443, None]
    assert apply(spark, tx.clamp_port, ["80", " 443 ", "1e3", "65536", "-1", "http", "80d"]) == [80, 443, 1000, None, None, None, None]


def test_users_and_hosts(spark):
    assert apply(spark, tx.extract_user, ["for invalid user bob from x", 'USER="al.ice"', "the user carol", "use"]) == ["bob", "al.ice", "carol", None]
    assert apply(spark, tx.extract_host, ["host=db-1 x", "Mar 12 01:02:03 web-1 sshd", "x Mar 12 01:02:03 web-1"]) == ["db-1", "web-1", None]


def test_times(spark):
    texts = ["a 2026-03-04T05:06:07.5+02:00 z", "2026-03-04 05:06", "Mar  4 07:08:09 x", "[09:10] y", "1.2.3.4:99:10", "1767225600", "2026-13-40T05:06:07"]
    got = apply(spark, tx.parse_time, texts)
    assert [(g.time_label, g.hour) if g else None for g in got] == [
        ("05:06", 5), ("05:06", 5), ("07:08", 7), ("09:10", 9), None, None, ("05:06", 5)]
    assert got[6].ts is None and got[2].ts is None
    stamps = apply(spark, lambda c: F.date_format(tx.parse_time(c)["ts"], "yyyy-MM-dd HH:mm:ss"), texts[:2])
    assert stamps == ["2026-03-04 03:06:07", "2026-03-04 05:06:00"]


def test_classification_order_and_block_verb(spark):
    texts = ["Failed password", "session opened", "sudo denied", "IN TXT", "within txt", "conn dropped", "warning", "hello", "a.exe", "a.exes"]
    got = [(r.action, r.status) for r in apply(spark, tx.classify, texts)]
    assert got == [("failed_login", "failed"), ("successful_login", "success"), ("priv_escalation", "blocked"), ("dns_query", "flagged"),
                   ("event", "info"), ("blocked_traffic", "blocked"), ("system_alert", "flagged"), ("event", "info"),
                   ("file_download", "flagged"), ("event", "info")]


def test_status_words_keep_their_known_quirks(spark):
    got = apply(spark, lambda c: tx.normalize_status(c, F.lit("info")), ["unsuccessful", "broken", "denied", "404", "401", "x204", "204"])
    assert got == ["success", "success", "info", "info", "failed", "info", "success"]


def test_display(spark):
    assert apply(spark, tx.humanize_action, ["failed_login", "DNS_query", ""]) == ["Failed Login", "DNS Query", ""]
    assert apply(spark, lambda c: tx.truncate(c, 4), ["abcd", "abcde"]) == ["abcd", "abc…"]
    assert apply(spark, lambda c: tx.shift_time(c, -3), ["00:01", "12:30"]) == ["23:58", "12:27"]
    assert apply(spark, tx.source_name, ["https://A.com/x/y.log?q=1", "https://a.com", "z" * 70]) == ["a.com/y.log", "a.com", "z" * 60]
    names = spark.createDataFrame([(["a"],), (["a", "b"],), (["x", "http://h/f"],)], "n array<string>")
    assert [r[0] for r in names.select(tx.dataset_label(F.col("n"))).collect()] == ["a", "2 uploaded files", "Connected: http://h/f"]
    label = spark.range(1).select(tx.run_label().alias("l")).first().l
    assert len(label) == 20 and label.endswith(" UTC")
    assert apply(spark, tx.sha256_short, ["abc"]) == ["ba78…15ad"]


def test_bands_differ_for_fractions(spark):
    row = spark.range(1).select(tx.severity_from_risk(F.lit(75.5)).alias("s"), tx.risk_bucket(F.lit(75.5)).alias("b")).first()
    assert (row.s, row.b) == ("High", "Critical")
