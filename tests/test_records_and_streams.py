import pytest
from pyspark.sql import functions as F

from helpers import auth_log, write
from logwarden.schema import KDD_SCHEMA, UNSW_SCHEMA
from logwarden.sources import records
from logwarden.sources.logs import parse_files
from logwarden.sources.records import read_flows, read_records, read_traffic, write_features, write_report
from logwarden.streaming import streams


def test_labelled_records(spark, tmp_path):
    base = ["0", "tcp", "http", "SF"] + ["1"] * 37
    text = "\n".join(",".join(base + [label, "20"]) for label in ("normal", "neptune", "weird"))
    df = read_records(spark, write(tmp_path, {"r.csv": text}))
    assert len(KDD_SCHEMA.fields) == 43 and "difficulty" not in df.columns
    assert [(r.label, r.attack_category, r.is_anomaly) for r in df.collect()] == [("normal", "normal", 0), ("neptune", "dos", 1), ("weird", "unknown", 1)]


def test_traffic_records(spark, tmp_path):
    names = [f.name for f in UNSW_SCHEMA.fields]
    row = ["1", "0.5", "tcp", "-", "FIN"] + ["2"] * 38 + ["Exploits", "1"]
    got = read_traffic(spark, write(tmp_path, {"t.csv": ",".join(names) + "\n" + ",".join(row)})).first()
    assert len(names) == 45 and (got.dur, got.state, got.is_sm_ips_ports, got.attack_cat, got.label) == (0.5, "FIN", 2.0, "Exploits", 1)


def test_flow_captures(spark, tmp_path):
    header = " Flow Duration, Fwd Header Length,Fwd Header Length, Rate, Label"
    files = {"Monday-x.csv": header + "\n10,1,2,Infinity,BENIGN\n", "Friday-x.csv": (header + "\n0,1,2,NaN,Web Attack ").encode() + b"\x96" + b" XSS\n"}
    paths = write(tmp_path, files)
    rows = {r.role: r for r in read_flows(spark, paths).collect()}
    assert rows["train"]["Fwd Header Length.1"] == 2.0 and rows["train"]["Rate"] is None and rows["train"].is_attack == 0
    assert rows["test"]["Rate"] is None and rows["test"].is_attack == 1 and rows["test"]["Flow Duration"] == 0.0
    with pytest.raises(ValueError, match="Label"):
        read_flows(spark, write(tmp_path, {"bad.csv": "a,b\n1,2\n"}))


def test_report_and_feature_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", [1.0, 2.0]), ("test", [3.0, 4.0])], "split string, features array<double>")
    write_features(df, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).where("split = 'test'")
    assert list(back.first().features) == [3.0, 4.0]
    write_report(df.select("split"), str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def run(spark, tmp_path, stream, name, mode):
    return streams.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"), mode)


def test_stream_equals_batch_and_dates_syslog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = write(tmp_path / "in", {"auth.log": auth_log()})
    arriving = streams.normalized_stream(streams.read_line_stream(spark, str(tmp_path / "in")), default_year=2026)
    got = run(spark, tmp_path, arriving, "out", "append")
    batch = parse_files(spark, paths)
    key = lambda df: sorted((r.raw, r.action, r.status, r.source_ip, r.port) for r in df.collect())
    assert key(got) == key(batch)
    assert got.where("ts is null").count() == 0
    assert got.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm")).first()[0] == "2026-03-03 01:52"


def test_brute_force_windows_and_late_rows(spark, tmp_path):
    folder = tmp_path / "ev"
    def batch(n, rows):
        df = spark.createDataFrame(rows, "ts string, source_ip string").select(
            F.to_timestamp("ts").alias("ts"), "source_ip", F.lit("failed_login").alias("action"), F.lit("failed").alias("status"))
        df.coalesce(1).write.mode("append").parquet(str(folder))

    def read():
        schema = "ts timestamp, source_ip string, action string, status string"
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    batch(1, [(f"2026-01-01 10:00:{i:02d}", "1.1.1.1") for i in range(12)])
    alerts = streams.latest(run(spark, tmp_path, streams.brute_force_windows(read()), "w", "update"), ["source_ip", "window_start", "window_end"])
    assert {r.n_failed for r in alerts.collect()} == {12}
    # A day later the watermark has passed; a row for the first window comes too late.
    batch(2, [("2026-01-02 10:00:00", "2.2.2.2")])
    run(spark, tmp_path, streams.brute_force_windows(read()), "w", "update")
    batch(3, [("2026-01-01 10:00:30", "1.1.1.1")])
    late = streams.latest(run(spark, tmp_path, streams.brute_force_windows(read()), "w", "update"), ["source_ip", "window_start", "window_end"])
    assert {r.n_failed for r in late.collect()} == {12}
    with_ts, without = streams.timed(spark.read.parquet(str(folder)))
    assert with_ts.count() == 14 and without.count() == 0


def test_flow_files_of_different_headers(spark, tmp_path):
    from logwarden.sources.records import read_flows

    (tmp_path / "Monday-WorkingHours.csv").write_text(" A, B, Label\n1,2,BENIGN\n3,Infinity,Bot\n")
    (tmp_path / "Tuesday-WorkingHours.csv").write_text("Label,B, A ,C\nBot,5,6,7\n")
    (tmp_path / "Friday-WorkingHours.csv").write_text(" A, B, Label\n")
    (tmp_path / "Wednesday-WorkingHours.csv").write_text("")
    got = {(r.A, r.B, r.C, r.Label, r.file[:3]) for r in read_flows(spark, str(tmp_path)).collect()}
    assert got == {(1.0, 2.0, None, "BENIGN", "Mon"), (3.0, None, None, "Bot", "Mon"), (6.0, 5.0, 7.0, "Bot", "Tue")}
    (tmp_path / "x.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="x.csv"):
        read_flows(spark, str(tmp_path))


def test_layouts_of_captures_sort_no_lines(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"A{i},Label\n" + "1,x\n" * 50 + "0,0\n")
    (tmp_path / "empty.csv").write_text("")
    layouts = records.flow_layouts(spark, str(tmp_path))
    assert sorted(r.header for r in layouts.collect()) == ["A0,Label", "A1,Label", "A2,Label"]
    plan = layouts._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Aggregate" not in plan
