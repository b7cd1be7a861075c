import json

import pytest

from helpers import write
from logwarden import cluster
from logwarden.sources import logs
from logwarden.sources.logs import Ingest, csv_cells, latest_by_name, list_sources, parse_files
from pyspark.sql import functions as F


def events_of(spark, tmp_path, name, text):
    ingest = Ingest(spark, write(tmp_path, {name: text}))
    events = ingest.stored()
    return ingest.summary(events).first().format, events.orderBy("ingest_seq").collect()


def test_csv_cells(spark):
    cases = {
        'a,b,c': ["a", "b", "c"], '"a,b", c ,': ["a,b", "c", ""], '"say ""hi""",x': ['say "hi"', "x"], '': [""], ',': ["", ""],
        'a"b,c"d': ["ab,cd"], '"open,to the end': ["open,to the end"], '""': [""], '""""': ['"'],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", csv_cells(F.col("line")).alias("cells")).collect()
    assert {r.line: list(r.cells) for r in rows} == cases


def test_csv_with_odd_header_missing_cells_and_quotes(spark, tmp_path):
    fmt, got = events_of(spark, tmp_path, "x.txt", ' Time , SRC_IP,User,Event_Type,Status,Port\n2026-01-02 03:04:05,1.2.3.4,"a, b",Failed-Login,denied,70000\n'
                                                   '\n10:11,,bob,view\n""\n')
    assert fmt == "csv" and len(got) == 2
    first, second = got
    assert (first.source_ip, first.user, first.action, first.status, first.port, first.time_label) == ("1.2.3.4", "a, b", "failed_login", "blocked", None, "03:04")
    assert (second.source_ip, second.user, second.action, second.hour) == (None, "bob", "view", 10)


def test_repeated_csv_header_uses_its_last_column(spark, tmp_path):
    _, got = events_of(spark, tmp_path, "x.csv", "ip,user,user\n1.1.1.1,first,last\n1.1.1.2,first\n")
    assert [r.user for r in got] == ["last", None]


def test_json_documents(spark, tmp_path):
    rec = {"src": "10.0.0.1", "user": "kim", "action": "Login OK", "status": 200, "port": "22", "ts": "2026-01-02T03:04:05Z"}
    fmt, got = events_of(spark, tmp_path, "a.json", json.dumps([rec, 5, None, [1], rec], indent=2))
    assert fmt == "json" and len(got) == 2
    assert (got[0].source_ip, got[0].user, got[0].action, got[0].status, got[0].port) == ("10.0.0.1", "kim", "login_ok", "success", 22)
    assert got[0].raw == json.dumps(rec, separators=(",", ":"))
    fmt, got = events_of(spark, tmp_path, "b.data", "  " + json.dumps([rec]))
    assert fmt == "json" and len(got) == 1
    fmt, got = events_of(spark, tmp_path, "c.json", json.dumps({"x": 1, "records": [rec, rec], "events": "no list"}))
    assert fmt == "json" and len(got) == 2
    assert events_of(spark, tmp_path, "d.json", "[]") == ("json", [])
    assert events_of(spark, tmp_path, "e.json", json.dumps(rec))[0] == "json"
    fmt, got = events_of(spark, tmp_path, "f.json", '{"broken": \nsudo root access')
    assert fmt == "jsonl" and [r.action for r in got] == ["event", "priv_escalation"]


def test_bracketed_log_lines_stay_a_log(spark, tmp_path):
    fmt, got = events_of(spark, tmp_path, "g.log", "[02:10] login failed src=1.2.3.4\n[02:11] ok\n")
    assert fmt == "log" and got[0].time_label == "02:10" and got[0].source_ip == "1.2.3.4"


def test_jsonl_falls_back_per_line(spark, tmp_path):
    text = '{"source": "1.1.1.1", "Action": "x"}\n// note\n\n[1, 2]\n42\n{"a": 1},\nFailed password for root from 2.2.2.2 port 22\n'
    fmt, got = events_of(spark, tmp_path, "h.jsonl", text)
    assert fmt == "jsonl" and len(got) == 3
    assert got[0].source_ip == "1.1.1.1" and got[0].action == "event"  # keys of JSON records are case-sensitive
    assert got[1].raw == '{"a": 1},' and (got[2].user, got[2].port, got[2].action) == ("root", 22, "failed_login")


def test_order_duplicates_size_and_empty_files(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    paths = write(tmp_path / "one", {"b.log": "old line\n", "a.log": "second\nthird\n", "empty.log": "", "big.log": "x\n" * 1000})
    paths += write(tmp_path / "two", {"b.log": "first\n"})
    ingest = Ingest(spark, paths, max_file_bytes=500, keep_latest_by_name=True)
    assert [r.raw for r in ingest.events.orderBy("ingest_seq").collect()] == ["first", "second", "third"]
    summary = {r.file: (r.format, r.n_events) for r in ingest.summary().collect()}
    assert summary == {"b.log": ("log", 1), "a.log": ("log", 2), "empty.log": ("log", 0)}
    assert list_sources(spark, paths, keep_latest_by_name=False).count() == 5


def test_line_order_over_many_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(200_000)]
    path = write(tmp_path, {"long.log": "\n".join(lines)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        got = [r.raw for r in parse_files(spark, path).orderBy("ingest_seq").select("raw").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines


def test_short_splits_are_refused(spark, tmp_path):
    path = write(tmp_path, {"a.log": "x\n"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        with pytest.raises(ValueError, match="maxPartitionBytes"):
            parse_files(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_given_formats_skip_sniffing(spark, tmp_path):
    paths = write(tmp_path, {"a.log": "1,2\nfailed login", "t.csv": "ip,user\n1.1.1.1,x\n"})
    ingest = Ingest(spark, paths, formats={"a.log": "log", "t.csv": "csv"})
    assert {r.file: (r.format, r.n_events) for r in ingest.summary().collect()} == {"a.log": ("log", 2), "t.csv": ("csv", 1)}


def test_latest_by_name(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "name string, load_order int")
    assert {(r.name, r.load_order, r.ordinal) for r in latest_by_name(rows).collect()} == {("a", 3, 1), ("b", 2, 2)}


def test_equal_base_names_in_dated_folders_are_all_kept(spark, tmp_path):
    for day in ("dt=2026-03-01", "dt=2026-03-02"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "part-00000.log").write_text(f"event of {day}\n")
    ingest = Ingest(spark, [str(tmp_path / "dt=2026-03-01"), str(tmp_path / "dt=2026-03-02")])
    assert sorted(r.raw for r in ingest.events.collect()) == ["event of dt=2026-03-01", "event of dt=2026-03-02"]
    assert ingest.events.select("file").distinct().count() == 2


@pytest.mark.parametrize("gap_free", [True, False])
def test_event_index_counts_events_over_files_and_splits(spark, tmp_path, gap_free):
    """Dropped lines do not count, small files share a task, and a large file is read in several splits."""
    from logwarden.sources.logs import event_index

    big = "".join(f"{'# note' if i % 5 == 2 else ''}user=u{i} login failed {'x' * 60}\n" for i in range(40_000))
    files = {"a.log": "# only notes\n\n", "b.log": "one\n\n# two\nthree\n", "c.log": big, "d.json": json.dumps([{"user": "p"}, 7, {"user": "q"}]),
             "e.csv": "time,user\n10:00,k\n\n11:00,l\n", "f.jsonl": '{"user": "m"}\n// no\n{"user": "n"}\n'}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    try:
        ingest = Ingest(spark, write(tmp_path, files))
        got = event_index(ingest.numbered, gap_free).select("event_index", "ingest_seq", "file", "raw").orderBy("ingest_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.event_index for r in got] == list(range(len(got)))
    kept = [line for line in big.splitlines() if not line.startswith("#")]
    assert [r.raw for r in got if r.file == "c.log"] == kept and len(got) == 2 + len(kept) + 2 + 2 + 2
    assert len({r.ingest_seq >> 33 for r in got if r.file == "c.log"}) > 2


def test_activity_of_files_goes_by_event_place(spark, tmp_path):
    from logwarden.plans.analysis import Analysis

    lines = ["# head", *["login failed" for _ in range(30)], "10:15 ok"]
    ingest = Ingest(spark, write(tmp_path, {"a.log": "\n".join(lines[:10]), "b.log": "\n".join(lines[10:])}))
    hours = {int(r.hour): r.events for r in Analysis(ingest.stored()).activity.collect()}
    want = {h: 0 for h in range(24)}
    for i in range(30):
        want[i % 24] += 1
    want[10] += 1
    assert hours == want


def test_sniff_sorts_no_lines(spark):
    """Numbers are counted by file in a hash; lines with a sort would be held by the task of a large file."""
    rows = [("a.csv", i, v) for i, v in enumerate(["  ", "Time,User", "1,x", "", '""', " last] "])] + [("b.log", 9, None), ("b.log", 10, "[one"), (None, 3, "{}")]
    plans, plain = [], logs.written
    logs.written = lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain(df, name)
    try:
        found = {r.file: r for r in logs.sniff(spark.createDataFrame(rows, "file string, ingest_seq bigint, value string")).collect()}
    finally:
        logs.written = plain
    assert "SortAggregate" not in dict(plans)["sniffed-numbers"]
    a, b, c = found["a.csv"], found["b.log"], found[None]
    assert (a.first_line, a.header_line, a.first_char, a.last_char, a.header_seq, a.n_lines, a.n_jsonl) == ("  ", "Time,User", "T", "]", 1, 3, 3)
    assert (b.first_line, b.header_line, b.first_char, b.last_char) == (None, "[one", "[", "e") and (c.first_char, c.last_char) == ("{", "}")


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    """One row group goes whole to one split, however many splits the scan has."""
    path = str(tmp_path / "t")
    spark.range(0, 4000, 1, 1).selectExpr("id", "repeat(uuid(), 40) as text").write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 10)
    try:
        df = spark.read.parquet(path)
        sizes = lambda d: [n for n in d.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores and max(sizes(df)) == 4000
        dealt = sizes(cluster.dealt(df, "id", 200))
        assert len(dealt) == max(20, cores) and max(dealt) < 400 and sum(dealt) == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
