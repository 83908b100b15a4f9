import csv
import random

import pytest
from pyspark.sql import functions as F

from auditlark.functions.times import coerce_us
from auditlark.sources import access_log as W
from auditlark.sources import feeds as S
from auditlark.sources import json_lines as J
from auditlark.sources import syslog as L
from auditlark.sources import windows_xml as X
from auditlark.sources.regex_lines import parse_regex_lines, to_java

NOW = 1_700_000_000_000_000


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")


def test_cascade(spark):
    texts = [
        '{"event": "AUTH_OK", "user": "a", "ts": 5}', "CEF:0|v|p|1.0|sig|name|9|src=1.2.3.4 msg=hello world", "<34>Oct 11 22:14:15 mymachine su: failed",
        "plain text", "", "[1, 2]", '"text"', "42", "{'single': 1}", '{"a": 1} trailing', "<999>oops", "CEF:0|too|short", "\r\n", "null",
    ]
    got = [(r.event, r.parsed) for r in L.parse_log_lines(lines(spark, *texts), NOW).orderBy("line_id").collect()]
    assert got == [
        ("AUTH_OK", "json"), ("CEF", "cef"), ("SYSLOG", "bsd_syslog"), ("RAW", "none"), ("EMPTY", None), ("RAW", "json_scalar"),
        ("RAW", "json_scalar"), ("RAW", "json_scalar"), ("RAW", "none"), ("RAW", "none"), ("RAW", "none"), ("RAW", "none"), ("EMPTY", None),
        ("RAW", "json_scalar"),
    ]


def test_bsd_fields(spark):
    row = L.parse_bsd_syslog(lines(spark, "<165>Aug  4 05:34:00 host-9 app[123]: a: b")).first()
    assert (row.pri, row.facility, row.severity, row.day, row.app, row.pid, row.msg) == (165, 20, 5, "4", "app", "123", "a: b")


def test_cef_keeps_the_last_duplicate_and_pipes_in_the_extension(spark):
    row = L.parse_cef(lines(spark, "CEF:1|v|p|2.0|s|n|5|a=1 b=x=y a=2 junk c=|z")).first()
    assert row.format_version == "1" and row.product_version == "2.0"
    assert row.extensions == {"a": "2", "b": "x=y", "c": "|z"}


def test_jsonl_defaults(spark):
    rows = J.parse_jsonl_events(lines(spark, "# note", "", '{"event": "auth_ok"}', "not json" + "x" * 500), NOW).orderBy("line_id").collect()
    assert [(r.event, r.user, r.src_ip, r.host, r.asset_class, r.ts_us) for r in rows] == [
        ("AUTH_OK", "-", "0.0.0.0", "-", "Standard", NOW), ("RAW", "-", "0.0.0.0", "-", "Standard", NOW)]
    assert len(rows[1].msg) == 400 and rows[0].iso == "2023-11-14T22:13:20.000000Z"


@pytest.mark.parametrize("text,us", [
    ("1700000000", 1_700_000_000_000_000), ("1.5", 1_500_000), ("2024-01-01T00:00:00Z", 1_704_067_200_000_000),
    ("2024-01-01T00:00:00", 1_704_067_200_000_000), ("2024-01-01T02:00:00+02:00", 1_704_067_200_000_000), ("yesterday", None), (None, None),
])
def test_time_coercion(spark, text, us):
    assert spark.createDataFrame([(text,)], "t string").select(coerce_us(F.col("t"))).first()[0] == us


def test_json_aliases(spark):
    row = J.normalize_json_logs(lines(spark, '{"UserName": "bob", "src": "", "ip": "1.1.1.1", "Message": "m", "action": "login", "time": "9"}', "nope"), NOW).collect()
    assert [(r.user, r.src_ip, r.msg, r.event, r.ts_us, r.host) for r in row] == [("bob", "1.1.1.1", "m", "login", 9_000_000, "-")]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,username,source_ip,event_type,message\n2024-01-01T00:00:00Z, ann ,2.2.2.2,AUTH_OK,\"hi, you\"\n")
    row = J.import_csv_logs(spark, str(tmp_path), NOW).first()
    assert (row.user, row.src_ip, row.event, row.msg, row.parsed) == ("ann", "2.2.2.2", "AUTH_OK", "hi, you", "csv_import")
    with pytest.raises(ValueError):
        J.check_csv_header(["a", "b"])


def test_windows_xml(spark):
    good = (
        '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID Qualifiers="0">4625</EventID><Level>0</Level>'
        '<TimeCreated SystemTime="2024-01-01T00:00:00Z"/><Channel>Security</Channel><Computer>DC1</Computer></System><EventData>'
        '<Data Name="TargetUserName">admin</Data><Data Name="IpAddress">-</Data><Data>bare</Data></EventData></Event>'
    )
    df = spark.createDataFrame([(good,), ("<Other/>",), ("<Event><System>",), ("",)], "xml string")
    row, = X.parse_windows_events(df, NOW).collect()
    assert (row.win_event_id, row.user, row.src_ip, row.host, row.ts_us) == ("4625", "admin", "0.0.0.0", "DC1", 1_704_067_200_000_000)
    assert row.event_data == {"TargetUserName": "admin", "IpAddress": "-", "Data2": "bare"}
    assert row.msg == "Windows Event 4625 on DC1 (Security) TargetUserName=admin; IpAddress=-; Data2=bare"


def test_regex_parser(spark):
    rows = parse_regex_lines(lines(spark, "1.2.3.4 bob login 7", "zzz"), r"(?P<ip>\S+) (?P<user>\w+) (?P<action>\w+) (?P<shard_no>\d+)", NOW).collect()
    assert [(r.src_ip, r.user, r.event, r.regex_fields["shard_no"]) for r in rows] == [("1.2.3.4", "bob", "login", "7")]
    assert to_java(r"(?P<q>['\"])x(?P=q)")[0] == r"(['\"])x\1"
    for bad in ("", "(?P<x>"):
        with pytest.raises(ValueError):
            to_java(bad)


def test_access_log(spark):
    texts = [
        '1.1.1.1 - ann [10/Oct/2000:13:55:36 -0700] "POST /login HTTP/1.1" 401 12 "-" "' + "u" * 200 + '"',
        '2.2.2.2 - - [10/Oct/2000:13:55:36 -0700] "GET /a" 200 -', "junk",
    ]
    parsed = W.parse_access_log(lines(spark, *texts), NOW).orderBy("line_id")
    rows = parsed.collect()
    assert [(r.ip, r.status, r.proto, r.ts_us) for r in rows] == [("1.1.1.1", 401, "HTTP/1.1", 971_211_336_000_000), ("2.2.2.2", 200, "", 971_211_336_000_000)]
    assert len(rows[0].ua) == 160
    out = W.access_events(parsed.withColumn("site", F.lit("shop"))).collect()
    assert sorted((r.event, r.msg) for r in out if r.line_id == 0) == [
        ("AUTH_FAIL", "WEB AUTH_FAIL POST /login -> 401"), ("HTTP_REQ", "POST /login HTTP/1.1 401 12")]
    assert [r.event for r in out if r.line_id == 1] == ["HTTP_REQ"]


def test_site_lookup_prefers_the_id(spark):
    sites = spark.createDataFrame([(1, "shop"), (2, "1"), (7, "blog")], "site_id int, name string")
    refs = spark.createDataFrame([("1",), ("blog",), (" 7 ",), ("x",), ("",)], "site_ref string")
    got = {r.site_ref: r.site_id for r in W.resolve_sites(refs, sites).collect()}
    assert got == {"1": 1, "blog": 7, " 7 ": 7, "x": None, "": None}


def test_feeds(spark):
    urls = S.url_list(lines(spark, "# c", "http://Evil.example/x", "https://u:p@evil.example:81/y", "http://1.2.3.4/z", "nohost", "http://local/"))
    assert {(r.ioc, r.ioc_type) for r in urls.collect()} == {("evil.example", "domain"), ("1.2.3.4", "ip")}
    ips = S.ip_list(lines(spark, "# c", "5.6.7.8 online", "5.6.7.8", "9.9.9.9,", "host"))
    assert sorted(r.ioc for r in ips.collect()) == ["5.6.7.8", "9.9.9.9"]
    rows = S.indicator_csv(lines(
        spark, "# header", '"d","1","1.2.3.4:80","ip:port","botnet","fam"', '"d","2","Bad.Example","domain","",""',
        '"d","3","http://c2.example/x","url","c2","f"', f'"d","4","{"A" * 64}","sha256_hash","t","m"', '"d","5","abc","md5_hash","t","m"',
        '"d","6","short"', "d,7,x.example,domain,t,"))
    got = {r.ioc: (r.ioc_type, r.description) for r in rows.collect()}
    assert got == {
        "1.2.3.4": ("ip", "AbuseCH-ThreatFox-LIVE: botnet (fam)"), "bad.example": ("domain", "AbuseCH-ThreatFox-LIVE: threatfox-ioc"),
        "c2.example": ("domain", "AbuseCH-ThreatFox-LIVE: c2 (f)"), "a" * 64: ("sha256", "AbuseCH-ThreatFox-LIVE: t (m)"),
        "x.example": ("domain", "AbuseCH-ThreatFox-LIVE: t"),
    }


def test_ioc_csv_validation(spark):
    rows = spark.createDataFrame([("1.1.1.1", "IP", "500"), ("", "ip", "5"), ("x", "email", "5"), ("y.example", "domain", "abc")], "IOC string, ioc_type string, confidence string")
    got = [(r.ioc, r.confidence, r.valid) for r in S.ioc_csv(rows).collect()]
    assert got == [("1.1.1.1", 100, True), ("", 5, False), ("x", 5, False), ("y.example", 60, True)]
    with pytest.raises(ValueError):
        S.ioc_csv(rows.drop("ioc_type"))


def test_control_bytes_stay_inside_their_field(spark):
    request = '9.9.9.9 - bob [10/Oct/2023:13:55:36 +0000] "GET /a\x01b\x02c HTTP/1.1" 200 12 "-" "agent \x01 one"'
    row = W.parse_access_log(lines(spark, "\x01junk", request), NOW).first()
    assert (row.url, row.proto, row.status, row.ua) == ("/a\x01b\x02c", "HTTP/1.1", 200, "agent \x01 one")
    row = L.parse_bsd_syslog(lines(spark, "<34>Oct 11 22:14:15 ho\x01st a\x02p[7]: m\x01\x01\x02\x03")).first()
    assert (row.host, row.app, row.pid, row.msg) == ("ho\x01st", "a\x02p", "7", "m\x01\x01\x02\x03")
    sites = spark.createDataFrame([(1, "s")], "site_id long, name string")
    refs = lines(spark, request, "bad \x01 line").withColumn("site_ref", F.lit("\ts "))
    counts, _ = W.ingest_accounting(refs, sites, NOW)
    assert [(r.parsed, r.skipped, r.events) for r in counts.collect()] == [(1, 1, 1)]


def test_white_space_of_any_kind_is_stripped(spark):
    events = J.parse_jsonl_events(lines(spark, "\t# comment", "\t", "　", '\t{"event": "AUTH_OK", "ts": 5}\x0b'), NOW).collect()
    assert [(r.event, r.ts_us) for r in events] == [("AUTH_OK", 5_000_000)]
    found = S.url_list(lines(spark, "\thttp://evil.example/x", "http://evil2.example\t")).collect()
    assert sorted(r.ioc for r in found) == ["evil.example", "evil2.example"]


def test_quoted_line_breaks_in_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,username,message\n5,alice,"one\ntwo"\n6,bob,three\n')
    rows = J.import_csv_logs(spark, str(tmp_path / "a.csv"), NOW, multi_line=True).collect()
    assert sorted((r.user, r.msg) for r in rows) == [("alice", "one\ntwo"), ("bob", "three")]


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(['a', ' ', ',', '\n', '"', '\n\n', 'é']) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    for part in range(2):
        with open(tmp_path / f"f{part}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if part else "\r\n", quoting=csv.QUOTE_ALL)
            writer.writerow(["timestamp", "username", "message"])
            writer.writerows((i, f"u{i}", f"<{m}>") for i, m in rows if i % 2 == part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        found = {r.user: r.msg for r in J.import_csv_logs(spark, str(tmp_path), NOW, multi_line=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == {f"u{i}": f"<{m}>" for i, m in rows}


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(['a', ' ', ',', '\n', '"', '\n\n', 'é']) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    for part in range(2):
        with open(tmp_path / f"f{part}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n" if part else "\r\n", quoting=csv.QUOTE_ALL)
            writer.writerow(["timestamp", "username", "message"])
            writer.writerows((i, f"u{i}", f"<{m}>") for i, m in rows if i % 2 == part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        found = {r.user: r.msg for r in J.import_csv_logs(spark, str(tmp_path), NOW, multi_line=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == {f"u{i}": f"<{m}>" for i, m in rows}
