"""Log parsing. The raw lines are rendered from the event table; the SQL twins
state what a correct parser must give back, from the same columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.windows import US
from ..session import scratch
from ..sources import access_log as W
from ..sources import json_lines as J
from ..sources import syslog as L
from ..sources import windows_xml as X
from ..sources.regex_lines import parse_regex_lines
from .adapters import sec_events, table
from .catalog import over_events, query

INGEST_US = 1_700_000_000 * US


def quoted(name: str):
    return F.concat(F.lit('"'), F.col(name), F.lit('"'))


def seconds_text():
    return F.format_string("%d.%06d", F.expr(f"ts_us div {US}"), F.expr(f"ts_us % {US}"))


def json_text(**names: str):
    """A JSON object: key -> column, with the time as a number."""
    parts = [F.concat(F.lit(f'"{key}": '), quoted(col)) for key, col in names.items()]
    return F.concat(F.lit('{"ts": '), seconds_text(), F.lit(", "), F.concat_ws(", ", *parts), F.lit("}"))


def jsonl_lines(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    good = json_text(event="lower_event", user="user", src_ip="src_ip", host="host", msg="msg")
    line = (
        F.when(F.col("event_id") % 10 == 7, F.concat(F.lit("{broken "), "msg"))
        .when(F.col("event_id") % 10 == 8, F.concat(F.lit("# "), "msg"))
        .when(F.col("event_id") % 10 == 9, F.lit("   "))
        .otherwise(good)
    )
    return events.withColumn("lower_event", F.lower("event")).select("event_id", line.alias("line"))


@query(over_events(f"""
SELECT event_id, CASE WHEN bad THEN {INGEST_US} ELSE ts_us END AS ts_us,
  CASE WHEN bad THEN 'RAW' ELSE event END AS event, CASE WHEN bad THEN '-' ELSE "user" END AS "user",
  CASE WHEN bad THEN '0.0.0.0' ELSE src_ip END AS src_ip, CASE WHEN bad THEN '-' ELSE host END AS host,
  'Standard' AS asset_class, CASE WHEN bad THEN '{{broken ' || msg ELSE msg END AS msg
FROM (SELECT *, event_id % 10 = 7 AS bad FROM sec WHERE event_id % 10 NOT IN (8, 9))"""))
def parse_jsonl_events(spark, sf_dir):
    return J.parse_jsonl_events(jsonl_lines(spark, sf_dir), INGEST_US).select(
        "event_id", "ts_us", "event", "user", "src_ip", "host", "asset_class", "msg"
    )


def mixed_lines(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    kind = F.col("event_id") % 6
    cef = F.concat(
        F.lit("CEF:0|acme|sensor|1.2|"), "event", F.lit("|"), "user", F.lit("|5|src="), "src_ip",
        F.lit(" noise dst=10.0.0.1 src="), "atk_ip",
    )
    pri = F.col("k") + 60
    bsd = F.concat(
        F.lit("<"), pri, F.lit(">Jan "), F.format_string("%2d", F.col("k") % 28 + 1), F.lit(" 10:20:30 "), "host",
        F.lit(" sshd"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("["), F.col("k") + 1000, F.lit("]"))).otherwise(""),
        F.lit(": "), "msg",
    )
    line = (
        F.when(kind == 0, json_text(event="event", user="user", src_ip="src_ip", host="host", msg="msg"))
        .when(kind == 1, cef)
        .when(kind == 2, bsd)
        .when(kind == 3, F.concat(F.lit("plain "), "msg", F.lit("\r\n")))
        .when(kind == 4, F.col("event_id").cast("string"))
        .otherwise(F.lit("\n"))
    )
    return events.select("event_id", line.alias("line"))


MIXED_SQL = f"""
, m AS (SELECT *, event_id % 6 AS kind FROM sec)
, parsed AS (SELECT event_id, CASE WHEN kind = 0 THEN ts_us ELSE {INGEST_US} END AS ts_us,
  CASE kind WHEN 0 THEN event WHEN 1 THEN 'CEF' WHEN 2 THEN 'SYSLOG' WHEN 5 THEN 'EMPTY' ELSE 'RAW' END AS event,
  CASE kind WHEN 0 THEN 'json' WHEN 1 THEN 'cef' WHEN 2 THEN 'bsd_syslog' WHEN 3 THEN 'none' WHEN 4 THEN 'json_scalar' END AS parsed,
  CASE WHEN kind = 0 THEN "user" END AS "user", CASE WHEN kind IN (0, 2) THEN host END AS host,
  CASE kind WHEN 0 THEN msg WHEN 2 THEN msg WHEN 3 THEN 'plain ' || msg WHEN 4 THEN event_id::VARCHAR WHEN 5 THEN '' END AS msg
  FROM m)"""


@query(over_events(MIXED_SQL + " SELECT * FROM parsed"))
def parse_log_lines(spark, sf_dir):
    return L.parse_log_lines(mixed_lines(spark, sf_dir), INGEST_US).select(
        "event_id", "ts_us", "event", "parsed", "user", "host", "msg"
    )


@query(over_events(MIXED_SQL + " SELECT coalesce(parsed, 'empty') AS parsed, count(*) AS lines FROM parsed GROUP BY 1"))
def ingest_counters(spark, sf_dir):
    counted = L.ingest_counters(L.parse_log_lines(mixed_lines(spark, sf_dir), INGEST_US))
    return counted.withColumn("parsed", F.coalesce("parsed", F.lit("empty")))


@query(over_events("""
SELECT event_id, '0' AS format_version, 'acme' AS vendor, 'sensor' AS product, '1.2' AS product_version,
  event AS signature, "user" AS name, '5' AS severity, atk_ip AS src, '10.0.0.1' AS dst, 2::INT AS n_extensions
FROM sec WHERE event_id % 6 = 1"""))
def parse_cef(spark, sf_dir):
    records = L.parse_cef(mixed_lines(spark, sf_dir))
    return records.select(
        "event_id", "format_version", "vendor", "product", "product_version", "signature", "name", "severity",
        F.col("extensions")["src"].alias("src"), F.col("extensions")["dst"].alias("dst"),
        F.size("extensions").alias("n_extensions"),
    )


@query(over_events("""
SELECT event_id, (k + 60)::INT AS pri, ((k + 60) // 8)::INT AS facility, ((k + 60) % 8)::INT AS severity, 'Jan' AS month,
  (k % 28 + 1)::VARCHAR AS day, '10:20:30' AS "time", host, 'sshd' AS app,
  CASE WHEN k % 2 = 0 THEN (k + 1000)::VARCHAR END AS pid, msg
FROM sec WHERE event_id % 6 = 2"""))
def parse_bsd_syslog(spark, sf_dir):
    return L.parse_bsd_syslog(mixed_lines(spark, sf_dir))


# Three spellings of the same record, and one line that is not an object.
@query(over_events(f"""
SELECT event_id, CASE WHEN event_id % 4 = 2 THEN {INGEST_US} ELSE ts_us END AS ts_us,
  CASE WHEN event_id % 4 = 2 THEN 'JSON_LOG' ELSE event END AS event, "user",
  CASE WHEN event_id % 4 = 1 THEN '0.0.0.0' ELSE src_ip END AS src_ip, host, msg
FROM sec WHERE event_id % 4 <> 3"""))
def normalize_json_logs(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    iso = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    aliased = F.concat(
        F.lit('{"@timestamp": "'), iso, F.lit('", "UserName": "'), "user", F.lit('", "source_ip": "", "Device": "'), "host",
        F.lit('", "type": "'), "event", F.lit('", "message": "'), "msg", F.lit('"}'),
    )
    partial = F.concat(
        F.lit('{"time": "yesterday", "account": "'), "user", F.lit('", "ip": "'), "src_ip", F.lit('", "computer": "'), "host",
        F.lit('", "log": "'), "msg", F.lit('"}'),
    )
    kind = F.col("event_id") % 4
    line = (
        F.when(kind == 0, json_text(event="event", user="user", src_ip="src_ip", host="host", msg="msg"))
        .when(kind == 1, aliased).when(kind == 2, partial).otherwise(F.lit("[1, 2]"))
    )
    normal = J.normalize_json_logs(events.select("event_id", line.alias("line")), INGEST_US)
    return normal.select("event_id", "ts_us", "event", "user", "src_ip", "host", "msg")


@query(over_events("""
SELECT event_id, ts_us, event, "user", src_ip, '-' AS host, msg, 'csv_import' AS parsed FROM sec"""))
def import_csv_logs(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    header = ["Timestamp", "UserName", "Source_IP", "Event_Type", "Message"]
    csv = F.concat_ws(",", seconds_text(), "user", "src_ip", "event", F.concat(F.lit('"'), "msg", F.lit('"')))
    schema = ", ".join(f"{h} string" for h in header)
    rows = events.select("event_id", F.from_csv(csv, schema).alias("c")).select("event_id", "c.*")
    normal = J.normalize_csv_rows(rows, INGEST_US, header)
    return normal.select("event_id", "ts_us", "event", "user", "src_ip", "host", "msg", "parsed")


# Every third message is cut by a line break and holds a quotation.
@query(over_events("""
SELECT ts_us, event, "user", src_ip, CASE WHEN event_id % 3 = 0 THEN 'no ' || event_id || chr(10) || 'says "' || msg || '"' ELSE 'no ' || event_id || ' ' || msg END AS msg FROM sec"""))
def import_csv_files(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    number = F.concat(F.lit("no "), "event_id")
    msg = F.when(F.col("event_id") % 3 == 0, F.concat(number, F.lit('\nsays "'), "msg", F.lit('"'))).otherwise(F.concat_ws(" ", number, "msg"))
    rows = events.select(
        seconds_text().alias("Timestamp"), F.col("user").alias("UserName"), F.col("src_ip").alias("Source_IP"), F.col("event").alias("Event_Type"), msg.alias("Message"))
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    rows.repartition(3).write.options(header=True, escape='"', quoteAll=True).csv(folder)
    return J.import_csv_logs(spark, folder, INGEST_US, multi_line=True).select("ts_us", "event", "user", "src_ip", "msg")


# Every third message is cut by a line break and holds a quotation.
@query(over_events("""
SELECT ts_us, event, "user", src_ip, CASE WHEN event_id % 3 = 0 THEN 'no ' || event_id || chr(10) || 'says "' || msg || '"' ELSE 'no ' || event_id || ' ' || msg END AS msg FROM sec"""))
def import_csv_files(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    number = F.concat(F.lit("no "), "event_id")
    msg = F.when(F.col("event_id") % 3 == 0, F.concat(number, F.lit('\nsays "'), "msg", F.lit('"'))).otherwise(F.concat_ws(" ", number, "msg"))
    rows = events.select(
        seconds_text().alias("Timestamp"), F.col("user").alias("UserName"), F.col("src_ip").alias("Source_IP"), F.col("event").alias("Event_Type"), msg.alias("Message"))
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    rows.repartition(3).write.options(header=True, escape='"', quoteAll=True).csv(folder)
    return J.import_csv_logs(spark, folder, INGEST_US, multi_line=True).select("ts_us", "event", "user", "src_ip", "msg")


def xml_records(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    iso = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ip = F.when(F.col("k") % 3 == 0, F.lit("-")).otherwise(F.col("src_ip"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Audit"/><EventID>'),
        F.col("k") + 4600, F.lit('</EventID><Level>0</Level><TimeCreated SystemTime="'), iso,
        F.lit('"/><Channel>Security</Channel><Computer>'), "host",
        F.lit('</Computer></System><EventData><Data Name="TargetUserName">'), "user",
        F.lit('</Data><Data Name="IpAddress">'), ip, F.lit("</Data></EventData></Event>"),
    )
    broken = F.when(F.col("event_id") % 10 == 9, F.lit("<Event><System>")).otherwise(xml)
    return events.select("event_id", broken.alias("xml"), F.lit("Security").alias("channel"))


@query(over_events("""
SELECT event_id, ts_us, (k + 4600)::VARCHAR AS win_event_id, 'Security' AS channel, '0' AS level, host AS computer, host, "user",
  CASE WHEN k % 3 = 0 THEN '0.0.0.0' ELSE src_ip END AS src_ip,
  'Windows Event ' || (k + 4600) || ' on ' || host || ' (Security) TargetUserName=' || "user" || '; IpAddress='
    || CASE WHEN k % 3 = 0 THEN '-' ELSE src_ip END AS msg
FROM sec WHERE event_id % 10 <> 9"""))
def parse_windows_events(spark, sf_dir):
    parsed = X.parse_windows_events(xml_records(spark, sf_dir).drop("channel"), INGEST_US)
    return parsed.select("event_id", "ts_us", "win_event_id", "channel", "level", "computer", "host", "user", "src_ip", "msg")


@query(over_events("""
SELECT event_id, (k + 4600)::VARCHAR AS win_event_id, '0' AS level, 'Audit' AS provider, host,
  strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS event_time,
  '[Security] EventID ' || (k + 4600) || ' Audit: ' || "user" || '; ' || CASE WHEN k % 3 = 0 THEN '-' ELSE src_ip END AS msg
FROM sec WHERE event_id % 10 <> 9
UNION ALL SELECT event_id, '', '', '', '-', '', '[Security] EventID ? : no event data' FROM sec WHERE event_id % 10 = 9"""))
def parse_winevt_raw(spark, sf_dir):
    return X.parse_winevt_raw(xml_records(spark, sf_dir)).select(
        "event_id", "win_event_id", "level", "provider", "host", "event_time", "msg"
    )


@query(over_events("""
SELECT event_id, ts_us, src_ip, "user", msg, 'REGEX_LOG' AS event, '-' AS host, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS code
FROM sec WHERE event_id % 5 <> 4"""))
def regex_log_parser(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    code = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" code="), "k")).otherwise("")
    good = F.concat("src_ip", F.lit(" - "), "user", F.lit(" ["), seconds_text(), F.lit("]"), code, F.lit(' "'), "msg", F.lit('"'))
    lines = events.select("event_id", F.when(F.col("event_id") % 5 == 4, F.lit("no match")).otherwise(good).alias("line"))
    pattern = r'(?P<ip>\d+\.\d+\.\d+\.\d+) - (?P<user_name>\S+) \[(?P<time>[^\]]+)\](?: code=(?P<code>\d+))? "(?P<message>[^"]+)"'
    parsed = parse_regex_lines(lines, pattern.replace("user_name", "username"), INGEST_US)
    return parsed.select(
        "event_id", "ts_us", "src_ip", "user", "msg", "event", "host",
        F.try_element_at("regex_fields", F.lit("code")).alias("code"),
    )


@query(over_events("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '-' ELSE host END AS host, CASE WHEN event_id % 4 <> 3 THEN 'sshd[' || k || ']' END AS app,
  CASE WHEN event_id % 4 = 3 THEN 'boot marker ' || event_id ELSE '[sshd[' || k || ']] ' || msg END AS msg FROM sec"""))
def parse_journald(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    entry = F.concat(F.lit("Sep 22 17:33:01.123456 "), "host", F.lit(" sshd["), "k", F.lit("]: "), "msg")
    line = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("boot marker "), "event_id")).otherwise(entry)
    return L.parse_journald(events.select("event_id", line.alias("line"))).select("event_id", "host", "app", "msg")


STATUSES = (200, 401, 403, 404, 500)


def access_lines(spark, sf_dir):
    """Access-log lines over the request events; every eleventh is damaged."""
    events = sec_events(spark, sf_dir, "HTTP_REQ")
    path = F.concat(F.when(F.col("k") % 2 == 0, "/login?u=").otherwise("/page/"), "k")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("k") % 5 + 1).cast("int"))
    time = F.date_format(F.timestamp_micros("ts_us"), "dd/MMM/yyyy:HH:mm:ss")
    agent = F.when(F.col("k") % 3 == 0, "").otherwise(' "-" "agent/1.0"')
    good = F.concat(
        "src_ip", F.lit(" - "), "user", F.lit(" ["), time, F.lit(' +0000] "GET '), path, F.lit(' HTTP/1.1" '), status, F.lit(" "),
        F.col("k") + 100, agent,
    )
    line = F.when(F.col("event_id") % 11 == 10, F.concat(F.lit("damaged "), "msg")).otherwise(good)
    return events.select("event_id", F.col("host").alias("site"), line.alias("line"))


ACCESS_SQL = f"""
, req AS (SELECT event_id, src_ip AS ip, "user", 'GET' AS method, CASE WHEN k % 2 = 0 THEN '/login?u=' ELSE '/page/' END || k AS url,
   'HTTP/1.1' AS proto, ([{', '.join(map(str, STATUSES))}])[(k % 5 + 1)::INT]::INT AS status, (k + 100)::VARCHAR AS bytes,
   CASE WHEN k % 3 = 0 THEN '' ELSE 'agent/1.0' END AS ua, ts_us // {US} * {US} AS ts_us, host AS site
  FROM sec WHERE event = 'HTTP_REQ' AND event_id % 11 <> 10)"""
ACCESS_EVENTS_SQL = ACCESS_SQL + """
, ev AS (SELECT event_id, ts_us, 'HTTP_REQ' AS event, "user", ip AS src_ip, site AS host, concat_ws(' ', method, url, proto, status, bytes) AS msg,
    url, status AS http_status FROM req
  UNION ALL SELECT event_id, ts_us, 'AUTH_FAIL', "user", ip, site, 'WEB AUTH_FAIL ' || method || ' ' || url || ' -> ' || status, url, NULL
  FROM req WHERE status IN (401, 403) AND url LIKE '%login%')"""


def requests(spark, sf_dir):
    return W.parse_access_log(access_lines(spark, sf_dir), INGEST_US)


@query(over_events(ACCESS_SQL + " SELECT * FROM req"))
def parse_access_log(spark, sf_dir):
    return requests(spark, sf_dir)


@query(over_events(ACCESS_EVENTS_SQL + " SELECT * FROM ev"))
def access_log_events(spark, sf_dir):
    return W.access_events(requests(spark, sf_dir)).select(
        "event_id", "ts_us", "event", "user", "src_ip", "host", "msg", "url", "http_status"
    )


def sites(spark, sf_dir):
    """One site per host that serves requests; host-4 stays unregistered."""
    hosts = sec_events(spark, sf_dir, "HTTP_REQ").where("host <> 'host-4'").groupBy("host").agg(F.min("event_id").alias("m"))
    return hosts.select((F.regexp_extract("host", r"(\d+)$", 1).cast("int") + 1).alias("site_id"), F.col("host").alias("name"))


SITES_SQL = """
, sites AS (SELECT (right(host, 1)::INT + 1)::INT AS site_id, host AS name FROM sec WHERE event = 'HTTP_REQ' AND host <> 'host-4' GROUP BY host)"""


# Odd events name their site by number, even ones by name.
@query(over_events(ACCESS_SQL + SITES_SQL + """
SELECT site_id, name AS site, count(r.event_id) AS parsed, count(*) - count(r.event_id) AS skipped,
  sum(CASE WHEN r.event_id IS NULL THEN 0 WHEN status IN (401, 403) AND url LIKE '%login%' THEN 2 ELSE 1 END)::BIGINT AS events
FROM sec s JOIN sites ON name = s.host LEFT JOIN req r ON r.event_id = s.event_id WHERE s.event = 'HTTP_REQ' GROUP BY 1, 2"""))
def ingest_accounting(spark, sf_dir):
    number = (F.regexp_extract("site", r"(\d+)$", 1).cast("int") + 1).cast("string")
    lines = access_lines(spark, sf_dir).withColumn("site_ref", F.when(F.col("event_id") % 2 == 1, number).otherwise(F.col("site")))
    lines = lines.drop("site")
    return W.ingest_accounting(lines, sites(spark, sf_dir), INGEST_US)[0]


@query(over_events("""
SELECT event_id FROM sec WHERE event = 'HTTP_REQ' AND host = 'host-4'"""))
def ingest_rejects(spark, sf_dir):
    lines = access_lines(spark, sf_dir).withColumnRenamed("site", "site_ref")
    return W.ingest_accounting(lines, sites(spark, sf_dir), INGEST_US)[1].select("event_id")


@query(over_events(SITES_SQL + """
SELECT event_id, site_id, name AS site_name FROM sec LEFT JOIN sites ON name = host OR site_id::VARCHAR = host"""))
def site_lookup(spark, sf_dir):
    refs = sec_events(spark, sf_dir).select("event_id", F.col("host").alias("site_ref"))
    return W.resolve_sites(refs, sites(spark, sf_dir)).select("event_id", "site_id", "site_name")
