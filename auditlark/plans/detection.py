"""Rule detections on the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import detectors as D
from ..operators.windows import US
from .adapters import sec_events, sql_text, table
from .catalog import over_events, query

DAY = 86_400

# Host 4 falls silent on 20 January, and the clock stands at the end of the month.
SILENT_US, CLOCK_US = 1_705_708_800 * US, 1_706_745_600 * US

# The event table is sparse (a user has at most 17 events in three days), so
# the registered runs use wider windows than the library defaults.
PATTERN_ROWS_SQL = "(VALUES " + ", ".join(
    f"({i}, {sql_text(p.pattern_id)}, {sql_text(p.name)}, {sql_text(p.owasp)}, {sql_text(p.control_id)}, "
    f"{sql_text(p.severity)}, {sql_text(p.soar_action)}, {sql_text(p.signatures[0] if p.signatures else '')})"
    for i, p in enumerate(R.PATTERNS)
) + ") AS pat(position, pattern_id, name, owasp, control_id, severity, soar_action, rx)"

HITS_SQL = f"""
, hits AS (
  SELECT s.*, pattern_id, name, owasp, control_id, severity, soar_action, regexp_extract(msg, rx, 0) AS matched
  FROM sec s, {PATTERN_ROWS_SQL}
  WHERE event IN ('HTTP_REQ', 'APP_INPUT', 'RAW') AND rx <> '' AND regexp_matches(msg, rx)
), dedup AS (
  SELECT * FROM hits QUALIFY row_number() OVER (
    PARTITION BY pattern_id, src_ip, left(matched, 60) ORDER BY ts_us, event_id) = 1
)"""


def hits(spark, sf_dir):
    return D.with_pattern(D.signature_hits(D.scanned(sec_events(spark, sf_dir, "HTTP_REQ"))))


@query(over_events(HITS_SQL + " SELECT event_id, pattern_id, matched, src_ip FROM hits"))
def signature_hits(spark, sf_dir):
    return D.signature_hits(D.scanned(sec_events(spark, sf_dir, "HTTP_REQ"))).select("event_id", "pattern_id", "matched", "src_ip")


@query(f"""SELECT page_id, pattern_id, regexp_extract(html, rx, 0) AS matched FROM pages, {PATTERN_ROWS_SQL}
WHERE rx <> '' AND regexp_matches(html, rx)""")
def page_signature_hits(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return D.signature_hits(pages, "html").select("page_id", "pattern_id", "matched")


OWASP_SQL = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches({{0}}, {sql_text(rx)}) THEN '{label}' END" for label, rx in R.OWASP_CLASSES
) + "], lambda x: x IS NOT NULL), ',')"


@query(over_events(f"""
SELECT event_id, src_ip, {OWASP_SQL.replace('{0}', 'msg')} AS labels FROM sec
WHERE event IN ('HTTP_REQ', 'APP_INPUT', 'RAW') AND labels <> ''"""))
def owasp_line_scan(spark, sf_dir):
    found = D.owasp_scan(D.scanned(sec_events(spark, sf_dir, "HTTP_REQ")))
    return found.select("event_id", "src_ip", F.array_join("signatures", ",").alias("labels"))


@query(f"""SELECT page_id, {OWASP_SQL.replace('{0}', 'html')} AS labels FROM pages WHERE labels <> ''""")
def page_owasp_scan(spark, sf_dir):
    found = D.owasp_scan(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return found.select("page_id", F.array_join("signatures", ",").alias("labels"))


BRUTE_SQL = f"""
, fails AS (
  SELECT *, count(*) OVER w AS n, min(ts_us) OVER w AS first_us, list(ts_us) OVER w AS seen
  FROM sec WHERE event = 'AUTH_FAIL'
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {3 * DAY * US} PRECEDING AND CURRENT ROW)
), brute AS (SELECT * EXCLUDE (seen), list_sort(seen)[4] AS nth_us FROM fails WHERE n >= 4)"""


def brute(spark, sf_dir):
    return D.bruteforce_windows(sec_events(spark, sf_dir, "AUTH_FAIL"), keys=("user",), window_s=3 * DAY, threshold=4)


@query(over_events(BRUTE_SQL + """
SELECT event_id, "user", src_ip, host, asset_class, n, first_us, ts_us AS last_us, nth_us FROM brute"""))
def bruteforce_windows(spark, sf_dir):
    return brute(spark, sf_dir).select(
        "event_id", "user", "src_ip", "host", "asset_class", "n", "first_us", "last_us", "nth_us"
    )


@query(over_events(BRUTE_SQL + """
SELECT event_id, "user", round(greatest(0, ts_us + 2500000 - nth_us) / 1000000.0::DOUBLE, 3) AS latency_s FROM brute"""))
def detection_latency(spark, sf_dir):
    found = D.detection_latency(brute(spark, sf_dir), F.col("last_us") + 2_500_000)
    return found.select("event_id", "user", "latency_s")


@query(over_events(BRUTE_SQL + """
SELECT "user", min(ts_us) AS first_crossing_us, max(ts_us) AS last_us, arg_max(n, (ts_us, event_id)) AS "count"
FROM brute GROUP BY 1"""))
def active_attacks(spark, sf_dir):
    return D.active_attacks(brute(spark, sf_dir), ("user",))


@query(over_events(f"""
, f AS (SELECT *, lag(ts_us, 3) OVER (PARTITION BY atk_ip, "user" ORDER BY ts_us, event_id) AS back
        FROM sec WHERE event = 'AUTH_FAIL' AND atk_ip NOT IN ('', '0.0.0.0'))
, g AS (SELECT *, count(*) OVER w AS n, count(DISTINCT "user") OVER w AS n_users, max(back) OVER w AS m FROM f
  WINDOW w AS (PARTITION BY atk_ip ORDER BY ts_us RANGE BETWEEN {6 * 3600 * US} PRECEDING AND CURRENT ROW))
SELECT event_id, atk_ip, n, n_users FROM g
WHERE n >= 3 AND n_users >= 3 AND (m IS NULL OR m < ts_us - {6 * 3600 * US})"""))
def password_spray(spark, sf_dir):
    found = D.password_spray(
        sec_events(spark, sf_dir, "AUTH_FAIL"), ip="atk_ip", window_s=6 * 3600, min_users=3, min_fails=3, max_per_user=3
    )
    return found.select("event_id", "atk_ip", "n", "n_users")


@query(over_events(f"""
, f AS (SELECT *, count(*) OVER w AS n, count(DISTINCT src_ip) OVER w AS n_ips FROM sec
  WHERE event = 'AUTH_FAIL' AND "user" NOT IN ('', 'unknown')
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {3 * DAY * US} PRECEDING AND CURRENT ROW))
SELECT event_id, "user", n, n_ips FROM f WHERE n >= 4 AND n_ips >= 3"""))
def distributed_bruteforce(spark, sf_dir):
    found = D.distributed_bruteforce(sec_events(spark, sf_dir, "AUTH_FAIL"), window_s=3 * DAY, min_ips=3, min_fails=4)
    return found.select("event_id", "user", "n", "n_ips")


@query(over_events(f"""
, f AS (SELECT *, count(DISTINCT split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2)) OVER w AS n_nets
  FROM sec WHERE event = 'AUTH_OK' AND "user" NOT IN ('', '-', 'unknown') AND src_ip <> '' AND src_ip NOT LIKE '10.%'
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {DAY * US} PRECEDING AND CURRENT ROW))
SELECT event_id, "user", src_ip, n_nets FROM f WHERE n_nets >= 2"""))
def impossible_travel(spark, sf_dir):
    found = D.impossible_travel(sec_events(spark, sf_dir, "AUTH_OK"), window_s=DAY)
    return found.select("event_id", "user", "src_ip", "n_nets")


@query(over_events(f"""
, f AS (SELECT *, count(*) OVER (PARTITION BY "user" ORDER BY ts_us
    RANGE BETWEEN {10 * DAY * US} PRECEDING AND CURRENT ROW) AS n
  FROM sec WHERE event = 'HTTP_REQ' AND regexp_matches(msg, {sql_text(R.EXFIL_REGEX)}))
SELECT event_id, "user", n FROM f WHERE n >= 3"""))
def exfil_bursts(spark, sf_dir):
    found = D.exfil_bursts(sec_events(spark, sf_dir, "HTTP_REQ"), window_s=10 * DAY, threshold=3, keys=("user",))
    return found.select("event_id", "user", "n")


# Behavioural detections in the shape of signature hits; the text they are known by is the user or source they speak of.
GAP_SQL = f"""
, g_heard AS (SELECT * FROM sec WHERE host <> 'host-4' OR ts_us < {SILENT_US})
, g_count AS (SELECT host, ts_us // {3600 * US} AS b, count(*) AS c, min(ts_us) AS lo FROM g_heard GROUP BY ALL)
, g_lim AS (SELECT host, min(lo) AS lo FROM g_count GROUP BY 1)
, g_cal AS (SELECT host, lo, unnest(range(lo // {3600 * US}, {CLOCK_US // (3600 * US)} + 1)) AS b FROM g_lim)
, g_rows AS (SELECT g_cal.host, g_cal.lo, g_cal.b, coalesce(g_count.c, 0) AS current,
   sum(coalesce(g_count.c, 0)) OVER (PARTITION BY g_cal.host ORDER BY g_cal.b ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / 5.0::DOUBLE AS baseline
   FROM g_cal LEFT JOIN g_count ON g_count.host = g_cal.host AND g_count.b = g_cal.b)
, gaps AS (SELECT host, b * {3600 * US} AS bucket_us, current, baseline FROM g_rows
  WHERE lo <= (b - 5) * {3600 * US} AND baseline >= 2.0 AND current < 0.5::DOUBLE * baseline)"""


def gaps(spark, sf_dir):
    heard = sec_events(spark, sf_dir).where((F.col("host") != "host-4") | (F.col("ts_us") < SILENT_US))
    return D.telemetry_gap(heard, keys=("host",), bucket_s=3600, min_mean=2.0, ratio=0.5, as_of_us=CLOCK_US)


@query(over_events(GAP_SQL + " SELECT * FROM gaps"))
def telemetry_gap(spark, sf_dir):
    return gaps(spark, sf_dir).select("host", "bucket_us", "current", "baseline")


BEHAVE_SQL = GAP_SQL + f"""
, b_spray AS (SELECT *, count(*) OVER w AS n, count(DISTINCT "user") OVER w AS n_users, max(back) OVER w AS m FROM (
    SELECT *, lag(ts_us, 3) OVER (PARTITION BY atk_ip, "user" ORDER BY ts_us, event_id) AS back FROM sec
    WHERE event = 'AUTH_FAIL' AND atk_ip NOT IN ('', '0.0.0.0'))
  WINDOW w AS (PARTITION BY atk_ip ORDER BY ts_us RANGE BETWEEN {6 * 3600 * US} PRECEDING AND CURRENT ROW))
, b_wide AS (SELECT *, count(*) OVER w AS n, count(DISTINCT src_ip) OVER w AS n_ips FROM sec
  WHERE event = 'AUTH_FAIL' AND "user" NOT IN ('', 'unknown')
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {3 * DAY * US} PRECEDING AND CURRENT ROW))
, b_travel AS (SELECT *, count(DISTINCT split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2)) OVER w AS n_nets FROM sec
  WHERE event = 'AUTH_OK' AND "user" NOT IN ('', '-', 'unknown') AND src_ip <> '' AND src_ip NOT LIKE '10.%'
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {DAY * US} PRECEDING AND CURRENT ROW))
, b_exfil AS (SELECT *, count(*) OVER (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {10 * DAY * US} PRECEDING AND CURRENT ROW) AS n
  FROM sec WHERE event = 'HTTP_REQ' AND regexp_matches(msg, {sql_text(R.EXFIL_REGEX)}))
, behave AS (
  SELECT event_id, ts_us, "user", atk_ip AS src_ip, host, asset_class, 'PASSWORD_SPRAY' AS pattern_id, 'source ' || atk_ip AS matched FROM b_spray
    WHERE n >= 3 AND n_users >= 3 AND (m IS NULL OR m < ts_us - {6 * 3600 * US})
  UNION ALL SELECT event_id, ts_us, "user", src_ip, host, asset_class, 'DISTRIBUTED_BRUTEFORCE', 'user ' || "user" FROM b_wide WHERE n >= 4 AND n_ips >= 3
  UNION ALL SELECT event_id, ts_us, "user", src_ip, host, asset_class, 'IMPOSSIBLE_TRAVEL', 'user ' || "user" FROM b_travel WHERE n_nets >= 2
  UNION ALL SELECT event_id, ts_us, "user", src_ip, host, asset_class, 'EXFILTRATION', 'user ' || "user" FROM b_exfil WHERE n >= 3
  UNION ALL SELECT -1, bucket_us + {3600 * US}, '-', '-', host, 'Standard', 'TELEMETRY_GAP', 'host ' || host FROM gaps)"""
EVERY_SQL = BEHAVE_SQL + f"""
, every_hit AS (SELECT event_id, ts_us, "user", src_ip, host, asset_class, pattern_id, matched FROM hits
  UNION ALL SELECT * FROM behave)
, known AS (SELECT e.*, p.name, p.owasp, p.severity, p.soar_action, p.control_id FROM every_hit e JOIN {PATTERN_ROWS_SQL.replace(' AS pat(', ' AS p(')} USING (pattern_id)
  QUALIFY row_number() OVER (PARTITION BY pattern_id, src_ip, left(matched, 60) ORDER BY ts_us, event_id) = 1)"""
BEHAVIOUR_SQL = HITS_SQL + EVERY_SQL


def behaviours(spark, sf_dir):
    """Spray, distributed attempts, travel, exfiltration and silent hosts as pattern hits."""
    fails, logins = sec_events(spark, sf_dir, "AUTH_FAIL"), sec_events(spark, sf_dir, "AUTH_OK")
    of_user = F.concat(F.lit("user "), "user")
    spray = D.password_spray(fails, ip="atk_ip", window_s=6 * 3600, min_users=3, min_fails=3, max_per_user=3).withColumn("src_ip", F.col("atk_ip"))
    wide = D.distributed_bruteforce(fails, window_s=3 * DAY, min_ips=3, min_fails=4)
    travel = D.impossible_travel(logins, window_s=DAY)
    exfil = D.exfil_bursts(sec_events(spark, sf_dir, "HTTP_REQ"), window_s=10 * DAY, threshold=3, keys=("user",))
    found = D.behaviour_hits(spray, "PASSWORD_SPRAY", F.concat(F.lit("source "), "src_ip"))
    for rows, pattern in ((wide, "DISTRIBUTED_BRUTEFORCE"), (travel, "IMPOSSIBLE_TRAVEL"), (exfil, "EXFILTRATION")):
        found = found.unionByName(D.behaviour_hits(rows, pattern, of_user))
    return found.unionByName(D.gap_hits(gaps(spark, sf_dir), bucket_s=3600))


def every_hit(spark, sf_dir):
    """Signature and behavioural hits, each pattern, source and text once."""
    columns = ["event_id", "ts_us", "user", "src_ip", "host", "asset_class", "pattern_id", "matched"]
    signed = D.signature_hits(D.scanned(sec_events(spark, sf_dir, "HTTP_REQ"))).select(*columns)
    return D.dedup_hits(D.with_pattern(signed.unionByName(behaviours(spark, sf_dir).select(*columns))))


@query(over_events(BEHAVIOUR_SQL + """
SELECT event_id, ts_us, pattern_id, name, owasp, control_id, severity, src_ip, "user", host, left(matched, 120) AS matched FROM known"""))
def pattern_hits(spark, sf_dir):
    return every_hit(spark, sf_dir).select(
        "event_id", "ts_us", "pattern_id", "name", "owasp", "control_id", "severity", "src_ip", "user", "host", "matched"
    )


@query(over_events(BEHAVE_SQL + """
SELECT event_id, pattern_id, src_ip, matched FROM behave QUALIFY row_number() OVER (PARTITION BY pattern_id, src_ip, left(matched, 60) ORDER BY ts_us, event_id) = 1"""))
def behaviour_pattern_hits(spark, sf_dir):
    found = D.dedup_hits(D.with_pattern(behaviours(spark, sf_dir)))
    return found.select("event_id", "pattern_id", "src_ip", "matched")


# Door and badge readers are not in the event table; failed logins on a host stand in.
@query(over_events("""
SELECT event_id, "user", host FROM (SELECT *, CASE WHEN event <> 'AUTH_FAIL' THEN event
  WHEN k % 2 = 0 THEN 'BADGE_FAIL' ELSE 'PHYSICAL_FAIL' END AS door FROM sec)
WHERE door IN ('PHYSICAL_FAIL', 'BADGE_FAIL')"""))
def physical_failures(spark, sf_dir):
    reader = F.when(F.col("k") % 2 == 0, "BADGE_FAIL").otherwise("PHYSICAL_FAIL")
    events = sec_events(spark, sf_dir)
    doors = events.withColumn("event", F.when(F.col("event") == "AUTH_FAIL", reader).otherwise(F.col("event")))
    return D.physical_failures(doors).select("event_id", "user", "host")


HISTORY_SQL = f"""
, hist AS (SELECT *, (ts_us // {3600 * US}) % 24 AS hour,
    row_number() OVER (PARTITION BY "user" ORDER BY ts_us, event_id) AS t,
    row_number() OVER (PARTITION BY "user", src_ip ORDER BY ts_us, event_id) AS f,
    row_number() OVER (PARTITION BY "user", (ts_us // {3600 * US}) % 24 ORDER BY ts_us, event_id) AS h
  FROM sec WHERE event = 'AUTH_OK')"""


@query(over_events(HISTORY_SQL + """ SELECT event_id, "user", src_ip, t AS logins FROM hist WHERE f = 1 AND t >= 5"""))
def ueba_new_ip(spark, sf_dir):
    found = D.ueba_new_ip(D.login_history(sec_events(spark, sf_dir, "AUTH_OK")))
    return found.select("event_id", "user", "src_ip", "logins")


@query(over_events(HISTORY_SQL + """
SELECT event_id, "user", hour::INT AS hour, h AS hour_logins, t AS logins FROM hist WHERE t >= 10 AND h / t < 0.10"""))
def ueba_off_hours(spark, sf_dir):
    found = D.ueba_off_hours(D.login_history(sec_events(spark, sf_dir, "AUTH_OK")))
    return found.select("event_id", "user", "hour", "hour_logins", "logins")


FINDINGS_SQL = HISTORY_SQL + """
, findings AS (
  SELECT *, 'NEW_IP' AS kind,
    format('{}: address {} not seen in {} logins so far', "user", src_ip, t) AS detail
  FROM hist WHERE f = 1 AND t >= 5
  UNION ALL BY NAME
  SELECT *, 'OFF_HOURS' AS kind,
    format('{}: hour {} UTC has {}% of the logins', "user", hour, round(100 * (h / t))::INT) AS detail
  FROM hist WHERE t >= 10 AND h / t < 0.10)
, unique_findings AS (SELECT * FROM findings
  QUALIFY row_number() OVER (PARTITION BY "user", kind, detail ORDER BY ts_us, event_id) = 1)"""


@query(over_events(FINDINGS_SQL + """ SELECT event_id, "user", kind, detail FROM unique_findings"""))
def ueba_findings(spark, sf_dir):
    return D.ueba_findings(sec_events(spark, sf_dir, "AUTH_OK")).select("event_id", "user", "kind", "detail")


def host_assets(spark, sf_dir):
    """Assets keyed by the hosts seen in the events; risk is derived from the host number."""
    events = sec_events(spark, sf_dir)
    return events.groupBy(F.col("host").alias("hostname")).agg(
        F.max("asset_class").alias("classification"), (F.count("*") % 50 + 50).cast("int").alias("risk_score")
    )


ASSETS_SQL = """
, assets AS (SELECT host AS hostname, max(asset_class) AS classification, (count(*) % 50 + 50)::INT AS risk_score
  FROM sec GROUP BY 1)"""


@query(over_events(HITS_SQL + ASSETS_SQL + f"""
SELECT event_id, pattern_id, host, 'PISF-13.2' AS escalated_control FROM dedup JOIN assets ON hostname = host
WHERE classification = {sql_text(R.CLASS_CII)}"""))
def cii_escalation(spark, sf_dir):
    found = D.cii_escalation(D.dedup_hits(hits(spark, sf_dir)), host_assets(spark, sf_dir))
    return found.select("event_id", "pattern_id", "host", "escalated_control")


@query(over_events(BEHAVIOUR_SQL + """
SELECT event_id, pattern_id, src_ip, CASE WHEN soar_action = 'block_ip' AND src_ip NOT IN ('', '0.0.0.0') THEN 'block_ip'
  WHEN soar_action = 'kill_session' THEN 'kill_session' ELSE 'alert' END AS decision, severity = 'Critical' AS snapshot
FROM known"""))
def response_decisions(spark, sf_dir):
    found = D.response_decisions(every_hit(spark, sf_dir))
    return found.select("event_id", "pattern_id", "src_ip", "decision", "snapshot")


@query(over_events(f"""
SELECT event_id, src_ip, {OWASP_SQL.replace('{0}', 'msg')} AS labels, 'block_ip' AS decision, true AS snapshot FROM sec
WHERE event IN ('HTTP_REQ', 'APP_INPUT', 'RAW') AND labels <> ''"""))
def request_decisions(spark, sf_dir):
    found = D.owasp_decisions(D.owasp_scan(D.scanned(sec_events(spark, sf_dir, "HTTP_REQ"))))
    return found.select("event_id", "src_ip", F.array_join("signatures", ",").alias("labels"), "decision", "snapshot")


AS_OF_US = 1_706_400_000 * US  # 2024-01-28 00:00:00 UTC, inside the event range


@query(over_events(f"""
SELECT "user", count(*) AS fails FROM sec
WHERE event = 'AUTH_FAIL' AND ts_us BETWEEN {AS_OF_US - 3 * DAY * US} AND {AS_OF_US} GROUP BY 1"""))
def window_occupancy(spark, sf_dir):
    return D.window_occupancy(sec_events(spark, sf_dir, "AUTH_FAIL"), AS_OF_US, window_s=3 * DAY, keys=("user",))


@query(over_events(""" SELECT event_id, ts_us, event, "user", src_ip FROM sec ORDER BY ts_us DESC, event_id DESC LIMIT 80"""))
def recent_events(spark, sf_dir):
    return D.latest(sec_events(spark, sf_dir).select("event_id", "ts_us", "event", "user", "src_ip"), 80)


@query(over_events(BRUTE_SQL + FINDINGS_SQL + """
SELECT attacks, anomalies, CASE WHEN attacks > 0 THEN 'UNDER ATTACK' WHEN anomalies > 0 THEN 'ELEVATED' ELSE 'NOMINAL' END AS status
FROM (SELECT (SELECT count(DISTINCT "user") FROM brute) AS attacks, (SELECT count(*) FROM unique_findings) AS anomalies)"""))
def soc_status(spark, sf_dir):
    attacks = D.active_attacks(brute(spark, sf_dir), ("user",))
    return D.soc_status(attacks, D.ueba_findings(sec_events(spark, sf_dir, "AUTH_OK")))
