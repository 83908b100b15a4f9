"""Streaming runs over the event table, compared with the batch SQL.

The input ends with the newest row, which the watermark never passes; the SQL
leaves rows of that instant out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import detectors as D
from ..operators import intel as I
from ..operators.windows import US
from ..session import scratch
from ..streaming import stream as M
from .adapters import sec_events, sec_events_from, sql_text
from .anomaly import EWMA_SQL, RISK_SQL, over_events_recursive
from .catalog import over_events, query
from .detection import BRUTE_SQL, DAY, HITS_SQL
from .ingest import sites
from .intel import STORE_SQL, merged_store
from .web import BLOCK_WINDOW, BLOCKS_SQL

NOW = "0 seconds"


def events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return sec_events_from(M.stream_table(spark, sf_dir, "events.parquet", schema))


def of_type(name: str) -> str:
    return f"(SELECT max(ts_us) FROM sec WHERE event = '{name}')"


@query(over_events(HITS_SQL + " SELECT event_id, pattern_id, matched, src_ip FROM hits"))
def stream_signature_hits(spark, sf_dir):
    found = D.with_pattern(D.signature_hits(D.scanned(events(spark, sf_dir))))
    return M.run_available(found.select("event_id", "pattern_id", "matched", "src_ip"))


@query(over_events(HITS_SQL + """
SELECT event_id, pattern_id, left(matched, 60) AS matched, src_ip FROM dedup WHERE ts_us < (SELECT max(ts_us) FROM hits)"""))
def stream_pattern_hits(spark, sf_dir):
    found = M.hits_stream(events(spark, sf_dir), NOW, quiet_s=3650 * DAY)
    return M.run_available(found.select("event_id", "pattern_id", "matched", "src_ip"))


# The event table as growing log files.
@query(over_events(f"""
SELECT event_id, ts_us, event, "user", src_ip, host, msg FROM sec"""))
def stream_jsonl_events(spark, sf_dir):
    log = sec_events(spark, sf_dir).select(F.to_json(F.struct(
        (F.col("ts_us") / US).alias("ts"), "event", "user", "src_ip", "host", F.concat_ws("|", "event_id", "msg").alias("msg"))).alias("value"))
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    log.repartition(4).write.text(folder)
    found = M.stream_events(spark, folder, 0)
    number = F.substring_index("msg", "|", 1).cast("long")
    return M.run_available(found.select(
        number.alias("event_id"), "ts_us", "event", "user", "src_ip", "host", F.expr("substring(msg, instr(msg, '|') + 1)").alias("msg")))


@query(over_events(f"""
, w AS (SELECT event, ts_us // {3600 * US} AS b, count(*) AS n FROM sec GROUP BY 1, 2)
SELECT b * {3600 * US} AS start_us, (b + 1) * {3600 * US} AS end_us, event, n FROM w WHERE (b + 1) * {3600 * US} <= (SELECT max(ts_us) FROM sec)"""))
def stream_event_counts(spark, sf_dir):
    return M.run_available(M.counts_stream(events(spark, sf_dir), ["event"], "1 hour", delay=NOW))


@query(over_events(f"""
, w AS (SELECT "user", unnest(range(ts_us // {DAY * US} - 2, ts_us // {DAY * US} + 1)) AS b FROM sec WHERE event = 'AUTH_FAIL')
SELECT b * {DAY * US} AS start_us, (b + 3) * {DAY * US} AS end_us, "user", count(*) AS n FROM w
WHERE (b + 3) * {DAY * US} <= {of_type('AUTH_FAIL')} GROUP BY b, "user" HAVING count(*) >= 4"""))
def stream_sliding_fails(spark, sf_dir):
    fails = events(spark, sf_dir).where("event = 'AUTH_FAIL'")
    return M.run_available(M.counts_stream(fails, ["user"], "3 days", "1 day", NOW, min_count=4))


@query(over_events(f"""
, o AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY "user" ORDER BY ts_us) < {6 * 3600 * US} THEN 0 ELSE 1 END AS opens FROM sec)
, s AS (SELECT *, sum(opens) OVER (PARTITION BY "user" ORDER BY ts_us) AS sid FROM o)
SELECT "user", count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM s GROUP BY "user", sid
HAVING max(ts_us) + {6 * 3600 * US} <= (SELECT max(ts_us) FROM sec)"""))
def stream_sessions(spark, sf_dir):
    return M.run_available(M.session_stream(events(spark, sf_dir), ["user"], "6 hours", NOW))


@query(over_events(BRUTE_SQL + f"""
SELECT event_id, "user", n, first_us FROM brute WHERE ts_us < {of_type('AUTH_FAIL')}"""))
def stream_bruteforce(spark, sf_dir):
    fails = events(spark, sf_dir).where("event = 'AUTH_FAIL'")
    found = M.run_available(M.sliding_window_stream(fails, F.col("user"), 3 * DAY, 4, delay=NOW))
    return found.select("event_id", F.col("key").alias("user"), "n", "first_us")


@query(over_events(f"""
, f AS (SELECT *, lag(ts_us, 3) OVER (PARTITION BY atk_ip, "user" ORDER BY ts_us, event_id) AS back FROM sec WHERE event = 'AUTH_FAIL')
, g AS (SELECT *, count(*) OVER w AS n, count(DISTINCT "user") OVER w AS n_users, max(back) OVER w AS m FROM f
  WINDOW w AS (PARTITION BY atk_ip ORDER BY ts_us RANGE BETWEEN {6 * 3600 * US} PRECEDING AND CURRENT ROW))
SELECT event_id, atk_ip, n, n_users FROM g
WHERE n >= 3 AND n_users >= 3 AND (m IS NULL OR m < ts_us - {6 * 3600 * US}) AND ts_us < {of_type('AUTH_FAIL')}"""))
def stream_password_spray(spark, sf_dir):
    fails = events(spark, sf_dir).where("event = 'AUTH_FAIL'")
    found = M.run_available(M.sliding_window_stream(
        fails, F.col("atk_ip"), 6 * 3600, 3, member=F.col("user"), min_distinct=3, max_per_member=3, delay=NOW))
    return found.select("event_id", F.col("key").alias("atk_ip"), "n", F.col("n_distinct").alias("n_users"))


@query(over_events(f"""
, f AS (SELECT *, count(*) OVER w AS n, count(DISTINCT src_ip) OVER w AS n_ips FROM sec WHERE event = 'AUTH_FAIL'
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {3 * DAY * US} PRECEDING AND CURRENT ROW))
SELECT event_id, "user", n, n_ips FROM f WHERE n >= 4 AND n_ips >= 3 AND ts_us < {of_type('AUTH_FAIL')}"""))
def stream_distributed_bruteforce(spark, sf_dir):
    fails = events(spark, sf_dir).where("event = 'AUTH_FAIL' AND user NOT IN ('', 'unknown')")
    found = M.run_available(M.sliding_window_stream(
        fails, F.col("user"), 3 * DAY, 4, member=F.col("src_ip"), min_distinct=3, delay=NOW))
    return found.select("event_id", F.col("key").alias("user"), "n", F.col("n_distinct").alias("n_ips"))


@query(over_events(f"""
, f AS (SELECT *, count(DISTINCT split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2)) OVER w AS n_nets FROM sec WHERE event = 'AUTH_OK'
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {DAY * US} PRECEDING AND CURRENT ROW))
SELECT event_id, "user", n_nets FROM f WHERE n_nets >= 2 AND ts_us < {of_type('AUTH_OK')}"""))
def stream_impossible_travel(spark, sf_dir):
    logins = events(spark, sf_dir).where("event = 'AUTH_OK'")
    net = F.substring_index("src_ip", ".", 2)
    found = M.run_available(M.sliding_window_stream(logins, F.col("user"), DAY, 1, member=net, min_distinct=2, delay=NOW))
    return found.select("event_id", F.col("key").alias("user"), F.col("n_distinct").alias("n_nets"))


def by_time(rows, *cuts):
    """``rows`` in parts that follow each other in time."""
    bounds = [None, *cuts, None]
    return [
        rows.where((F.lit(a is None) | (F.col("ts_us") >= F.lit(a or 0))) & (F.lit(b is None) | (F.col("ts_us") < F.lit(b or 0))))
        for a, b in zip(bounds, bounds[1:])
    ]


# Borders of the files that arrive one after the other.
FIRST_CUT, SECOND_CUT = 1_704_800_000 * US, 1_705_700_000 * US


@query(over_events(f"""
, r AS (SELECT * FROM sec WHERE event = 'HTTP_REQ' AND regexp_matches(msg, {sql_text(R.EXFIL_REGEX)}))
, f AS (SELECT *, count(*) OVER (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {10 * DAY * US} PRECEDING AND CURRENT ROW) AS n FROM r)
SELECT event_id, "user", n FROM f WHERE n >= 3 AND ts_us < (SELECT max(ts_us) FROM r)"""))
def stream_exfil_bursts(spark, sf_dir):
    reads = D.scanned(sec_events(spark, sf_dir, "HTTP_REQ")).where(F.col("msg").rlike(R.EXFIL_REGEX))
    bursts = lambda rows: M.sliding_window_stream(rows, F.col("user"), 10 * DAY, 3, delay=NOW)
    found, _ = M.run_released(by_time(reads, FIRST_CUT, SECOND_CUT), bursts)
    return found.select("event_id", F.col("key").alias("user"), "n")


@query(over_events(BLOCKS_SQL + """
SELECT site, src_ip, blocked_us, hits FROM blocks
WHERE blocked_us < (SELECT max(ts_us) FROM (SELECT ts_us FROM hits UNION ALL SELECT ts_us FROM owasp_hits))"""))
def stream_auto_blocks(spark, sf_dir):
    requests = sec_events(spark, sf_dir, "HTTP_REQ")
    known = sites(spark, sf_dir)
    blocks = lambda rows: M.auto_block_stream(rows, known, window_s=BLOCK_WINDOW, threshold=3, delay=NOW)
    found, _ = M.run_released(by_time(requests, FIRST_CUT, SECOND_CUT), blocks)
    return found.select("site", F.col("key").alias("src_ip"), F.col("ts_us").alias("blocked_us"), "hits")


@query(over_events("""
SELECT "user", ts_us, event_id, src_ip, host FROM sec WHERE event = 'AUTH_OK' QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts_us DESC, event_id DESC) = 1"""))
def stream_latest_logins(spark, sf_dir):
    logins = sec_events(spark, sf_dir, "AUTH_OK").select("user", "ts_us", "event_id", "src_ip", "host")
    root = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for part in by_time(logins, FIRST_CUT, SECOND_CUT):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(logins.schema).parquet(f"{root}/in").withColumn("version", F.struct("ts_us", "event_id"))
        M.upsert_sink(stream, f"{root}/table", f"{root}/state", ["user"], "version", {"availableNow": True}, compact_after=1).awaitTermination()
    return M.latest_state(spark, f"{root}/table", ["user"], "version").drop("version")


# Some failures of the first days arrive with the last file and are too late.
LATE = f"event_id % 40 = 7 AND ts_us < {FIRST_CUT}"


@query(over_events(f"""
, f AS (SELECT *, count(*) OVER (PARTITION BY "user" ORDER BY ts_us RANGE BETWEEN {3 * DAY * US} PRECEDING AND CURRENT ROW) AS n
  FROM sec WHERE event = 'AUTH_FAIL' AND NOT ({LATE}))
SELECT event_id, "user", n, (SELECT count(*) FROM sec WHERE event = 'AUTH_FAIL' AND {LATE}) AS dropped
FROM f WHERE n >= 4 AND ts_us < {of_type('AUTH_FAIL')}"""))
def stream_late_rows(spark, sf_dir):
    fails = sec_events(spark, sf_dir, "AUTH_FAIL")
    parts = [*by_time(fails.where(f"NOT ({LATE})"), FIRST_CUT, SECOND_CUT), fails.where(LATE)]
    found, dropped = M.run_released(parts, lambda rows: M.sliding_window_stream(rows, F.col("user"), 3 * DAY, 4, delay=NOW))
    return found.select("event_id", F.col("key").alias("user"), "n", F.lit(dropped).cast("long").alias("dropped"))


@query(over_events_recursive("," + EWMA_SQL.format(
    key='"user"', value="num", rank='row_number() OVER (PARTITION BY "user" ORDER BY ts_us, event_id)', source="sec") + """
SELECT event_id, n AS n_sample, round(z, 4) AS z, n > 10 AND z >= 3 AS spike FROM step JOIN sec USING (event_id)
WHERE ts_us < (SELECT max(ts_us) FROM sec)"""))
def stream_ewma_spikes(spark, sf_dir):
    found = M.run_available(M.ewma_stream(events(spark, sf_dir), F.col("user"), F.col("num"), delay=NOW))
    return found.select("event_id", "n_sample", F.round("z", 4).alias("z"), "spike")


WINDOW = 6 * 3600


@query(over_events_recursive(f"""
, r AS (SELECT event_id, ts_us, host, ts_us // {US} AS s, row_number() OVER (PARTITION BY host ORDER BY ts_us, event_id) AS n FROM sec WHERE event = 'AUTH_FAIL')
, fold AS (SELECT *, s AS last_sent, true AS sent FROM r WHERE n = 1
  UNION ALL SELECT r.*, CASE WHEN r.s - f.last_sent <= {WINDOW} THEN f.last_sent ELSE r.s END, r.s - f.last_sent > {WINDOW}
  FROM fold f JOIN r ON r.host = f.host AND r.n = f.n + 1)
SELECT event_id, host, CASE WHEN sent THEN 'sent' ELSE 'deduped' END AS status FROM fold WHERE ts_us < {of_type('AUTH_FAIL')}"""))
def stream_alert_dedup(spark, sf_dir):
    fails = events(spark, sf_dir).where("event = 'AUTH_FAIL'")
    found = M.run_available(M.suppress_stream(fails, F.col("host"), window_s=WINDOW, delay=NOW))
    return found.select("event_id", F.col("key").alias("host"), "status")


@query(over_events(RISK_SQL.format(source="sec") + """
SELECT event_id, "user", coalesce(l, 0)::BIGINT AS logins, round(score, 1) AS score, factors FROM risk WHERE ts_us < (SELECT max(ts_us) FROM sec)"""))
def stream_ueba_risk(spark, sf_dir):
    found = M.run_available(M.risk_stream(events(spark, sf_dir), delay=NOW))
    return found.select("event_id", F.col("key").alias("user"), "logins", F.round("score", 1).alias("score"), "factors")


@query(over_events(STORE_SQL + """
SELECT event_id, s.ioc, feed_name AS ioc_feed, confidence FROM sec JOIN merged s ON lower(trim(src_ip)) = lower(s.ioc)"""))
def stream_ioc_enrich(spark, sf_dir):
    found = I.enrich(events(spark, sf_dir).select("event_id", "src_ip"), "src_ip", merged_store(spark, sf_dir))
    return M.run_available(found.select("event_id", "ioc", "ioc_feed", "confidence"))
