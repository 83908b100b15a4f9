"""Web-traffic queries over the request events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import detectors as D
from ..operators import web as W
from ..operators.windows import US
from ..session import materialize
from .adapters import sec_events, sql_text
from .catalog import over_events, query
from .detection import BRUTE_SQL, HITS_SQL, OWASP_SQL, brute, hits
from .ingest import ACCESS_SQL, SITES_SQL, requests, sites

DAY = 86_400
AS_OF_US = 1_706_400_000 * US - 1  # the last microsecond of 2024-01-27 UTC
BLOCK_WINDOW = 3 * DAY

SITE_HITS_SQL = HITS_SQL + SITES_SQL + f"""
, owasp AS (SELECT *, {OWASP_SQL.replace('{0}', 'msg')} AS labels FROM sec WHERE event IN ('HTTP_REQ', 'APP_INPUT', 'RAW'))
, owasp_hits AS (SELECT * FROM owasp WHERE labels <> '')
, site_hits AS (SELECT site_id, name AS site, event_id, ts_us, src_ip, kind, label FROM (
    SELECT event_id, ts_us, src_ip, 'pattern' AS kind, pattern_id AS label, host, pattern_id || '|' || left(matched, 60) AS txt FROM dedup
    UNION ALL SELECT event_id, ts_us, src_ip, 'injection', labels, host, left(msg, 60) FROM owasp_hits) h JOIN sites ON name = host
  WHERE src_ip NOT IN ('', '0.0.0.0', '-', 'unknown')
  QUALIFY row_number() OVER (PARTITION BY kind, src_ip, txt, ts_us ORDER BY event_id) = 1)"""
BLOCKS_SQL = SITE_HITS_SQL + f"""
, counted AS (SELECT *, count(*) OVER (PARTITION BY site_id, src_ip ORDER BY ts_us RANGE BETWEEN {BLOCK_WINDOW * US} PRECEDING AND CURRENT ROW) AS n
  FROM site_hits)
, blocks AS (SELECT site_id, site, src_ip, ts_us AS blocked_us, n AS hits FROM counted WHERE n >= 3
  QUALIFY row_number() OVER (PARTITION BY site_id, src_ip ORDER BY ts_us, event_id, kind) = 1)"""
MODE_SQL = BRUTE_SQL + BLOCKS_SQL + """
, contained AS (SELECT src_ip, min(ts_us) AS c FROM (
    SELECT src_ip, ts_us FROM dedup WHERE soar_action = 'block_ip' AND src_ip NOT IN ('', '0.0.0.0')
    UNION ALL SELECT src_ip, ts_us FROM owasp_hits UNION ALL SELECT src_ip, ts_us FROM brute) GROUP BY 1)
, moded AS (SELECT b.*, CASE WHEN c <= blocked_us THEN 'ENGINE AUTO-CONTAINMENT' ELSE 'POLICY BLOCK' END AS mode,
    hits || ' hits by ' || src_ip || ' within 259200 s, 3 are enough' AS reason
  FROM blocks b LEFT JOIN contained USING (src_ip))"""


def owasp_found(spark, sf_dir):
    return D.owasp_scan(D.scanned(sec_events(spark, sf_dir, "HTTP_REQ")))


def found_site_hits(spark, sf_dir):
    return W.site_hits(D.dedup_hits(hits(spark, sf_dir)), owasp_found(spark, sf_dir), sites(spark, sf_dir))


def found_blocks(spark, sf_dir):
    return W.auto_blocks(found_site_hits(spark, sf_dir), window_s=BLOCK_WINDOW)


def moded_blocks(spark, sf_dir, decisions=None):
    """Blocks with their mode; detections are stored once, as several steps read them."""
    if decisions is None:
        decisions = materialize(D.response_decisions(D.dedup_hits(hits(spark, sf_dir))))
    owasp = materialize(owasp_found(spark, sf_dir))
    contained = W.containments(decisions, owasp, brute(spark, sf_dir))
    blocks = W.auto_blocks(W.site_hits(decisions, owasp, sites(spark, sf_dir)), window_s=BLOCK_WINDOW)
    return W.auto_block_mode(blocks, contained)


@query(over_events(SITE_HITS_SQL + " SELECT * FROM site_hits"))
def site_hits(spark, sf_dir):
    return found_site_hits(spark, sf_dir)


@query(over_events(BLOCKS_SQL + " SELECT * FROM blocks"))
def auto_blocks(spark, sf_dir):
    return found_blocks(spark, sf_dir).drop("reason")


@query(over_events(MODE_SQL + " SELECT site, src_ip, blocked_us, mode FROM moded"))
def auto_block_mode(spark, sf_dir):
    return moded_blocks(spark, sf_dir).select("site", "src_ip", "blocked_us", "mode")


BLOCK_INCIDENTS_SQL = MODE_SQL + """
, block_incidents AS (SELECT blocked_us AS ts_us, src_ip AS source_ip, site AS target_host, 'WEBSITE_AUTO_BLOCK' AS classification,
  reason AS detection_rule, mode || ': ' || reason AS mitigating_action, 'website-monitor' AS privilege_state FROM moded)"""


@query(over_events(BLOCK_INCIDENTS_SQL + " SELECT * FROM block_incidents"))
def block_incidents(spark, sf_dir):
    return W.block_incidents(moded_blocks(spark, sf_dir)).drop("raw_record")


def unblocks(spark, sf_dir):
    """Operators lift a block when the source later logs in cleanly (k < 30)."""
    logins = sec_events(spark, sf_dir, "AUTH_OK").where("k < 30")
    known = sites(spark, sf_dir).select("site_id", F.col("name").alias("host"))
    return logins.join(known, "host").select("site_id", "src_ip", F.col("ts_us").alias("unblocked_us"), "event_id")


UNBLOCKS_SQL = """
, unblocks AS (SELECT site_id, src_ip, ts_us AS unblocked_us, event_id FROM sec JOIN sites ON name = host WHERE event = 'AUTH_OK' AND k < 30)"""


@query(over_events(BLOCKS_SQL + UNBLOCKS_SQL + """
SELECT site_id, site, src_ip, blocked_us FROM blocks b WHERE NOT EXISTS (
  SELECT 1 FROM unblocks u WHERE u.site_id = b.site_id AND u.src_ip = b.src_ip AND u.unblocked_us >= b.blocked_us)"""))
def active_blocks(spark, sf_dir):
    return W.active_blocks(found_blocks(spark, sf_dir), unblocks(spark, sf_dir)).select("site_id", "site", "src_ip", "blocked_us")


@query(over_events(BLOCKS_SQL + UNBLOCKS_SQL + """
, ep AS (SELECT c.*, (SELECT count(*) FROM unblocks u WHERE u.site_id = c.site_id AND u.src_ip = c.src_ip AND u.unblocked_us < c.ts_us) AS episode
  FROM counted c WHERE n >= 3)
SELECT site_id, site, src_ip, ts_us AS blocked_us, n AS hits FROM ep
QUALIFY row_number() OVER (PARTITION BY site_id, src_ip, episode ORDER BY ts_us, event_id, kind) = 1"""))
def auto_block_episodes(spark, sf_dir):
    blocks = W.auto_blocks(found_site_hits(spark, sf_dir), window_s=BLOCK_WINDOW, unblocks=unblocks(spark, sf_dir))
    return blocks.drop("reason")


MINUTES_SQL = f"""
SELECT s.name AS site, strftime(make_timestamp({AS_OF_US} - age * {60 * US}), '%H:%M') AS minute, count(x.ts_us) AS n
FROM sites s CROSS JOIN (SELECT unnest(range(0, 1440)) AS age) LEFT JOIN {{rows}} x
  ON x.site = s.name AND x.ts_us <= {AS_OF_US} AND ({AS_OF_US} - x.ts_us) // {60 * US} = age
GROUP BY s.name, age"""


@query(over_events(ACCESS_SQL + SITES_SQL + MINUTES_SQL.replace("{rows}", "req")))
def requests_per_minute(spark, sf_dir):
    return W.per_minute(requests(spark, sf_dir), sites(spark, sf_dir), AS_OF_US, minutes=1440)


@query(over_events(SITE_HITS_SQL + MINUTES_SQL.replace("{rows}", "site_hits")))
def hits_per_minute(spark, sf_dir):
    return W.per_minute(found_site_hits(spark, sf_dir), sites(spark, sf_dir), AS_OF_US, minutes=1440)


@query(over_events(SITE_HITS_SQL + """
SELECT site, ts_us, kind, label, src_ip, event_id FROM site_hits ORDER BY ts_us DESC, event_id DESC, kind DESC LIMIT 20"""))
def latest_site_hits(spark, sf_dir):
    return D.latest(found_site_hits(spark, sf_dir).drop("site_id"), 20, ("ts_us", "event_id", "kind"))


@query(over_events(ACCESS_SQL + """
SELECT ip AS source_ip, count(*) AS requests FROM req GROUP BY 1 ORDER BY requests DESC, source_ip LIMIT 10"""))
def top_ips(spark, sf_dir):
    return W.top_values(requests(spark, sf_dir), F.col("ip"), "source_ip")


@query(over_events(ACCESS_SQL + """
SELECT site, url, count(*) AS requests FROM req GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, url) <= 10"""))
def top_urls(spark, sf_dir):
    return W.top_values(requests(spark, sf_dir), W.short_url(F.col("url")), "url", by="site")


@query(over_events(ACCESS_SQL + " SELECT site, status::VARCHAR AS status, count(*) AS requests FROM req GROUP BY 1, 2"))
def status_breakdown(spark, sf_dir):
    return W.status_breakdown(requests(spark, sf_dir))


@query(over_events(ACCESS_SQL + BLOCKS_SQL + """
SELECT name AS site, coalesce(requests, 0) AS requests, coalesce(unique_ips, 0) AS unique_ips, coalesce(hits, 0) AS hits, coalesce(blocks, 0) AS blocks
FROM sites LEFT JOIN (SELECT site, count(*) AS requests, count(DISTINCT ip) AS unique_ips FROM req GROUP BY 1) r ON r.site = name
LEFT JOIN (SELECT site, count(*) AS hits FROM site_hits GROUP BY 1) h ON h.site = name
LEFT JOIN (SELECT site, count(*) AS blocks FROM blocks GROUP BY 1) b ON b.site = name"""))
def site_kpis(spark, sf_dir):
    return W.site_kpis(
        requests(spark, sf_dir), found_site_hits(spark, sf_dir), found_blocks(spark, sf_dir), sites(spark, sf_dir)
    )


@query(over_events("""
SELECT host AS site, CASE WHEN bool_or(k < 10) AND bool_or(k >= 10) THEN 'file+http' WHEN bool_or(k < 10) THEN 'http' ELSE 'file' END AS ingest_sources
FROM sec WHERE event = 'HTTP_REQ' GROUP BY 1"""))
def site_sources(spark, sf_dir):
    rows = sec_events(spark, sf_dir, "HTTP_REQ")
    return W.site_sources(rows.select(F.col("host").alias("site"), F.when(F.col("k") < 10, "http").otherwise("file").alias("source")))
