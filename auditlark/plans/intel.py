"""Threat-indicator queries. Feeds are rendered from pages, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import intel as I
from ..operators.windows import US
from ..sources import feeds as S
from .adapters import sec_events, table
from .catalog import over_events, query

AS_OF_US = 1_706_400_000 * US  # 2024-01-28 00:00:00 UTC
HOST_SQL = "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"


def url_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    line = F.when(F.col("page_id") % 9 == 8, F.concat(F.lit("# "), "url")).otherwise(
        F.when(F.col("page_id") % 9 == 7, F.lit("not a url")).otherwise(F.upper("url"))
    )
    return pages.select(F.col("page_id").alias("line_id"), line.alias("line"))


URL_IOCS_SQL = f"""
url_iocs AS (SELECT min(page_id) AS line_id, {HOST_SQL} AS ioc, 'domain' AS ioc_type FROM pages WHERE page_id % 9 < 7 GROUP BY 2)"""


@query("WITH" + URL_IOCS_SQL + """
SELECT line_id, ioc, ioc_type, 'AbuseCH-URLhaus-LIVE' AS feed_name FROM url_iocs""")
def ti_urlhaus(spark, sf_dir):
    return S.url_list(url_lines(spark, sf_dir)).select("line_id", "ioc", "ioc_type", "feed_name")


def ip_lines(spark, sf_dir):
    events = sec_events(spark, sf_dir, "AUTH_FAIL")
    line = F.when(F.col("k") % 7 == 0, F.concat(F.lit("#"), "src_ip")).when(F.col("k") % 7 == 1, F.lit("bad.value 1")).otherwise(
        F.concat("src_ip", F.lit(",,  first seen "), "k")
    )
    return events.select(F.col("event_id").alias("line_id"), line.alias("line"))


IP_IOCS_SQL = """
, ip_iocs AS (SELECT min(event_id) AS line_id, src_ip AS ioc, 'ip' AS ioc_type FROM sec
  WHERE event = 'AUTH_FAIL' AND k % 7 > 1 GROUP BY 2)"""


@query(over_events(IP_IOCS_SQL + " SELECT line_id, ioc, ioc_type, 'AbuseCH-Feodo-LIVE' AS feed_name FROM ip_iocs"))
def ti_iplist(spark, sf_dir):
    return S.ip_list(ip_lines(spark, sf_dir)).select("line_id", "ioc", "ioc_type", "feed_name")


def csv_lines(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    kind = F.col("k") % 6
    value = (
        F.when(kind == 0, F.concat("src_ip", F.lit(":443")))
        .when(kind == 1, F.concat(F.lit("Bad-"), "user", F.lit(".Example.net")))
        .when(kind == 2, F.concat(F.lit("http://u:p@"), "user", F.lit(".evil.example.org:8080/x?y=1")))
        .when(kind == 3, F.upper(F.sha2(F.col("user"), 256)))
        .when(kind == 4, F.md5("user"))
        .otherwise(F.lit("nodots"))
    )
    types = F.element_at(F.array(*[F.lit(t) for t in ("ip:port", "domain", "url", "sha256_hash", "md5_hash", "domain")]), (kind + 1).cast("int"))
    line = F.concat(
        F.lit('"2024-01-01","'), F.col("event_id"), F.lit('", "'), value, F.lit('", "'), types, F.lit('", "'),
        F.when(F.col("k") % 2 == 0, "").otherwise("c2"), F.lit('", "fam'), F.col("k"), F.lit('"'),
    )
    return events.select(F.col("event_id").alias("line_id"), line.alias("line"))


@query(over_events("""
, raw AS (SELECT event_id, k, CASE k % 6 WHEN 0 THEN src_ip WHEN 1 THEN 'bad-' || "user" || '.example.net'
    WHEN 2 THEN "user" || '.evil.example.org' ELSE sha256("user") END AS ioc,
    CASE k % 6 WHEN 0 THEN 'ip' WHEN 3 THEN 'sha256' ELSE 'domain' END AS ioc_type FROM sec WHERE k % 6 < 4)
SELECT event_id AS line_id, ioc, ioc_type, 'AbuseCH-ThreatFox-LIVE: ' || CASE WHEN k % 2 = 0 THEN 'threatfox-ioc' ELSE 'c2' END
  || ' (fam' || k || ')' AS description
FROM raw QUALIFY row_number() OVER (PARTITION BY ioc ORDER BY event_id) = 1"""))
def ti_threatfox(spark, sf_dir):
    return S.indicator_csv(csv_lines(spark, sf_dir)).select("line_id", "ioc", "ioc_type", "description")


@query(over_events("""
SELECT event_id AS line_id, ioc, ioc_type, 'OTX pulse: pulse ' || event_id AS description FROM (
  SELECT event_id, src_ip AS ioc, 'ip' AS ioc_type FROM sec
  UNION ALL SELECT event_id, "user" || '.example.com', 'domain' FROM sec)"""))
def ti_pulses(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    json = F.concat(
        F.lit('{"results": [{"name": "pulse '), F.col("event_id"), F.lit('", "indicators": [{"type": "IPv4", "indicator": "'), "src_ip",
        F.lit('"}, {"type": "FileHash-MD5", "indicator": "x"}, {"type": "hostname", "indicator": " '), "user",
        F.lit('.example.com "}, {"type": "domain", "indicator": ""}]}, {"name": "empty", "indicators": []}]}'),
    )
    return S.pulses(events.select(F.col("event_id").alias("line_id"), json.alias("json"))).select(
        "line_id", "ioc", "ioc_type", "description"
    )


def csv_rows(spark, sf_dir):
    """A user CSV: every event proposes its source; some rows are invalid."""
    events = sec_events(spark, sf_dir)
    types = F.when(F.col("k") % 5 == 0, "email").when(F.col("k") % 5 == 1, " IP ").otherwise("ip")
    confidence = F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, "999").when(F.col("k") % 4 == 2, "abc").otherwise(F.col("k").cast("string"))
    return events.select(
        F.col("event_id").alias("line_id"), F.concat(F.lit(" "), "src_ip").alias("IOC"), types.alias("ioc_type"),
        confidence.alias("confidence"), F.lit("scan").alias("threat_type"), F.lit(None).cast("string").alias("description"),
    )


def ip_store(spark, sf_dir):
    """The store after the IP list was imported."""
    return S.ip_list(ip_lines(spark, sf_dir)).select(
        "ioc", "ioc_type", "feed_name", F.lit(85).alias("confidence"), "threat_type", "description"
    )


STORE_SQL = IP_IOCS_SQL + """
, store AS (SELECT ioc, ioc_type, 'AbuseCH-Feodo-LIVE' AS feed_name, 85 AS confidence FROM ip_iocs)
, csv AS (SELECT event_id, src_ip AS ioc, 'ip' AS ioc_type, k % 5 <> 0 AS valid,
    greatest(1, least(100, CASE k % 4 WHEN 0 THEN 60 WHEN 1 THEN 999 WHEN 2 THEN 60 ELSE k END))::INT AS confidence FROM sec)
, merged AS (SELECT * FROM store UNION ALL
  SELECT ioc, ioc_type, 'CSV-Import', confidence FROM (SELECT * FROM csv WHERE valid
    QUALIFY row_number() OVER (PARTITION BY ioc ORDER BY event_id) = 1) c WHERE ioc NOT IN (SELECT ioc FROM store))"""


def merged_store(spark, sf_dir):
    checked = S.ioc_csv(csv_rows(spark, sf_dir)).where("valid")
    return I.merge_iocs(ip_store(spark, sf_dir), checked)


@query(over_events(STORE_SQL + """
SELECT (SELECT count(*) FROM merged WHERE feed_name = 'CSV-Import') AS added,
  (SELECT count(*) FROM csv WHERE valid) - (SELECT count(*) FROM merged WHERE feed_name = 'CSV-Import') AS skipped,
  (SELECT count(*) FROM csv WHERE NOT valid) AS invalid"""))
def ti_csv_import(spark, sf_dir):
    return I.import_counts(ip_store(spark, sf_dir), S.ioc_csv(csv_rows(spark, sf_dir)))


@query(over_events(STORE_SQL + " SELECT * FROM merged"))
def ti_merge(spark, sf_dir):
    return merged_store(spark, sf_dir).select("ioc", "ioc_type", "feed_name", "confidence")


@query(over_events(STORE_SQL + """
SELECT event_id, s.ioc, feed_name AS ioc_feed, confidence FROM sec JOIN merged s ON lower(trim(src_ip)) = lower(s.ioc)"""))
def ioc_enrich(spark, sf_dir):
    events = sec_events(spark, sf_dir).select("event_id", "src_ip")
    return I.enrich(events, "src_ip", merged_store(spark, sf_dir)).select("event_id", "ioc", "ioc_feed", "confidence")


@query(over_events(IP_IOCS_SQL + """
SELECT event_id, src_ip FROM sec WHERE lower(trim(src_ip)) NOT IN (SELECT lower(ioc) FROM ip_iocs)"""))
def ioc_clean_events(spark, sf_dir):
    events = sec_events(spark, sf_dir).select("event_id", "src_ip")
    return I.enrich(events, "src_ip", ip_store(spark, sf_dir), "left_anti")


@query("WITH" + URL_IOCS_SQL + f""" SELECT page_id, ioc FROM pages LEFT JOIN url_iocs ON {HOST_SQL} = ioc""")
def ioc_enrich_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", S.url_host(F.col("url")).alias("host"))
    iocs = S.url_list(url_lines(spark, sf_dir)).withColumn("confidence", F.lit(85))
    return I.enrich(pages, "host", iocs, "left").select("page_id", "ioc")


IPV4_IN_TEXT = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


# Addresses quoted in documents; those quoted in low-quality documents form the block list.
@query(f"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4_IN_TEXT}')) AS ip FROM documents),
i AS (SELECT DISTINCT ip FROM d JOIN labels USING (doc_id) WHERE quality = 0)
SELECT doc_id, ip, i.ip IS NOT NULL AS listed FROM (SELECT DISTINCT doc_id, ip FROM d) d LEFT JOIN i USING (ip)""")
def ioc_enrich_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IPV4_IN_TEXT), F.lit(0)))).alias("ip"))
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    listed = S.ip_list(found.join(poor, "doc_id", "left_semi").select(F.col("doc_id").alias("line_id"), F.col("ip").alias("line")))
    return I.enrich(found, "ip", listed.withColumn("confidence", F.lit(85)), "left").select(
        "doc_id", "ip", F.col("ioc").isNotNull().alias("listed")
    )


def feeds(spark, sf_dir):
    """One feed per host; its last update is the host's last flow record."""
    events = sec_events(spark, sf_dir)
    return events.groupBy("host").agg(
        F.max(F.when((F.col("event") == "NET_FLOW") & (F.col("k") < 3), F.col("ts_us"))).alias("u"), F.count("*").alias("n")
    ).select(
        F.when(F.col("host") == "host-0", "AbuseCH-Feodo-LIVE").when(F.col("host") == "host-1", "OTX-Live").otherwise(F.col("host")).alias("feed_name"),
        F.date_format(F.timestamp_micros("u"), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("last_updated"),
        (F.col("n") % 24 + 1).cast("int").alias("update_interval_h"), F.lit("simulated").alias("feed_kind"),
    )


FEEDS_SQL = """
, feeds AS (SELECT CASE host WHEN 'host-0' THEN 'AbuseCH-Feodo-LIVE' WHEN 'host-1' THEN 'OTX-Live' ELSE host END AS feed_name,
    max(CASE WHEN event = 'NET_FLOW' AND k < 3 THEN ts_us END) // 1000000 * 1000000 AS u,
    (count(*) % 24 + 1)::INT AS update_interval_h FROM sec GROUP BY host)
, f AS (SELECT *, strftime(make_timestamp(u), '%Y-%m-%d %H:%M:%S UTC') AS last_updated,
    coalesce({as_of} > u + update_interval_h * 3600000000, true) AS stale FROM feeds)""".replace("{as_of}", str(AS_OF_US))


@query(over_events(FEEDS_SQL + " SELECT feed_name, last_updated FROM f WHERE stale"))
def ti_stale_feeds(spark, sf_dir):
    return I.stale_feeds(feeds(spark, sf_dir), AS_OF_US).select("feed_name", "last_updated")


@query(over_events(FEEDS_SQL + STORE_SQL + """
SELECT feed_name, last_updated, coalesce(n, 0) AS ioc_count, stale FROM f
LEFT JOIN (SELECT feed_name, count(*) AS n FROM merged GROUP BY 1) USING (feed_name)"""))
def ti_feed_health(spark, sf_dir):
    return I.feed_health(feeds(spark, sf_dir), merged_store(spark, sf_dir), AS_OF_US).select(
        "feed_name", "last_updated", "ioc_count", "stale"
    )


@query(over_events(FEEDS_SQL + f"""
, up AS (SELECT CASE WHEN "user" = 'user0' THEN 'OTX-Live' ELSE 'feed-' || "user" END AS feed_name, max(ts_us) AS u FROM sec GROUP BY "user")
SELECT coalesce(f.feed_name, up.feed_name) AS feed_name,
  coalesce(strftime(make_timestamp(up.u), '%Y-%m-%d %H:%M:%S UTC'), f.last_updated) AS last_updated,
  coalesce(f.update_interval_h, 12)::INT AS update_interval_h,
  CASE WHEN up.feed_name IS NULL THEN 'simulated' ELSE 'live' END AS feed_kind
FROM f FULL JOIN up ON f.feed_name = up.feed_name"""))
def ti_feed_upsert(spark, sf_dir):
    updates = sec_events(spark, sf_dir).groupBy("user").agg(F.max("ts_us").alias("u")).select(
        F.when(F.col("user") == "user0", "OTX-Live").otherwise(F.concat(F.lit("feed-"), "user")).alias("feed_name"),
        F.date_format(F.timestamp_micros("u"), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("last_updated"),
        F.lit(12).alias("update_interval_h"), F.lit("live").alias("feed_kind"),
    )
    return I.upsert_feeds(feeds(spark, sf_dir), updates)


@query(over_events(STORE_SQL + " SELECT ioc, feed_name, confidence FROM merged ORDER BY confidence DESC, ioc LIMIT 200"))
def ti_top_iocs(spark, sf_dir):
    return I.top_iocs(merged_store(spark, sf_dir)).select("ioc", "feed_name", "confidence")


@query(over_events(FEEDS_SQL + f"""
SELECT CASE feed_name WHEN 'OTX-Live' THEN 'otx' ELSE 'abusech' END AS feed_group, max(u) AS last_us,
  {AS_OF_US} - coalesce(max(u), 0) >= CASE feed_name WHEN 'OTX-Live' THEN 12 ELSE 6 END * 3600000000 AS due
FROM f WHERE feed_name IN ('OTX-Live', 'AbuseCH-Feodo-LIVE') GROUP BY feed_name"""))
def ti_refresh_due(spark, sf_dir):
    return I.refresh_due(feeds(spark, sf_dir), AS_OF_US)
