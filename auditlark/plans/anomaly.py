"""Statistical and behavioural anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies as A
from ..operators import stats as S
from ..operators import ueba as U
from ..operators.windows import US
from .adapters import sec_events, table
from .catalog import over_events, query


@query("""
SELECT l_orderkey, l_linenumber, round(z, 6) AS z FROM (
  SELECT l_orderkey, l_linenumber, (l_extendedprice - avg(l_extendedprice) OVER w) / stddev_pop(l_extendedprice) OVER w AS z
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) WHERE abs(z) >= 1.6""")
def lineitem_zscore_outliers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    found = S.zscore_outliers(items, ["l_returnflag"], "l_extendedprice", threshold=1.6)
    return found.select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


@query("""
SELECT event_id, event_type, value, round(z, 6) AS z FROM (
  SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY event_type)) WHERE n >= 3 AND abs(z) >= 3""")
def zscore_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return S.zscore_outliers(events, ["event_type"], "value").withColumn("z", F.round("z", 6))


@query("""
WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, event_type, value, round(0.6745::DOUBLE * (value - med) / mad, 6) AS mz
FROM events JOIN m USING (event_type) JOIN d USING (event_type)
WHERE mad > 0 AND abs(0.6745::DOUBLE * (value - med) / mad) >= 3.5""")
def mad_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    found = S.mad_outliers(events, ["event_type"], "value")
    return found.select("event_id", "event_type", "value", F.round("mz", 6).alias("mz"))


ENTROPY_SQL = """
WITH chars AS (SELECT {id}, c, count(*) AS n FROM (SELECT {id}, unnest(string_split({text}, '')) AS c FROM {table}) GROUP BY ALL),
ent AS (SELECT {id}, -sum(n / total * log2(n / total)) AS bits FROM (
  SELECT *, sum(n) OVER (PARTITION BY {id}) AS total FROM chars) GROUP BY 1)
"""


@query(ENTROPY_SQL.format(id="doc_id", text="text", table="documents") + """
SELECT doc_id, round(coalesce(bits, 0), 6) AS entropy FROM documents LEFT JOIN ent USING (doc_id)""")
def shannon_entropy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.entropy(docs, "text").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query(ENTROPY_SQL.format(id="page_id", text="url", table="pages") + """
SELECT page_id, url, round(bits, 6) AS entropy FROM pages JOIN ent USING (page_id) WHERE bits >= 4.0""")
def entropy_outliers(spark, sf_dir):
    found = S.entropy_outliers(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return found.select("page_id", "url", F.round("entropy", 6).alias("entropy"))


EWMA_SQL = """
ranked AS (SELECT {key} AS key, event_id, {value} AS x, {rank} AS n FROM {source}),
step AS (
  SELECT key, event_id, n, x, x AS m, 0.0::DOUBLE AS v, 0.0::DOUBLE AS z FROM ranked WHERE n = 1
  UNION ALL
  SELECT r.key, r.event_id, r.n, r.x, 0.3::DOUBLE * r.x + 0.7::DOUBLE * s.m,
    0.3::DOUBLE * (r.x - s.m) * (r.x - s.m) + 0.7::DOUBLE * s.v,
    (r.x - s.m) / greatest(sqrt(s.v), CASE WHEN s.m <> 0 THEN 0.05::DOUBLE * abs(s.m) ELSE 1e-6::DOUBLE END)
  FROM step s JOIN ranked r ON r.key = s.key AND r.n = s.n + 1)"""


@query("WITH RECURSIVE" + EWMA_SQL.format(
    key="user_id", value="value", rank="row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)", source="events",
) + """ SELECT event_id, n AS n_sample, round(z, 4) AS z, round(m, 4) AS mean, n > 10 AND z >= 3 AS spike FROM step""")
def ewma_spikes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")
    )
    scored = S.ewma_spikes(events, ["user_id"], "value")
    return scored.select("event_id", "n_sample", F.round("z", 4).alias("z"), F.round("mean", 4).alias("mean"), "spike")


RATE_SQL = f"""
series AS (
  SELECT host, ts_us, event_id, avg(rate) OVER (PARTITION BY host ORDER BY ts_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rate_mean,
    row_number() OVER (PARTITION BY host ORDER BY ts_us) - 5 AS n_sample
  FROM (SELECT host, ts_us, event_id, {US}.0::DOUBLE / (ts_us - lag(ts_us) OVER (PARTITION BY host ORDER BY ts_us)) AS rate
    FROM (SELECT host, ts_us, min(event_id) AS event_id FROM sec GROUP BY 1, 2))
  QUALIFY n_sample > 0)"""


@query(over_events("," + RATE_SQL + " SELECT event_id, host, n_sample, round(rate_mean, 8) AS rate_mean FROM series"))
def event_rate_series(spark, sf_dir):
    series = S.event_rate_series(sec_events(spark, sf_dir), ["host"])
    return series.select("event_id", "host", "n_sample", F.round("rate_mean", 8).alias("rate_mean"))


SPIKE_SQL = "," + RATE_SQL + "," + EWMA_SQL.format(key="host", value="rate_mean", rank="n_sample", source="series")


def over_events_recursive(body: str) -> str:
    return over_events(body).replace("WITH sec", "WITH RECURSIVE sec", 1)


@query(over_events_recursive(SPIKE_SQL + """
SELECT event_id, key AS host, n AS n_sample, round(least(100, 55 + least(45, 5 * z)), 1) AS score
FROM step WHERE n > 15 AND z >= 3"""))
def rate_spikes(spark, sf_dir):
    found = S.rate_spikes(sec_events(spark, sf_dir), ["host"])
    return found.select("event_id", "host", "n_sample", F.round("score", 1).alias("score"))


RISK_SQL = f"""
, b AS (SELECT *, (ts_us // {3600 * US}) % 24 AS hour, (event = 'AUTH_OK')::INT AS ok, (event = 'AUTH_FAIL')::INT AS fail
  FROM {{source}} WHERE "user" NOT IN ('', '-', 'unknown'))
, e AS (SELECT *, row_number() OVER u - 1 AS seen, sum(ok) OVER p AS l,
    sum(ok) OVER (PARTITION BY "user", src_ip ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_ip,
    sum(ok) OVER (PARTITION BY "user", host ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_host,
    sum(ok) OVER (PARTITION BY "user", hour ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l_hour,
    list(ts_us) OVER (PARTITION BY "user" ORDER BY ts_us, event_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS back
  FROM b WINDOW u AS (PARTITION BY "user" ORDER BY ts_us, event_id),
    p AS (PARTITION BY "user" ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, a AS (SELECT *, sum(fail) OVER q AS rf, count(*) OVER q AS ra,
    len(list_filter(back, lambda t: t >= ts_us - {600 * US})) AS recent, len(back) AS n,
    greatest(1.0::DOUBLE, (back[-1] - back[1]) / {60 * US}.0::DOUBLE) AS span
  FROM e WHERE ok + fail = 1
  WINDOW q AS (PARTITION BY "user" ORDER BY ts_us, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
, parts AS (SELECT *, coalesce(l, 0) >= 5 AS trusted,
    coalesce(l_ip, 0) = 0 AND src_ip <> '0.0.0.0' AS new_ip,
    coalesce(l_hour, 0) / greatest(1, coalesce(l, 0)) < 0.10 AS off_hours,
    ra >= 5 AND rf / ra >= 0.5 AS failures,
    coalesce(recent >= 10 AND recent / 10.0 > 5 * n / span, false) AS burst,
    coalesce(l_host, 0) = 0 AND host <> '-' AS new_host FROM a)
, risk AS (SELECT *, CASE WHEN trusted THEN least(100.0::DOUBLE, round(
      CASE WHEN new_ip THEN 35 ELSE 0 END + CASE WHEN off_hours THEN 25 ELSE 0 END
      + CASE WHEN failures THEN 20.0::DOUBLE * least(1.0::DOUBLE, rf / ra) ELSE 0 END
      + CASE WHEN burst THEN 15 ELSE 0 END + CASE WHEN new_host THEN 5 ELSE 0 END, 1)) ELSE 0.0::DOUBLE END AS score,
    CASE WHEN trusted THEN concat_ws(',', CASE WHEN new_ip THEN 'new_ip' END, CASE WHEN off_hours THEN 'off_hours' END,
      CASE WHEN failures THEN 'failures' END, CASE WHEN burst THEN 'burst' END, CASE WHEN new_host THEN 'new_host' END)
    ELSE '' END AS factors FROM parts)"""


@query(over_events(RISK_SQL.format(source="sec") + """
SELECT event_id, "user", coalesce(l, 0)::BIGINT AS logins, score, factors FROM risk"""))
def ueba_risk(spark, sf_dir):
    scored = U.user_risk(sec_events(spark, sf_dir))
    return scored.select("event_id", "user", "logins", "score", F.array_join("factors", ",").alias("factors"))


@query(over_events("""
, l AS (SELECT "user", count(*) AS logins_observed, count(DISTINCT src_ip) AS known_ips, count(DISTINCT host) AS known_hosts
  FROM sec WHERE event = 'AUTH_OK' GROUP BY 1)
, r AS (SELECT "user", avg((event = 'AUTH_FAIL')::INT) AS ratio FROM (SELECT * FROM sec WHERE event IN ('AUTH_OK', 'AUTH_FAIL')
  QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts_us DESC, event_id DESC) <= 50) GROUP BY 1)
SELECT "user", logins_observed, known_ips, known_hosts, round(coalesce(ratio, 0), 3) AS recent_fail_ratio,
  round(least(100, coalesce(ratio, 0) * 60), 1) AS posture_score, logins_observed >= 5 AS baseline_trusted
FROM l LEFT JOIN r USING ("user")"""))
def user_risk_table(spark, sf_dir):
    return U.user_posture(sec_events(spark, sf_dir))


# Host names in the table are short; a tenth of the events gets a hashed name.
def dga_events(spark, sf_dir):
    events = sec_events(spark, sf_dir)
    name = F.concat(
        F.substring(F.md5(F.concat("user", F.lit("/"), F.col("k"))), 1, 20),
        F.lit("-wxyzq."), F.substring(F.md5(F.col("user")), 1, 6), F.lit(".net"),
    )
    return events.withColumn("host", F.when(F.col("k") % 10 == 0, name).otherwise(F.col("host")))


DGA_SQL = """
, dga AS MATERIALIZED (SELECT * REPLACE (CASE WHEN k % 10 = 0 THEN substr(md5("user" || '/' || k), 1, 20) || '-wxyzq.' || substr(md5("user"), 1, 6)
  || '.net' ELSE host END AS host) FROM sec)
, dchars AS (SELECT host, c, count(*) AS n FROM (SELECT host, unnest(string_split(lower(host), '')) AS c
  FROM (SELECT DISTINCT host FROM dga WHERE contains(host, '.') AND length(host) >= 12)) GROUP BY ALL)
, dent AS (SELECT host, -sum(n / total * log2(n / total)) AS bits FROM (
  SELECT *, sum(n) OVER (PARTITION BY host) AS total FROM dchars) GROUP BY 1)
, dfound AS (SELECT dga.*, bits, least(100, 45 + (bits - 4.2::DOUBLE) * 30) AS score FROM dga JOIN dent USING (host) WHERE bits >= 4.2)"""


@query(over_events(DGA_SQL + " SELECT event_id, host, round(bits, 6) AS entropy, round(score, 4) AS score FROM dfound"))
def dga_hosts(spark, sf_dir):
    found = A.dga_hosts(dga_events(spark, sf_dir))
    return found.select("event_id", "host", F.round("entropy", 6).alias("entropy"), F.round("score", 4).alias("score"))


ANOMALY_SQL = DGA_SQL + SPIKE_SQL.replace("FROM sec", "FROM dga") + RISK_SQL.format(source="dga") + """
, layers AS (
  SELECT d.event_id, d.ts_us, 'EWMA event-rate spike' AS detector, round(least(100, 55 + least(45, 5 * z)), 1) AS score,
    least(100, 55 + least(45, 5 * z)) AS raw, d."user", d.src_ip, d.host
  FROM step JOIN dga d USING (event_id) WHERE n > 15 AND z >= 3
  UNION ALL
  SELECT event_id, ts_us, 'UEBA user-risk', score, score, "user", src_ip, host FROM risk WHERE score >= 40
  UNION ALL
  SELECT event_id, ts_us, 'Entropy (DGA-like host)', round(score, 1), score, "user", src_ip, host FROM dfound WHERE score >= 40)
, anomalies AS (SELECT event_id, ts_us, detector, score,
    CASE WHEN raw >= 80 THEN 'Critical' WHEN raw >= 60 THEN 'High' WHEN raw >= 40 THEN 'Medium' ELSE 'Low' END AS severity,
    "user", src_ip, host FROM layers
  QUALIFY row_number() OVER (PARTITION BY detector, "user", src_ip ORDER BY ts_us, event_id) = 1)"""


def found_anomalies(spark, sf_dir):
    return A.anomalies(dga_events(spark, sf_dir))


@query(over_events_recursive(ANOMALY_SQL + " SELECT event_id, ts_us, detector, score, severity, \"user\", src_ip, host FROM anomalies"))
def anomalies(spark, sf_dir):
    return found_anomalies(spark, sf_dir).select(
        "event_id", "ts_us", "detector", "score", "severity", "user", "src_ip", "host"
    )


@query(over_events_recursive(ANOMALY_SQL + """
SELECT severity, detector, count(*) AS n FROM anomalies GROUP BY GROUPING SETS ((severity), (detector))"""))
def anomaly_stats(spark, sf_dir):
    return A.anomaly_stats(found_anomalies(spark, sf_dir))


INCIDENT_SQL = ANOMALY_SQL + """
, ml_incidents AS (SELECT ts_us, src_ip AS source_ip, host AS target_host, 'ML_ANOMALY:' || detector AS classification,
    'alert' AS mitigating_action, 'n/a' AS privilege_state FROM anomalies WHERE severity IN ('High', 'Critical'))"""


@query(over_events_recursive(INCIDENT_SQL + " SELECT * FROM ml_incidents"))
def anomaly_incidents(spark, sf_dir):
    return A.anomaly_incidents(found_anomalies(spark, sf_dir)).select(
        "ts_us", "source_ip", "target_host", "classification", "mitigating_action", "privilege_state"
    )
