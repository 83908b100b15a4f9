"""Views of the driver tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as R

# One request line per signature pattern, then a harmless export.
PAYLOADS = [
    "GET /item?id=1' OR '1'='1 HTTP/1.1",
    "GET /search?q=<script>alert(1)</script> HTTP/1.1",
    "GET /ping?host=1.1.1.1; cat /tmp/x HTTP/1.1",
    "GET /tpl?name={{7*7}} HTTP/1.1",
    "GET /log?x=${jndi:ldap://h/a} HTTP/1.1",
    "GET /fetch?url=http://169.254.169.254/latest HTTP/1.1",
    "GET /file?p=../../etc/passwd HTTP/1.1",
    "GET /.git/HEAD HTTP/1.1",
    "POST /obj rO0ABXNyABFq HTTP/1.1",
    "GET /login?user=a&password=hunter2 HTTP/1.1",
    "GET /admin/users HTTP/1.1",
    "POST /cart quantity=-5 HTTP/1.1",
    "GET /download/report.csv?x=1 HTTP/1.1",
]
EVENT_NAMES = {
    "error": "AUTH_FAIL", "signup": "AUTH_OK", "purchase": "NET_FLOW", "view": "HTTP_REQ", "click": "HTTP_REQ",
}
SENTENCES = {
    "AUTH_FAIL": "failed password attempt",
    "AUTH_OK": "accepted password",
    "NET_FLOW": "flow record",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sec_events(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """The ``events`` table as security events, optionally of some kinds only.

    The kinds are filtered on the stored column, so the filter reaches the scan.
    """
    raw = table(spark, sf_dir, "events")
    if only:
        raw = raw.where(F.col("event_type").isin(*[t for t, name in EVENT_NAMES.items() if name in only]))
    return sec_events_from(raw)


def sec_events_from(raw: DataFrame) -> DataFrame:
    """Rows of the ``events`` table, batch or streaming, as security events."""
    k = F.get_json_object("props", "$.k").cast("int")
    uid = F.col("user_id")
    event = F.when(F.col("event_type").isin("view", "click"), "HTTP_REQ")
    for source, name in EVENT_NAMES.items():
        if name != "HTTP_REQ":
            event = event.when(F.col("event_type") == source, name)
    msg = F.when(
        F.col("event") == "HTTP_REQ",
        F.element_at(F.array(*[F.lit(p) for p in PAYLOADS]), (F.col("event_id") % len(PAYLOADS) + 1).cast("int")),
    )
    for name, text in SENTENCES.items():
        msg = msg.when(F.col("event") == name, text)
    return (
        # The generator keeps later filters on derived columns from parsing the JSON again.
        raw.select("*", F.explode(F.array(k)).alias("k"), event.alias("event"))
        .select(
            "event_id",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            "event",
            F.concat(F.lit("user"), uid).alias("user"),
            F.concat_ws(".", 20 + F.col("k") % 3, uid % 7, F.col("k") % 5, uid % 250).alias("src_ip"),
            F.concat_ws(".", 20 + F.col("k") % 3, F.col("k") % 4, F.col("k") % 2, F.col("k") % 10).alias("atk_ip"),
            F.concat(F.lit("host-"), uid % 5).alias("host"),
            F.when(uid % 5 < 4, R.CLASS_CII).otherwise(R.CLASS_STANDARD).alias("asset_class"),
            msg.alias("msg"),
            F.col("value").alias("num"),
            F.col("k"),
        )
    )


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sec_events_sql() -> str:
    """The same view as a DuckDB common table expression body."""
    payloads = ", ".join(sql_text(p) for p in PAYLOADS)
    return f"""
    SELECT event_id, epoch_us(ts) AS ts_us,
      CASE event_type WHEN 'error' THEN 'AUTH_FAIL' WHEN 'signup' THEN 'AUTH_OK'
        WHEN 'purchase' THEN 'NET_FLOW' ELSE 'HTTP_REQ' END AS event,
      'user' || user_id AS "user",
      concat_ws('.', 20 + k % 3, user_id % 7, k % 5, user_id % 250) AS src_ip,
      concat_ws('.', 20 + k % 3, k % 4, k % 2, k % 10) AS atk_ip,
      'host-' || (user_id % 5) AS host,
      CASE WHEN user_id % 5 < 4 THEN {sql_text(R.CLASS_CII)} ELSE {sql_text(R.CLASS_STANDARD)} END AS asset_class,
      CASE event_type WHEN 'error' THEN {sql_text(SENTENCES['AUTH_FAIL'])}
        WHEN 'signup' THEN {sql_text(SENTENCES['AUTH_OK'])} WHEN 'purchase' THEN {sql_text(SENTENCES['NET_FLOW'])}
        ELSE ([{payloads}])[(event_id % {len(PAYLOADS)} + 1)::INT] END AS msg,
      value AS num, k
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
    """
