"""Web access logs in Combined Log Format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import regex_groups, rstrip, strip

# Line format (groups: ip, user, time, method, url, protocol, status, bytes, referrer, agent).
ACCESS_REGEX = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)(?:\s+([^"]+))?"\s+(\d{3})\s+(\S+)'
    r'(?:\s+"([^"]*)"\s+"([^"]*)")?.*$'
)
TIME_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"


def parse_access_log(lines: DataFrame, ingest_us: int, line: str = "line") -> DataFrame:
    """Parsed requests; lines in another format are dropped."""
    groups = regex_groups(strip(F.col(line)), ACCESS_REGEX, 10)
    # The generator drops other lines without repeating the match in a filter.
    rows = lines.withColumn("_g", F.explode(F.array(groups))).where("_g IS NOT NULL")
    part = lambda i: F.col("_g")[i - 1]
    ts = F.unix_micros(F.try_to_timestamp(part(3), F.lit(TIME_FORMAT)))
    return rows.select(
        *[c for c in lines.columns if c != line],
        part(1).alias("ip"), part(2).alias("user"), part(4).alias("method"), part(5).alias("url"),
        strip(part(6)).alias("proto"), part(7).try_cast("int").alias("status"), part(8).alias("bytes"),
        F.substring(part(10), 1, 160).alias("ua"), F.coalesce(ts, F.lit(ingest_us)).alias("ts_us"),
    )


def access_events(requests: DataFrame, site: str = "site") -> DataFrame:
    """One HTTP_REQ per request, plus AUTH_FAIL for refused requests to login pages."""
    request = rstrip(F.concat_ws(" ", "method", "url", "proto", F.col("status").cast("string"), "bytes"))
    refused = F.col("status").isin(401, 403) & F.col("url").rlike(R.LOGIN_URL_REGEX)
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("HTTP_REQ").alias("event"), request.alias("msg"),
                     F.col("status").alias("http_status"), F.col("ua").alias("user_agent")),
            F.when(refused, F.struct(
                F.lit("AUTH_FAIL").alias("event"),
                F.format_string("WEB AUTH_FAIL %s %s -> %d", "method", "url", "status").alias("msg"),
                F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("user_agent"))),
        )
    )
    own = [c for c in requests.columns if c not in
           ("ip", "user", "method", "url", "proto", "status", "bytes", "ua", "ts_us", site)]
    return requests.withColumn("_e", F.explode(kinds)).select(
        *own, "ts_us", "_e.event", "user", F.col("ip").alias("src_ip"), F.col(site).alias("host"),
        F.lit(R.CLASS_STANDARD).alias("asset_class"), "_e.msg", F.col(site).alias("site"), "url",
        "_e.http_status", "_e.user_agent", F.lit("WEBSITE_MONITOR").alias("vector"),
    )


def ingest_accounting(lines: DataFrame, sites: DataFrame, ingest_us: int, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Lines parsed, skipped and turned into events per known site, and the rejected lines.

    ``lines`` has ``site_ref`` (site id or name) and the text.
    """
    resolved = resolve_sites(lines, sites)
    known = resolved.where("site_id IS NOT NULL")
    known = known.withColumn("_g", regex_groups(strip(F.col(line)), ACCESS_REGEX, 10))
    ok = F.col("_g").isNotNull()
    refused = F.col("_g")[6].isin("401", "403") & F.col("_g")[4].rlike(R.LOGIN_URL_REGEX)
    counts = known.groupBy("site_id", F.col("site_name").alias("site")).agg(
        F.count_if(ok).alias("parsed"),
        F.count_if(~ok).alias("skipped"),
        F.sum(F.when(ok & refused, 2).when(ok, 1).otherwise(0)).alias("events"),
    )
    rejects = resolved.where("site_id IS NULL").drop("site_id", "site_name")
    return counts, rejects


def resolve_sites(refs: DataFrame, sites: DataFrame, ref: str = "site_ref") -> DataFrame:
    """Add ``site_id`` and ``site_name`` for a reference that is a numeric id or an exact name."""
    by_id = sites.select(F.col("site_id").cast("string").alias("_id_key"), F.col("site_id").alias("_id1"), F.col("name").alias("_n1"))
    by_name = sites.select(F.col("name").alias("_name_key"), F.col("site_id").alias("_id2"), F.col("name").alias("_n2"))
    key = strip(F.col(ref))
    digits = F.when(key.rlike("^[0-9]+$"), F.regexp_replace(key, "^0+(?=.)", ""))
    return (
        refs.withColumn("_key", key)
        .withColumn("_digits", digits)
        .join(by_id, F.col("_digits") == F.col("_id_key"), "left")
        .join(by_name, F.col("_key") == F.col("_name_key"), "left")
        .withColumn("site_id", F.coalesce("_id1", "_id2"))
        .withColumn("site_name", F.coalesce("_n1", "_n2"))
        .drop("_key", "_digits", "_id_key", "_name_key", "_id1", "_id2", "_n1", "_n2")
    )
