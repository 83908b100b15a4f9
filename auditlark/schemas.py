"""Schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical event. ``ts_us`` (microseconds since the epoch, exact) is the order
# key of every window; ``event_id`` breaks ties.
SECURITY_EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("asset_class", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("vector", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
    ]
)

INCIDENT = T.StructType(
    [
        T.StructField("ts_us", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("target_host", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("detection_rule", T.StringType()),
        T.StructField("mitigating_action", T.StringType()),
        T.StructField("privilege_state", T.StringType()),
        T.StructField("raw_record", T.StringType()),
    ]
)

PATTERN = T.StructType(
    [
        T.StructField("pattern_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("owasp", T.StringType()),
        T.StructField("control_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("soar_action", T.StringType()),
        T.StructField("mitigation", T.ArrayType(T.StringType())),
        T.StructField("position", T.IntegerType()),
    ]
)

TECHNIQUE = T.StructType(
    [
        T.StructField("pattern_id", T.StringType()),
        T.StructField("technique_id", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("tactics", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
    ]
)

CONTROL = T.StructType(
    [
        T.StructField("control_id", T.StringType()),
        T.StructField("domain_id", T.StringType()),
        T.StructField("domain_name", T.StringType()),
        T.StructField("seed_status", T.StringType()),
        T.StructField("risk_weight", T.IntegerType()),
    ]
)

ASSET = T.StructType(
    [
        T.StructField("hostname", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("risk_score", T.IntegerType()),
    ]
)

IOC = T.StructType(
    [
        T.StructField("ioc", T.StringType()),
        T.StructField("ioc_type", T.StringType()),
        T.StructField("feed_name", T.StringType()),
        T.StructField("confidence", T.IntegerType()),
        T.StructField("threat_type", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
