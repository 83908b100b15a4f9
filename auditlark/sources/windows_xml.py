"""Windows event records in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.times import coerce_us, iso_utc

EVENT_SCHEMA = (
    "System struct<EventID string, Computer string, Channel string, Level string, Security string, "
    "TimeCreated struct<_SystemTime string>>, EventData struct<Data array<struct<_Name string, _VALUE string>>>"
)


def parse_windows_events(rows: DataFrame, ingest_us: int, xml: str = "xml") -> DataFrame:
    """One ``<Event>`` per row; malformed records and other roots are dropped."""
    text = strip(F.col(xml))
    root_is_event = text.rlike(r"^(<\?xml[^>]*\?>\s*)?<([A-Za-z0-9]+:)?Event[\s>]")
    parsed = (
        rows.withColumn("_e", F.from_xml(text, EVENT_SCHEMA, {"rowTag": "Event", "mode": "PERMISSIVE"}))
        .where(root_is_event & F.col("_e.System").isNotNull())
        .drop(xml)
    )

    def system(name: str) -> Column:
        return F.coalesce(strip(F.col(f"_e.System.{name}")), F.lit(""))

    pairs = F.transform(
        F.coalesce(F.col("_e.EventData.Data"), F.array()),
        lambda d, i: F.struct(
            F.coalesce(F.nullif(d["_Name"], F.lit("")), F.concat(F.lit("Data"), i.cast("string"))).alias("key"),
            F.coalesce(strip(d["_VALUE"]), F.lit("")).alias("value"),
        ),
    )
    parsed = parsed.withColumn("_pairs", pairs).withColumn("event_data", F.map_from_entries("_pairs"))

    def data(name: str) -> Column:
        return F.nullif(F.try_element_at("event_data", F.lit(name)), F.lit(""))

    ip = F.coalesce(data("IpAddress"), data("SourceIP"), F.lit("0.0.0.0"))
    or_unknown = lambda c: F.when(c == "", "?").otherwise(c)
    shown = F.array_join(F.transform(F.slice("_pairs", 1, 6), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "; ")
    ts_us = F.coalesce(coerce_us(F.col("_e.System.TimeCreated._SystemTime")), F.lit(ingest_us))
    return parsed.select(
        *[c for c in rows.columns if c != xml],
        ts_us.alias("ts_us"), iso_utc(ts_us).alias("iso"),
        F.lit("windows_event_xml").alias("parsed"), F.lit("WIN_EVENT").alias("event"),
        system("EventID").alias("win_event_id"), system("Channel").alias("channel"), system("Level").alias("level"),
        system("Computer").alias("computer"),
        F.coalesce(F.nullif(system("Computer"), F.lit("")), F.lit("-")).alias("host"),
        F.coalesce(data("TargetUserName"), data("SubjectUserName"), F.nullif(system("Security"), F.lit("")),
                   F.lit("-")).alias("user"),
        F.when(ip == "-", "0.0.0.0").otherwise(ip).alias("src_ip"),
        "event_data",
        F.concat(F.lit("Windows Event "), system("EventID"), F.lit(" on "), or_unknown(system("Computer")), F.lit(" ("),
                 or_unknown(system("Channel")), F.lit(") "), shown).alias("msg"),
    )


def parse_winevt_raw(rows: DataFrame, xml: str = "xml", channel: str = "channel") -> DataFrame:
    """Field extraction by expression, for records that need not be well-formed."""
    text = F.col(xml)

    def tag(name: str) -> Column:
        return strip(F.regexp_extract(text, f"<{name}[^>]*>([^<]*)</{name}>", 1))

    values = F.transform(F.regexp_extract_all(text, F.lit(r"<Data(?:[^>]*)>([^<]*)</Data>"), F.lit(1)), lambda v: strip(v))
    detail = F.substring(F.array_join(F.filter(values, lambda v: v != ""), "; "), 1, 300)
    provider = F.regexp_extract(text, r'<Provider[^>]*Name="([^"]+)"', 1)
    either = lambda c, other: F.when(c == "", other).otherwise(c)
    return rows.select(
        *[c for c in rows.columns if c not in (xml, channel)],
        F.col(channel),
        F.lit("SYSTEM_LOG").alias("event"), F.lit("system_log").alias("parsed"),
        tag("EventID").alias("win_event_id"), tag("Level").alias("level"), provider.alias("provider"),
        tag("Computer").alias("computer"), either(tag("Computer"), F.lit("-")).alias("host"),
        F.lit("-").alias("user"), F.lit("-").alias("src_ip"),
        F.regexp_extract(text, r'<TimeCreated[^>]*SystemTime="([^"]+)"', 1).alias("event_time"),
        F.concat(F.lit("["), F.col(channel), F.lit("] EventID "), either(tag("EventID"), F.lit("?")), F.lit(" "), provider,
                 F.lit(": "), either(detail, F.lit("no event data"))).alias("msg"),
        F.lit("SYSTEM_LOG").alias("vector"),
    )
