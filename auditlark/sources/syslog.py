"""Syslog-style lines: the cascade parser, CEF, BSD syslog and journal text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import regex_groups, strip
from ..functions.times import coerce_us
from .json_lines import with_json

# Line formats.
BSD_REGEX = (
    r"^<(\d{1,3})>([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([^:\s\[]+)(?:\[(\d+)\])?:\s*(.*)$"
)
JOURNAL_REGEX = r"^\w{3}\s+\d{1,2}\s+(\d{2}:\d{2}:\d{2})(?:\.\d+)?\s+(\S+)\s+([^:]+):\s*(.*)$"


def cef_struct(line: Column) -> Column:
    """Header fields and the extension map of a CEF record; null when it is not one."""
    parts = F.split(line, "[|]", 8)
    tokens = F.filter(F.split(F.coalesce(F.get(parts, F.lit(7)), F.lit("")), r"\s+"), lambda t: t.contains("="))
    entries = F.transform(
        tokens,
        lambda t: F.struct(
            F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(t, "^[^=]*=", "").alias("value")
        ),
    )
    record = F.struct(
        F.regexp_replace(F.get(parts, F.lit(0)), "^CEF:", "").alias("format_version"),
        *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(
            ("vendor", "product", "product_version", "signature", "name", "severity"), start=1)],
        F.map_from_entries(entries).alias("extensions"),
    )
    return F.when(line.startswith("CEF:") & (F.size(parts) >= 7), record)


def bsd_record(groups: Column) -> Column:
    def part(i: int) -> Column:
        return groups[i - 1]

    pri = part(1).try_cast("int")
    record = F.struct(
        pri.alias("pri"),
        F.shiftright(pri, 3).alias("facility"),
        pri.bitwiseAND(7).alias("severity"),
        part(2).alias("month"), part(3).alias("day"), part(4).alias("time"),
        part(5).alias("host"), part(6).alias("app"),
        F.nullif(part(7), F.lit("")).alias("pid"), part(8).alias("msg"),
    )
    return F.when(groups.isNotNull(), record)


def parse_cef(lines: DataFrame, line: str = "line") -> DataFrame:
    """CEF records only."""
    return lines.withColumn("cef", cef_struct(F.col(line))).where("cef IS NOT NULL").select(
        *[c for c in lines.columns if c != line], "cef.*"
    )


def parse_bsd_syslog(lines: DataFrame, line: str = "line") -> DataFrame:
    """BSD syslog records only."""
    found = F.explode(F.array(regex_groups(F.col(line), BSD_REGEX, 8)))
    rows = lines.select(*[c for c in lines.columns if c != line], found.alias("_g")).where("_g IS NOT NULL")
    return rows.withColumn("bsd", bsd_record(F.col("_g"))).select(*[c for c in rows.columns if c != "_g"], "bsd.*")


def parse_log_lines(lines: DataFrame, ingest_us: int, line: str = "line") -> DataFrame:
    """Every line to one event: empty, JSON object, other JSON, CEF, BSD syslog, else RAW."""
    rows = lines.withColumn("_l", F.regexp_replace(F.col(line), r"[\r\n]+$", ""))
    rows = (
        with_json(rows, "_l")
        .withColumn("_cef", F.when(F.col("_value").isNull(), cef_struct(F.col("_l"))))
        .withColumn("_g", F.when(F.col("_value").isNull() & F.col("_l").startswith("<"), regex_groups(F.col("_l"), BSD_REGEX, 8)))
        .withColumn("_bsd", bsd_record(F.col("_g")))
    )
    empty = F.col("_l") == ""

    def pick(on_json: Column, cef: Column, bsd: Column, rest: Column, on_empty: Column) -> Column:
        return (
            F.when(empty, on_empty)
            .when(F.col("_json").isNotNull(), on_json)
            .when(F.col("_cef").isNotNull(), cef)
            .when(F.col("_bsd").isNotNull(), bsd)
            .otherwise(rest)
        )

    def field(name: str) -> Column:
        return F.try_element_at("_json", F.lit(name))

    nothing = F.lit(None).cast("string")
    scalar = F.when(F.col("_value").isNotNull(), "json_scalar").otherwise("none")
    ts_us = F.coalesce(coerce_us(field("ts")), F.lit(ingest_us))
    return rows.select(
        *[c for c in lines.columns if c != line],
        ts_us.alias("ts_us"),
        pick(field("event"), F.lit("CEF"), F.lit("SYSLOG"), F.lit("RAW"), F.lit("EMPTY")).alias("event"),
        pick(F.coalesce(field("parsed"), F.lit("json")), F.lit("cef"), F.lit("bsd_syslog"), scalar, nothing).alias("parsed"),
        pick(field("user"), nothing, nothing, nothing, nothing).alias("user"),
        pick(field("src_ip"), nothing, nothing, nothing, nothing).alias("src_ip"),
        pick(field("host"), nothing, F.col("_bsd.host"), nothing, nothing).alias("host"),
        pick(field("msg"), nothing, F.col("_bsd.msg"), F.col("_l"), F.lit("")).alias("msg"),
        F.col("_cef").alias("cef_fields"),
        F.col("_bsd").alias("syslog_fields"),
        F.col("_json").alias("json_fields"),
    )


def parse_journald(lines: DataFrame, line: str = "line") -> DataFrame:
    """Journal text (short-precise); other lines keep their text as the message."""
    text = F.col(line)
    hit = text.rlike(JOURNAL_REGEX)
    app = strip(F.regexp_extract(text, JOURNAL_REGEX, 3))
    body = F.concat(F.lit("["), app, F.lit("] "), strip(F.regexp_extract(text, JOURNAL_REGEX, 4)))
    return lines.select(
        *[c for c in lines.columns if c != line],
        F.lit("SYSTEM_LOG").alias("event"), F.lit("system_log").alias("parsed"), F.lit("journald").alias("channel"),
        F.when(hit, F.regexp_extract(text, JOURNAL_REGEX, 2)).otherwise("-").alias("host"),
        F.lit("-").alias("user"), F.lit("-").alias("src_ip"),
        F.when(hit, app).alias("app"),
        F.substring(F.when(hit, body).otherwise(text), 1, 500).alias("msg"),
        F.lit("SYSTEM_LOG").alias("vector"),
    )


def ingest_counters(parsed: DataFrame) -> DataFrame:
    """Lines per parser."""
    return parsed.groupBy("parsed").agg(F.count("*").alias("lines"))
