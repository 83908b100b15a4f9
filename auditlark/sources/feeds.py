"""Threat-indicator feeds: text lists, indicator CSV and pulse JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import strip
from ..operators.windows import first_row

# Value formats.
IPV4_REGEX = r"^\d{1,3}(?:\.\d{1,3}){3}$"
URL_HOST_REGEX = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)"
THREATFOX_COLUMNS = (
    "first_seen string, id string, ioc string, ioc_type string, threat_type string, malware string, rest string"
)
PULSE_SCHEMA = "results array<struct<name string, indicators array<struct<type string, indicator string>>>>"


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL; empty when there is none."""
    return F.lower(strip(F.regexp_extract(url, URL_HOST_REGEX, 1)))


def host_type(host: Column) -> Column:
    return F.when(host.rlike(IPV4_REGEX), "ip").when(host.contains("."), "domain")


def _finish(rows: DataFrame, order: str) -> DataFrame:
    """First occurrence of each value, in line order."""
    typed = rows.where("ioc IS NOT NULL AND ioc <> '' AND ioc_type IS NOT NULL")
    return first_row(typed, ["ioc"], [order])


def _content(lines: DataFrame, line: str) -> DataFrame:
    return lines.withColumn("_l", strip(F.col(line))).where((F.col("_l") != "") & ~F.col("_l").startswith("#"))


def _label(feed: str, rows: DataFrame) -> DataFrame:
    name, threat, _ = R.FEEDS[feed]
    return rows.withColumn("feed_name", F.lit(name)).withColumn("threat_type", F.lit(threat)).withColumn(
        "description", F.lit(f"{name}: {threat}")
    )


def url_list(lines: DataFrame, *, line: str = "line", order: str = "line_id", feed: str = "urlhaus") -> DataFrame:
    """Hosts of listed URLs."""
    rows = _content(lines, line).withColumn("ioc", url_host(F.col("_l")))
    rows = rows.select(order, "ioc", host_type(F.col("ioc")).alias("ioc_type"))
    return _label(feed, _finish(rows, order))


def ip_list(lines: DataFrame, *, line: str = "line", order: str = "line_id", feed: str = "feodo") -> DataFrame:
    """First token of each line, when it is an IPv4 address."""
    token = F.regexp_replace(F.get(F.split("_l", r"\s+"), F.lit(0)), ",+$", "")
    rows = _content(lines, line).withColumn("ioc", token).where(F.col("ioc").rlike(IPV4_REGEX))
    return _label(feed, _finish(rows.select(order, "ioc", F.lit("ip").alias("ioc_type")), order))


def indicator_csv(lines: DataFrame, *, line: str = "line", order: str = "line_id", feed: str = "threatfox") -> DataFrame:
    """Typed indicators; addresses lose their port, URLs become hosts, other types are dropped."""
    name, default_threat, _ = R.FEEDS[feed]
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"'}
    # The extra field is present exactly when the line has all six columns.
    record = F.from_csv(F.concat("_l", F.lit(",end")), THREATFOX_COLUMNS, options)
    # The generator keeps later filters from repeating the CSV parse.
    rows = _content(lines, line).select(order, F.explode(F.array(record)).alias("c")).select(order, "c.*")
    rows = rows.where("rest IS NOT NULL")
    raw, kind = strip("ioc"), F.lower(strip("ioc_type"))
    address = strip(F.substring_index(raw, ":", 1))
    value = (
        F.when((kind == "ip:port") & address.rlike(IPV4_REGEX), address)
        .when((kind == "domain") & (host_type(raw) == "domain"), F.lower(raw))
        .when(kind == "url", url_host(raw))
        .when((kind == "sha256_hash") & (F.length(raw) == 64), F.lower(raw))
    )
    typ = (
        F.when(kind == "ip:port", "ip").when(kind == "domain", "domain")
        .when(kind == "url", host_type(url_host(raw))).when(kind == "sha256_hash", "sha256")
    )
    threat = F.coalesce(F.nullif(strip("threat_type"), F.lit("")), F.lit(default_threat))
    family = F.coalesce(strip("malware"), F.lit(""))
    text = F.concat(F.lit(f"{name}: "), threat, F.when(family != "", F.concat(F.lit(" ("), family, F.lit(")"))).otherwise(""))
    fields = F.struct(value.alias("ioc"), typ.alias("ioc_type"), F.substring(text, 1, 400).alias("description"))
    typed = rows.select(order, F.explode(F.array(fields)).alias("f")).select(order, "f.*")
    return _finish(typed, order).withColumn("feed_name", F.lit(name)).withColumn("threat_type", F.lit(default_threat))


def pulses(documents: DataFrame, *, column: str = "json", order: str = "line_id") -> DataFrame:
    """Indicators of pulse documents whose type is tracked."""
    known = F.create_map(*[F.lit(x) for pair in R.PULSE_TYPES.items() for x in pair])
    exploded = (
        documents.select(order, F.explode(F.from_json(column, PULSE_SCHEMA)["results"]).alias("p"))
        .select(order, F.substring(F.coalesce("p.name", F.lit("otx-pulse")), 1, 120).alias("pulse"),
                F.explode("p.indicators").alias("i"))
    )
    rows = exploded.select(
        order, strip("i.indicator").alias("ioc"), F.try_element_at(known, F.col("i.type")).alias("ioc_type"),
        F.concat(F.lit("OTX pulse: "), "pulse").alias("description"),
    )
    return rows.where("ioc_type IS NOT NULL AND ioc <> ''").withColumn("feed_name", F.lit(R.PULSE_FEED)).withColumn(
        "threat_type", F.lit("otx-pulse")
    )


def ioc_csv(rows: DataFrame) -> DataFrame:
    """Validate user CSV rows (``ioc``, ``ioc_type`` and optional columns); adds ``valid``."""
    columns = {c.strip().lower(): c for c in rows.columns}
    if "ioc" not in columns or "ioc_type" not in columns:
        raise ValueError(f"CSV must have 'ioc' and 'ioc_type' columns (saw: {sorted(columns)})")

    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(columns[name]), F.lit(""))) if name in columns else F.lit("")

    confidence = F.coalesce(text("confidence").try_cast("int"), F.lit(60))
    keep = [c for c in rows.columns if c.strip().lower() not in
            ("ioc", "ioc_type", "confidence", "threat_type", "description")]
    return rows.select(
        *keep, text("ioc").alias("ioc"), F.lower(text("ioc_type")).alias("ioc_type"),
        F.greatest(F.lit(1), F.least(F.lit(100), confidence)).alias("confidence"),
        F.substring(text("threat_type"), 1, 80).alias("threat_type"),
        F.substring(text("description"), 1, 400).alias("description"), F.lit("CSV-Import").alias("feed_name"),
    ).withColumn("valid", (F.col("ioc") != "") & F.col("ioc_type").isin(*R.IOC_TYPES))
