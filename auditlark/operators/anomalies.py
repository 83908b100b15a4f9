"""The layered anomaly table and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shannon_entropy
from .stats import rate_spikes
from .ueba import user_risk
from .windows import first_row

MIN_SCORE = 40.0
COLUMNS = ["event_id", "ts_us", "detector", "score", "severity", "explanation", "detail", "user", "src_ip", "host"]


def severity_band(score: Column) -> Column:
    return F.when(score >= 80, "Critical").when(score >= 60, "High").when(score >= 40, "Medium").otherwise("Low")


def dga_hosts(events: DataFrame, *, min_bits: float = 4.2, min_length: int = 12) -> DataFrame:
    """Events whose host name looks machine generated."""
    named = events.where(F.col("host").contains(".") & (F.length("host") >= min_length))
    return (
        named.withColumn("entropy", shannon_entropy(F.lower("host")))
        .where(F.col("entropy") >= min_bits)
        .withColumn("score", F.least(F.lit(100.0), F.lit(45.0) + (F.col("entropy") - min_bits) * 30.0))
    )


def _shape(df: DataFrame, detector: str, explanation: Column) -> DataFrame:
    return df.select(
        "event_id", "ts_us", F.lit(detector).alias("detector"), F.round("score", 1).alias("score"),
        severity_band(F.col("score")).alias("severity"), explanation.alias("explanation"),
        F.lit("").alias("detail"), "user", "src_ip", "host",
    )


def anomalies(events: DataFrame, *, rate_keys: tuple[str, ...] = ("host",), min_score: float = MIN_SCORE) -> DataFrame:
    """Rate spikes, user risk and generated hosts, one row per detector, user, source and detail."""
    carry = [c for c in ("user", "src_ip", "host") if c not in rate_keys]
    rate = rate_spikes(events, rate_keys, carry=carry)
    risk = user_risk(events).where((F.col("score") >= min_score) & (F.col("explanation") != ""))
    dga = dga_hosts(events).where(F.col("score") >= min_score)
    layers = [
        _shape(rate, "EWMA event-rate spike",
               F.format_string("%.1f events per second, %.1f deviations over the mean so far", "rate_mean", "z")),
        _shape(risk, "UEBA user-risk", F.col("explanation")),
        _shape(dga, "Entropy (DGA-like host)",
               F.format_string("%s: %.2f bits per character", "host", "entropy")),
    ]
    found = layers[0].unionByName(layers[1]).unionByName(layers[2])
    keyed = found.withColumn("_d", F.substring("detail", 1, 80))
    return first_row(keyed, ["detector", "user", "src_ip", "_d"], ["ts_us", "event_id"]).select(*COLUMNS)


def anomaly_stats(found: DataFrame) -> DataFrame:
    """Counts by severity and by detector in one pass."""
    return found.groupingSets([[F.col("severity")], [F.col("detector")]], F.col("severity"), F.col("detector")).agg(
        F.count("*").alias("n")
    )


def anomaly_incidents(found: DataFrame) -> DataFrame:
    """High and critical anomalies in ledger shape."""
    serious = found.where(F.col("severity").isin("High", "Critical"))
    return serious.select(
        "ts_us",
        F.col("src_ip").alias("source_ip"),
        F.col("host").alias("target_host"),
        F.concat(F.lit("ML_ANOMALY:"), "detector").alias("classification"),
        F.format_string("ML anomaly (%s) score=%.1f - %s", "detector", "score", F.substring("explanation", 1, 120)).alias(
            "detection_rule"
        ),
        F.lit("alert").alias("mitigating_action"),
        F.lit("n/a").alias("privilege_state"),
        F.substring(F.to_json(F.struct(*COLUMNS)), 1, 2000).alias("raw_record"),
    )
