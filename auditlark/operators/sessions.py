"""Network sessions per source and their revocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import strip


def live_sessions(events: DataFrame, attacks: DataFrame | None = None) -> DataFrame:
    """One session per real source: first and last activity, latest user and host.

    Sources known only from attacks are added.
    """
    order = F.struct("ts_us", "event_id")
    seen = events.withColumn("src_ip", strip("src_ip")).where(~F.col("src_ip").isin(*R.PLACEHOLDER_IPS))
    columns = ["src_ip", "ts_us", "event_id", "user", "host"]
    rows = seen.select(*columns, F.lit(1).alias("rank"))
    if attacks is not None:
        rows = rows.unionByName(attacks.where(F.col("src_ip") != "").select(*columns, F.lit(0).alias("rank")))
    order = F.struct("rank", "ts_us", "event_id")
    from_events = F.max("rank") == 1
    observed = F.when(F.col("rank") == 1, F.col("ts_us"))
    return rows.groupBy("src_ip").agg(
        F.when(from_events, F.min(observed)).otherwise(F.min("ts_us")).alias("first_seen_us"),
        F.when(from_events, F.max(observed)).otherwise(F.max("ts_us")).alias("last_seen_us"),
        F.max_by("user", order).alias("user"),
        F.max_by("host", order).alias("host"),
    )


def zt_sessions(events: DataFrame, revocations: DataFrame, status: str | None = None) -> DataFrame:
    """Sessions with their status; a revoked session stays revoked and its last activity
    is frozen at the first revocation, while user and host still refresh.

    ``revocations`` has ``src_ip``, ``revoked_us`` and ``revoked_by``; one that
    precedes the session has nothing to revoke.
    """
    seen = events.withColumn("src_ip", strip("src_ip")).where(~F.col("src_ip").isin(*R.PLACEHOLDER_IPS))
    starts = seen.groupBy("src_ip").agg(F.min("ts_us").alias("first_seen_us"))
    order = F.struct("revoked_us", "revoked_by")
    revoked = (
        revocations.withColumn("src_ip", strip("src_ip"))
        .join(starts, "src_ip")
        .where(F.col("revoked_us") >= F.col("first_seen_us"))
        .groupBy("src_ip")
        .agg(F.min("revoked_us").alias("frozen_us"), F.max("revoked_us").alias("revoked_us"),
             F.max_by("revoked_by", order).alias("revoked_by"))
    )
    newest = F.struct("ts_us", "event_id")
    # Aggregate before the second join: one row per source and side of the freeze.
    halves = (
        seen.join(revoked.select("src_ip", "frozen_us"), "src_ip", "left")
        .withColumn("active", F.coalesce(F.col("ts_us") <= F.col("frozen_us"), F.lit(True)))
        .groupBy("src_ip")
        .agg(
            F.min("ts_us").alias("first_seen_us"),
            F.max(F.when(F.col("active"), F.col("ts_us"))).alias("last_seen_us"),
            F.max_by("user", newest).alias("user"),
            F.max_by("host", newest).alias("host"),
        )
    )
    out = halves.join(revoked.drop("frozen_us"), "src_ip", "left").withColumn(
        "status", F.when(F.col("revoked_us").isNotNull(), "revoked").otherwise("active")
    )
    if status is not None:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.desc("last_seen_us"), "src_ip")


def kill_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Validate requested session kills and say whether a session existed."""
    ip = strip(F.coalesce("src_ip", F.lit("")))
    known = sessions.select(F.col("src_ip").alias("_known")).distinct()
    checked = requests.withColumn("src_ip", ip).join(known, F.col("src_ip") == F.col("_known"), "left")
    refused = F.col("src_ip").isin(*R.PLACEHOLDER_IPS)
    outcome = F.when(refused, "refused").when(F.col("_known").isNotNull(), "revoked").otherwise("no session")
    return checked.withColumn("outcome", outcome).drop("_known")
