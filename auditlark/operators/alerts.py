"""Alert routing, suppression and the delivery log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.tables import constant_df
from .folds import suppress_repeats


def dedup_key():
    return F.sha2(F.concat("severity", F.lit("\x00"), "title"), 256)


def deliveries(alerts: DataFrame, destinations: str = "destinations", routes: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per alert, routed channel and destination (``destinations`` maps channel to targets)."""
    rows = [(s, c) for s, channels in (routes or R.ALERT_ROUTES).items() for c in channels]
    table = constant_df(alerts.sparkSession, rows, "severity string, channel string")
    routed = alerts.join(F.broadcast(table), "severity")
    return routed.withColumn(
        "destination", F.explode(F.try_element_at(F.col(destinations), F.col("channel")))
    ).drop(destinations).withColumn("dedup_key", dedup_key())


def dispatch(alerts: DataFrame, destinations: str = "destinations", routes: dict[str, list[str]] | None = None,
             window_s: int = R.ALERT_WINDOW_S) -> DataFrame:
    """Every alert with ``status`` sent or deduped.

    Alerts that reach no destination leave no trace and suppress nothing; their
    status is ``unrouted``.
    """
    routes = routes or R.ALERT_ROUTES
    table = F.create_map(*[x for s, c in routes.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in c]).cast("array<string>"))])
    channels = F.coalesce(F.try_element_at(table, F.col("severity")), F.array().cast("array<string>"))
    reach = F.aggregate(
        channels, F.lit(0), lambda n, c: n + F.coalesce(F.size(F.try_element_at(F.col(destinations), c)), F.lit(0))
    )
    keyed = alerts.withColumn("dedup_key", dedup_key()).withColumn("_reach", reach)
    marked = suppress_repeats(keyed, ["dedup_key"], window_s=window_s, counts=F.col("_reach") > 0)
    return marked.withColumn("status", F.when(F.col("_reach") > 0, F.col("status")).otherwise("unrouted")).drop("_reach")


def delivery_log(dispatched: DataFrame, destinations: str = "destinations", routes: dict[str, list[str]] | None = None) -> DataFrame:
    """Log rows: a delivery per destination for sent alerts, one row per suppressed alert."""
    sent = deliveries(dispatched.where("status = 'sent'"), destinations, routes)
    muted = dispatched.where("status = 'deduped'").drop(destinations).withColumn("channel", F.lit("dedup")).withColumn(
        "destination", F.lit("-")
    )
    return sent.unionByName(muted.select(*sent.columns))


def latest_log(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` log rows."""
    return log.orderBy(F.desc("ts_us"), F.desc("event_id"), "title", "channel", "destination").limit(n)


def log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status", "channel").agg(F.count("*").alias("n"))
