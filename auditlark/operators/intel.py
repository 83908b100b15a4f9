"""Threat-indicator store: merge, enrichment and feed health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import strip
from ..functions.times import parse_stamp
from .windows import first_row, US


def merge_iocs(store: DataFrame, incoming: DataFrame, order: str = "line_id") -> DataFrame:
    """Store plus unseen indicators; the first writer of a value wins."""
    return store.unionByName(new_iocs(store, incoming, order).select(*store.columns))


def new_iocs(store: DataFrame, incoming: DataFrame, order: str = "line_id") -> DataFrame:
    return first_row(incoming, ["ioc"], [order]).join(store.select("ioc"), "ioc", "left_anti")


def import_counts(store: DataFrame, checked: DataFrame) -> DataFrame:
    """added / skipped / invalid of a validated CSV import."""
    valid = checked.where("valid").groupBy("ioc").agg(F.count("*").alias("copies"))
    known = store.select("ioc", F.lit(1).alias("known")).distinct()
    per_value = valid.join(known, "ioc", "left").select(
        F.when(F.col("known").isNull(), 1).otherwise(0).alias("added"),
        (F.col("copies") - F.when(F.col("known").isNull(), 1).otherwise(0)).alias("skipped"),
        F.lit(0).alias("invalid"),
    )
    bad = checked.select(F.lit(0).alias("added"), F.lit(0).alias("skipped"), F.when(F.col("valid"), 0).otherwise(1).alias("invalid"))
    return per_value.unionByName(bad).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "skipped", "invalid")])


def upsert_feeds(feeds: DataFrame, updates: DataFrame) -> DataFrame:
    """Feed rows after a refresh: known feeds get the new stamp and kind, new ones are added."""
    old, new = feeds.alias("o"), updates.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return old.join(new, F.col("o.feed_name") == F.col("n.feed_name"), "full_outer").select(
        keep("feed_name"), pick("last_updated"), keep("update_interval_h"), pick("feed_kind")
    )


def normalized(value: Column) -> Column:
    return F.lower(strip(value))


def enrich(rows: DataFrame, value: str, iocs: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the indicators that equal ``value`` without regard to case.

    The join strategy is left to the optimizer: the store is broadcast only
    while it is small enough, otherwise hot values are split by the adaptive
    skew join.
    """
    side = iocs.select(
        F.lower("ioc").alias("_key"), "ioc", "ioc_type", F.col("feed_name").alias("ioc_feed"), "confidence",
        F.col("threat_type").alias("ioc_threat"),
    )
    keyed = rows.withColumn("_v", normalized(F.col(value)))
    if how in ("left_semi", "left_anti"):
        side = side.select("_key")
    return keyed.join(side, F.col("_v") == F.col("_key"), how).drop("_v", "_key")


def stale(last_updated: Column, interval_h: Column, as_of_us: int) -> Column:
    due = parse_stamp(last_updated) + interval_h.cast("long") * 3600 * US
    return F.coalesce(F.lit(as_of_us) > due, F.lit(True))


def stale_feeds(feeds: DataFrame, as_of_us: int) -> DataFrame:
    return feeds.where(stale(F.col("last_updated"), F.col("update_interval_h"), as_of_us))


def feed_health(feeds: DataFrame, iocs: DataFrame, as_of_us: int) -> DataFrame:
    """Every feed with its number of indicators and whether it is stale."""
    counts = iocs.groupBy("feed_name").agg(F.count("*").alias("ioc_count"))
    return (
        feeds.join(counts, "feed_name", "left")
        .withColumn("ioc_count", F.coalesce("ioc_count", F.lit(0)))
        .withColumn("stale", stale(F.col("last_updated"), F.col("update_interval_h"), as_of_us))
        .orderBy("feed_name")
    )


def top_iocs(iocs: DataFrame, limit: int = 200, feed_name: str | None = None) -> DataFrame:
    chosen = iocs if feed_name is None else iocs.where(F.col("feed_name") == feed_name)
    return chosen.orderBy(F.desc("confidence"), "ioc").limit(limit)


def refresh_due(feeds: DataFrame, as_of_us: int) -> DataFrame:
    """Latest refresh per live feed group and whether the next one is due."""
    live = [name for name, _, _ in R.FEEDS.values()]
    group = F.when(F.col("feed_name").isin(*live), "abusech").when(F.col("feed_name") == R.PULSE_FEED, "otx")
    hours = F.when(F.col("feed_group") == "abusech", R.REFRESH_HOURS["abusech"]).otherwise(R.REFRESH_HOURS["otx"])
    latest = feeds.withColumn("feed_group", group).where("feed_group IS NOT NULL").groupBy("feed_group").agg(
        F.max(parse_stamp(F.col("last_updated"))).alias("last_us")
    )
    return latest.withColumn("due", F.lit(as_of_us) - F.coalesce("last_us", F.lit(0)) >= hours.cast("long") * 3600 * US)
