"""Per-user behaviour: risk of each authentication event and posture per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as R
from .detectors import hour_utc
from .windows import Total, row_blocks, running_totals, US

# Most each factor adds to a risk score.
WEIGHT_NEW_IP = 35.0
WEIGHT_OFF_HOURS = 25.0
WEIGHT_FAILURES = 20.0
WEIGHT_BURST = 15.0
WEIGHT_NEW_HOST = 5.0
MIN_LOGINS = 5
ATTEMPT_SPAN = 50
EVENT_SPAN = 500
BURST_SPAN_S = 600


def user_risk(
    events: DataFrame, *, block_rows: int = 200_000, attempt_span: int = ATTEMPT_SPAN, event_span: int = EVENT_SPAN
) -> DataFrame:
    """Risk 0-100 of every AUTH event from the user's earlier events only."""
    is_ok = (F.col("event") == "AUTH_OK").cast("int")
    is_fail = (F.col("event") == "AUTH_FAIL").cast("int")
    base = (
        events.where(~F.col("user").isin(*R.PLACEHOLDER_USERS))
        .select(
            "event_id", "ts_us", "event", "user",
            F.coalesce("src_ip", F.lit("0.0.0.0")).alias("src_ip"), F.coalesce("host", F.lit("-")).alias("host"),
        )
        .withColumn("hour", hour_utc(F.col("ts_us")))
        .withColumn("ok", is_ok)
        .withColumn("fail", is_fail)
    )
    counted = running_totals(
        base,
        ["user"],
        {
            "seen": Total(F.lit(1)),
            "attempts": Total(F.col("ok") + F.col("fail")),
            "fails": Total(F.col("fail")),
            "logins": Total(F.col("ok")),
            "ip_logins": Total(F.col("ok"), ("src_ip",)),
            "host_logins": Total(F.col("ok"), ("host",)),
            "hour_logins": Total(F.col("ok"), ("hour",)),
        },
    )
    with_volume = _volume(counted, block_rows, event_span)
    auth = with_volume.where((F.col("ok") + F.col("fail")) > 0)

    # Inclusive totals become prior totals.
    own = {"logins": "ok", "ip_logins": "ok", "host_logins": "ok", "hour_logins": "ok", "fails": "fail"}
    for total, weight in own.items():
        auth = auth.withColumn(total, F.col(total) - F.col(weight))
    w = Window.partitionBy("user", "block").orderBy("ts_us", "event_id")
    auth = (
        row_blocks(auth, "attempts", block_rows, attempt_span)
        .withColumn("recent_fails", F.col("fails") - F.coalesce(F.lag("fails", attempt_span).over(w), F.lit(0)))
        .where(~F.col("is_copy"))
        .withColumn("recent_attempts", F.least(F.lit(attempt_span), F.col("attempts") - 1))
        .drop("block", "is_copy")
    )

    ratio = F.col("recent_fails") / F.col("recent_attempts")
    share = F.col("hour_logins") / F.greatest(F.lit(1), F.col("logins"))
    factors = {
        "new_ip": ((F.col("ip_logins") == 0) & (F.col("src_ip") != "0.0.0.0"), F.lit(WEIGHT_NEW_IP),
                   F.format_string("%s is new after %d logins", "src_ip", "logins")),
        "off_hours": (share < 0.10, F.lit(WEIGHT_OFF_HOURS),
                      F.format_string("hour %d UTC holds %d of %d earlier logins",
                                      "hour", "hour_logins", "logins")),
        "failures": ((F.col("recent_attempts") >= 5) & (ratio >= 0.5), F.lit(WEIGHT_FAILURES) * F.least(F.lit(1.0), ratio),
                     F.format_string("%d of the latest %d attempts failed",
                                     "recent_fails", "recent_attempts")),
        "burst": (F.col("is_burst"), F.lit(WEIGHT_BURST),
                  F.format_string("%d events within %d seconds", "recent", F.lit(BURST_SPAN_S))),
        "new_host": ((F.col("host_logins") == 0) & (F.col("host") != "-"), F.lit(WEIGHT_NEW_HOST),
                     F.format_string("host %s is new to the user", "host")),
    }
    trusted = F.col("logins") >= MIN_LOGINS
    total = sum((F.when(hit, points).otherwise(0.0) for hit, points, _ in factors.values()), F.lit(0.0))
    return (
        auth.withColumn("score", F.when(trusted, F.least(F.lit(100.0), F.round(total, 1))).otherwise(0.0))
        .withColumn("factors", F.when(
            trusted, F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, (hit, _, _) in factors.items()]))
        ).otherwise(F.array().cast("array<string>")))
        .withColumn("explanation", F.when(
            trusted, F.array_join(F.array_compact(F.array(*[F.when(h, t) for h, _, t in factors.values()])), "; ")
        ).otherwise(""))
        .select("event_id", "ts_us", "event", "user", "src_ip", "host", "logins", "score", "factors", "explanation")
    )


def _volume(counted: DataFrame, block_rows: int, span: int) -> DataFrame:
    """Add ``recent`` and ``is_burst`` from the last ``span`` events before each row."""
    blocks = row_blocks(counted, "seen", block_rows, span)
    w = Window.partitionBy("user", "block").orderBy("ts_us", "event_id")
    blocks = (
        blocks.withColumn("_last", F.lag("ts_us", 1).over(w))
        .withColumn("_back", F.lag("ts_us", span).over(w))
        .withColumn("_oldest", F.first("ts_us").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    enter = F.struct(F.col("ts_us").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("d"))
    leave = F.struct((F.col("ts_us") + BURST_SPAN_S * US).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("d"))
    marks = blocks.withColumn("_m", F.explode(F.array(enter, leave))).select("*", "_m.*")
    running = (
        Window.partitionBy("user", "block").orderBy("at", "kind", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.least(F.lit(span), F.col("seen") - 1)
    first_us = F.when(F.col("seen") - 1 >= span, F.col("_back")).otherwise(F.col("_oldest"))
    span_min = F.greatest(F.lit(1.0), (F.col("_last") - first_us) / F.lit(60.0 * US))
    burst = (F.col("recent") >= 10) & (F.col("recent") / 10.0 > 5 * n / span_min)
    return (
        marks.withColumn("recent", F.least(F.lit(span), F.coalesce(F.sum("d").over(running), F.lit(0))))
        .where((F.col("kind") == 0) & ~F.col("is_copy"))
        .withColumn("is_burst", F.coalesce(burst, F.lit(False)))
        .drop("_last", "_back", "_oldest", "_m", "at", "kind", "d", "block", "is_copy")
    )


def user_posture(events: DataFrame, *, attempt_span: int = ATTEMPT_SPAN) -> DataFrame:
    """One row per user that ever logged in, riskiest first."""
    known = events.where(~F.col("user").isin(*R.PLACEHOLDER_USERS))
    logins = known.where("event = 'AUTH_OK'").groupBy("user").agg(
        F.count("*").alias("logins_observed"),
        F.count_distinct("src_ip").alias("known_ips"),
        F.count_distinct("host").alias("known_hosts"),
    )
    newest = Window.partitionBy("user").orderBy(F.desc("ts_us"), F.desc("event_id"))
    # The row_number filter is pruned per input partition before the exchange.
    recent = (
        known.where(F.col("event").isin("AUTH_OK", "AUTH_FAIL"))
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= attempt_span)
        .groupBy("user")
        .agg(F.avg((F.col("event") == "AUTH_FAIL").cast("double")).alias("_ratio"))
    )
    return (
        logins.join(recent, "user", "left")
        .withColumn("_ratio", F.coalesce("_ratio", F.lit(0.0)))
        .select(
            "user", "logins_observed", "known_ips", "known_hosts",
            F.round("_ratio", 3).alias("recent_fail_ratio"),
            F.round(F.least(F.lit(100.0), F.col("_ratio") * 60.0), 1).alias("posture_score"),
            (F.col("logins_observed") >= MIN_LOGINS).alias("baseline_trusted"),
        )
        .orderBy(F.desc("posture_score"), "user")
    )
