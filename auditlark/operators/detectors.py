"""Rule detections over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as R
from .windows import Over, Total, floor_div, first_row, running_totals, sliding_state, US


def scanned(events: DataFrame) -> DataFrame:
    return events.where(F.upper("event").isin(*R.SCANNED_EVENTS))


def signature_matches(text: Column, patterns: list[R.Pattern] | None = None) -> Column:
    """array<struct<pattern_id, matched>>: the text each pattern's first matching signature found, or ''."""
    entries = []
    for p in patterns or R.SIGNATURES:
        found = F.regexp_extract(text, p.signatures[-1], 0)
        for s in reversed(p.signatures[:-1]):
            found = F.when(text.rlike(s), F.regexp_extract(text, s, 0)).otherwise(found)
        entries.append(F.struct(F.lit(p.pattern_id).alias("pattern_id"), found.alias("matched")))
    return F.array(*entries)


def signature_hits(events: DataFrame, text: str = "msg") -> DataFrame:
    """One row per event and matching pattern; only matches are exploded."""
    return (
        events.withColumn("_hit", F.explode(F.filter(signature_matches(F.col(text)), lambda h: h.matched != "")))
        .select("*", "_hit.pattern_id", "_hit.matched")
        .drop("_hit")
    )


def owasp_labels(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(rx), F.lit(label)) for label, rx in R.OWASP_CLASSES]))


def owasp_scan(events: DataFrame, text: str = "msg") -> DataFrame:
    """Rows that match at least one of the three request classes, with their labels."""
    return events.withColumn("signatures", owasp_labels(F.col(text))).where(F.size("signatures") > 0)


def dedup_hits(hits: DataFrame) -> DataFrame:
    """First hit per pattern, source and leading matched text."""
    keyed = hits.withColumn("_key", F.substring("matched", 1, 60))
    return (
        first_row(keyed, ["pattern_id", "src_ip", "_key"], ["ts_us", "event_id"])
        .withColumn("matched", F.substring("matched", 1, 120))
        .drop("_key")
    )


def with_pattern(hits: DataFrame) -> DataFrame:
    """Join the registry; hits of unknown patterns are dropped."""
    return hits.join(F.broadcast(R.patterns_df(hits.sparkSession)), "pattern_id")


def bruteforce_windows(
    events: DataFrame, *, keys: tuple[str, ...] = ("src_ip", "user"), window_s: int = 60, threshold: int = 10,
    hot_rows: int | None = None,
) -> DataFrame:
    """Failed logins whose window holds ``threshold`` failures; ``nth_us`` tripped the rule."""
    fails = events.where("event = 'AUTH_FAIL'")
    state = sliding_state(fails, keys, window_s, first=True, nth=threshold, hot_rows=hot_rows)
    return state.where(F.col("n") >= threshold).withColumn("last_us", F.col("ts_us"))


def detection_latency(hits: DataFrame, processing_us: Column) -> DataFrame:
    """Seconds between the failure that crossed the threshold and its processing."""
    lag = F.greatest(F.lit(0), processing_us - F.col("nth_us")) / F.lit(float(US))
    return hits.withColumn("latency_s", F.round(lag, 3))


def active_attacks(hits: DataFrame, keys: tuple[str, ...] = ("src_ip", "user")) -> DataFrame:
    """One row per attacked key: first crossing and latest window size."""
    order = F.struct("ts_us", "event_id")
    return hits.groupBy(*keys).agg(
        F.min("ts_us").alias("first_crossing_us"),
        F.max("ts_us").alias("last_us"),
        F.max_by("n", order).alias("count"),
    )


def password_spray(
    events: DataFrame, *, ip: str = "src_ip", window_s: int = 120, min_users: int = 5, min_fails: int = 8,
    max_per_user: int = 3, hot_rows: int | None = None,
) -> DataFrame:
    fails = events.where((F.col("event") == "AUTH_FAIL") & ~F.col(ip).isin("", "0.0.0.0"))
    state = sliding_state(
        fails, [ip], window_s, distinct={"n_users": "user"}, over={"n_over": Over("user", max_per_user)},
        hot_rows=hot_rows,
    )
    return state.where(
        (F.col("n_users") >= min_users) & (F.col("n") >= min_fails) & (F.col("n_over") == 0)
    ).drop("n_over")


def distributed_bruteforce(
    events: DataFrame, *, window_s: int = 300, min_ips: int = 5, min_fails: int = 10, hot_rows: int | None = None
) -> DataFrame:
    fails = events.where((F.col("event") == "AUTH_FAIL") & ~F.col("user").isin("", "unknown"))
    state = sliding_state(fails, ["user"], window_s, distinct={"n_ips": "src_ip"}, hot_rows=hot_rows)
    return state.where((F.col("n_ips") >= min_ips) & (F.col("n") >= min_fails))


def impossible_travel(
    events: DataFrame, *, window_s: int = 900, min_nets: int = 2, hot_rows: int | None = None
) -> DataFrame:
    """Logins of one user from several /16 networks inside the window; 10.* is internal."""
    logins = events.where(
        (F.col("event") == "AUTH_OK")
        & ~F.col("user").isin(*R.PLACEHOLDER_USERS)
        & (F.col("src_ip") != "")
        & ~F.col("src_ip").startswith("10.")
    ).withColumn("net16", F.substring_index("src_ip", ".", 2))
    state = sliding_state(logins, ["user"], window_s, distinct={"n_nets": "net16"}, hot_rows=hot_rows)
    return state.where(F.col("n_nets") >= min_nets)


def exfil_bursts(
    events: DataFrame, *, window_s: int = 120, threshold: int = 20, keys: tuple[str, ...] = ("src_ip",),
    hot_rows: int | None = None,
) -> DataFrame:
    reads = scanned(events).where(F.col("msg").rlike(R.EXFIL_REGEX))
    return sliding_state(reads, list(keys), window_s, hot_rows=hot_rows).where(F.col("n") >= threshold)


def telemetry_gap(
    events: DataFrame, *, keys: tuple[str, ...] = (), bucket_s: int = 60, history: int = 5, min_mean: float = 10.0,
    ratio: float = 0.10, as_of_us: int,
) -> DataFrame:
    """Buckets that hold under ``ratio`` of the mean of the ``history`` buckets before them.

    Every bucket up to ``as_of_us`` counts, also those after a key's own last event:
    a source that falls silent for good is the case to catch.

    Counts are pre-aggregated per bucket and each count is sent to the buckets
    it is a baseline for, so empty buckets appear without a calendar and no
    window spans the series.
    """
    bucket_us = bucket_s * US
    keyed = events if keys else events.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    counts = keyed.groupBy(*by, floor_div(F.col("ts_us"), bucket_us).alias("bucket")).agg(
        F.count("*").alias("c"), F.min("ts_us").alias("lo")
    )
    bounds = counts.groupBy(*by).agg(F.min("lo").alias("oldest_us"))
    spread = counts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(history)))).groupBy(
        *by, (F.col("bucket") + F.col("step")).alias("bucket")
    ).agg(
        F.sum(F.when(F.col("step") == 0, F.col("c")).otherwise(0)).alias("current"),
        (F.sum(F.when(F.col("step") > 0, F.col("c")).otherwise(0)) / F.lit(float(history))).alias("baseline"),
    )
    fired = spread.join(bounds, by).where(
        (F.col("bucket") <= as_of_us // bucket_us)
        & (F.col("oldest_us") <= (F.col("bucket") - history) * bucket_us)
        & (F.col("baseline") >= min_mean)
        & (F.col("current") < F.lit(ratio) * F.col("baseline"))
    )
    return fired.select(*keys, (F.col("bucket") * bucket_us).alias("bucket_us"), "current", "baseline")


def physical_failures(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin("PHYSICAL_FAIL", "BADGE_FAIL"))


def login_history(events: DataFrame) -> DataFrame:
    """Successful logins with running totals per user, per (user, ip) and per (user, hour)."""
    logins = events.where("event = 'AUTH_OK'").withColumn("hour", hour_utc(F.col("ts_us")))
    one = F.lit(1)
    return running_totals(
        logins,
        ["user"],
        {"logins": Total(one), "ip_logins": Total(one, ("src_ip",)), "hour_logins": Total(one, ("hour",))},
    )


def hour_utc(ts_us: Column) -> Column:
    return F.pmod(floor_div(ts_us, 3600 * US), F.lit(24)).cast("int")


def ueba_new_ip(history: DataFrame, *, min_logins: int = 5) -> DataFrame:
    found = history.where((F.col("ip_logins") == 1) & (F.col("logins") >= min_logins))
    return found.withColumn("kind", F.lit("NEW_IP")).withColumn(
        "detail", F.format_string("%s: address %s not seen in %d logins so far", "user", "src_ip", "logins")
    )


def ueba_off_hours(history: DataFrame, *, min_logins: int = 10, max_share: float = 0.10) -> DataFrame:
    share = F.col("hour_logins") / F.col("logins")
    found = history.where((F.col("logins") >= min_logins) & (share < max_share))
    # Hour and whole percent only: later logins of the same hour repeat the finding.
    return found.withColumn("kind", F.lit("OFF_HOURS")).withColumn(
        "detail", F.format_string("%s: hour %d UTC has %d%% of the logins", "user", "hour", F.round(100 * share).cast("int"))
    )


def ueba_findings(events: DataFrame) -> DataFrame:
    """Both login findings, one per user, kind and detail."""
    history = login_history(events)
    both = ueba_new_ip(history).unionByName(ueba_off_hours(history))
    return first_row(both, ["user", "kind", "detail"], ["ts_us", "event_id"])


def cii_escalation(hits: DataFrame, assets: DataFrame, *, control_id: str = "PISF-13.2") -> DataFrame:
    """Hits on critical assets, flagged for the escalation control.

    The class in the asset table wins; the event's own class is the fallback.
    """
    known = assets.select(F.col("hostname").alias("host"), "classification")
    klass = F.coalesce("classification", "asset_class")
    return (
        hits.join(known, "host", "left")
        .withColumn("asset_class", klass)
        .drop("classification")
        .where(F.col("asset_class").isin(R.CLASS_CII, "CII"))
        .withColumn("escalated_control", F.lit(control_id))
    )


def response_decisions(hits: DataFrame) -> DataFrame:
    """What the playbook decides per hit; nothing is executed."""
    blockable = ~F.col("src_ip").isin("", "0.0.0.0")
    action = F.col("soar_action")
    decision = (
        F.when((action == "block_ip") & blockable, "block_ip")
        .when(action == "kill_session", "kill_session")
        .otherwise("alert")
    )
    return hits.withColumn("decision", decision).withColumn("snapshot", F.col("severity") == "Critical")


def owasp_decisions(scan: DataFrame) -> DataFrame:
    """Request-scan hits always contain the source and ask for a snapshot."""
    return scan.withColumn("decision", F.lit("block_ip")).withColumn("snapshot", F.lit(True))


def window_occupancy(events: DataFrame, as_of_us: int, *, window_s: int = 60,
                     keys: tuple[str, ...] = ("src_ip", "user")) -> DataFrame:
    live = events.where(
        (F.col("event") == "AUTH_FAIL")
        & (F.col("ts_us") >= as_of_us - window_s * US)
        & (F.col("ts_us") <= as_of_us)
    )
    return live.groupBy(*keys).agg(F.count("*").alias("fails")).orderBy(F.desc("fails"), *keys)


def latest(df: DataFrame, n: int, order: tuple[str, ...] = ("ts_us", "event_id")) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def soc_status(attacks: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: attack beats elevated beats nominal."""
    tagged = attacks.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        anomalies.select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = tagged.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("attacks"), F.coalesce(F.sum("b"), F.lit(0)).alias("anomalies")
    )
    banner = F.when(F.col("attacks") > 0, "UNDER ATTACK").when(F.col("anomalies") > 0, "ELEVATED").otherwise("NOMINAL")
    return counts.withColumn("status", banner)


def behaviour_hits(found: DataFrame, pattern_id: str, matched: Column) -> DataFrame:
    """Bring a behavioural detection into the shape of a signature hit."""
    return found.select(
        "event_id", "ts_us", "user", "src_ip", "host", "asset_class", F.lit(pattern_id).alias("pattern_id"), matched.alias("matched")
    )


def gap_hits(gaps: DataFrame, *, bucket_s: int = 60) -> DataFrame:
    """Telemetry gaps per host as pattern hits, at the end of the silent bucket; no event stands behind them, so their id is -1."""
    return gaps.select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("bucket_us") + bucket_s * US).alias("ts_us"), F.lit("-").alias("user"), F.lit("-").alias("src_ip"),
        "host", F.lit(R.CLASS_STANDARD).alias("asset_class"), F.lit("TELEMETRY_GAP").alias("pattern_id"), F.concat(F.lit("host "), "host").alias("matched"),
    )
