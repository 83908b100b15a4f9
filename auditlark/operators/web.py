"""Web-traffic analytics and the auto-block policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import strip
from .windows import Total, first_row, floor_div, running_totals, sliding_state, US

BLOCK_THRESHOLD = 3
BLOCK_WINDOW_S = 300


def site_hits(pattern_hits: DataFrame, owasp_hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Pattern and request-scan hits on registered sites, each once, real sources only.

    A malicious request may count once in each family, as both detectors see it.
    """
    columns = ["event_id", "ts_us", "src_ip", "kind", "label", "_site", "_text"]
    p = pattern_hits.select(
        "event_id", "ts_us", "src_ip", F.lit("pattern").alias("kind"), F.col("pattern_id").alias("label"),
        F.col("host").alias("_site"), F.concat_ws("|", "pattern_id", F.substring("matched", 1, 60)).alias("_text"),
    )
    site = F.coalesce("site", "host") if "site" in owasp_hits.columns else F.col("host")
    i = owasp_hits.select(
        "event_id", "ts_us", "src_ip", F.lit("injection").alias("kind"), F.array_join("signatures", ",").alias("label"),
        site.alias("_site"), F.substring("msg", 1, 60).alias("_text"),
    )
    known = sites.select("site_id", F.col("name").alias("_site"))
    hits = p.select(columns).unionByName(i.select(columns)).join(known, "_site")
    hits = hits.withColumn("src_ip", strip("src_ip")).where(~F.col("src_ip").isin(*R.PLACEHOLDER_IPS))
    return first_row(hits, ["kind", "src_ip", "_text", "ts_us"], ["event_id"]).select(
        "site_id", F.col("_site").alias("site"), "event_id", "ts_us", "src_ip", "kind", "label"
    )


def auto_blocks(
    hits: DataFrame, *, window_s: int = BLOCK_WINDOW_S, threshold: int = BLOCK_THRESHOLD,
    unblocks: DataFrame | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """First crossing per (site, source); an unblock starts a new episode."""
    keys = ["site_id", "site", "src_ip"]
    crossed = sliding_state(hits, keys, window_s, hot_rows=hot_rows).where(F.col("n") >= threshold)
    episode_keys = ["site_id", "src_ip"]
    if unblocks is not None:
        marks = unblocks.select("site_id", "src_ip", F.col("unblocked_us").alias("ts_us"), F.lit(1).alias("_u"))
        both = crossed.withColumn("_u", F.lit(0)).unionByName(marks, allowMissingColumns=True)
        crossed = running_totals(both, episode_keys, {"episode": Total(F.col("_u"))}).where("_u = 0").drop("_u")
        episode_keys = [*episode_keys, "episode"]
    first = first_row(crossed, episode_keys, ["ts_us", "event_id", "kind"])
    reason = F.format_string(
        f"%d hits by %s within {window_s} s, {threshold} are enough", "n", "src_ip"
    )
    return first.select("site_id", "site", "src_ip", F.col("ts_us").alias("blocked_us"), F.col("n").alias("hits"),
                        reason.alias("reason"))


def containments(decisions: DataFrame, owasp_hits: DataFrame, bruteforce: DataFrame) -> DataFrame:
    """First time each source was contained by any detector."""
    parts = [
        decisions.where("decision = 'block_ip'").select("src_ip", "ts_us"),
        owasp_hits.select("src_ip", "ts_us"),
        bruteforce.select("src_ip", "ts_us"),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("src_ip").agg(F.min("ts_us").alias("contained_us"))


def auto_block_mode(blocks: DataFrame, contained: DataFrame) -> DataFrame:
    """Whether the engine had contained the source before the site policy fired."""
    earlier = F.coalesce(F.col("contained_us") <= F.col("blocked_us"), F.lit(False))
    return (
        blocks.join(contained, "src_ip", "left")
        .withColumn("mode", F.when(earlier, "ENGINE AUTO-CONTAINMENT").otherwise("POLICY BLOCK"))
        .drop("contained_us")
    )


def block_incidents(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        F.col("blocked_us").alias("ts_us"), F.col("src_ip").alias("source_ip"), F.col("site").alias("target_host"),
        F.lit("WEBSITE_AUTO_BLOCK").alias("classification"), F.col("reason").alias("detection_rule"),
        F.concat(F.col("mode"), F.lit(": "), "reason").alias("mitigating_action"),
        F.lit("website-monitor").alias("privilege_state"),
        F.format_string("auto-block site=%s ip=%s hits=%d", "site", "src_ip", "hits").alias("raw_record"),
    )


def active_blocks(blocks: DataFrame, unblocks: DataFrame, site_id: int | None = None) -> DataFrame:
    """Blocks without a later unblock, newest first."""
    last = unblocks.groupBy("site_id", "src_ip").agg(F.max("unblocked_us").alias("unblocked_us"))
    live = blocks.join(last, ["site_id", "src_ip"], "left").where(
        F.col("unblocked_us").isNull() | (F.col("unblocked_us") < F.col("blocked_us"))
    ).drop("unblocked_us")
    if site_id is not None:
        live = live.where(F.col("site_id") == site_id)
    return live.orderBy(F.desc("blocked_us"), "site_id", "src_ip")


def per_minute(rows: DataFrame, sites: DataFrame, as_of_us: int, *, minutes: int = 30, site: str = "site") -> DataFrame:
    """Rows per minute and site over the last ``minutes``, zeros included."""
    age = floor_div(F.lit(as_of_us) - F.col("ts_us"), 60 * US)
    counts = (
        rows.where((F.col("ts_us") <= as_of_us) & (F.col("ts_us") > as_of_us - minutes * 60 * US))
        .groupBy(F.col(site).alias("site"), age.alias("age"))
        .agg(F.count("*").alias("n"))
    )
    calendar = sites.select(
        F.col("name").alias("site"), F.explode(F.expr(f"sequence(0L, {minutes - 1}L)")).alias("age")
    )
    label = F.date_format(F.timestamp_micros(F.lit(as_of_us) - F.col("age") * 60 * US), "HH:mm")
    return calendar.join(counts, ["site", "age"], "left").select(
        "site", label.alias("minute"), F.coalesce("n", F.lit(0)).alias("n")
    )


def top_values(rows: DataFrame, value: Column, name: str, k: int = 10, by: str | None = None) -> DataFrame:
    """The ``k`` most frequent values, overall or per ``by``; ties by value."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys, value.alias(name)).agg(F.count("*").alias("requests"))
    if by is None:
        return counts.orderBy(F.desc("requests"), name).limit(k)
    w = Window.partitionBy(by).orderBy(F.desc("requests"), name)
    return counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def short_url(url: Column) -> Column:
    return F.when(F.length(url) > 70, F.concat(F.substring(url, 1, 70), F.lit("…"))).otherwise(url)


def status_breakdown(requests: DataFrame, site: str = "site") -> DataFrame:
    return requests.groupBy(site, F.col("status").cast("string").alias("status")).agg(F.count("*").alias("requests"))


def site_kpis(requests: DataFrame, hits: DataFrame, blocks: DataFrame, sites: DataFrame, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    r = requests.groupBy("site").agg(F.count("*").alias("requests"), distinct("ip").alias("unique_ips"))
    h = hits.groupBy("site").agg(F.count("*").alias("hits"))
    b = blocks.groupBy("site").agg(F.count("*").alias("blocks"))
    out = sites.select(F.col("name").alias("site")).join(r, "site", "left").join(h, "site", "left").join(b, "site", "left")
    return out.select("site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("requests", "unique_ips", "hits", "blocks")])


def site_sources(ingests: DataFrame) -> DataFrame:
    """The kinds of input each site has used, joined by ``+``."""
    joined = F.array_join(F.array_sort(F.collect_set("source")), "+")
    return ingests.groupBy("site").agg(joined.alias("ingest_sources"))
