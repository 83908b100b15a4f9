"""Control status, readiness and framework coverage.

Every operator groups by ``org``; a single organisation is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.tables import constant_df
from ..functions.times import stamp_utc
from .windows import Total, running_totals

EVIDENCE_CHARS = 4000


def control_promotions(bruteforce: DataFrame, owasp: DataFrame, findings: DataFrame, pattern_hits: DataFrame) -> DataFrame:
    """Status events that detections cause.

    Inputs carry ``event_id, ts_us`` and, where a rule needs it, ``asset_class``
    (brute force), ``signatures`` (request scan) or ``control_id`` (patterns).
    """
    def controls(*ids: str | Column) -> Column:
        return F.explode(F.array_compact(F.array(*[F.lit(i) if isinstance(i, str) else i for i in ids])))

    cii = F.when(F.col("asset_class").isin(R.CLASS_CII, "CII"), "PISF-13.2")
    bac = F.when(F.array_contains("signatures", "BAC"), "PISF-05.1")
    pieces = [
        (bruteforce, controls("PISF-05.2", "PISF-05.1", cii), "brute force"),
        (owasp, controls("PISF-04.2", "PISF-10.1", bac), "request scan"),
        (findings, controls("PISF-05.3"), "user behaviour"),
        (pattern_hits, controls(F.col("control_id")), "pattern"),
    ]
    out = None
    for df, ids, source in pieces:
        # Each detector raises a control at most once per event.
        rows = df.select("org", "event_id", "ts_us", ids.alias("control_id"), F.lit(source).alias("source"))
        rows = rows.withColumn("status", F.lit(R.STATUS_UNDER_ATTACK)).withColumn(
            "evidence", F.format_string("%s event %d", "source", "event_id")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def domain_status_events(changes: DataFrame) -> DataFrame:
    """Expand a domain-wide status change to its controls."""
    controls = R.controls_df(changes.sparkSession).select("control_id", "domain_id")
    return changes.join(F.broadcast(controls), "domain_id").drop("domain_id")


def control_status(events: DataFrame, orgs: DataFrame) -> DataFrame:
    """Last status, last assessment and evidence tail of every control of every organisation.

    The evidence is the last 4000 characters of all stamped lines, so only the
    newest lines that can fit are kept per control; they are pruned before any
    group is built.
    """
    stamped = events.withColumn("_line", F.concat(F.lit("["), stamp_utc(F.col("ts_us")), F.lit("] "), "evidence"))
    # Newest first; a line is needed while fewer than 4000 characters follow it.
    backwards = stamped.withColumn("ts_us", -F.col("ts_us")).withColumn("_len", F.length("_line") + 1).withColumn(
        "_tie", F.struct(-F.col("event_id"), "evidence")
    )
    used = running_totals(backwards, ["org", "control_id"], {"_used": Total(F.col("_len"))}, tie="_tie")
    tail = used.where(F.col("_used") - F.col("_len") <= EVIDENCE_CHARS)
    newest_first = F.array_sort(F.collect_list(F.struct(F.col("_used"), "_line", "status", F.col("ts_us"))))
    folded = tail.groupBy("org", "control_id").agg(newest_first.alias("_t")).select(
        "org", "control_id",
        F.col("_t")[0]["status"].alias("_status"), (-F.col("_t")[0]["ts_us"]).alias("last_assessment_us"),
        F.right(F.array_join(F.reverse(F.transform("_t", lambda x: x["_line"])), "\n"), F.lit(EVIDENCE_CHARS)).alias("evidence"),
    )
    seeds = org_controls(orgs)
    return seeds.join(folded, ["org", "control_id"], "left").select(
        "org", "control_id", "domain_id", "domain_name", "risk_weight",
        F.coalesce("_status", "seed_status").alias("status"), "last_assessment_us", "evidence",
    )


def org_controls(orgs: DataFrame) -> DataFrame:
    """The catalogue of controls for every organisation."""
    controls = F.array(*[
        F.struct(F.lit(c).alias("control_id"), F.lit(c.split(".")[0]).alias("domain_id"),
                 F.lit(R.DOMAINS[c.split(".")[0]]).alias("domain_name"), F.lit(s).alias("seed_status"), F.lit(w).alias("risk_weight"))
        for c, w, s, _ in R.CONTROLS
    ])
    return orgs.select("org", F.inline(controls))


def latest_status(events: DataFrame, orgs: DataFrame) -> DataFrame:
    """Status only: the fold without evidence, one pre-aggregated pass."""
    last = events.groupBy("org", "control_id").agg(F.max_by("status", F.struct("ts_us", "event_id")).alias("_status"))
    return org_controls(orgs).join(last, ["org", "control_id"], "left").withColumn(
        "status", F.coalesce("_status", "seed_status")
    ).drop("_status", "seed_status")


def control_restore(statuses: DataFrame, as_of_us: int, evidence: str = "containment executed") -> DataFrame:
    """Events that return attacked controls to Compliant; gaps stay."""
    return statuses.where(F.col("status") == R.STATUS_UNDER_ATTACK).select(
        "org", "control_id", F.lit(as_of_us).alias("ts_us"), F.lit(R.STATUS_COMPLIANT).alias("status"), F.lit(evidence).alias("evidence")
    )


def _status_counts() -> list[Column]:
    is_ = lambda s: F.col("status") == s
    return [
        F.count_if(is_(R.STATUS_COMPLIANT)).alias("compliant"),
        F.count_if(is_(R.STATUS_NON_COMPLIANT)).alias("non_compliant"),
        F.count_if(is_(R.STATUS_UNDER_ATTACK)).alias("under_attack"),
    ]


def domain_rollup(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("org", "domain_id", "domain_name").agg(
        F.count("*").alias("control_count"), *_status_counts(), F.sum("risk_weight").alias("weight_sum")
    )


def readiness(statuses: DataFrame, assets: DataFrame, incidents: DataFrame) -> DataFrame:
    """Weighted share of compliant controls, less 8 points per attacked one."""
    earned = F.sum(F.when(F.col("status") == R.STATUS_COMPLIANT, F.col("risk_weight")).otherwise(0))
    scored = statuses.groupBy("org").agg(
        *_status_counts(), F.count("*").alias("total"), earned.alias("_earned"), F.sum("risk_weight").alias("_weight")
    )
    score = F.greatest(F.lit(0.0), F.round(100.0 * F.col("_earned") / F.col("_weight") - 8.0 * F.col("under_attack"), 1))
    a = assets.groupBy("org").agg(
        F.count_if(F.col("classification") == R.CLASS_CII).alias("cii_assets"), F.count("*").alias("asset_count")
    )
    i = incidents.groupBy("org").agg(F.count("*").alias("ledger_rows"))
    out = scored.withColumn("score", score).join(a, "org", "left").join(i, "org", "left")
    return out.withColumn("tone", score_tone(F.col("score"), F.col("under_attack"))).select(
        "org", "score", "tone", "compliant", "non_compliant", "under_attack", "total",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cii_assets", "asset_count", "ledger_rows")],
    )


def score_tone(score: Column, under_attack: Column) -> Column:
    return F.when((score < 45) | (under_attack > 0), "bad").when(score < 75, "warn").otherwise("good")


def institutional_risk(statuses: DataFrame, assets: DataFrame) -> DataFrame:
    """Mean risk of critical assets, raised by attacked controls and gaps."""
    base = assets.groupBy("org").agg(
        F.coalesce(F.avg(F.when(F.col("classification") == R.CLASS_CII, F.col("risk_score"))), F.lit(0.0)).alias("base"),
        F.count_if(F.col("classification") == R.CLASS_CII).alias("cii_count"),
    )
    counts = statuses.groupBy("org").agg(*_status_counts())
    raw = F.coalesce("base", F.lit(0.0)) * (1.0 + 0.08 * F.col("under_attack") + 0.03 * F.col("non_compliant"))
    out = counts.join(base, "org", "left").withColumn("score", F.round(F.least(F.lit(100.0), raw), 1))
    band = F.when(F.col("under_attack") > 0, "SEVERE").when((F.col("score") >= 88) | (F.col("non_compliant") >= 4), "ELEVATED").otherwise("LOW")
    return out.withColumn("band", band).select(
        "org", "score", "band", F.coalesce("cii_count", F.lit(0)).alias("cii_count"), "under_attack", "non_compliant",
        F.round(F.coalesce("base", F.lit(0.0)), 1).alias("base"),
    )


def asset_grid(statuses: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets with a tag that follows the worst control of the organisation."""
    attacked = statuses.groupBy("org").agg((F.count_if(F.col("status") == R.STATUS_UNDER_ATTACK) > 0).alias("_attacked"))
    cii = F.col("classification") == R.CLASS_CII
    tag = F.when(cii & F.col("_attacked"), "CII-ESCALATED").when(cii, "CII-PRIORITY").otherwise("STANDARD")
    return assets.join(attacked, "org", "left").withColumn("_attacked", F.coalesce("_attacked", F.lit(False))).withColumn("tag", tag).drop("_attacked")


def asset_register(assets: DataFrame) -> DataFrame:
    return assets.orderBy(F.desc("risk_score"), "org", "hostname")


def _mapped(statuses: DataFrame) -> DataFrame:
    keys = R.frameworks_df(statuses.sparkSession)
    return statuses.join(F.broadcast(keys), "control_id")


def framework_coverage(statuses: DataFrame) -> DataFrame:
    """Mapped and compliant controls per framework."""
    controls = _mapped(statuses).dropDuplicates(["org", "framework_key", "control_id"])
    out = controls.groupBy("org", "framework_key").agg(F.count("*").alias("total_mapped"), *_status_counts())
    return out.withColumn("coverage_pct", F.round(100.0 * F.col("compliant") / F.col("total_mapped"), 1))


def framework_matrix(statuses: DataFrame) -> DataFrame:
    """One row per control with the references of each framework as text."""
    cells = _mapped(statuses).groupBy("org", "control_id", "status").pivot("framework_key", list(R.FRAMEWORKS))
    refs = F.array_sort(F.collect_list(F.struct("position", "ref")))
    return cells.agg(F.array_join(F.transform(refs, lambda x: x["ref"]), ", "))


def framework_notes(statuses: DataFrame, framework_key: str = "peca_2016") -> DataFrame:
    """References of one framework with the subject of each section."""
    notes = constant_df(statuses.sparkSession, list(R.SECTION_NOTES.items()), "ref string, note string")
    refs = _mapped(statuses).where(F.col("framework_key") == framework_key)
    return refs.join(F.broadcast(notes), "ref", "left").select("org", "control_id", "status", "ref", "note")
