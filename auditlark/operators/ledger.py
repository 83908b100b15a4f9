"""Incident ledger, evidence hashes, timelines and attack chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.times import stamp_utc

HASHED = (
    "timestamp", "source_ip", "target_host", "classification", "detection_rule", "mitigating_action", "privilege_state",
)


def canonical_record() -> Column:
    """``k=v`` pairs in fixed order: the text the evidence hash covers."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in HASHED]
    return F.concat_ws("|", *parts)


def with_evidence(incidents: DataFrame) -> DataFrame:
    """Add the stamp, the canonical record, its hash and a key that is stable across runs."""
    stamped = incidents.withColumn("timestamp", stamp_utc(F.col("ts_us")))
    hashed = stamped.withColumn("canonical", canonical_record())
    return hashed.withColumn("sha256", F.sha2("canonical", 256)).withColumn(
        "incident_key", F.sha2(F.concat_ws("|", F.col("ts_us").cast("string"), "canonical", "raw_record"), 256)
    )


def playbook_incidents(decisions: DataFrame) -> DataFrame:
    """Decided pattern hits in ledger shape."""
    rule = F.concat_ws(" ", "pattern_id", "name")
    return decisions.select(
        "ts_us", F.col("src_ip").alias("source_ip"), F.col("host").alias("target_host"),
        F.col("asset_class").alias("classification"), rule.alias("detection_rule"),
        F.col("decision").alias("mitigating_action"), F.lit("user").alias("privilege_state"),
        F.concat(F.lit("matched="), "matched").alias("raw_record"),
    )


def build_ledger(*sources: DataFrame) -> DataFrame:
    """One ledger from all incident sources, each identical incident once."""
    columns = ["ts_us", *HASHED[1:], "raw_record"]
    ledger = sources[0].select(*columns)
    for source in sources[1:]:
        ledger = ledger.unionByName(source.select(*columns))
    return with_evidence(ledger).dropDuplicates(["incident_key"])


def verify(ledger: DataFrame) -> DataFrame:
    """Rows with ``tampered``: the stored hash no longer covers the fields."""
    return ledger.withColumn("tampered", F.sha2(canonical_record(), 256) != F.col("sha256"))


def recent(ledger: DataFrame, limit: int = 25, classification_prefix: str | None = None) -> DataFrame:
    """Latest incidents; the filter applies before the limit."""
    chosen = ledger if classification_prefix is None else ledger.where(
        F.col("classification").startswith(classification_prefix)
    )
    return chosen.orderBy(F.desc("ts_us"), "incident_key").limit(limit)


def resolve_pattern(rule: Column, classification: Column) -> Column:
    """Pattern id named in the rule, else the first pattern whose name occurs in either text."""
    rule, classification = F.coalesce(rule, F.lit("")), F.coalesce(classification, F.lit(""))
    by_id = [F.when(F.upper(rule).contains(p.pattern_id), p.pattern_id) for p in R.PATTERNS]
    by_name = [
        F.when(F.lower(classification).contains(p.name.lower()) | F.lower(rule).contains(p.name.lower()), p.pattern_id)
        for p in R.PATTERNS
    ]
    return F.coalesce(*by_id, *by_name)


def mitre_annotate(rows: DataFrame, pattern: str) -> DataFrame:
    """Add technique columns; rows of unknown patterns keep nulls."""
    t = R.techniques_df(rows.sparkSession).select(
        F.col("pattern_id").alias("_pid"), F.col("technique_id").alias("mitre_technique_id"),
        F.col("technique").alias("mitre_technique"), F.col("tactics").alias("mitre_tactics"), F.col("url").alias("mitre_url"),
    )
    return rows.join(F.broadcast(t), F.upper(pattern) == F.col("_pid"), "left").drop("_pid")


def tactic_rollup(hits: DataFrame) -> DataFrame:
    """Hits per tactic and severity, with subtotals."""
    annotated = mitre_annotate(hits, "pattern_id").where("mitre_tactics IS NOT NULL")
    return (
        annotated.select("severity", F.explode("mitre_tactics").alias("tactic"), "mitre_technique_id")
        .cube("severity", "tactic")
        .agg(F.count("*").alias("hits"), F.count_distinct("mitre_technique_id").alias("techniques"))
    )


def technique_coverage(hits: DataFrame) -> DataFrame:
    """One row: patterns and techniques of the registry, and those seen in the hits."""
    spark = hits.sparkSession
    seen = hits.groupBy("pattern_id").agg(F.count("*").alias("n"))
    registry = R.patterns_df(spark).select("pattern_id").join(R.techniques_df(spark), "pattern_id", "left")
    return registry.join(seen, "pattern_id", "left").agg(
        F.count("*").alias("total_patterns"), F.count("technique_id").alias("mapped_patterns"),
        F.count_distinct("technique_id").alias("distinct_techniques"), F.count("n").alias("observed_patterns"),
        F.count_distinct(F.when(F.col("n").isNotNull(), F.col("technique_id"))).alias("observed_techniques"),
    )


def owasp_rollup(hits: DataFrame) -> DataFrame:
    """Patterns per category and their hits; unseen categories keep 0."""
    seen = hits.groupBy("pattern_id").agg(F.count("*").alias("n"))
    return (
        R.patterns_df(hits.sparkSession)
        .join(seen, "pattern_id", "left")
        .groupBy("owasp")
        .agg(F.array_join(F.array_sort(F.collect_set("pattern_id")), ",").alias("patterns"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    )


def latest_per_source(ledger: DataFrame) -> DataFrame:
    """The newest incident of every source, as focus of timelines and chains."""
    order = F.struct("ts_us", "incident_key")
    return ledger.groupBy("source_ip").agg(F.max_by("incident_key", order).alias("focus_key"))


def incident_timeline(ledger: DataFrame, focus: DataFrame, cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Timeline of focus incidents, at most one per source.

    Every incident is placed once, on the timeline of its source: as the
    creation when it is the focus, else as related. Cases and their notes hang
    off the focus. ``cases`` has ``incident_key, case_id, title, status``;
    ``notes`` has ``case_id, note_us, author, note``.
    """
    placed = ledger.join(focus, "source_ip")
    is_focus = F.col("incident_key") == F.col("focus_key")
    created = F.format_string(
        "%s by %s on %s, found by %s, answered with %s",
        "classification", "source_ip", "target_host", "detection_rule", "mitigating_action",
    )
    related = F.format_string(
        "same source: %s on %s, answered with %s",
        "classification", "target_host", "mitigating_action",
    )
    incidents = placed.select(
        "focus_key", "ts_us",
        F.when(is_focus, "incident_created").otherwise("related_incident").alias("kind"),
        F.when(is_focus, created).otherwise(related).alias("summary"),
    )
    heads = placed.where(is_focus).select("focus_key", "ts_us")
    linked = cases.withColumnRenamed("incident_key", "focus_key").join(heads, "focus_key")
    # Linked cases are shown at the time of the incident.
    case_rows = linked.select(
        "focus_key", "ts_us", F.lit("case_linked").alias("kind"),
        F.format_string("case %d, %s: %s", "case_id", "status", "title").alias("summary"),
    )
    note_rows = notes.join(linked.select("case_id", "focus_key"), "case_id").select(
        "focus_key", F.col("note_us").alias("ts_us"), F.lit("case_note").alias("kind"),
        F.format_string("case %d: %s", "case_id", "note").alias("summary"),
    )
    return incidents.unionByName(case_rows).unionByName(note_rows)


def ordered_timeline(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("focus_key", "ts_us", F.col("kind") != "incident_created", "kind", "summary")


def _chain_base(ledger: DataFrame, focus: DataFrame) -> DataFrame:
    placed = ledger.join(focus, "source_ip").withColumn("is_focus", F.col("incident_key") == F.col("focus_key"))
    placed = placed.withColumn("pattern_id", resolve_pattern(F.col("detection_rule"), F.col("classification")))
    named = mitre_annotate(placed, "pattern_id")
    return named.withColumn("tech", F.concat(F.lit("tech:"), F.coalesce("pattern_id", F.lit("unknown")))).withColumn(
        "action", F.when(F.coalesce("mitigating_action", F.lit("")) == "", "no action recorded").otherwise(F.col("mitigating_action"))
    )


def _related_id() -> Column:
    return F.concat(F.lit("host:"), "target_host", F.lit("#inc"), F.substring("incident_key", 1, 12))


def chain_nodes(ledger: DataFrame, focus: DataFrame) -> DataFrame:
    """Source, technique, host and action of the focus, plus one host per related incident."""
    base = _chain_base(ledger, focus)

    def node(id_: Column, label: Column, kind: str) -> Column:
        return F.struct(id_.alias("node_id"), label.alias("label"), F.lit(kind).alias("type"))

    technique = F.coalesce(F.concat_ws(" ", F.col("mitre_technique_id"), F.col("mitre_technique")), F.lit(""))
    technique = F.when(technique != "", technique).otherwise(F.coalesce("pattern_id", "classification"))
    own = F.array(
        node(F.concat(F.lit("ip:"), "source_ip"), F.col("source_ip"), "attacker_ip"),
        node(F.col("tech"), technique, "technique"),
        node(F.concat(F.lit("host:"), "target_host"), F.col("target_host"), "victim_host"),
        node(F.lit("action:mitigation"), F.substring("action", 1, 60), "action"),
    )
    label = F.concat("target_host", F.lit(" (#"), F.substring("incident_key", 1, 12), F.lit(")"))
    other = F.array(node(_related_id(), label, "victim_host"))
    return base.select("focus_key", F.inline(F.when(F.col("is_focus"), own).otherwise(other)))


def chain_edges(ledger: DataFrame, focus: DataFrame) -> DataFrame:
    """The labelled edges between the nodes of ``chain_nodes``."""
    base = _chain_base(ledger, focus)

    def edge(a: Column, b: Column, label: str) -> Column:
        return F.struct(a.alias("from_id"), b.alias("to_id"), F.lit(label).alias("label"))

    ip, host = F.concat(F.lit("ip:"), "source_ip"), F.concat(F.lit("host:"), "target_host")
    own = F.array(
        edge(ip, F.col("tech"), "exploits via"), edge(F.col("tech"), host, "targets"),
        edge(host, F.lit("action:mitigation"), "mitigated by"),
    )
    other = F.array(edge(ip, _related_id(), "also targeted"))
    return base.select("focus_key", F.inline(F.when(F.col("is_focus"), own).otherwise(other)))


def playbook_target(attacks: DataFrame, injections: DataFrame, assets: DataFrame) -> DataFrame:
    """What the playbook would act on: first attack, else latest injection, else first critical asset.

    Each input is reduced to its one best row before they are compared.
    """
    columns = ["source_ip", "target_host", "classification", "detection_rule"]
    first_attack = attacks.orderBy("ts_us", "event_id").limit(1).select(
        F.lit(1).alias("priority"), F.col("src_ip").alias("source_ip"), F.col("host").alias("target_host"),
        F.col("asset_class").alias("classification"), F.lit("PISF-05.2 sliding window").alias("detection_rule"),
    )
    last_injection = injections.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(1).select(
        F.lit(2).alias("priority"), F.col("src_ip").alias("source_ip"), F.col("host").alias("target_host"),
        F.col("asset_class").alias("classification"), F.lit("PISF-04.2 / PISF-10.1").alias("detection_rule"),
    )
    critical = F.when(F.col("classification") == R.CLASS_CII, 0).otherwise(1)
    asset = assets.orderBy(critical, F.desc("risk_score"), "hostname").limit(1).select(
        F.lit(3).alias("priority"), F.lit(R.MANUAL_SOURCE_IP).alias("source_ip"), F.col("hostname").alias("target_host"),
        "classification", F.lit("MANUAL PLAYBOOK (no live window hit)").alias("detection_rule"),
    )
    return first_attack.unionByName(last_injection).unionByName(asset).orderBy("priority").limit(1).select(*columns)
