"""Indicators, web policy, sessions, ledger, cases, alerts and governance."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditlark import registry as R
from auditlark.operators import alerts as K
from auditlark.operators import cases as C
from auditlark.operators import content as T
from auditlark.operators import folds
from auditlark.operators import governance as G
from auditlark.operators import intel as I
from auditlark.operators import ledger as L
from auditlark.operators import sessions as S
from auditlark.operators import web as W
from auditlark.operators.windows import find_slices

US = 1_000_000


def test_merge_keeps_the_first_writer(spark):
    store = spark.createDataFrame([("a", "old")], "ioc string, feed_name string")
    new = spark.createDataFrame([(2, "b", "second"), (1, "b", "first"), (3, "a", "late")], "line_id long, ioc string, feed_name string")
    assert sorted(map(tuple, I.merge_iocs(store, new).collect())) == [("a", "old"), ("b", "first")]
    checked = new.withColumn("valid", F.col("line_id") != 2)
    assert tuple(I.import_counts(store, checked).first()) == (1, 1, 1)


def test_enrichment_ignores_case_and_space(spark):
    iocs = spark.createDataFrame([("Evil.Example", "domain", "f", 80, "t")], "ioc string, ioc_type string, feed_name string, confidence int, threat_type string")
    rows = spark.createDataFrame([(" evil.example ",), ("good.example",)], "v string")
    assert [r.v for r in I.enrich(rows, "v", iocs).collect()] == [" evil.example "]
    assert [r.v for r in I.enrich(rows, "v", iocs, "left_anti").collect()] == ["good.example"]


def test_feed_staleness(spark):
    feeds = spark.createDataFrame([("a", "2024-01-01 00:00:00 UTC", 6), ("b", "2024-01-01 05:00:00 UTC", 6), ("c", None, 6)],
                                  "feed_name string, last_updated string, update_interval_h int")
    as_of = 1_704_067_200 * US + 7 * 3600 * US
    assert sorted(r.feed_name for r in I.stale_feeds(feeds, as_of).collect()) == ["a", "c"]


def hits(spark, rows):
    return spark.createDataFrame([(1, "shop", i, int(t * US), ip, "pattern", "XSS") for i, (t, ip) in enumerate(rows)],
                                 "site_id int, site string, event_id long, ts_us long, src_ip string, kind string, label string")


def test_auto_block_fires_once_and_again_after_unblock(spark):
    h = hits(spark, [(0, "a"), (100, "a"), (299, "a"), (300, "a"), (310, "a"), (0, "b"), (301, "b"), (602, "b")])
    blocks = W.auto_blocks(h).collect()
    assert [(b.src_ip, b.blocked_us, b.hits) for b in blocks] == [("a", 299 * US, 3)]
    lifted = spark.createDataFrame([(1, "a", 305 * US, 99)], "site_id int, src_ip string, unblocked_us long, event_id long")
    again = W.auto_blocks(h, unblocks=lifted).orderBy("blocked_us").collect()
    assert [b.blocked_us for b in again] == [299 * US, 310 * US]
    assert W.active_blocks(W.auto_blocks(h), lifted).count() == 0


def test_block_mode(spark):
    blocks = W.auto_blocks(hits(spark, [(0, "a"), (1, "a"), (2, "a"), (0, "b"), (1, "b"), (2, "b")]))
    contained = spark.createDataFrame([("a", 1 * US), ("b", 9 * US)], "src_ip string, contained_us long")
    got = {r.src_ip: r.mode for r in W.auto_block_mode(blocks, contained).collect()}
    assert got == {"a": "ENGINE AUTO-CONTAINMENT", "b": "POLICY BLOCK"}


def test_minutes_and_urls(spark):
    sites = spark.createDataFrame([(1, "shop")], "site_id int, name string")
    rows = spark.createDataFrame([("shop", 1740 * US), ("shop", 1 * US), ("shop", 1741 * US)], "site string, ts_us long")
    got = W.per_minute(rows, sites, 1800 * US).collect()
    assert len(got) == 30
    assert {r.minute: r.n for r in got if r.n} == {"00:30": 1, "00:29": 1, "00:01": 1}
    long = "/" + "x" * 80
    assert spark.createDataFrame([(long,)], "u string").select(W.short_url(F.col("u"))).first()[0] == long[:70] + "…"


def test_revoked_session_freezes_activity(spark, events):
    ev = events([{"ts": 1, "event": "X", "user": "a"}, {"ts": 5, "event": "X", "user": "b"}, {"ts": 2, "event": "X", "src_ip": "0.0.0.0"}])
    rev = spark.createDataFrame([("9.9.9.9", 3 * US, "soc"), ("7.7.7.7", 3 * US, "soc")], "src_ip string, revoked_us long, revoked_by string")
    row, = S.zt_sessions(ev, rev).collect()
    assert (row.status, row.first_seen_us, row.last_seen_us, row.user) == ("revoked", US, US, "b")
    early = rev.withColumn("revoked_us", F.lit(0).cast("long"))
    assert S.zt_sessions(ev, early).first().status == "active"
    kills = spark.createDataFrame([(" 9.9.9.9",), ("-",), ("8.8.8.8",)], "src_ip string")
    assert sorted(r.outcome for r in S.kill_requests(kills, S.live_sessions(ev)).collect()) == ["no session", "refused", "revoked"]


INCIDENT = dict(ts_us=0, source_ip="1.1.1.1", target_host="h", classification="SQLi", detection_rule="BRUTEFORCE seen",
                mitigating_action="block", privilege_state="user", raw_record="")


def ledger(spark, *changes):
    return L.build_ledger(spark.createDataFrame([{**INCIDENT, **c} for c in changes or [{}]], schema=(
        "ts_us long, source_ip string, target_host string, classification string, detection_rule string, mitigating_action string, "
        "privilege_state string, raw_record string")))


def test_evidence_hash_covers_the_fields(spark):
    row = ledger(spark).first()
    text = ("timestamp=1970-01-01 00:00:00 UTC|source_ip=1.1.1.1|target_host=h|classification=SQLi|detection_rule=BRUTEFORCE seen|"
            "mitigating_action=block|privilege_state=user")
    assert row.canonical == text and row.sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert L.verify(ledger(spark)).first().tampered is False
    assert L.verify(ledger(spark).withColumn("target_host", F.lit("x"))).first().tampered is True


def test_pattern_resolution_and_annotation(spark):
    df = spark.createDataFrame([("x BRUTEFORCE y", ""), ("", "seen Cross-Site Scripting"), ("none", "none")], "r string, c string")
    got = [r[0] for r in df.select(L.resolve_pattern(F.col("r"), F.col("c"))).collect()]
    assert got == ["BRUTEFORCE", "XSS", None]
    named = L.mitre_annotate(spark.createDataFrame([("password_spray",), ("NOPE",)], "p string"), "p").orderBy("p").collect()
    assert [r.mitre_url for r in named] == [None, "https://attack.mitre.org/techniques/T1110/003/"]


def test_registry_counts(spark):
    row = L.technique_coverage(spark.createDataFrame([("SQLI",)], "pattern_id string")).first()
    assert (row.total_patterns, row.mapped_patterns, row.distinct_techniques, row.observed_patterns, row.observed_techniques) == (19, 19, 15, 1, 1)


def test_timeline_and_chain(spark):
    incidents = ledger(spark, {}, {"ts_us": 5 * US, "target_host": "g"}, {"ts_us": US, "source_ip": "2.2.2.2"})
    focus = L.latest_per_source(incidents)
    key = focus.where("source_ip = '1.1.1.1'").first().focus_key
    cases = spark.createDataFrame([(key, 4, "t", "open")], "incident_key string, case_id long, title string, status string")
    notes = spark.createDataFrame([(4, 9 * US, "ann", "hello")], "case_id long, note_us long, author string, note string")
    rows = L.ordered_timeline(L.incident_timeline(incidents, focus, cases, notes).where(F.col("focus_key") == key)).collect()
    assert [r.kind for r in rows] == ["related_incident", "incident_created", "case_linked", "case_note"]
    nodes = L.chain_nodes(incidents, focus).where(F.col("focus_key") == key).collect()
    assert sorted(n.type for n in nodes) == ["action", "attacker_ip", "technique", "victim_host", "victim_host"]
    assert "T1110.001 Brute Force: Password Guessing" in {n.label for n in nodes}
    edges = L.chain_edges(incidents, focus).where(F.col("focus_key") == key).collect()
    assert {e.to_id for e in edges} | {e.from_id for e in edges} == {n.node_id for n in nodes}


def test_case_service_levels(spark):
    req = spark.createDataFrame([(1, " a ", "Critical", 0), (2, "b", "Low", 0), (3, " ", "Low", 0), (4, "c", "Odd", 0)],
                                "case_id long, title string, severity string, created_us long")
    good, bad = C.create_cases(req)
    assert {r.case_id: r.sla_due_us for r in good.collect()} == {1: 4 * 3600 * US, 2: 168 * 3600 * US}
    assert {r.case_id for r in bad.collect()} == {3, 4}

    def at(hours, status="open"):
        row = C.sla_status(good.where("case_id = 1").withColumn("status", F.lit(status)), int(hours * 3600 * US)).first()
        return row.sla_state, row.sla_remaining

    assert at(1) == ("ok", "3h 0m") and at(3.5) == ("warning", "0h 30m") and at(5.25) == ("breached", "-1h 15m")
    assert at(9, "closed")[0] == "closed"


def replay_cases(steps):
    state, out = {}, {}
    for case, ts, i, to in sorted(steps, key=lambda s: (s[0], s[1], s[2])):
        now = state.get(case, "open")
        legal = (now, to) in R.CASE_TRANSITIONS
        state[case] = to if legal else now
        out[i] = (now, legal, state[case])
    return out


@pytest.mark.parametrize("block_rows,hot_rows", [(3, 20), (7, None), (256, None)])
def test_case_replay_over_blocks(spark, monkeypatch, block_rows, hot_rows):
    monkeypatch.setattr(folds, "CHAINED", 4)
    rng = random.Random(8)
    steps = [(rng.randrange(3), rng.randrange(10_000) * US, i, rng.choice(R.CASE_STATES)) for i in range(400)]
    df = spark.createDataFrame(steps, "case_id long, ts_us long, event_id long, to_status string")
    got = {r.event_id: (r.from_status, r.legal, r.status) for r in folds.case_transitions(df, block_rows=block_rows, hot_rows=hot_rows).collect()}
    assert got == replay_cases(steps)


def test_case_replay_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, 0, 1, "triage"), (1, 1, 2, None), (1, 2, 3, "odd")], "case_id long, ts_us long, event_id long, to_status string")
    out = folds.case_transitions(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert [(r.legal, r.status) for r in out.orderBy("step").collect()] == [(True, "triage"), (False, "triage"), (False, "triage")]


def test_case_current(spark):
    cases = spark.createDataFrame([(1, 0), (2, 0)], "case_id long, created_us long")
    steps = spark.createDataFrame([(1, 5, 1, "triage"), (1, 6, 2, "closed")], "case_id long, ts_us long, event_id long, to_status string")
    touches = spark.createDataFrame([(2, 9)], "case_id long, ts_us long")
    got = {r.case_id: (r.status, r.updated_us, r.next_states) for r in C.case_current(cases, steps, touches).collect()}
    assert got == {1: ("triage", 5, ["contained"]), 2: ("open", 9, ["triage"])}


@pytest.mark.parametrize("hot_rows", [10, None])
@pytest.mark.parametrize("seed", [1, 2])
def test_suppression_equals_replay(spark, seed, hot_rows):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(20_000) * US + rng.randrange(US), f"k{rng.randrange(2)}") for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, k string")
    got = {r.event_id: r.status for r in folds.suppress_repeats(df, ["k"], hot_rows=hot_rows).collect()}
    last = {}
    for i, ts, k in sorted(rows, key=lambda r: (r[1], r[0])):
        second = ts // US
        send = k not in last or second - last[k] > 900
        last[k] = second if send else last[k]
        assert got[i] == ("sent" if send else "deduped")


def test_an_unbroken_run_of_a_million_alerts(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("event_id"), (F.col("id") * US).alias("ts_us"), F.lit("one").alias("k"))
    slices = find_slices(df, ["k"], hot_rows=10_000)
    assert len(slices.borders) == 1 and len(next(iter(slices.borders.values()))) >= 3
    out = folds.suppress_repeats(df, ["k"], hot_rows=10_000).where("status = 'sent'").agg(F.count("*"), F.min("event_id"), F.max("event_id"), F.sum(F.col("event_id") % 901)).first()
    assert tuple(out) == (1110, 0, 901 * 1109, 0)


def test_dispatch_routes_and_log(spark):
    both = {"email": ["a", "b"], "webhook": ["w"]}
    rows = [(1, 0, "Critical", "x", both), (2, 900 * US, "Critical", "x", both), (3, 901 * US, "Critical", "x", both),
            (4, 0, "Medium", "y", both), (5, 0, "Low", "z", both), (6, 0, "High", "q", {})]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, severity string, title string, destinations map<string,array<string>>")
    sent = K.dispatch(df)
    assert {r.event_id: r.status for r in sent.collect()} == {1: "sent", 2: "deduped", 3: "sent", 4: "sent", 5: "unrouted", 6: "unrouted"}
    log = K.delivery_log(sent)
    assert log.where("event_id = 1").count() == 3 and log.where("event_id = 4").count() == 1
    assert {(r.status, r.channel, r.n) for r in K.log_counts(log).collect()} == {("sent", "email", 4), ("sent", "webhook", 3), ("deduped", "dedup", 1)}


@pytest.fixture
def one_org(spark):
    orgs = spark.createDataFrame([("o",)], "org string")
    none = spark.createDataFrame([], "org string, event_id long, ts_us long, control_id string, status string, evidence string")
    assets = R.assets_df(spark).withColumn("org", F.lit("o"))
    return orgs, none, assets


def test_seed_scores(spark, one_org):
    orgs, none, assets = one_org
    seed = G.latest_status(none, orgs)
    score = G.readiness(seed, assets, none).first()
    assert (score.score, score.compliant, score.non_compliant, score.under_attack, score.cii_assets) == (74.9, 20, 8, 0, 4)
    risk = G.institutional_risk(seed, assets).first()
    assert (risk.score, risk.band, risk.base) == (100.0, "ELEVATED", 87.5)
    assert {(r.total_mapped, r.compliant, r.coverage_pct) for r in G.framework_coverage(seed).collect()} == {(28, 20, 71.4)}
    row = G.framework_matrix(seed).where("control_id = 'PISF-04.1'").first()
    assert (row.pci_dss_4, row.peca_2016) == ("11.4, 11.4.1", "s.4, s.10")
    assert {r.tag for r in G.asset_grid(seed, assets).collect()} == {"CII-PRIORITY", "STANDARD"}
    assert G.framework_notes(seed).where("note IS NULL").count() == 0


def test_attack_lowers_the_score_and_restore_lifts_it(spark, one_org):
    orgs, _, assets = one_org
    hit = spark.createDataFrame([("o", 1, 5, "PISF-05.2", "Under Attack", "e")], "org string, event_id long, ts_us long, control_id string, status string, evidence string")
    now = G.latest_status(hit, orgs)
    score = G.readiness(now, assets, hit).first()
    assert score.under_attack == 1 and score.score == round(100 * 151 / 215 - 8, 1) and score.tone == "bad"
    assert {r.tag for r in G.asset_grid(now, assets).collect()} == {"CII-ESCALATED", "STANDARD"}
    back = hit.unionByName(G.control_restore(now, 9).withColumn("event_id", F.lit(2).cast("long")))
    assert G.readiness(G.latest_status(back, orgs), assets, hit).first().under_attack == 0


def test_evidence_is_the_tail_of_all_lines(spark, one_org):
    orgs, _, _ = one_org
    rows = [("o", i, i * US, "PISF-05.2", "Under Attack" if i % 2 else "Compliant", "x" * (i % 90)) for i in range(300)]
    df = spark.createDataFrame(rows, "org string, event_id long, ts_us long, control_id string, status string, evidence string")
    row = G.control_status(df, orgs).where("control_id = 'PISF-05.2'").first()
    from datetime import datetime, timezone

    stamp = lambda i: datetime.fromtimestamp(i, timezone.utc).strftime("[%Y-%m-%d %H:%M:%S UTC] ")
    assert row.evidence == "\n".join(stamp(i) + "x" * (i % 90) for i in range(300))[-4000:]
    assert (row.status, row.last_assessment_us) == ("Under Attack", 299 * US)


def test_secret_scan(spark):
    text = "# password = 'hidden'\n  db_password = 'hunter22'\napi_key=\"abcd\"\nSECRET = bare_value # note\nlonely = 'x'\ntoken = unquoted\n"
    rows = T.secret_scan(spark.createDataFrame([(1, text)], "id int, text string"), "text").orderBy("line").collect()
    assert [(r.line, r.identifier, r.masked_value) for r in rows] == [
        (2, "db_password", "hu••••22"), (3, "api_key", "••••"), (4, "SECRET", "ba••••••ue")]


def test_sca_scan(spark):
    text = "# deps\nDjango==3.0.13\nrequests==2.20.0\npillow@8.3\nflask\nnumpy==1.0\nurllib3==1.25.10"
    rows = T.sca_scan(spark.createDataFrame([(1, text)], "id int, text string"), "text").orderBy("line").collect()
    assert [r.status for r in rows] == ["VULNERABLE", "CLEAR", "VULNERABLE", "VULNERABLE", "NO BASELINE", "CLEAR"]


def test_id_mask(spark):
    df = spark.createDataFrame([("a 12345-1234567-8 b 1-2-3 99999-0000000-1",)], "t string")
    assert [r.masked_id for r in T.find_ids(df, "t").collect()] == ["123••-•••••••-8", "999••-•••••••-1"]


def test_sinks(spark, tmp_path):
    from auditlark.sources import sinks

    incidents = ledger(spark, {}, {"ts_us": 90_000 * US})
    sinks.append_ledger(incidents, str(tmp_path / "ledger"))
    sinks.append_ledger(incidents, str(tmp_path / "ledger"))
    back = spark.read.parquet(str(tmp_path / "ledger"))
    assert back.count() == 4 and back.select("day").distinct().count() == 2
    focus = L.latest_per_source(incidents)
    sinks.export_forensics(
        incidents.select("incident_key"), L.chain_nodes(incidents, focus), L.chain_edges(incidents, focus), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f" / "nodes")).count() == 5
    sinks.append_jsonl(incidents.select("source_ip"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
