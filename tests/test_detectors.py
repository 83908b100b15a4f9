from pyspark.sql import functions as F

from auditlark import registry as R
from auditlark.operators import detectors as D

US = 1_000_000


def fails(n, **kw):
    return [{"ts": 1000 + i, "event": "AUTH_FAIL", **kw} for i in range(n)]


def test_nine_failures_stay_quiet_and_ten_fire(events):
    assert D.bruteforce_windows(events(fails(9))).count() == 0
    hit = D.bruteforce_windows(events(fails(10))).collect()
    assert [(h.n, h.first_us, h.last_us, h.nth_us) for h in hit] == [(10, 1000 * US, 1009 * US, 1009 * US)]


def test_failures_spread_over_more_than_a_minute_stay_quiet(events):
    rows = [{"ts": 1000 + 10 * i, "event": "AUTH_FAIL"} for i in range(20)]
    assert D.bruteforce_windows(events(rows)).count() == 0


def test_keys_do_not_mix(events):
    rows = fails(9) + [{**r, "user": "bob"} for r in fails(9)]
    assert D.bruteforce_windows(events(rows)).count() == 0


def test_active_attack_and_latency(events):
    hits = D.bruteforce_windows(events(fails(12)))
    row = D.active_attacks(hits).first()
    assert (row.first_crossing_us, row.last_us, row["count"]) == (1009 * US, 1011 * US, 12)
    latest = D.detection_latency(hits, F.lit(1012 * US)).orderBy(F.desc("ts_us")).first()
    assert latest.latency_s == 3.0


def test_spray_needs_many_users_with_few_failures_each(events):
    spread = [{"ts": 1000 + i, "event": "AUTH_FAIL", "user": f"u{i % 5}"} for i in range(8)]
    assert D.password_spray(events(spread)).count() == 1
    heavy = [{"ts": 1000 + i, "event": "AUTH_FAIL", "user": f"u{i % 5 if i < 5 else 0}"} for i in range(9)]
    assert D.password_spray(events(heavy)).count() == 0
    hidden = [{**r, "src_ip": "0.0.0.0"} for r in spread]
    assert D.password_spray(events(hidden)).count() == 0


def test_distributed_bruteforce(events):
    rows = [{"ts": 1000 + 20 * i, "event": "AUTH_FAIL", "src_ip": f"5.5.5.{i % 5}"} for i in range(10)]
    found = D.distributed_bruteforce(events(rows)).collect()
    assert [(r.n, r.n_ips) for r in found] == [(10, 5)]


def test_travel_ignores_internal_networks(events):
    rows = [{"ts": 0, "event": "AUTH_OK", "src_ip": "1.2.3.4"}, {"ts": 899, "event": "AUTH_OK", "src_ip": "1.3.3.4"}]
    assert D.impossible_travel(events(rows)).count() == 1
    rows[1]["src_ip"] = "10.3.3.4"
    assert D.impossible_travel(events(rows)).count() == 0
    rows[1] = {"ts": 901, "event": "AUTH_OK", "src_ip": "1.3.3.4"}
    assert D.impossible_travel(events(rows)).count() == 0


def test_exfiltration_counts_download_urls_only(events):
    rows = [{"ts": i, "event": "HTTP_REQ", "msg": "GET /download/a"} for i in range(20)]
    rows += [{"ts": i, "event": "HTTP_REQ", "msg": "GET /index"} for i in range(50)]
    assert [r.n for r in D.exfil_bursts(events(rows)).collect()] == [20]


def test_every_signature_fires_on_a_sample(events):
    samples = {
        "SQLI": "id=1 UNION  SELECT a", "XSS": "<ScRiPt>", "CMDI": "a; whoami", "SSTI": "{{ 7 * 7 }}", "LOG4SHELL": "${jndi:ldap}",
        "SSRF": "url=http://192.168.1.5/", "LFI_TRAVERSAL": "/etc/passwd", "MISCONFIG_PROBE": "/server-status", "DESERIAL": "rO0ABX",
        "SECRET_IN_URL": "/x?a=1&token=abcd", "BAC_PROBE": "/wp-admin", "BUSINESS_LOGIC_ABUSE": "quantity = -1",
    }
    assert set(samples) == {p.pattern_id for p in R.SIGNATURES}
    rows = [{"ts": i, "event": "HTTP_REQ", "msg": m, "user": p} for i, (p, m) in enumerate(samples.items())]
    hits = D.signature_hits(D.scanned(events(rows))).collect()
    assert {h.user for h in hits if h.user == h.pattern_id} == set(samples)
    clean = [{"ts": 0, "event": "HTTP_REQ", "msg": "GET /index.html 200"}, {"ts": 1, "event": "NET_FLOW", "msg": "<script>"}]
    assert D.signature_hits(D.scanned(events(clean))).count() == 0


def test_hits_are_deduplicated_and_joined(events):
    rows = [{"ts": i, "event": "HTTP_REQ", "msg": "GET /admin"} for i in (5, 3, 9)]
    hits = D.with_pattern(D.dedup_hits(D.signature_hits(events(rows)))).collect()
    assert [(h.ts_us, h.name, h.control_id) for h in hits] == [(3 * US, "Broken Access Control Probe", "PISF-05.1")]


def test_owasp_labels(events):
    rows = [{"ts": 0, "event": "HTTP_REQ", "msg": "/admin?q=<script>' or '1'='1"}, {"ts": 1, "event": "HTTP_REQ", "msg": "/"}]
    assert [r.signatures for r in D.owasp_scan(events(rows)).collect()] == [["SQLi", "XSS", "BAC"]]


def test_telemetry_gap_needs_full_history(events):
    rows = [{"ts": m * 60 + i, "event": "NET_FLOW"} for m in range(5) for i in range(20)]
    gap = rows + [{"ts": 5 * 60 + 1, "event": "NET_FLOW"}]
    found = D.telemetry_gap(events(gap), as_of_us=5 * 60 * US + 1).collect()
    assert [(r.bucket_us, r.current, r.baseline) for r in found] == [(300 * US, 1, 20.0)]
    short = [r for r in gap if r["ts"] >= 60]
    assert D.telemetry_gap(events(short), as_of_us=5 * 60 * US + 1).count() == 0
    silent = rows + [{"ts": 6 * 60 + 1, "event": "NET_FLOW"}]  # minute 5 holds nothing
    assert [r.current for r in D.telemetry_gap(events(silent), as_of_us=6 * 60 * US).orderBy("bucket_us").collect()] == [0, 1]
    # Nothing comes after minute 4 at all.
    assert [r.bucket_us for r in D.telemetry_gap(events(rows), as_of_us=7 * 60 * US).orderBy("bucket_us").collect()] == [300 * US, 360 * US, 420 * US]
    assert D.telemetry_gap(events(rows), as_of_us=4 * 60 * US + 59).count() == 0


def test_new_ip_after_five_logins(events):
    rows = [{"ts": i, "event": "AUTH_OK"} for i in range(4)] + [{"ts": 10, "event": "AUTH_OK", "src_ip": "8.8.8.8"}]
    found = D.ueba_new_ip(D.login_history(events(rows))).collect()
    assert [(r.src_ip, r.logins) for r in found] == [("8.8.8.8", 5)]
    assert D.ueba_new_ip(D.login_history(events(rows[1:]))).count() == 0


def test_off_hours_share(events):
    rows = [{"ts": 86_400 * i + 9 * 3600, "event": "AUTH_OK"} for i in range(10)] + [{"ts": 86_400 * 20 + 3 * 3600, "event": "AUTH_OK"}]
    found = D.ueba_off_hours(D.login_history(events(rows))).collect()
    assert [(r.hour, r.hour_logins, r.logins) for r in found] == [(3, 1, 11)]


def test_escalation_prefers_the_asset_class(spark, events):
    hits = events([{"ts": 0, "event": "X", "host": "a"}, {"ts": 1, "event": "X", "host": "b", "asset_class": "CII"}])
    assets = spark.createDataFrame([("a", R.CLASS_CII), ("b", R.CLASS_STANDARD)], "hostname string, classification string")
    assert [r.host for r in D.cii_escalation(hits, assets).collect()] == ["a"]


def test_decisions(spark):
    rows = [("block_ip", "1.1.1.1", "Critical"), ("block_ip", "0.0.0.0", "High"), ("kill_session", "1.1.1.1", "High"), ("alert", "1.1.1.1", "Medium")]
    out = D.response_decisions(spark.createDataFrame(rows, "soar_action string, src_ip string, severity string")).collect()
    assert [r.decision for r in out] == ["block_ip", "alert", "kill_session", "alert"]
    assert [r.snapshot for r in out] == [True, False, False, False]


def test_status_banner(spark):
    none, one = spark.range(0), spark.range(1)
    assert D.soc_status(one, one).first().status == "UNDER ATTACK"
    assert D.soc_status(none, one).first().status == "ELEVATED"
    assert D.soc_status(none, none).first().status == "NOMINAL"


def test_physical_feed_and_latest(events):
    rows = [{"ts": 1, "event": "BADGE_FAIL"}, {"ts": 2, "event": "PHYSICAL_FAIL"}, {"ts": 3, "event": "AUTH_OK"}]
    assert D.physical_failures(events(rows)).count() == 2
    assert [r.ts_us for r in D.latest(events(rows), 2).collect()] == [3 * US, 2 * US]
    occupied = D.window_occupancy(events(fails(3)), 1002 * US).first()
    assert occupied.fails == 3
