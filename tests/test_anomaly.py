import math
import random
import time
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from auditlark.functions.text import shannon_entropy, text_entropy
from auditlark.operators import anomalies as A
from auditlark.operators import stats as S
from auditlark.operators import ueba as U

US = 1_000_000


def series(spark, values):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")


def test_zscore_flags_the_spike_only(spark):
    found = S.zscore_outliers(series(spark, [10] * 20 + [100]), ["k"], "v").collect()
    assert [r.i for r in found] == [20]
    assert S.zscore_outliers(series(spark, [5, 5, 5]), ["k"], "v").count() == 0
    assert S.zscore_outliers(series(spark, [1, 100]), ["k"], "v").count() == 0


def test_mad_sees_outliers_that_mask_each_other(spark):
    values = [10, 11, 9, 10, 12, 10, 11, 9, 10, 500, 510]
    assert [r.i for r in S.mad_outliers(series(spark, values), ["k"], "v").orderBy("i").collect()] == [9, 10]
    assert S.zscore_outliers(series(spark, values), ["k"], "v").count() == 0
    assert S.mad_outliers(series(spark, [5, 5, 5, 9]), ["k"], "v").count() == 0


@pytest.mark.parametrize("text,bits", [("", 0.0), ("aaaa", 0.0), ("ab", 1.0), ("aab", 0.918296), ("abcd", 2.0), ("ééàà", 1.0)])
def test_entropy(spark, text, bits):
    got = spark.createDataFrame([(text,)], "t string").select(shannon_entropy(F.col("t")).alias("e")).first().e
    assert got == pytest.approx(bits, abs=1e-6)


def test_entropy_of_long_texts(spark):
    rng = random.Random(7)
    many = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1_000_000))
    counts = Counter(many)
    expected = -sum(n / len(many) * math.log2(n / len(many)) for n in counts.values())
    start = time.perf_counter()
    assert text_entropy(many) == pytest.approx(expected)
    assert time.perf_counter() - start < 1
    assert text_entropy(many[:5000], slice_chars=77) == pytest.approx(text_entropy(many[:5000]))
    rows = [(0, many), (1, None), (2, "a\u0000\U0001F600\U0001F600"), (3, "\U0001F600" * 9)]
    got = [r.e for r in spark.createDataFrame(rows, "i int, t string").select("i", shannon_entropy(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == [pytest.approx(expected), 0.0, 1.5, 0.0]


def test_ewma_waits_for_the_warmup(spark):
    def run(values):
        df = spark.createDataFrame([("k", i, i * US, float(v)) for i, v in enumerate(values)], "k string, event_id long, ts_us long, v double")
        return [r.spike for r in S.ewma_spikes(df, ["k"], "v").orderBy("ts_us").collect()]

    assert run([10] * 15 + [100])[-1] is True
    assert not any(run([10] * 5 + [100]))
    assert not any(run([10] * 30 + [0]))


def test_dga_hosts(events):
    rows = [{"ts": 0, "event": "X", "host": "x7f3k9q2zvb8w1m4.evil-cdn.net"}, {"ts": 1, "event": "X", "host": "www.example.com"},
            {"ts": 2, "event": "X", "host": "abcdefghijklmnopqrstuvwx"}]
    found = A.dga_hosts(events(rows)).collect()
    assert len(found) == 1 and found[0].score == pytest.approx(45 + (found[0].entropy - 4.2) * 30)


def test_severity_bands(spark):
    df = spark.createDataFrame([(80.0,), (79.9,), (59.9,), (39.9,)], "s double")
    assert [r[0] for r in df.select(A.severity_band(F.col("s"))).collect()] == ["Critical", "High", "Medium", "Low"]


def replay_risk(rows, attempt_span, event_span):
    """Risk by the stated rules, one event at a time."""
    ips, hosts, hours = defaultdict(set), defaultdict(set), defaultdict(lambda: defaultdict(int))
    logins = defaultdict(int)
    attempts = defaultdict(lambda: deque(maxlen=attempt_span))
    seen = defaultdict(lambda: deque(maxlen=event_span))
    out = {}
    for i, ts, event, user, ip, host in sorted(rows, key=lambda r: (r[1], r[0])):
        hour = ts // US // 3600 % 24
        if event in ("AUTH_OK", "AUTH_FAIL"):
            score, n = 0.0, logins[user]
            if n >= 5:
                score += 35 if ip not in ips[user] and ip != "0.0.0.0" else 0
                score += 25 if hours[user][hour] / n < 0.10 else 0
                if len(attempts[user]) >= 5:
                    ratio = sum(attempts[user]) / len(attempts[user])
                    score += 20 * ratio if ratio >= 0.5 else 0
                times = seen[user]
                if len(times) >= 10:
                    recent = sum(t >= ts - 600 * US for t in times)
                    span = max(1.0, (times[-1] - times[0]) / US / 60)
                    score += 15 if recent >= 10 and recent / 10 > 5 * len(times) / span else 0
                score += 5 if host != "-" and host not in hosts[user] else 0
            out[i] = min(100.0, score)
        seen[user].append(ts)
        if event == "AUTH_OK":
            ips[user].add(ip), hosts[user].add(host)
            hours[user][hour] += 1
            logins[user] += 1
            attempts[user].append(0)
        elif event == "AUTH_FAIL":
            attempts[user].append(1)
    return out


@pytest.mark.parametrize("seed,attempt_span,event_span,block", [(1, 50, 500, 200_000), (2, 6, 12, 15), (3, 5, 20, 20)])
def test_user_risk_equals_replay(spark, seed, attempt_span, event_span, block):
    rng = random.Random(seed)
    rows, ts = [], 0
    for i in range(500):
        ts += rng.choice([1, 5, 30, 7200, 40_000]) * US
        rows.append((i, ts, rng.choice(["AUTH_OK", "AUTH_OK", "AUTH_FAIL", "HTTP_REQ"]), f"u{rng.randrange(2)}",
                     f"1.1.1.{rng.randrange(6)}", rng.choice(["a", "b", "c", "-"])))
    df = spark.createDataFrame(rows, "event_id long, ts_us long, event string, user string, src_ip string, host string")
    got = {r.event_id: r.score for r in U.user_risk(
        df, block_rows=block, attempt_span=attempt_span, event_span=event_span).collect()}
    expected = replay_risk(rows, attempt_span, event_span)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=0.051)


def test_risk_of_a_burst(spark):
    rows = [(i, i * 86_400 * US, "AUTH_OK", "u", "1.1.1.1", "a") for i in range(20)]
    base = 20 * 86_400 * US
    rows += [(100 + i, base + i * US, "HTTP_REQ", "u", "1.1.1.1", "a") for i in range(12)]
    rows.append((200, base + 60 * US, "AUTH_OK", "u", "1.1.1.1", "a"))
    df = spark.createDataFrame(rows, "event_id long, ts_us long, event string, user string, src_ip string, host string")
    last = U.user_risk(df).where("event_id = 200").first()
    assert (last.score, last.factors) == (15.0, ["burst"])


def test_posture(events):
    rows = [{"ts": i, "event": "AUTH_OK"} for i in range(5)] + [{"ts": 10 + i, "event": "AUTH_FAIL"} for i in range(5)]
    row = U.user_posture(events(rows)).first()
    assert (row.logins_observed, row.recent_fail_ratio, row.posture_score, row.baseline_trusted) == (5, 0.5, 30.0, True)


def test_anomalies_become_incidents(spark):
    found = spark.createDataFrame(
        [(1, 0, "UEBA user-risk", s, b, "why", "", "u", "1.1.1.1", "h") for s, b in ((85.0, "Critical"), (65.0, "High"), (45.0, "Medium"))],
        "event_id long, ts_us long, detector string, score double, severity string, explanation string, detail string, user string, src_ip string, host string",
    )
    rows = A.anomaly_incidents(found).collect()
    assert {r.classification for r in rows} == {"ML_ANOMALY:UEBA user-risk"} and len(rows) == 2
    assert {(r.severity, r.n) for r in A.anomaly_stats(found).where("severity IS NOT NULL").collect()} == {
        ("Critical", 1), ("High", 1), ("Medium", 1)}
