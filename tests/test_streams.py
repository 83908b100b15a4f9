"""Streaming operators over several micro-batches, with rows out of order between files."""

import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlark.operators import detectors as D
from auditlark.operators.folds import suppress_repeats
from auditlark.session import checkpoint_root
from auditlark.sources.json_lines import parse_jsonl_events
from auditlark.streaming import stream as M
from auditlark.streaming.processors import EwmaSpikes, SiteBlocks, SlidingWindow, UserRisk

US = 1_000_000
SCHEMA = "event_id long, ts_us long, event string, user string, src_ip string, host string, msg string"


@pytest.fixture
def shuffled(spark, tmp_path):
    """600 failures in six files; a row is at most 60 s out of order."""
    rng = random.Random(7)
    rows = sorted((rng.randrange(6000), i) for i in range(600))
    rows = [(i, t * US, "AUTH_FAIL", f"u{i % 3}", f"1.1.1.{i % 4}", "h", "GET /admin") for t, i in rows]
    rows = [r for _, r in sorted((r[1] + rng.randrange(60) * US, r) for r in rows)]
    for part in range(6):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"f{part}"))
    batch = spark.read.schema(SCHEMA).parquet(*[str(tmp_path / f"f{p}") for p in range(6)])

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f*"))

    return batch, stream


def passed(batch):
    """Rows the final watermark (two minutes behind the newest row) has passed."""
    newest = batch.agg(F.max("ts_us")).first()[0]
    return newest - 121 * US


def test_windows_equal_batch(spark, shuffled):
    batch, stream = shuffled
    expected = D.bruteforce_windows(batch, keys=("user",), window_s=100, threshold=4).where(F.col("ts_us") < passed(batch))
    found = M.run_available(M.sliding_window_stream(stream(), F.col("user"), 100, 4, delay="2 minutes")).where(F.col("ts_us") < passed(batch))
    a = sorted(map(tuple, expected.select("event_id", "n", "first_us").collect()))
    assert a and a == sorted(map(tuple, found.select("event_id", "n", "first_us").collect()))


def test_replay_rows_fill_windows_silently(spark, shuffled):
    batch, stream = shuffled
    found = M.run_available(M.sliding_window_stream(stream(), F.col("user"), 100, 4, fire_from_us=3000 * US, delay="2 minutes"))
    expected = D.bruteforce_windows(batch, keys=("user",), window_s=100, threshold=4).where(F.col("ts_us") >= 3000 * US)
    a = sorted(r.event_id for r in expected.where(F.col("ts_us") < passed(batch)).collect())
    assert a == sorted(r.event_id for r in found.where(F.col("ts_us") < passed(batch)).collect())


def test_suppression_equals_batch(spark, shuffled):
    batch, stream = shuffled
    found = M.run_available(M.suppress_stream(stream(), F.col("user"), delay="2 minutes")).where(F.col("ts_us") < passed(batch))
    expected = suppress_repeats(batch, ["user"]).where(F.col("ts_us") < passed(batch))
    assert sorted(map(tuple, found.select("event_id", "status").collect())) == sorted(map(tuple, expected.select("event_id", "status").collect()))


def test_jsonl_files_become_events(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"event": "auth_ok", "ts": 5}\n# skip\n\nbroken\n')
    rows = M.run_available(M.stream_events(spark, str(tmp_path), 9)).collect()
    assert sorted((r.event, r.ts_us) for r in rows) == [("AUTH_OK", 5 * US), ("RAW", 9)]


def test_ledger_sink_is_idempotent(spark, tmp_path, shuffled):
    _, stream = shuffled
    out = str(tmp_path / "ledger")
    listener = M.LateRows()
    spark.streams.addListener(listener)
    hits = M.hits_stream(stream().withColumn("event", F.lit("HTTP_REQ")), "2 minutes")
    query = M.ledger_sink(hits, out, str(tmp_path / "ck"), lambda b: b.select("src_ip", "pattern_id"), {"availableNow": True})
    query.awaitTermination()
    assert {r.src_ip for r in spark.read.parquet(out).collect()} == {f"1.1.1.{i}" for i in range(4)}
    spark.streams.removeListener(listener)
    assert listener.by_query[query.id] == 0


def test_parts_go_on_from_one_checkpoint(spark, shuffled):
    batch, _ = shuffled
    late = batch.where("event_id % 50 = 1 AND ts_us < 1000000000")
    rest = batch.exceptAll(late)
    parts = [rest.where(f"ts_us < {2000 * US}"), rest.where(f"ts_us >= {2000 * US}"), late]
    found, dropped = M.run_released(parts, lambda rows: M.sliding_window_stream(rows, F.col("user"), 100, 4, delay="2 minutes"))
    expected = D.bruteforce_windows(rest, keys=("user",), window_s=100, threshold=4).where(F.col("ts_us") < passed(rest))
    assert dropped == late.count() > 0
    got = sorted(map(tuple, found.where(F.col("ts_us") < passed(rest)).select("event_id", "n").collect()))
    assert got == sorted(map(tuple, expected.select("event_id", "n").collect()))


class FakeState(dict):
    """The calls of a map state that the processors make."""

    def getValue(self, key):  # noqa: N802
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.pop(key, None)

    def containsKey(self, key):  # noqa: N802
        return key in self

    def iterator(self):
        return iter(list(self.items()))


def test_risk_state_forgets_addresses():
    day = 86_400
    risk = UserRisk({"new_ip": 10, "off_hours": 0, "failures": 0, "burst": 0, "new_host": 0}, 1, 10, 10, 60, keep_s=10 * day)
    risk.ips, risk.hosts, risk.hours = FakeState(), FakeState(), FakeState()
    memory, most, scores = [], 0, []
    for step in range(100):
        rows = [(step * day * US + i * US, step * 1000 + i, "", json.dumps({"event": "AUTH_OK", "src_ip": f"a{step * 1000 + i}", "host": "h"})) for i in range(1000)]
        out, memory = risk.advance(memory, rows)
        most = max(most, len(risk.ips))
        scores += out["score"].tolist()
    assert most <= 13_000 and len(risk.hours) <= 24 and len(memory) == 21 and set(scores[1:]) == {10.0}
    again, _ = risk.advance(memory, [(100 * day * US, 1, "", json.dumps({"event": "AUTH_OK", "src_ip": "a99000", "host": "h"})),
                                     (100 * day * US, 2, "", json.dumps({"event": "AUTH_OK", "src_ip": "a5", "host": "h"}))])
    assert again["score"].tolist() == [0.0, 10.0]


def test_late_rows_are_counted(spark, tmp_path):
    for part, t in enumerate((1000, 2000, 5, 3000)):
        row = [(part, t * US, "AUTH_FAIL", "u", "1.1.1.1", "h", "m")]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"f{part}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f*"))
    listener = M.LateRows()
    spark.streams.addListener(listener)
    counts = M.counts_stream(stream, ["user"], "1 second", delay="0 seconds")
    query = M.append_sink(counts, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True})
    query.awaitTermination()
    for _ in range(50):
        if listener.by_query.get(query.id):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.by_query[query.id] == 1


def test_upsert_keeps_the_latest_row_per_key(spark, tmp_path, shuffled):
    batch, stream = shuffled
    out = tmp_path / "state"
    query = M.upsert_sink(stream(), str(out), str(tmp_path / "ck"), ["user"], trigger={"availableNow": True}, buckets=2, compact_after=2)
    query.awaitTermination()
    got = {r.user: r.ts_us for r in M.latest_state(spark, str(out), ["user"]).collect()}
    assert got == {r.user: r.last for r in batch.groupBy("user").agg(F.max("ts_us").alias("last")).collect()}
    assert len(list((out / "delta").iterdir())) == 6 and any((out / "base").iterdir())


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    for part, keys in enumerate((range(2000), range(3))):
        rows = [(i, (part * 10 + 1) * US, "AUTH_OK", f"u{i}", "1.1.1.1", "h", "m") for i in keys]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"f{part}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "f*"))
        M.upsert_sink(stream, str(tmp_path / "t"), str(tmp_path / "ck"), ["user"], trigger={"availableNow": True}).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "t" / "delta"))
    assert {r.batch_id: r["count"] for r in log.groupBy("batch_id").count().collect()} == {0: 2000, 1: 3}
    assert M.latest_state(spark, str(tmp_path / "t"), ["user"]).where(f"ts_us = {11 * US}").count() == 3


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


class FakeHandle:
    """Map and list states that count the calls made to them."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, []

    def getMapState(self, name, *_):  # noqa: N802
        handle = self

        class Counted(FakeState):
            def __getattribute__(self, attr):
                if attr in ("getValue", "updateValue", "removeKey", "containsKey", "iterator", "keys"):
                    handle.calls += 1
                return super().__getattribute__(attr)

        return self.states.setdefault(name, Counted())

    def getListState(self, name, *_):  # noqa: N802
        class Held(list):
            get, put, clear = lambda s: iter(list(s)), lambda s, rows: s.__setitem__(slice(None), rows), list.clear

        return self.states.setdefault(name, Held())

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


@pytest.mark.parametrize("processor, value", [
    (EwmaSpikes(), lambda i: str(i % 7)),
    (UserRisk({"new_ip": 35, "off_hours": 25, "failures": 20, "burst": 15, "new_host": 5}, 5, 50, 500, 600),
     lambda i: json.dumps({"event": "AUTH_OK", "src_ip": f"a{i % 15}", "host": "h"})),
    (SiteBlocks(3 * 86_400, 3), lambda i: json.dumps({"site": "s", "kind": "pattern", "text": f"t{i % 13}"})),
    (SlidingWindow(3 * 86_400, 4), lambda i: ""),
])
def test_calls_to_the_state_do_not_follow_the_rows(processor, value):
    handle = FakeHandle()
    processor.init(handle)
    rows = [(i * 3600 * US, i, "", value(i), "k") for i in range(2000)]
    random.Random(1).shuffle(rows)
    pdf = pd.DataFrame(rows, columns=["ts_us", "event_id", "member", "value", "key"])
    list(processor.handleInputRows(("k",), iter([pdf]), None))
    found = []
    for hour in (1000, 3000):
        timer = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: hour * 3_600_000})()
        found += [out for out in processor.handleExpiredTimer(("k",), timer, None)]
    # 500 hours of one row each lay in as many buckets before.
    assert handle.calls < 200 and not handle.states["pending"]
    assert found and all((f["key"] == "k").all() for f in found)


def test_keys_of_one_share_do_not_mix(spark, shuffled, monkeypatch):
    batch, stream = shuffled
    monkeypatch.setattr(M, "SHARES", 1)
    many = lambda rows: rows.withColumn("user", F.concat("user", F.col("event_id") % 5))
    expected = D.bruteforce_windows(many(batch), keys=("user",), window_s=500, threshold=4).where(F.col("ts_us") < passed(batch))
    found = M.run_available(M.sliding_window_stream(many(stream()), F.col("user"), 500, 4, delay="2 minutes")).where(F.col("ts_us") < passed(batch))
    a = sorted(map(tuple, expected.select("event_id", "user", "n", "first_us").collect()))
    assert a and a == sorted(map(tuple, found.select("event_id", "key", "n", "first_us").collect()))
