"""Window helpers against plain replays on random input, with slices and blocks small
enough that one key spans many of them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlark.operators import windows as W
from auditlark.operators.stats import exact_median, ewma_spikes
from auditlark.operators.windows import Over, Total, carried, find_slices, row_blocks, running_totals, sliding_state

US = 1_000_000


def random_rows(seed, n=300, span=400):
    rng = random.Random(seed)
    return [
        (i, rng.randrange(span) * US, f"ip{rng.randrange(2)}", f"u{rng.randrange(4)}") for i in range(n)
    ]


@pytest.mark.parametrize("hot_rows", [10, 1_000])
@pytest.mark.parametrize("window", [30, 2_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_sliding_state_equals_replay(spark, seed, window, hot_rows):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "event_id long, ts_us long, ip string, user string")
    got = {
        r.event_id: (r.n, r.users, r.over > 0, r.first_us, r.nth_us)
        for r in sliding_state(
            df, ["ip"], window, distinct={"users": "user"}, over={"over": Over("user", 3)}, first=True, nth=3, hot_rows=hot_rows
        ).collect()
    }
    assert len(got) == len(rows)
    for event_id, ts, ip, _ in rows:
        inside = sorted((t, i, u) for i, t, p, u in rows if p == ip and ts - window * US <= t <= ts)
        counts = Counter(u for _, _, u in inside)
        third = inside[2][0] if len(inside) >= 3 else None
        expected = (len(inside), len(counts), max(counts.values()) > 3, inside[0][0])
        assert got[event_id][:4] == expected
        if third is not None:
            assert got[event_id][4] == third


def test_one_key_in_one_window_is_many_even_tasks(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(5_000) * US, "ip", f"u{rng.randrange(3)}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "event_id long, ts_us long, ip string, user string")
    slices = find_slices(df, ["ip"], hot_rows=100)
    sizes = [r["count"] for r in slices.cut(df, "ts_us").groupBy("_slice").count().collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) >= tasks and max(sizes) <= 2 * sum(sizes) / len(sizes)
    out = sliding_state(df, ["ip"], 10_000, distinct={"users": "user"}, first=True, hot_rows=100)
    upto = Counter(ts for _, ts, _, _ in rows)
    n, total = {}, 0
    for ts in sorted(upto):
        total += upto[ts]
        n[ts] = total
    oldest = min(upto)
    for r in out.collect():
        assert (r.n, r.first_us) == (n[r.ts_us], oldest) and 1 <= r.users <= 3


def test_carried_rows_reach_over_empty_slices(spark):
    df = spark.createDataFrame([("k", 1, 10, 1), ("k", 1, 20, 2), ("k", 3, 50, 3), ("k", 4, 60, 4)], "k string, _slice int, ts long, id int")
    before = carried(df, ["k"], ["ts"], 2).orderBy("_slice", "ts").collect()
    assert [(r._slice, r.id) for r in before] == [(3, 1), (3, 2), (4, 2), (4, 3)]
    after = carried(df, ["k"], ["ts"], 3, back=True).orderBy("_slice", "ts").collect()
    assert [(r._slice, r.id) for r in after] == [(1, 3), (1, 4), (3, 4)]


@pytest.mark.parametrize("hot_rows", [None, 20, 1000])
def test_running_totals_equal_replay(spark, hot_rows):
    rows = random_rows(5, n=400)
    df = spark.createDataFrame(rows, "event_id long, ts_us long, ip string, user string")
    out = running_totals(
        df, ["ip"], {"seen": Total(F.lit(1)), "mine": Total(F.lit(1), ("user",)),
                     "odd": Total(F.col("event_id") % 2)}, hot_rows=hot_rows,
    )
    got = {r.event_id: (r.seen, r.mine, r.odd) for r in out.collect()}
    for event_id, ts, ip, user in rows:
        before = [(i, u) for i, t, p, u in rows if p == ip and (t, i) <= (ts, event_id)]
        expected = (len(before), sum(u == user for _, u in before), sum(i % 2 for i, _ in before))
        assert got[event_id] == expected


def test_row_blocks_bound_every_group(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("rank"))
    blocks = row_blocks(df, "rank", 100, 7)
    sizes = blocks.groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] == 107
    assert blocks.where("NOT is_copy").count() == 1000
    with pytest.raises(ValueError):
        row_blocks(df, "rank", 5, 6)


def test_exact_median_of_skewed_groups(spark):
    import numpy as np

    rng = random.Random(3)
    values = {"a": [rng.expovariate(0.01) for _ in range(3000)], "b": [5.0] * 50 + [1e9], "c": [1.0, 2.0], "d": [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v", accuracy=100).collect()}
    assert got == {k: float(np.median(v)) for k, v in values.items()}


def test_ewma_blocks_equal_one_pass(spark):
    rng = random.Random(4)
    xs = [rng.gauss(100, 10) + (500 if rng.random() < 0.02 else 0) for _ in range(8000)]
    df = spark.createDataFrame([("k", i, i * US, x) for i, x in enumerate(xs)], "k string, event_id long, ts_us long, x double")
    alpha = 0.9  # forgets quickly, so 8000 rows make several blocks
    out = ewma_spikes(df, ["k"], "x", alpha=alpha, block_rows=10).orderBy("n_sample").collect()
    mean, var = xs[0], 0.0
    assert len(out) == len(xs) and out[0].z == 0
    for row, x in zip(out[1:], xs[1:]):
        z = (x - mean) / max(var ** 0.5, 0.05 * abs(mean))
        mean, var = alpha * x + (1 - alpha) * mean, alpha * (x - mean) ** 2 + (1 - alpha) * var
        assert row.z == pytest.approx(z, rel=1e-9) and row.mean == pytest.approx(mean, rel=1e-12)
        assert row.spike == (row.n_sample > 10 and z >= 3)


def test_more_rows_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "TASK_ROWS", 100)
    rows = spark.range(2000).selectExpr("id AS event_id", "id * 7 % 500 AS ts_us", "id % 90 AS k", "'h' AS host")
    found = W.running_totals(rows, ["k"], {"n": W.Total(F.lit(1))})
    assert found.rdd.getNumPartitions() >= 20
    by_key = {}
    for r in sorted(found.collect(), key=lambda r: (r.k, r.ts_us, r.event_id)):
        by_key.setdefault(r.k, []).append(r.n)
    assert len(by_key) == 90 and all(n == list(range(1, len(n) + 1)) for n in by_key.values())
    few = W.running_totals(rows.where("event_id < 90"), ["k"], {"n": W.Total(F.lit(1))})
    assert few.rdd.getNumPartitions() <= 4
