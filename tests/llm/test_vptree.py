"""Vantage-point search against brute force."""

import numpy as np
import pytest

from auditlark.llm import vptree


def brute(rows, queries, k):
    """{(query id, vector)}: [(score, id)] over distinct (id, vector)."""
    pool = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in pool])
    ids = np.array([i for i, _ in pool])
    out = {}
    for q, v in sorted({(i, tuple(v)) for i, v in queries}):
        v = np.array(v)
        cosine = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        best = {}
        for i, c in zip(ids.tolist(), cosine.tolist()):
            if i != q:
                best[i, round(c, 12)] = c
        out[q] = sorted(((-round(c, 9), i) for i, c in best), key=lambda r: r)[:k]
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SHARD": 60, "LEAF": 8, "PIVOTS": 4, "BLOCK": 7, "PACK": 3}.items():
        monkeypatch.setattr(vptree, name, value)


def vectors(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(5, dim))[rng.integers(0, 5, n)]
    # A third of the rows are copies of one vector, some of another.
    x[::3] = x[0]
    x[1::30] = x[1]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_factor_one_is_exact(spark, small):
    rows = vectors(1500)
    df = vptree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    queries = [r for r in rows if r[0] % 50 == 0]
    found = vptree.search(df, df.filter("vec_id % 50 = 0"), k=5, factor=1.0).toPandas()
    expected = brute(rows, queries, 5)
    got = {q: [(-round(s, 9), i) for s, i in zip(g.sort_values("rank").score, g.sort_values("rank").vec_id)] for q, g in found.groupby("query_id")}
    assert got == expected


def test_recall_of_the_default_factor(spark, small):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) + 1.2 * rng.normal(size=(10, 24))[rng.integers(0, 10, 3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = vptree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = vptree.search(df, df.filter("vec_id % 50 = 0"), k=5).toPandas()
    expected = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {(q, i) for q, i in zip(found.query_id, found.vec_id)}
    wanted = {(q, i) for q, hits in expected.items() for _, i in hits}
    assert len(found) == len(wanted) and len(got & wanted) >= 0.9 * len(wanted)


def test_tree_work_falls_with_the_factor():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 4))
    ids = np.full((4000, 6), vptree._NO_ID)
    ids[:, 0] = np.arange(4000)
    tree = vptree.VPTree.load(vptree.VPTree(x, ids).dump())
    work = [tree.search(x[::40], np.arange(0, 4000, 40), 5, np.full(100, np.inf), f)[2] for f in (1.0, 3.0, 8.0)]
    assert work[0] < 0.5 * 100 * 4000 and work[2] < work[1] < work[0]


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "b"), (1, [2.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"),
        (6, [1.0, None], "a"), (None, [1.0, 1.0], "a"), (7, [0.0, -1.0], "a"), (8, [1.0, 1.0, 1.0], "a"), (9, [], "a"), (50, [-0.0, 3.0], "a"),
    ]
    df = vptree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    found = vptree.search(df, df.filter("vec_id % 50 = 0"), k=5).toPandas().sort_values(["query_id", "rank"])
    assert [tuple(r) for r in found[["query_id", "rank", "vec_id"]].itertuples(index=False)] == [(0, 1, 1), (0, 2, 7), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 7)]
    assert found["score"].tolist() == [1.0, 0.0, 0.0, 0.0, 0.0, -1.0]
    assert vptree.search(df.limit(0), df.limit(0)).count() == 0
    assert vptree.search(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0
