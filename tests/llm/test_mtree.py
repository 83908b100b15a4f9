import numpy as np
import pytest

from auditlark.llm import mtree as M


def brute(ids, vectors, queries, k):
    out = []
    for q, v in queries:
        rows = sorted({(-int(np.dot(x, v)), int(i), tuple(x)) for i, x in zip(ids, vectors) if i != q})[:k]
        out += [(q, rank, i, -s) for rank, (s, i, _) in enumerate(rows, 1)]
    return out


@pytest.mark.parametrize("page", [2, 5, 128])
def test_tree_search_is_exact_and_prunes(monkeypatch, page):
    monkeypatch.setattr(M, "PAGE", page)
    rng = np.random.default_rng(page)
    centers = rng.integers(-200, 200, (8, 6))
    vectors = centers[rng.integers(0, 8, 700)] + rng.integers(-3, 4, (700, 6))
    ids = rng.permutation(5_000)[:700]
    own, folded = M.fold(ids, vectors, 6)
    tree = M.MTree.load(M.MTree(own, folded, float(np.sqrt((own ** 2).sum(1).max()))).dump())
    computed = []
    for i in range(60):
        found, n = tree.search(vectors[i], int(ids[i]), 5, None)
        computed.append(n)
        assert [(int(ids[i]), r, x, s) for r, (s, x) in enumerate(found, 1)] == brute(ids, vectors, [(int(ids[i]), vectors[i])], 5)
        floor = found[-1][0]
        assert tree.search(vectors[i], int(ids[i]), 5, floor)[0] == found
    assert page == 128 or np.mean(computed) < 0.6 * len(own)


def test_search_over_a_table(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 40)
    monkeypatch.setattr(M, "SAMPLE", 50)
    monkeypatch.setattr(M, "PACK", 3)
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "x") for i in range(300)]
    rows += [(1_000 + i, [0.5, 0.25, 0.0, -0.5], "copy") for i in range(150)]
    rows += [(2_000, None, "n"), (2_001, [1.0, None, 0.0, 0.0], "n"), (2_002, [float("nan"), 1.0, 1.0, 1.0], "n"), (2_003, [1.0, 1.0, float("inf"), 1.0], "n"),
             (2_004, [], "n"), (2_050, [1.0, 2.0], "short"), (None, [1.0, 1.0, 1.0, 1.0], "n"), (50, rows[50][1], "repeat")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = M.usable(table)
    found = M.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5).collect()
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all()]
    ids, vecs = [g[0] for g in good], [g[1] for g in good]
    queries = [(i, v) for i, v in {i: v for i, v in good}.items() if i % 50 == 0]
    assert sorted(map(tuple, found)) == sorted(brute(ids, vecs, queries, 5))


def test_few_rows_and_empty_table(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [0.5, 0.5])], "vec_id long, embedding array<double>")
    vectors = M.usable(table)
    found = M.search(vectors, vectors.filter("vec_id = 0")).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 7, 32768), (0, 2, 8, 32768)]
    one = vectors.filter("vec_id = 0")
    assert M.search(one, one).count() == 0
    none = vectors.limit(0)
    assert M.search(none, none).columns == ["query_id", "rank", "vec_id", "score"] and M.search(none, none).count() == 0
