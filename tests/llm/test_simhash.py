import random
import re

import numpy as np
import pytest
import xxhash

from auditlark.llm import simhash as S


def brute_fingerprint(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_groups(fps, radius):
    """Smallest index reachable, for each index."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


def test_covering_masks_catch_every_pair_within_the_radius():
    rng = random.Random(2)
    for radius in (1, 2, 4):
        masks = S.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3_000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(diff & (m & (1 << 64) - 1) == 0 for m in masks)


def test_spanning_edges_link_like_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        centers = rng.integers(0, 1 << 63, 3).astype(np.uint64)
        flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(40)]
        fps = np.array([centers[i % 3] ^ f for i, f in enumerate(flips)], np.uint64)
        a, b = S.spanning_edges(fps, 4)
        assert len(a) < len(fps)
        root = list(range(len(fps)))
        for _ in fps:
            for x, y in zip(a, b):
                root[x] = root[y] = min(root[x], root[y])
        assert root == brute_groups([int(f) for f in fps], 4)


def exploded_broadcasts(df):
    """Broadcasts in the physical plan of ``df`` that hold exploded rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [re.search(r"[^ :+-]|$", line).start() for line in lines]
    found = []
    for i, line in enumerate(lines):
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        if " BroadcastExchange " in line and any(" Generate " in x for x in lines[i:below]):
            found.append(line)
    return found


def test_exploded_rows_are_not_broadcast(spark):
    rng = np.random.default_rng(8)
    drawn = rng.integers(-1 << 62, 1 << 62, 700)
    rows = [(int(x), int(x)) for x in np.concatenate([drawn, drawn ^ (1 << rng.integers(0, 60, 700))])]
    classes = S.materialize(spark.createDataFrame(rows, "fp long, node long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # As the planner sees them the rows are below the threshold; they are 31 for each class.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "96k")
        edges = S.near_edges(classes, 4)
        assert len(edges.collect()) == 700
        assert " Generate " in edges._jdf.queryExecution().executedPlan().toString()
        assert not exploded_broadcasts(edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def texts():
    rng = random.Random(5)
    words = [f"Word{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 4, 5, 80, 200, 300)]
    out = base + base + ["", " \t\n", None, "é 日本 ß", "a" * 5_000, "x y " * 4_000]
    for t in base[5:]:
        for _ in range(12):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S.near_edges, "__defaults__", (block,))
    rows = [(i * 7 % 101 + 3, t, "kept", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")
    found = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(r[1], 4) for r in rows]
    roots = brute_groups(fps, 4)
    smallest = {}
    for (i, *_), root in zip(rows, roots):
        smallest[root] = min(smallest.get(root, i), i)
    assert len(found) == len(rows)
    for (i, *_), fp, root in zip(rows, fps, roots):
        assert found[i].fp & (1 << 64) - 1 == fp and found[i].component_id == smallest[root]


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "one two three four five"), (None, "one two three four five"), (5, "six seven eight nine ten"), (5, "six seven eight nine ten"), (9, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, None), (None, None), (5, 5), (5, 5), (9, 4), (4, 4)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(None, rows[0][1]), (5, rows[2][1]), (4, "")], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0
    assert S.drop_near_duplicates(docs.limit(0)).columns == ["doc_id", "text"]
