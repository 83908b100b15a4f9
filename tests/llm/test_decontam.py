import random
import re

import numpy as np
import pytest

from auditlark.llm import decontam as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    own, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            for p in range(len(own) - k + 1):
                if own[p:p + k] == w[a:a + k]:
                    hit |= set(range(p, p + k))
                    ids |= {i} - {None}
    return len(own), len(hit), len(ids), sorted(map(str, ids)), bool(hit)


def cases():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Ärger", "cat9", "x", "日本", "dog", "O'Neil", "ran", "hill"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.choice([0, 1, 3, 4, 6, 9]))) for i in range(14)] + [(None, "rare words here now"), (99, None), (98, " ,;"), (3, "dup id text of hill"), (3, "dup id text of hill")]
    docs = [(i, phrase(rng.randint(0, 60)) + rng.choice(["", ". ", "\n"]) + rng.choice([t or "" for _, t in items])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, "rare WORDS here, now"), (103, "rare WORDS here, now"), (None, "x rare words here now"), (104, "the " * 3_000)]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_contamination_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(D, "SEGMENT_BYTES", 300)
        monkeypatch.setattr(D, "ITEMS_PER_BLOCK", 4)
    docs, items = cases()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, term string")
    found = D.contamination(table, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, n int"), window=4).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in found], key=str)
    assert got == sorted([(i, *brute(t, items, 4)) for i, t in docs], key=str)


def test_dropping_and_empty_tables(spark):
    docs, items = cases()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted([d for d in docs if not brute(d[1], items, 4)[-1]], key=str)
    assert sorted([tuple(r) for r in D.drop_contaminated(table, bench, 4).collect()], key=str) == clean
    assert D.contamination(table.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination(table, bench.limit(0)).collect())
    assert D.drop_contaminated(table, bench.limit(0)).count() == len(docs)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha x x x x x x x beta gamma"), (3, "beta gamma"), (4, "alpha")], "doc_id long, text string")
    items = D.item_words(spark.createDataFrame([(7, "gamma alpha beta")], "item_id long, text string"))
    index = D.build_index(docs)
    place = {(r.segment, r.ordinal): r.doc_id for r in index.filter("kind = 'doc'").collect()}
    found = D.matches(index, items, window=3, proximity=5).collect()
    assert [(place[r.segment, r.ordinal], r.item_id) for r in found] == [(1, 7)]
    lists = {"a": np.array([0, 5, 9]), "b": np.array([1, 6])}
    assert D.phrase_starts(lists, {"a": 9, "b": 1}, ["a", "b"]).tolist() == [0, 5]
    assert D.phrase_starts(lists, {}, ["b", "a"]).tolist() == []


def test_words_without_white_space_and_long_texts():
    data = np.frombuffer(("a" * (D._PIECE + 50) + " b-c " + "d " * D._PIECE).encode(), np.uint8)
    _, a, b, first = D.word_table(data, np.array([0, D._PIECE + 55, len(data)]))
    assert first.tolist() == [0, 3, 3 + D._PIECE] and b[0] - a[0] == D._PIECE + 50
