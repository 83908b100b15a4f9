import random

import corpus_pipeline
from auditlark.llm import shingles as S

from .test_simhash import exploded_broadcasts


def grams(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(texts, at=0.8):
    """Smallest index reachable, for each index, comparing all pairs."""
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if similarity(a, sets[j]) >= at and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def planted(rng, n=40):
    """Texts of 120 to 400 words and copies with some words changed."""
    prose = lambda k: [f"w{rng.randrange(900)}" for _ in range(k)]
    texts = []
    for _ in range(n):
        base = prose(rng.randint(120, 400))
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    return texts


def test_the_stage_drops_every_planted_pair_at_the_similarity(spark):
    texts = planted(random.Random(4)) + ["", None, "one two", "One  two", "a b c d e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = groups(texts)
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert kept == sorted(set(roots)) and len(kept) < len(texts) / 2


def test_small_blocks_link_alike(spark):
    rng = random.Random(9)
    # A chain: neighbours are near, ends are not, so the smallest node of a bucket does not link all.
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = []
    for i in range(40):
        base = list(base)
        base[i * 5] = f"c{i}"
        texts.append(" ".join(base))
    texts += planted(rng, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = groups(texts)
    for block in (S.BLOCK, 3):
        found = {r.doc_id: r.group for r in S.similar_groups(docs, block=block).collect()}
        smallest = {}
        for i in sorted(found):
            smallest.setdefault(found[i], i)
        assert [smallest[found[i]] for i in sorted(found)] == want


def test_the_stage_searches_fingerprints(spark, monkeypatch):
    """What the covering tables reach is linked without any band."""
    texts = planted(random.Random(4), 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Bands that no two sets share.
    monkeypatch.setattr(S, "band_keys", lambda own: [S._node(own)] * S.BANDS)
    fps = [S.fingerprint_of(S.shingle_hashes(t.lower().encode(), 5)) for t in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b)
            if bin(fps[a] ^ fps[b]).count("1") <= S.RADIUS and similarity(grams(texts[a]), grams(texts[b])) >= 0.8]
    group = {r.doc_id: r.group for r in S.similar_groups(docs).collect()}
    assert len(near) > 5 and sum(group[a] == group[b] for a, b in near) == len(near)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()}
    roots = groups(texts)
    assert {roots[i] for i in kept} == set(roots) and len(kept) < len(texts)


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    plans, write = [], S.materialize

    def recorded(df):
        plans.append((df._jdf.queryExecution().executedPlan().toString(), exploded_broadcasts(df)))
        return write(df)

    monkeypatch.setattr(S, "materialize", recorded)
    docs = spark.createDataFrame(list(enumerate(planted(random.Random(4), 12))), "doc_id long, text string")
    S.similar_groups(docs)
    # The bands, the covering tables and the blocks of the buckets that are searched.
    assert sum(" Generate " in plan for plan, _ in plans) == 3
    assert [found for _, found in plans if found] == []
