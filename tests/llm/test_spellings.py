"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlark.llm import spellings as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, min_length=5, min_count=3, one_in=97, ratio=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [u for u in words if abs(len(u) - len(w)) < 2 and one_edit(u, w)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, n, len(near[w]), forms[w], words.get(forms[w]), root))
    return out


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.variants(docs, **kw).collect()}


def corpus(seed, letters="aeiost", n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(60)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 12)):
            w = words[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
            own.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 50 else None, rng.choice([" ", ", ", "\n", "-"]).join(own)))
    return rows


@pytest.mark.parametrize("bucket", [256, 2])
def test_variants_equal_brute_force(spark, monkeypatch, bucket):
    """With small buckets most words ask letter by letter."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = corpus(bucket) + [(7, None), (8, ""), (9, "   "), (9, "12 34 ab")]
    rows += [(1000 + i, " ".join(["chaintt"] * 4 + ["chaint"] * (i % 5 > 1) + ["chains"] * (i % 5 == 4))) for i in range(100)]
    expected = brute(rows, one_in=7)
    assert sum(r[3] is not None for r in expected) > 50 and any(r[3] != r[5] for r in expected if r[3])
    assert found(spark, rows, one_in=7) == expected


def test_letters_beyond_ascii_and_long_runs(spark):
    long = "ab" * 1_500
    rows = [(i, f"straße STRASSE straÿe Ärger ärger Ärger× ärge {long} {long}c {long[1:]}") for i in range(4)] + [(i, "straße naïve naïvé") for i in range(9)]
    assert found(spark, rows) == brute(rows)


def test_ties_and_an_empty_table(spark):
    rows = [(i, "abcde") for i in range(3)] + [(i, "abcdz abcdy") for i in range(10, 16)]
    got = found(spark, rows, one_in=10**9)
    assert ("abcde", 3, 2, "abcdy", 6, "abcdy") in got and got == brute(rows, one_in=10**9)
    assert found(spark, []) == set()


def test_neighbourhoods_hold_every_edit():
    """The keys of all words one edit away are among a word's keys, under both alphabets."""
    rng = np.random.default_rng(2)
    for symbols in (S.SYMBOLS, None):
        word = rng.choice(S.ALPHABET, 8).astype(np.uint64)
        keys = set(S.neighbour_keys(word[None], symbols)[0].tolist())
        for at in range(9):
            letter = rng.choice(S.ALPHABET)
            edits = [np.insert(word, at, letter)] + ([np.delete(word, at), np.where(np.arange(8) == at, letter, word)] if at < 8 else [])
            for edit in edits:
                assert int(S.own_keys(edit[None], symbols)[0]) in keys
