import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from auditlark.llm import bpe

CASES = [
    "Hello world's  don't 123 É é ΣΑΣ ﬁ İ x́y <|endoftext|> a<|startoftext|>b", "a\xa0b c!!! ??'s 'S 'll", "", "  ", "é!!日本語 𝄞 ½²Ⅷ", "<|endoftext|>",
    "hello<|endoftext|>", "a" * 300, "thththth" * 40 + " the" * 50, "\x00\x1c\x1f\x85​﻿ x", "é ́ <|endof text|>", "'s't're'xm", "ẞ ǅ Ω K",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.default_path())


def test_encoder_matches_the_library(reference, monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary.load(bpe.default_path()))
    rng = random.Random(1)
    alphabet = "etaoin shrdlu'sß.,!?1é日\n\t<|>ÀΣ"
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(500)]
    for piece in (bpe.PIECE_CHARS, 40):
        monkeypatch.setattr(bpe, "PIECE_CHARS", piece)
        ids, at = encoder.encode(texts)
        for text, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_a_full_cache_starts_afresh(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    encoder = bpe.Encoder(bpe.Vocabulary.load(bpe.default_path()))
    for text in ["one two three four five six seven <|endoftext|>", "eight nine", "one two"]:
        assert encoder.encode([text])[0].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_words_of_a_usual_partition_are_merged_once(monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary.load(bpe.default_path()))
    merged = []

    def merge(words):
        merged.extend(words)
        return np.arange(len(words)), list(range(1, 1 + len(words)))

    monkeypatch.setattr(encoder, "merge", merge)
    letters = "abcdefghijklmnop"
    words = ["".join(letters[i >> s & 15] for s in (16, 12, 8, 4, 0)) for i in range(200_000)]
    texts = [" ".join(words[a:a + 5_000]) for a in range(0, len(words), 5_000)]
    first, again = (encoder.encode(texts) for _ in range(2))
    assert len(merged) == len(words) and (first[0] == again[0]).all() and (first[1] == again[1]).all()
    assert first[1].tolist() == list(range(0, len(words) + 1, 5_000))


def test_round_trip_over_a_table(spark, reference):
    rows = [(i, t, "kept") for i, t in enumerate([None, *CASES, *CASES[:2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    vocabulary = bpe.Vocabulary.load(bpe.default_path())
    found = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == reference.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([-1, 320, None, 10**6, 320],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, vocabulary).collect()] == ["", "", "a</w> a</w>"]
