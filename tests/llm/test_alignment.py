"""Token alignment against whole-text encodings."""

import hashlib
from collections import Counter

import pytest

from auditlark.llm import alignment
from auditlark.llm.bpe import byte_symbols

FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

HOSTILE = [
    None, "", " ", "  ", "\n", "a", "x  y ", " a\nb", "a \n b\n\n  c\t\td \r\n e", "it's don't  WE'LL", "ﬁ①é é  x 　y z", "▁x", "good ▁ bad",
    "<0x0A><s></s><unk><|endoftext|> x<|endoftext|>", "x\x00y\x1cz \x1f w", "日本語 の テキスト。\n改行", "​ ‍👩‍👩‍👧 🇩🇪", "a" * 3000, "ab " * 700, " \t" * 50 + "x",
    "1234567 89,012.3", "     leading", "trailing     ", "\x85 \x85a \x0b\x0c b",
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    byte_file, piece_file = alignment.default_paths()
    first = Tokenizer.from_file(byte_file)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    of = {c: i for i, c in enumerate(byte_symbols())}
    docs, counts = [], Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        ta = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        tb = []
        for i in b:
            piece = second.id_to_piece(i)
            tb.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            docs.append(None)
            continue
        spans = []
        for tokens in (ta, tb):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        ends = [{e for _, e in own} for own in spans]
        common = sorted(ends[0] & ends[1])
        groups, start = [], 0
        for stop in common:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, own) if start < e <= stop) for ids, own in zip((a, b), spans)))
            start = stop
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, f) in zip(b, spans[1]) if max(s, t) < min(e, f)] if len(a) < 4000 else []
        docs.append((len(a), len(b), groups, links))
        counts.update(links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = doc
        out.append((
            n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 96, 7])
def test_alignment_against_whole_texts(spark, chunk):
    words = "the quick brown fox's naïve jumps\nover 12 lazy  dogs — straße ".split(" ")
    texts = [*HOSTILE, *HOSTILE, " ".join(words[(i * i + i // 7) % len(words)] for i in range(900))]
    rows = [(i // 2 if i != 4 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    found = alignment.align(docs, chunk=chunk).toPandas()
    expected = sorted((str(r[0]), *v) for r, v in zip(rows, brute(texts)))
    got = sorted(("None" if r["doc_id"] != r["doc_id"] else str(int(r["doc_id"])), *[r[f] for f in FIELDS]) for r in found.to_dict("records"))
    assert got == expected


def test_small_blocks_give_the_same_sums(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 50)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 20)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 100)
    texts = [f"one two three {i} " * (i % 5) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alignment.align(docs, chunk=64).orderBy("doc_id").toPandas()
    assert [tuple(r) for r in found[FIELDS].itertuples(index=False)] == brute(texts)


@pytest.mark.parametrize("joined", [1, 40, 1 << 13])
def test_units_encoded_together_have_the_tokens_of_each(monkeypatch, joined):
    monkeypatch.setattr(alignment, "JOINED_CHARS", joined)
    monkeypatch.setattr(alignment, "JOINED", 3)
    encoders = alignment.Encoders(*alignment.default_paths())
    units = [u for t in HOSTILE for u in alignment._UNIT.findall(" " + (t or ""))]
    units += [f" x{i} naïve" for i in range(50)]
    found = encoders.tokens(units)
    valid, a, b, lengths = encoders.encode(units)
    assert found.valid.tolist() == valid.tolist() and not valid.all() and found.lengths.tolist() == lengths.tolist()
    for ids, flat, sizes in ((a, found.a, found.n_a), (b, found.b, found.n_b)):
        ids = [x if ok else [] for x, ok in zip(ids, valid)]
        assert flat.tolist() == [i for x in ids for i in x] and sizes.tolist() == [len(x) for x in ids]
    assert not len(encoders.tokens([]).valid)


def test_short_units_do_not_cost_a_call_each():
    encoders = alignment.Encoders(*alignment.default_paths())
    asked = []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **more)

    library, encoders.a = encoders.a, Counted()
    reader = alignment.Reader(encoders, 0)
    out = reader.read([{"rid": 1, "doc_id": 1, "part": None, "text": " ".join(f"w{i}" for i in range(5_000))}])
    assert len(asked) < 20 and len(out) == 1 and out[0]["n_a"] >= 5_000


def test_composition_is_associative():
    encoders = alignment.Encoders(*alignment.default_paths())
    valid, a, b, _ = encoders.encode([" incomprehensibilities-naïve_straße12345"])
    assert valid.all()
    a, a_ends, b, b_ends = encoders.ends(a, b)
    cuts = [0, 3, 8, 9, 17, 26, 31, int(a_ends[-1])]
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        x, y = ((e > low) & (e <= high) for e in (a_ends, b_ends))
        parts.append(alignment.Fragment.of(a[x], a_ends[x], b[y], b_ends[y]))
    left = alignment.Fragment()
    for p in parts:
        left = left.then(p)
    right = alignment.Fragment()
    for p in reversed(parts):
        right = p.then(right)
    reread = alignment.Fragment.load(right.dump())
    groups, n, pairs = alignment.closed(a, a_ends, b, b_ends)
    for whole in (left, right, reread):
        whole = whole.finished()
        assert (whole.body, whole.n_body, sorted(whole.pairs.tolist())) == (groups, n, sorted(pairs.tolist()))


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
