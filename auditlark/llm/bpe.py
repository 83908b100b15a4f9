"""BPE encoding and decoding by a pair occurrence index.

Texts are normalised (canonical composition, lower case) and cut into words. The
distinct words a partition has not met yet are laid out as one linked list of
symbols, and an index maps each mergeable pair, by its rank, to all its
positions. Active ranks are taken in ascending order; a rank is applied at all
its positions from left to right, and the positions of the pairs that arise on
either side are added to their lists. Words never join, so one pass serves all
of them. Encoded words are kept in a bounded cache of the partition.

Decoding looks every id up in the vocabulary and joins the strings, as a
tokenizer file without a decoder asks for.

The vocabulary is read on the driver from a path that is a parameter (a
tokenizer file of fixed size) and broadcast.

Defined results: a null or empty text gives an empty id list, a null id list
decodes to an empty text; ids outside the vocabulary decode to nothing; a text
of any length is encoded in pieces cut at white space; columns of the input are
kept, one that clashes with the output is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import row_slices, text_buffers, tidy

#: Distinct words of each of the two generations a partition keeps; a full one becomes the older one.
CACHE_WORDS = 150_000
#: Bytes of text encoded at once, and characters of one text scanned at once.
SLICE_BYTES = 1 << 20
PIECE_CHARS = 1 << 19
#: Rows decoded at once.
DECODED_ROWS = 256

_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the word pattern of the vocabulary file.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_CUT = regex.compile(f"[{_SPACE}]")
_SHIFT = 17


def default_path() -> str:
    """The public word vocabulary that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """``tokens`` by id; ``first``: ids of the bytes inside a word, ``last``: at its end.

    ``codes`` (sorted) and ``code_ranks`` give the rank of a pair of ids, ``merged``
    the id that a rank makes; ``special`` maps strings that are cut out of raw text to ids.
    """

    tokens: list[str]
    first: np.ndarray
    last: np.ndarray
    codes: np.ndarray
    code_ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        codes = np.array([(vocab[a] << _SHIFT) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        symbols = byte_symbols()
        return cls(
            tokens, np.array([vocab[s] for s in symbols]), np.array([vocab[s + suffix] for s in symbols]),
            codes[order], order, np.array([vocab[a + b] for a, b in pairs]), special,
        )


class Words:
    """Words by number, and the ids of all of them in one array."""

    def __init__(self, single: dict[str, int]):
        self.number = defaultdict(count().__next__)
        self.ids, self.starts = np.array(list(single.values()), np.int32), np.arange(len(single) + 1)
        self.numbers(iter(single), len(single))

    def numbers(self, words: Iterator[str], n: int) -> np.ndarray:
        """The number of each word; one not met yet gets the next one."""
        return np.fromiter(map(self.number.__getitem__, words), np.int64, n)

    def absent(self) -> list[str]:
        """Words that have no ids yet, by number."""
        return list(islice(reversed(self.number), len(self.number) - len(self.starts) + 1))[::-1]

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, end of each word)."""
        first = self.starts[numbers]
        sizes = self.starts[numbers + 1] - first
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(first - ends + sizes, sizes) + np.arange(sizes.sum())], ends


class Encoder:
    """Encodes texts of one partition."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.ranks = dict(zip(v.codes.tolist(), v.code_ranks.tolist()))
        self.pairs = {r: (c >> _SHIFT, c & ((1 << _SHIFT) - 1)) for c, r in self.ranks.items()}
        self.merged = v.merged.tolist()
        self.known, self.older = Words(v.special), Words({})
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None

    def split(self, text: str) -> Iterator[str]:
        """Words and special tokens of a raw text, in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text[at:m.start()])
            yield m[0]
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Capital sigma is lowered without regard to its place in the word.
            text = unicodedata.normalize("NFC", text).replace("\N{GREEK CAPITAL LETTER SIGMA}", "\N{GREEK SMALL LETTER SIGMA}")
        return _WORD.findall(text.lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        ids, counts, held, n_held = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), [], 0

        def flush():
            self._renew()
            sizes = np.fromiter((len(words) for _, words in held), np.int64, len(held))
            numbers = self.known.numbers(chain.from_iterable(words for _, words in held), int(sizes.sum()))
            self._learn()
            found, ends = self.known.take(numbers)
            ids.append(found)
            of_text = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])
            np.add.at(counts, np.fromiter((row for row, _ in held), np.int64, len(held)), of_text)
            held.clear()

        for row, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > PIECE_CHARS:
                    cut = _CUT.search(text, at + PIECE_CHARS)
                    end = cut.end() if cut else end
                held.append((row, list(self.split(text[at:end]))))
                n_held, at = n_held + end - at, end
                if n_held > PIECE_CHARS:
                    flush()
                    n_held = 0
        flush()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def _renew(self) -> None:
        if len(self.known.number) > CACHE_WORDS:
            # Words still in use come back from the older generation, the rest is forgotten.
            self.older, self.known = self.known, Words(self.vocabulary.special)

    def _learn(self) -> None:
        """The ids of the words that got a number but have none yet."""
        absent = self.known.absent()
        if not absent:
            return
        old = np.fromiter((self.older.number.get(w, -1) for w in absent), np.int64, len(absent))
        ids, ends = self.older.take(old[old >= 0])
        sizes = np.zeros(len(absent), np.int64)
        sizes[old >= 0] = np.diff(ends, prepend=0)
        new = [w for w, i in zip(absent, old.tolist()) if i < 0]
        if new:
            merged, ends = self.merge(new)
            sizes[old < 0] = np.diff(ends, prepend=0)
            both = np.empty(len(ids) + len(merged), np.int32)
            at = np.repeat(old >= 0, sizes)
            both[at], both[~at] = ids, merged
            ids = both
        self.known.add(ids, sizes)

    def merge(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """(ids of all words, end of each word), by the pair occurrence index."""
        v = self.vocabulary
        raw = [w.encode("utf-8") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        final = np.zeros(len(data), bool)
        final[ends - 1] = True
        symbols = np.where(final, v.last[data], v.first[data]).astype(np.int64)
        codes = (symbols[:-1] << _SHIFT) | symbols[1:]
        place = np.minimum(np.searchsorted(v.codes, codes), len(v.codes) - 1)
        known = np.flatnonzero((v.codes[place] == codes) & ~final[:-1])
        ranks = v.code_ranks[place[known]]
        order = np.argsort(ranks, kind="stable")
        ranks, known = ranks[order], known[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        index = {int(ranks[a]): known[a:b].tolist() for a, b in zip([0, *cuts], [*cuts, len(ranks)]) if b > a}
        sym = symbols.tolist()
        after = [-1 if f else i + 1 for i, f in enumerate(final.tolist())]
        before = [-1, *(-1 if f else i for i, f in enumerate(final.tolist()[:-1]))]
        lookup, active = self.ranks.get, list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right = self.pairs[rank]
            new = self.merged[rank]
            for i in sorted(index.pop(rank)):
                j = after[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue  # a merge since then took one of the two
                sym[i], sym[j] = new, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := lookup((new << _SHIFT) | sym[k])) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(active, r)
                        index[r].append(i)
                if (p := before[i]) >= 0 and (r := lookup((sym[p] << _SHIFT) | new)) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(p)
        done = np.array(sym, np.int64)
        kept = np.cumsum(done >= 0)
        return done[done >= 0], kept[ends - 1].tolist()


def _with(docs: DataFrame, out: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    docs = docs.drop(out)
    return docs, T.StructType([*docs.schema.fields, T.StructField(out, kind)])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text, an array of ints."""
    docs, schema = _with(docs, out, T.ArrayType(T.IntegerType(), False))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            column = pc.fill_null(batch.column(text), "")
            _, at = text_buffers(column)
            for a, b in row_slices(at, SLICE_BYTES):
                ids, offsets = encoder.encode(column[a:b].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), lists], [*batch.schema.names, out])

    return docs.mapInArrow(tidy(run), schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list: the tokens' strings, joined by one space."""
    docs, schema = _with(docs, out, T.StringType())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches):
        tokens = pa.array(shared.value)
        for batch in (b.slice(a, DECODED_ROWS) for b in batches for a in range(0, b.num_rows, DECODED_ROWS)):
            lists = batch.column(ids)
            flat, at = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            values = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
            inside = (values >= 0) & (values < len(tokens))
            at = np.concatenate([[0], np.cumsum(inside)])[at]
            strings = tokens.take(pa.array(values[inside].astype(np.int64)))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), strings), " ")
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out])

    return docs.mapInArrow(tidy(run), schema)
